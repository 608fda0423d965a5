"""Near-duplicate groups with HyperMinHash registers.

A document's shingle set fills ``registers`` buckets.  Bucket j keeps the
smallest value of the j-th hash over the set, compressed to its number of
leading zeros and ten mantissa bits (16 bits in all).  Runs of ``rows``
registers form bands; documents that share a band are candidates.  A candidate
pair must pass the collision-corrected Jaccard estimate of its registers (five
standard errors below the threshold), and is then confirmed on the full sets.

Equal sets are one node from the start, so thousands of exact copies cost one
row per copy and no pairs.  In a band bucket every member is first paired with
one centre only; what the confirmed links leave in different components is
paired again: members outside the bucket's largest component against the others,
and in crowded buckets only pairs that an exact bound on shared shingles lets
through (see ``_across_components``).  So a bucket of near copies costs rows in
proportion to its size, no pair across components is lost, and no bucket has a cap.

With the default 28 bands of 4 registers a pair at similarity 0.8 shares no
band with probability (1 - 0.8**4)**28 = 4e-7.

Edge cases: a null, empty or white-space text has an empty set, is linked with
nothing and is kept; a text with fewer words than a shingle is one shingle.
Rows with a null id take part, and a component of only such rows has a null
id and is kept.  Repeated rows give repeated result rows.  An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codesieve.llm import common as C

MANTISSA = 10
FEW = 8
SIGNED = "doc_id long, n_shingles long, node long, regs binary"


def _register_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = C.mixed(np.arange(1, 2 * n + 1, dtype=C.U64) * C.MIX)
    return x[:n] | C.U64(1), x[n:]


def _compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the mantissa bits after the leading one."""
    x, zeros = least.copy(), np.zeros(len(least), C.U64)
    for s in (32, 16, 8, 4, 2, 1):
        small = x < (C.U64(1) << C.U64(64 - s))
        x = np.where(small, x << C.U64(s), x)
        zeros += small.astype(C.U64) * C.U64(s)
    mantissa = (x << C.U64(1)) >> C.U64(64 - MANTISSA)
    return ((np.minimum(zeros, C.U64(63)) << C.U64(MANTISSA)) | mantissa).astype("<u2")


def registers_of(shingles: np.ndarray, n: int) -> np.ndarray:
    mul, add = _register_seeds(n)
    least = np.full(n, np.iinfo(np.uint64).max, C.U64)
    for at in range(0, len(shingles), 2048):
        block = shingles[at:at + 2048]
        h = mul[:, None] * block[None, :]
        h += add[:, None]
        h ^= h >> C.U64(32)
        np.minimum(least, h.min(axis=1), out=least)
    return _compressed(least)


def _collision(n: float, m: float) -> float:
    """Chance that the registers of two disjoint sets agree by accident."""
    lo, hi = 0.5 ** np.arange(1, 65), 0.5 ** np.arange(0, 64)
    level = lambda k: np.exp(k * np.log1p(-lo)) - np.exp(k * np.log1p(-np.minimum(hi, 1 - 1e-16)))
    return float((level(n) * level(m)).sum() / 2 ** MANTISSA)


def signatures(docs: DataFrame, k: int, registers: int) -> DataFrame:
    """(doc_id, n_shingles, node, regs); node is null for an empty set."""
    def run(batches):
        for b in C.frames(batches):
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                s = C.shingle_set(C.ascii_words(t, True), k)
                rows.append((i, len(s), C.digest64(s.tobytes()) if len(s) else None,
                             registers_of(s, registers).tobytes() if len(s) else None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "node", "regs"], dtype=object)  # else nulls make floats
            yield out.astype({"doc_id": "Int64", "n_shingles": "int64", "node": "Int64"})

    return docs.mapInPandas(run, SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles array<long>), the full set of each given document."""
    def run(batches):
        for b in C.frames(batches):
            sets = [C.shingle_set(C.ascii_words(t, True), k) for t in b["text"]]
            yield pd.DataFrame({"node": [C.digest64(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(run, "node long, shingles array<long>")


def _estimate(registers: int):
    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = np.empty(len(a))
        for i, (x, y, p, q) in enumerate(zip(a, b, n, m, strict=True)):
            same = np.count_nonzero(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")) / registers
            c = _collision(p, q)
            out[i] = (same - c) / (1 - c)
        return pd.Series(out)

    return estimate


def _across_components(part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket that lie in different components and may still
    be similar enough.  ``part``: (bucket, node, n, root).

    With few members outside the bucket's largest component (``FEW``), those
    against all members.  The crowded buckets of one largest component form a
    group, and its pairs must share a rare shingle: with the shingles of every member
    ordered by the group's counts, rarest first, the first one that two members share
    stands at places ``p`` and ``q``, so they share at most the smaller of n - p and m - q.
    Only pairs whose bound reaches the threshold are emitted; those that cannot
    reach it never meet.  No pair that can reach it is lost.
    """
    enough = lambda both: f"{100 + percent} * ({both}) >= {percent} * (l.n + r.n)"
    sizes = part.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("c", "root")).alias("main"),
                                        (F.sum("c") - F.max("c")).alias("others")).where("parts > 1")
    rest = C.cut(part.join(split, "bucket"))
    pair = F.col("l.node").alias("a"), F.col("r.node").alias("b")

    few = rest.where(F.col("others") <= FEW)
    direct = few.where("root <> main").alias("l").join(few.alias("r"), "bucket") \
        .where("l.root <> r.root and " + enough("least(l.n, r.n)")).select(*pair)

    group = C.cut(rest.where(F.col("others") > FEW).select("main", "node", "n", "root").distinct())
    listed = group.join(sets.select("node", "shingles"), "node").select("main", "node", "n", "root", F.explode("shingles").alias("s"))
    held = listed.groupBy("main", "s").agg(F.count("*").alias("df"))
    rarest = W.partitionBy("main", "node").orderBy("df", "s")
    listed = listed.join(held, ["main", "s"]).withColumn("at", F.row_number().over(rarest) - 1)
    ahead = C.cut(listed.where(f"df > 1 and 100 * (n - at) >= {percent} * n").select("main", "s", "node", "n", "root", "at"))
    shared = ahead.where("root <> main").alias("l").join(ahead.alias("r"), ["main", "s"]) \
        .where("l.root <> r.root and " + enough("least(l.n - l.at, r.n - r.at)")).select(*pair)
    return direct.union(shared)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 28, rows: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document; documents are
    linked if 100 * intersection >= percent * union of their shingle sets."""
    docs, registers = C.texts(docs, id_col, text_col), bands * rows
    sig = C.cut(signatures(docs, shingle_words, registers))
    nodes = C.cut(sig.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").cast("int").alias("n"), F.first("regs").alias("regs")))

    width = 2 * rows
    keyed = nodes.select("node", "n", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("regs", b * width + 1, width)) for b in range(bands)])).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = C.cut(keyed.join(shared, "bucket"))
    # A bucket's centre: of its members the one that meets most others over all its buckets.
    met = members.groupBy("node").agg(F.sum("c").alias("met"))
    centres = members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("centre"))

    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / registers) ** 0.5

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are links: by size, then by the registers' estimate, then by the full sets."""
        side = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in ("n", "regs", "shingles")])
        return (pairs.join(side("a"), "a").join(side("b"), "b")
                .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
                .where(_estimate(registers)("regsa", "regsb", "na", "nb") >= least)
                .withColumn("both", F.size(F.array_intersect("shinglesa", "shinglesb")))
                .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
                .select("a", "b"))

    # The full set of every document that shares a bucket, read from the texts once.
    wanted = members.select("node").distinct()
    ids = nodes.join(wanted, "node", "left_semi").select("first_id").distinct()
    known = _sets(docs.join(ids, docs["doc_id"].eqNullSafe(ids["first_id"]), "left_semi"), shingle_words)
    sets = C.cut(known.dropDuplicates(["node"]).join(nodes.join(wanted, "node", "left_semi").drop("first_id"), "node"))

    stars = members.join(centres, "bucket").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    first = C.cut(ordered(stars))
    links = C.cut(confirmed(first, sets))
    comp = components_of(links)

    part = C.cut(members.join(comp, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")))
    cross = _across_components(part, sets, percent)
    second = C.cut(ordered(cross).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        links = links.union(confirmed(second, sets))
        comp = components_of(links)

    roots = nodes.select("node", "first_id").join(comp, "node", "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root"))
    least_id = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = roots.join(least_id, "root").select("node", "component_id")
    out = sig.select("doc_id", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def components_of(links: DataFrame) -> DataFrame:
    return C.cut(C.components(links))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group left: the row
    with the smallest id (of rows repeating that id, all)."""
    out = near_duplicates(docs, shingle_words, percent).where("kept").select("doc_id").distinct()
    named = out.withColumnRenamed("doc_id", "_kept_id")
    return docs.join(named, docs["doc_id"].eqNullSafe(named["_kept_id"]), "left_semi")

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codesieve.session import ensure_checkpoint_dir

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)


#: Spark's option (4.1) that removes the shuffle files of an action when it ends; a frame takes it up when it is made.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RELEASING = threading.Lock()


def releasing(df: DataFrame) -> DataFrame:
    """``df`` for one action: the shuffle files behind it go when that ends, not
    when the driver next collects its garbage.  Other frames keep theirs."""
    conf = df.sparkSession.conf
    with _RELEASING:
        usual = conf.get(RELEASE, "false")
        conf.set(RELEASE, "true")
        try:
            return df.select("*")
        finally:
            conf.set(RELEASE, usual)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return releasing(df).checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path of ``scratch`` from the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: whatever
    else ``docs`` carries cannot clash with the operator's own columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bind(value: Column, body) -> Column:
    """``body(v)`` where ``v`` is ``value`` computed once for the row (a
    lambda variable, which Catalyst does not expand in place)."""
    return F.transform(F.array(value), body)[0]


def ascii_words(text: str | None, lower: bool) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes, A-Z lower-cased if asked.
    ``bytes.split`` and ``bytes.lower`` know exactly these ASCII characters."""
    if not text:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    if not words:
        return np.empty(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes, built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    b, out, done, power, size = U64(base | 1), None, 0, h, 1
    bp, rest = b, k  # bp = base ** size
    while rest:
        if rest & 1:
            tail = power[done:done + n]
            out = tail.copy() if out is None else out * bp + tail
            done += size
        rest >>= 1
        if rest:
            m = len(power) - size
            power = power[:m] * bp + power[size:size + m]
            with np.errstate(over="ignore"):
                bp = bp * bp
            size *= 2
    return mixed(out)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter sequence
    is one shingle; no words, no shingles."""
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    if len(h) < k:
        return mixed(window_hashes(h, len(h)) + U64(len(h)) * MIX)
    return np.unique(window_hashes(h, k))


def digest64(data: bytes) -> int:
    """64 bits of a cryptographic hash, as a signed long."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as (node, root), root
    the smallest node of the component; nodes without edges do not appear.

    Large-star and small-star steps alternate until every edge points at its
    root; each step is a grouped minimum and a join, and its result is written
    to the shared checkpoint folder.  Nothing but two sums reaches the driver.
    """
    big = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    def sums(df):
        return tuple(releasing(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))).collect()[0])

    now = cut(edges.where("a <> b").select(*big).distinct())
    seen, settled = sums(now), False
    while not settled:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = now.join(low, "b").select("a", F.col("m").alias("b"))  # an edge's larger end to the smallest its smaller end knows
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = sums(now)
        settled, seen = after == seen, after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def numbered(rows: DataFrame, group: list[str], place: str, order: list[str], name: str, salts: int = 1024) -> DataFrame:
    """``rows`` with their number within ``group`` (from 0, no gaps) as ``name``.

    The order is by salt of the hash ``place`` and, within a salt, by ``order``: a
    group that holds a third of all rows is numbered by many tasks.
    """
    rows = rows.withColumn("_salt", F.pmod(F.col(place), F.lit(salts)))
    counts = rows.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order))
    return (rows.withColumn("_own", own).join(counts, [*group, "_salt"])
            .withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before"))


#: What a reused Python worker keeps for the next tasks of the same pass.
RESIDENT: dict = {}


def frames(batches: Iterable[pd.DataFrame], keep: object = None) -> Iterable[pd.DataFrame]:
    """The non-empty batches of a ``mapInPandas`` input.  What passes before this one
    have left in ``RESIDENT`` is let go, but for ``keep``."""
    for key in [k for k, v in RESIDENT.items() if v is not keep]:
        del RESIDENT[key]
    return (b for b in batches if len(b))

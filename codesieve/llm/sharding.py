"""Shards of near-equal bytes by a k-d tree over document metadata.

The points are groups of equal texts: size in bytes, language and source (the
smallest of the group's), each as an integer coordinate (a text by its rank among the distinct
values, spread over ``SPREAD``); the weight is the group's bytes.  A node that must give ``n`` shards is split at the weighted
quantile ``(n // 2) / n`` (the median for an even ``n``) along its widest
dimension, until a leaf is one shard of the target bytes.

Quantiles are found from distributed histograms: one grouped sum per pass, whose
result (at most ``BINS`` rows per open node) is all that reaches the driver;
the bin holding the quantile is refined until the cut is within ``tolerance`` of
a shard.  Within equal coordinates rows are ordered by text hash, then by id
hash, so equal texts stay together unless a cut must run through a group.

Law: ``bytes``.  Edge cases: a null text weighs one byte, as an empty one does;
null metadata comes first; repeated rows are placed one by one (identical ids
in one place); with no rows there is nothing to place; with fewer rows than
shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codesieve.llm import common as C

BINS = 1 << 14
TIE_BITS = 30
SPREAD = 1 << 28  # of the coordinates of texts
FEW = 100_000
HOT = 200
DIMENSIONS = ("size", "lang", "source")


def _points(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, tie, place, d0 ..): one narrow row per document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    known = [c for c in dims if c != "size" and c in docs.columns]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(text).alias("fp"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"m{i}") for i, c in enumerate(known)])
    if known:
        rows = _with_group_values(C.cut(rows), len(known))
        for i in range(len(known)):
            rows = _with_rank(rows, f"g{i}", f"r{i}")
    coords = [F.col("size")] if "size" in dims else []
    coords += [F.col(f"r{i}") for i in range(len(known))]
    return rows.select(
        "doc_id", "size", "text_crc32", F.shiftrightunsigned(F.xxhash64("fp"), 64 - TIE_BITS).alias("tie"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 2).alias("place"),
        *[c.alias(f"d{i}") for i, c in enumerate(coords)])


def _with_group_values(rows: DataFrame, n: int) -> DataFrame:
    """A group's own metadata is its smallest, so copies from several sources share one point.  Groups of more than one in
    ``HOT`` of all rows (fewer than ``HOT``) are joined by broadcast, where their rows lie."""
    least = C.cut(rows.groupBy("fp", "size").agg(F.count("*").alias("c"), *[F.min(f"m{i}").alias(f"g{i}") for i in range(n)]))
    total = least.agg(F.sum("c")).first()[0] or 0
    hot, cold = (least.where(x).drop("c") for x in (F.col("c") * HOT > total, F.col("c") * HOT <= total))
    few = rows.join(F.broadcast(hot), ["fp", "size"])
    return few.unionByName(rows.join(F.broadcast(hot.select("fp", "size")), ["fp", "size"], "left_anti").join(cold, ["fp", "size"]))


def _with_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the rank of ``value`` among its distinct values, from 0 up to ``SPREAD``, as ``name``.  The values are
    ranged, numbered in each range and offset by what came before; a table of at most ``FEW`` values is broadcast."""
    ranged = rows.select(F.col(value).alias("v")).distinct().repartitionByRange(C.shuffle_width(rows.sparkSession), "v")
    part = F.spark_partition_id()
    own = C.cut(ranged.withColumn("part", part))
    counts = sorted((r.part, r["count"]) for r in own.groupBy("part").count().collect())  # a row per range
    total, before, at = sum(n for _, n in counts), [F.lit(-1), F.lit(0)], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(at)]
        at += n
    place = (F.row_number().over(W.partitionBy("part").orderBy("v")) - 1 + F.element_at(F.create_map(*before), F.col("part"))).cast("long")
    ranks = own.select("v", F.floor(place * F.lit(SPREAD) / F.lit(max(total, 1))).cast("long").alias(name))
    return rows.join(F.broadcast(ranks) if total <= FEW else ranks, F.col(value) == F.col("v")).drop("v")


class _Node:
    """Rows under ``inside`` give the shards ``first`` up to ``first + n``."""

    def __init__(self, first: int, n: int, inside: Column):
        self.first, self.n, self.inside = first, n, inside


class _Search:
    """The search for one node's cut: rows in ``scope`` with a key from ``lo``
    to ``hi`` are open; those under ``under`` weigh ``left`` and are left of the cut."""

    def __init__(self, node: _Node, key: Column, lo: int, hi: int, total: int, tolerance: float):
        self.key, self.lo, self.hi, self.scope = key, lo, hi, node.inside
        self.under, self.left, self.by_id, self.cut = F.lit(False), 0, False, None
        self.aim, self.slack = total * (node.n // 2) / node.n, total / node.n * tolerance

    @property
    def shift(self) -> int:
        return max(0, ((self.hi - self.lo) // BINS).bit_length())

    def histogram(self) -> tuple[Column, Column]:
        return self.scope & self.key.between(self.lo, self.hi), F.shiftrightunsigned(self.key - self.lo, self.shift)

    def step(self, bins: list[tuple[int, int]]) -> None:
        """Settle on a bin's edge, or narrow the search to the bin."""
        sums = self.left + np.cumsum([b for _, b in bins])
        j = min(int(np.searchsorted(sums, self.aim)), len(bins) - 1)
        start = self.lo + (bins[j][0] << self.shift)
        end, below, above = start + (1 << self.shift) - 1, int(sums[j - 1]) if j else self.left, int(sums[j])
        last = self.shift == 0 and self.by_id
        near_below = self.aim - below <= above - self.aim
        if self.aim - below <= self.slack or (last and near_below):
            self.cut = self.under | (self.scope & (self.key < start))
        elif above - self.aim <= self.slack or last:
            self.cut = self.under | (self.scope & (self.key <= end))
        elif self.shift:
            self.lo, self.hi, self.left = start, end, below
        else:  # one group of equal texts is too heavy to stay whole: go on within it by id
            self.under, self.scope, self.left = self.under | (self.scope & (self.key < start)), self.scope & (self.key == start), below
            self.key, self.lo, self.hi, self.by_id = F.col("place"), 0, (1 << 62) - 1, True


def _cuts(points: DataFrame, nodes: list[_Node], dims: int, tolerance: float) -> list[Column]:
    """Per node the condition of its left part."""
    which = F.lit(None).cast("int")
    for k, node in enumerate(nodes):
        which = F.when(node.inside, k).otherwise(which)
    stats = {r.node: r for r in points.groupBy(which.alias("node")).agg(
        F.sum("size").alias("bytes"), *[F.min(f"d{i}").alias(f"lo{i}") for i in range(dims)],
        *[F.max(f"d{i}").alias(f"hi{i}") for i in range(dims)]).where("node is not null").collect()}
    whole = [max([1, *(r[f"hi{i}"] - r[f"lo{i}"] for r in stats.values())]) for i in range(dims)]
    searches: dict[int, _Search] = {}
    for k, r in stats.items():
        d = max(range(dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
        searches[k] = _Search(nodes[k], F.col(f"d{d}") * (1 << TIE_BITS) + F.col("tie"),
                              r[f"lo{d}"] << TIE_BITS, ((r[f"hi{d}"] + 1) << TIE_BITS) - 1, r.bytes, tolerance)
    while still := [k for k in searches if searches[k].cut is None]:
        which, at = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k in still:
            scope, where = searches[k].histogram()
            which, at = F.when(scope, k).otherwise(which), F.when(scope, where).otherwise(at)
        rows = points.select(which.alias("node"), at.alias("at"), "size").where("node is not null") \
            .groupBy("node", "at").agg(F.sum("size").alias("bytes")).collect()
        for k in still:
            searches[k].step(sorted((r["at"], r["bytes"]) for r in rows if r["node"] == k))
    return [searches[k].cut if k in searches else F.lit(False) for k in range(len(nodes))]


def shard_documents(docs: DataFrame, n_shards: int | None = 8, target_bytes: int | None = None,
                    dims: tuple[str, ...] = DIMENSIONS, tolerance: float = 0.002,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row: ``n_shards`` shards, or
    as many as give each at most about ``target_bytes`` (then pass ``n_shards=None``)."""
    points = C.cut(_points(docs, dims, id_col, text_col))
    n_dims = sum(c.startswith("d") and c[1:].isdigit() for c in points.columns)
    if n_shards is None:
        if not target_bytes:
            raise ValueError("n_shards or target_bytes")
        n_shards = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    leaves, level = [], [_Node(0, n_shards, F.lit(True))]
    while level:
        leaves += [x for x in level if x.n == 1]
        level = [x for x in level if x.n > 1]
        below = []
        for node, left in zip(level, _cuts(points, level, n_dims, tolerance) if level else [], strict=True):
            half = node.n // 2
            below += [_Node(node.first, half, node.inside & left), _Node(node.first + half, node.n - half, node.inside & ~left)]
        level = below
    shard = F.lit(None).cast("int")
    for leaf in leaves:
        shard = F.when(leaf.inside, leaf.first).otherwise(shard)
    placed = points.select("doc_id", "size", "text_crc32", "place", shard.alias("shard"))
    return C.numbered(placed, ["shard"], "place", ["place", "doc_id", "text_crc32", "size"], "slot", 4096).drop("place")


def write_shards(docs: DataFrame, placement: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, ordered by slot (ids must be distinct)."""
    placed = placement.select(F.col("doc_id").alias("_placed"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(placed, docs[id_col].eqNullSafe(placed["_placed"])).drop("_placed")
    width = C.shuffle_width(docs.sparkSession)
    rows.repartitionByRange(width, "_shard", "_slot").sortWithinPartitions("_shard", "_slot") \
        .write.partitionBy("_shard").parquet(path)

"""Nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on at most ``sample`` vectors (those with the smallest id
hash; more, up to ``max_sample``, where so many leaves ask for it): each node is split by k-means into ``branch`` children until a node
stands for at most ``leaf_rows`` vectors of the table, so that leaves grow in number, not in size, with the table (up to
some ``max_sample / LEAF_SAMPLE`` leaves; beyond, in size).  Every vector is indexed in the leaf that
the nearest centres lead to.  A query walks the tree best bin first: a priority queue
holds the open nodes by the inner product with their centres, and leaves come out
in the order in which they will be searched.

How many leaves are visited is calibrated: for a bounded set of ``probes``
queries the exact neighbours among all vectors are found in blocks, and the number
of leaves is widened until ``recall`` of them lie in visited leaves (all leaves, if
need be, which is exact).  A query whose visited leaves hold fewer than ``k`` other
rows goes on down its queue until they do.

Leaves are cut into blocks of about ``block_rows`` vectors
by id hash (so a leaf of a third of all rows, say copies of one vector, is many
blocks), and queries of neighbouring leaves make chunks of about ``chunk_rows``, which visit
much the same blocks.  A block is sent only to the chunks that visit it.  What a chunk visits is dealt by id hash to
a few spans: as many as keep all tasks busy, and one for each ``SPAN_ROWS`` vectors of the table.  A task holds the
queries of one chunk, streams the vectors of one span in order of their leaves, multiplies each leaf with the queries that
visit it and keeps the best ``k`` per query; a second step keeps the best of the spans.  So a query
goes into the search, and ``k`` rows come out of it, once a span, however many leaves and blocks it
visits.  The inner products themselves are as many as rows visited: where neighbours lie in no clusters (random vectors of
many dimensions), that is a share of the table, and copies of blocks grow as vectors x queries / ``chunk_rows``.
Scores are inner products of the original
vectors in double precision, ties go to the smaller id.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite
components take no part; nor do null ids.  Vectors of each length are searched among
their own kind, with a tree of their own (an id with several lengths is asked in each).  Rows repeating an id are all candidates, and none of them for its own id;
of a repeated query id the smallest vector (as an array) is asked.
Fewer than ``k`` candidates give them all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C


LEAF_SAMPLE = 16  # sampled vectors a leaf
SPAN_ROWS = 1 << 20  # vectors of the table that one task may stream past a chunk of queries
PRODUCTS = 1 << 20  # scores in memory at once


class Tree:
    """Centres per node; ``kids[node]`` lists children, leaves have a number."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_rows: int, seed: int = 10):
        self.centres, self.kids, self.leaf_of = [], [], []
        rng, self.leaves = np.random.default_rng(seed), 0
        self._grow(sample, sample.mean(axis=0), branch, leaf_rows, rng)

    def _grow(self, rows: np.ndarray, centre: np.ndarray, branch: int, leaf_rows: int, rng) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.kids.append([])
        self.leaf_of.append(-1)
        parts = []
        if len(rows) > leaf_rows:
            centres, own = _k_means(rows, branch, rng)
            parts = [(centres[j], rows[own == j]) for j in range(len(centres)) if (own == j).any()]
        if len(parts) < 2:
            self.leaf_of[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.kids[node] = [self._grow(part, c, branch, leaf_rows, rng) for c, part in parts]
        return node

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by nearest centre at each level."""
        out, open_ = np.empty(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while open_:
            node, own = open_.pop()
            if not self.kids[node]:
                out[own] = self.leaf_of[node]
            else:
                centres = np.stack([self.centres[c] for c in self.kids[node]])
                near = _nearest(rows[own], centres)
                open_ += [(c, own[near == j]) for j, c in enumerate(self.kids[node]) if (near == j).any()]
        return out

    def visits(self, query: np.ndarray, n: int, sizes: list[int] | None = None, least: int = 0) -> list[int]:
        """The first ``n`` leaves for one query, best bin first, and more until
        they hold ``least`` rows by their ``sizes``."""
        out, queue, held = [], [(0.0, 0)], 0
        while queue and (len(out) < n or held < least):
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                out.append(self.leaf_of[node])
                held += sizes[out[-1]] if sizes else 0
            else:
                near = np.stack([self.centres[c] for c in self.kids[node]]) @ query
                for c, s in zip(self.kids[node], near.tolist(), strict=True):
                    heapq.heappush(queue, (-s, c))
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)


def _k_means(rows: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = _nearest(rows, centres)
        centres = np.stack([rows[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres, _nearest(rows, centres)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>, place, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    return rows.withColumns({"place": F.xxhash64("vec_id", F.lit(10)), "dim": F.size("v")})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order
    whatever the block's shape, so that equal vectors tie exactly."""
    return np.einsum("qd,rd->qr", queries, rows, optimize=False)


class _Best:
    """The best ``k`` found so far of each of one chunk's queries."""

    def __init__(self, asks: np.ndarray, queries: np.ndarray, leaves: list[np.ndarray], k: int):
        self.asks, self.queries, self.k = asks, queries, k
        of, by = np.concatenate(leaves), np.repeat(np.arange(len(asks)), [len(x) for x in leaves])
        order = np.argsort(of, kind="stable")
        found, first = np.unique(of[order], return_index=True)
        self.visitors = dict(zip(found.tolist(), np.split(by[order], first[1:]), strict=True))  # leaf: its queries' places
        self.floor = np.full(len(asks), -np.inf)  # what the next must reach
        self.kept, self.more, self.n_more = self._none(), [], 0

    @staticmethod
    def _none() -> tuple[np.ndarray, ...]:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, leaf: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors of one leaf, to the queries that visit it."""
        visitors = self.visitors.get(leaf, np.empty(0, np.int64))
        step = max(1, PRODUCTS // len(ids))
        for at in range(0, len(visitors), step):
            own = visitors[at:at + step]
            s = _scores(self.queries[own], vectors)
            s[self.asks[own, None] == ids[None, :]] = -np.inf
            least = self.floor[own]
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            q, r = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            self.more.append((own[q], s[q, r], ids[r], np.full(len(r), leaf)))
            self.n_more += len(r)
            if self.n_more > PRODUCTS:
                self.settle()

    def settle(self) -> None:
        q, s, ids, leaf = map(np.concatenate, zip(self.kept, *self.more, strict=True))
        order = np.lexsort((ids, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.floor[q[place == self.k - 1]] = s[order][place[place < self.k] == self.k - 1]
        self.kept, self.more, self.n_more = (q[place < self.k], s[order], ids[order], leaf[order]), [], 0

    def found(self) -> pd.DataFrame:
        self.settle()
        q, s, ids, leaf = self.kept
        return pd.DataFrame({"query_id": self.asks[q], "vec_id": ids, "score": s, "leaf": leaf})


def _search(indexed: DataFrame, asked: DataFrame, blocks_of: list[list[int]], chunks: int, spans: int, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the best ``k`` per query and span.
    ``asked`` has query_id, q, chunk and the leaves to visit; a block goes to the chunks that ask it."""
    asked = C.cut(asked)

    def blocks(batches):
        for b in C.frames(batches):
            for chunk, own in b.groupby("chunk"):
                visited = np.unique(np.concatenate(own["leaves"].to_list()))
                yield pd.DataFrame({"by_chunk": chunk, "in_block": sorted({y for x in visited.tolist() for y in blocks_of[x]})})

    pairs = asked.select("chunk", "leaves").mapInPandas(blocks, "by_chunk int, in_block int").distinct()
    task = lambda chunk, span: (F.col(chunk) * spans + span).cast("int").alias("task")
    right = indexed.join(pairs, F.col("block") == F.col("in_block")).select(
        task("by_chunk", F.pmod("place", F.lit(spans))), "leaf", F.col("vec_id").alias("id"), "v", F.lit(None).cast("array<long>").alias("leaves"))
    left = asked.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).select(
        task("chunk", F.col("span")), F.lit(-1).cast("long").alias("leaf"), F.col("query_id").alias("id"), F.col("q").alias("v"), "leaves")

    def run(batches):
        now, asks, best = None, [], None
        for b in C.frames(batches):
            for number, part in b.groupby("task"):
                if number != now:  # queries come first
                    if best:
                        yield best.found()
                    now, asks, best = number, [], None
                is_query = part["leaf"] < 0
                if is_query.any():
                    asks.append(part[is_query])
                rows = part[~is_query]
                if len(rows) and asks:
                    if not best:
                        q = pd.concat(asks)
                        best = _Best(q["id"].to_numpy(), _matrix(q["v"]), q["leaves"].to_list(), k)
                    for leaf, own in rows.groupby("leaf"):
                        ids, vectors = own["id"].to_numpy(), _matrix(own["v"])
                        for at in range(0, len(ids), block_rows):
                            best.offer(leaf, ids[at:at + block_rows], vectors[at:at + block_rows])
        if best:
            yield best.found()

    return left.union(right).repartitionById(chunks * spans, "task").sortWithinPartitions("task", "leaf").mapInPandas(
        run, "query_id long, vec_id long, score double, leaf long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query: a query's rows are at most ``k`` per span."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "leaf"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"), "b.leaf")


def _packed(counts: list[int], size: int) -> tuple[list[int], list[int]]:
    """For each leaf the first of its parts and their number: neighbouring light leaves share a part of
    about ``size`` rows, a heavy leaf has several."""
    first, parts, at, fill = [], [], 0, 0
    for m in counts:
        if fill and fill + m > size:
            at, fill = at + 1, 0
        first.append(at)
        parts.append(-(-max(m, 1) // size))
        fill += m
        if parts[-1] > 1:
            at, fill = at + parts[-1], 0
    return first, parts


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, branch: int = 8, sample: int = 20_000, max_sample: int = 200_000,
            leaf_rows: int = 512, probes: int = 200, recall: float = 0.96, block_rows: int = 2048, chunk_rows: int = 2048,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query;
    ``is_query`` is a condition on column ``vec_id``."""
    spark = vectors.sparkSession
    rows, out = C.cut(usable(vectors, id_col, vector_col)), None
    for r in rows.groupBy("dim").count().where("count > 1").orderBy("dim").collect():  # a row per length
        found = _nearest_alike(rows.where(F.col("dim") == r.dim).drop("dim"), r["count"], is_query, k, branch, sample, max_sample, leaf_rows, probes, recall,
                               block_rows, chunk_rows)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_alike(rows: DataFrame, n: int, is_query: Column, k: int, branch: int, sample: int, max_sample: int, leaf_rows: int, probes: int,
                   recall: float, block_rows: int, chunk_rows: int) -> DataFrame:
    """``nearest`` among the ``n`` vectors of one length."""
    spark = rows.sparkSession
    size = min(max_sample, max(sample, LEAF_SAMPLE * n // leaf_rows))
    fit = _matrix(rows.orderBy("place", "vec_id", "v").limit(size).select("v").toPandas()["v"])
    tree = Tree(fit, branch, max(4, len(fit) * leaf_rows // n))
    held = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in C.frames(batches):
            b["leaf"] = held.value.leaf(_matrix(b["v"]))
            yield b

    indexed = C.cut(rows.mapInPandas(index, "vec_id long, v array<double>, place long, leaf long"))
    counts = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf
    sizes = [counts.get(x, 0) for x in range(tree.leaves)]
    first, parts = _packed(sizes, block_rows)
    array = lambda x: F.array(*map(F.lit, x))

    def part_of(first: list[int], parts: list[int], place: Column) -> Column:
        leaf = F.col("leaf").cast("int")
        return F.get(array(first), leaf) + F.pmod(place, F.get(array(parts), leaf)).cast("int")

    indexed = indexed.withColumn("block", part_of(first, parts, F.col("place")))
    blocks_of = [list(range(f, f + p)) for f, p in zip(first, parts, strict=True)]

    queries = C.cut(indexed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min(F.struct("v", "leaf")).alias("least"), F.count("*").alias("own")).select("query_id", "least.leaf", F.col("least.v").alias("q"), "own"))
    asking = {r.leaf: r.n for r in queries.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf
    chunks = _packed([asking.get(x, 0) for x in range(tree.leaves)], chunk_rows)
    queries = queries.withColumn("chunk", part_of(*chunks, F.xxhash64("query_id")))

    def best(own: DataFrame, visits: int, chunks: int) -> DataFrame:
        def run(batches):
            for b in C.frames(batches):
                b["leaves"] = [held.value.visits(np.asarray(q), visits, sizes, k + m) for q, m in zip(b["q"], b["own"], strict=True)]
                yield b[["query_id", "q", "chunk", "leaves"]]

        spans = min(-(-n // block_rows), max(-(-C.shuffle_width(spark) // chunks), -(-n // SPAN_ROWS)))
        asked = own.mapInPandas(run, "query_id long, q array<double>, chunk int, leaves array<long>")
        return _top(_search(indexed, asked, blocks_of, chunks, spans, k, block_rows), k)

    # Calibration: in how many leaves, best bin first, do the exact neighbours of the probes lie?
    probe = C.cut(queries.orderBy(F.xxhash64("query_id", F.lit(3))).limit(probes))
    exact = best(probe.withColumn("chunk", F.lit(0)), tree.leaves, 1).select("query_id", "leaf").collect()
    order = {r.query_id: {x: j for j, x in enumerate(tree.visits(np.array(r.q), tree.leaves))} for r in probe.collect()}
    depth = np.sort([order[r.query_id][r.leaf] + 1 for r in exact])
    visits = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) if len(depth) else 1

    return best(queries, visits, max(map(sum, zip(*chunks, strict=True)))).drop("leaf")

"""Ops 42 and 43: per-key fixed-window rate limit.

Rule: a key's window starts at its first request and ends at
``reset_at = first + window``; a new one starts only when ``ts > reset_at``
(strict); inside a window the first ``limit`` requests pass and denied ones
do not count.  Window starts depend only on the timestamps, so per key the
work is a greedy chain over sorted times: numpy ``searchsorted`` jumps from
window to window instead of stepping row by row.

Batch: the events are ranged by (key, time, id), so that a key of any size
spreads over many tasks.  A key that goes on in a later range needs the state (end
of the open window, its count, windows so far) at the start of that range.  What a range
does to a state depends only on the first event after the open window's end: a
range's *map* lists, for each of its events that may be that first one (those within one
window of the range's start), the state that the chain from there leaves.  Maps compose: ``FAN``
neighbouring ranges of a key are composed in parallel, one task a key runs through the composed maps, and
the states at the group starts run through the ranges again, in parallel.  Then every range is
replayed from its state.  Only keys at a range's border have maps, at most two a range; the
driver holds one state a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.session import ensure_checkpoint_dir

_NO_KEY = object()
NOTHING = int(np.iinfo(np.int64).min)  # the end of a window when none is open
FAN = 64
OUT_SCHEMA = "event_id bigint, key string, allowed boolean, window_count bigint, window_no bigint"


def chain(ts: np.ndarray, window_ns: int, limit: int, reset: int | None, count: int, win: int):
    """Decide one key's sorted requests given the carried state.
    Returns (allowed, window_count, window_no, reset, count, win)."""
    n = len(ts)
    allowed = np.empty(n, dtype=bool)
    wcount = np.empty(n, dtype=np.int64)
    wno = np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        if reset is None or ts[i] > reset:
            reset, count, win = int(ts[i]) + window_ns, 0, win + 1
        j = int(np.searchsorted(ts, reset, side="right"))
        ranks = count + np.arange(1, j - i + 1, dtype=np.int64)
        allowed[i:j] = ranks <= limit
        wcount[i:j] = np.minimum(ranks, limit)
        wno[i:j] = win
        count = min(count + (j - i), limit)
        i = j
    return allowed, wcount, wno, reset, count, win


MAP = "k string, part int, n bigint, ts binary, reset binary, count binary, wins binary"
STATE = "k string, part int, reset bigint, count bigint, win bigint"


def transition(ts: np.ndarray, window_ns: int, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The map of one key's sorted times: (events, times that may be first, and the reset, count and
    windows opened that the chain from each leaves).  The chains are followed by pointer doubling."""
    n = len(ts)
    jump, last, wins = np.searchsorted(ts, ts + window_ns, side="right"), np.arange(n), np.ones(n, np.int64)
    while (on := np.flatnonzero(jump < n)).size:
        to = jump[on]
        last[on], wins[on], jump[on] = last[to], wins[on] + wins[to], jump[to]
    m = min(n, int(np.searchsorted(ts, ts[0] + window_ns, side="right")) + 1)
    return n, ts[:m], (ts[last] + window_ns)[:m], np.minimum(limit, n - last)[:m], wins[:m]


def moved(state, own, limit: int):
    """States (reset, count, win; arrays) after a range with the map ``own``."""
    (reset, count, win), (n, ts, after, counts, wins) = state, own
    at = np.searchsorted(ts, reset, side="right")
    none = at >= len(ts)  # no event after the open window's end: all events are in it
    at = np.minimum(at, len(ts) - 1)
    return (np.where(none, reset, after[at]), np.where(none, np.minimum(limit, count + n), counts[at]), np.where(none, win, win + wins[at]))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, tuple]]:
    for b in batches:
        for r in b.to_dict("records"):
            yield r, (int(r["n"]), *(np.frombuffer(r[x], np.int64) for x in ("ts", "reset", "count", "wins")))


def _composed(limit: int, window_ns: int):
    """Maps of neighbouring ranges (sorted by key, group and part) -> one map a group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None

        def closed():
            columns = [np.concatenate(x).tobytes() for x in zip(*held["pieces"], strict=True)]
            return pd.DataFrame([(now[0], now[1], held["n"], *columns)], columns=["k", "part", "n", "ts", "reset", "count", "wins"])

        for r, own in _rows(batches):
            if (r["k"], r["g"]) != now:
                if held:
                    yield closed()
                now, held = (r["k"], r["g"]), {"n": 0, "pieces": [], "first": own[1][0]}
            held["pieces"] = [(p[0], *moved(p[1:], own, limit)) for p in held["pieces"]]
            own_ = slice(0, int(np.searchsorted(own[1], held["first"] + window_ns, side="right")) + 1)
            held["pieces"].append(tuple(x[own_] for x in own[1:]))
            held["n"] += own[0]
        if held:
            yield closed()

    return run


def _states(limit: int):
    """Maps sorted by key and part (with the key's first state, if any) -> the state before each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = _NO_KEY, None
        for r, own in _rows(batches):
            if (r["k"], r["g"]) != now:
                now = r["k"], r["g"]
                state = tuple(np.array([int(r[x])]) for x in ("reset0", "count0", "win0"))
            yield pd.DataFrame([(r["k"], r["part"], *(int(x[0]) for x in state))], columns=["k", "part", "reset", "count", "win"])
            state = moved(state, own, limit)

    return run


def _times(column: pd.Series) -> np.ndarray:
    """Nanoseconds; a null time is the earliest but one (the earliest stands for no open window)."""
    return np.maximum(column.to_numpy().astype("datetime64[ns]").astype(np.int64), NOTHING + 1)


def _cuts(b: pd.DataFrame) -> Iterator[tuple[object, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    keys = b["k"].to_numpy(dtype=object)
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True):
        yield keys[s], int(s), int(e)


def _border_maps(limit: int, window_ns: int):
    """The maps of a range's first and last key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, held, first = TaskContext.get().partitionId(), _NO_KEY, [], True

        def closed():
            n, *columns = transition(np.concatenate(held), window_ns, limit)
            return pd.DataFrame([(now, part, n, *(x.astype(np.int64).tobytes() for x in columns))], columns=["k", "part", "n", "ts", "reset", "count", "wins"])

        for b in batches:
            if b.empty:
                continue
            times = _times(b["t"])
            for k, s, e in _cuts(b):
                if k != now:
                    if held and first:
                        yield closed()
                        first = False
                    now, held = k, []
                held.append(times[s:e])
        if held:
            yield closed()

    return run


def _limiter(limit: int, window_s: float, before: dict | None = None):
    """Replay of sorted ranges; ``before``: (part, key) -> state at the range's start."""
    window_ns = int(window_s * 1e9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() if before else None
        cur, reset, count, win = _NO_KEY, None, 0, 0
        for b in batches:
            if b.empty:
                continue
            ts, parts = _times(b["t"]), []
            for k, s, e in _cuts(b):
                if k != cur:
                    cur, (reset, count, win) = k, (before or {}).get((part, k), (None, 0, 0))
                a, c, w, reset, count, win = chain(ts[s:e], window_ns, limit, reset, count, win)
                parts.append((a, c, w))
            yield pd.DataFrame({"event_id": b["i"].to_numpy(), "key": b["k"].to_numpy(dtype=object),
                                "allowed": np.concatenate([p[0] for p in parts]),
                                "window_count": np.concatenate([p[1] for p in parts]),
                                "window_no": np.concatenate([p[2] for p in parts])})
    return run


def _range_starts(ranged: DataFrame, limit: int, window_ns: int, fan: int) -> dict:
    """(part, key) -> (reset, count, win) of each range that goes on with a key of the range before."""
    maps = ranged.select("k", "t").mapInPandas(_border_maps(limit, window_ns), MAP).checkpoint(eager=True)
    wide = maps.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("k").alias("wide_k")).checkpoint(eager=True)
    if wide.isEmpty():
        return {}
    none = {"reset0": F.lit(NOTHING), "count0": F.lit(0), "win0": F.lit(0)}
    maps = maps.join(F.broadcast(wide), F.col("k").eqNullSafe(F.col("wide_k"))).drop("wide_k").withColumn("g", F.floor(F.col("part") / fan).cast("int"))
    groups = maps.repartition("k", "g").sortWithinPartitions("k", "g", "part").mapInPandas(_composed(limit, window_ns), MAP)
    at_groups = groups.withColumns(none | {"g": F.lit(0)}).repartition("k").sortWithinPartitions("k", "part").mapInPandas(_states(limit), STATE)
    start = F.broadcast(at_groups.select(F.col("k").alias("group_k"), F.col("part").alias("group_g"), *[F.col(x).alias(f"{x}0") for x in ("reset", "count", "win")]))
    inner = maps.join(start, F.col("k").eqNullSafe(F.col("group_k")) & (F.col("g") == F.col("group_g")))
    states = inner.repartition("k", "g").sortWithinPartitions("k", "g", "part").mapInPandas(_states(limit), STATE)
    return {(r.part, r.k): (r.reset, r["count"], r.win) for r in states.where(F.col("reset") != NOTHING).collect()}  # at most one a range


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id",
               limit: int = fixed.RATE_LIMIT, window_s: float = fixed.RATE_WINDOW_S,
               partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """Op 42 (batch): allowed / denied per event, the count in its window and
    the window's number for its key, which keeps its type (a null key is a key).
    Order within a key: (ts, id).  The ranged events are written to the checkpoint folder."""
    kind, spark = events.schema[key].dataType.simpleString(), events.sparkSession
    ensure_checkpoint_dir(spark)
    src = events.select(F.col(key).cast("string").alias("k"), F.col(ts).alias("t"), F.col(id_).cast("bigint").alias("i"))
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.repartitionByRange(width, "k", "t", "i").sortWithinPartitions("k", "t", "i").checkpoint(eager=True)
    before = _range_starts(ranged, limit, int(window_s * 1e9), fan)
    return ranged.mapInPandas(_limiter(limit, window_s, before), OUT_SCHEMA).withColumn("key", F.col("key").cast(kind))

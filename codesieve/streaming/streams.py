"""Structured Streaming operators: ops 43, 44 and 45, and op 5.

* op 43 ``rate_limit_stream``: op 42 with state per key.  Rows are held in
  state until the watermark reaches them and then replayed in (ts, id)
  order, so arrival order inside the delay cannot change the answer.  Rows
  behind the watermark are dropped by Spark before the function runs, which counts
  them (``late_rows``).  With ``evict`` a key's state goes once the watermark has passed its open window's end.
* op 45 ``decode_frames_stream``: op 13 with the unfinished tail as state
  per stream; chunks are applied in ``chunk_no`` order and gaps wait.
  JSON checks run in the JVM after the stateful step, exactly as in op 13.
* op 44 ``run_status_stream``: the first final event by (frame, line) and the places of the
  events that count, as typed state.

The states of ops 44 and 45 go when a stream has been quiet for ``idle`` of the event
time that ``ts`` names; without ``ts`` they stay (time-outs by the clock never let ``availableNow`` end).  State is typed columns (numbers, strings and arrays of them).

A call of Spark's grouped state costs milliseconds whatever its rows, so keys are not groups of their own: a
group is a bucket of keys by hash (``BUCKETS``, fixed for a checkpoint), its state the arrays of its keys' states, and each key
in it is treated by itself, with its own time to go.  A bucket's state is written again whenever one of its keys has rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codesieve.functions import fixed
from codesieve.operators.extract import events_of_lines
from codesieve.session import ensure_checkpoint_dir
from codesieve.streaming.rate_limit import NOTHING, chain

BUCKETS = 4096


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


# ---- op 43 ------------------------------------------------------------------------
RL_STATE = "keys array<string>, reset_ns array<bigint>, count array<bigint>, win array<bigint>, held binary"


def _rl_func(limit: int, window_s: float, evict: bool):
    window_ns = int(window_s * 1e9)

    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, reset, count, win, raw = (*map(list, state.get[:4]), state.get[4]) if state.exists else ([], [], [], [], b"")
        place = {k: j for j, k in enumerate(names)}
        rows = [np.frombuffer(raw, np.int64).reshape(-1, 3)]  # (key's place, time, id) of rows ahead of the watermark
        for p in pdfs:
            if len(p):
                codes, found = pd.factorize(p["k"].to_numpy(dtype=object), use_na_sentinel=False)
                own = np.array([place.setdefault(None if pd.isna(k) else k, len(place)) for k in found], np.int64)
                rows.append(np.column_stack([own[codes], p["t_ns"].to_numpy(np.int64), p["i"].to_numpy(np.int64)]))
        for k in list(place)[len(names):]:
            names.append(k)
            reset.append(None)
            count.append(0)
            win.append(0)
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        mark_ms = state.getCurrentWatermarkMs()
        due = rows[:, 1] <= mark_ms * 1_000_000
        ready, held = rows[due], rows[~due]
        if n := len(ready):
            allowed, wcount, wno, starts = np.empty(n, bool), *np.empty((3, n), np.int64)
            cuts = (np.flatnonzero(np.diff(ready[:, 0])) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, n], strict=True):
                j, ts, before = int(ready[s, 0]), ready[s:e, 1], None
                if reset[j] is not None:
                    before = reset[j] = int(reset[j])
                allowed[s:e], wcount[s:e], wno[s:e], reset[j], count[j], win[j] = chain(ts, window_ns, limit, before, int(count[j]), int(win[j]))
                if evict:  # a window's first row tells its start
                    open_at = None if before is None else before - window_ns
                    first = np.concatenate([[before is None or ts[0] > before], wno[s + 1:e] != wno[s:e - 1]])
                    at = np.maximum.accumulate(np.where(first, np.arange(e - s), -1))
                    starts[s:e] = np.where(at < 0, 0 if open_at is None else open_at, ts[at])
            out = pd.DataFrame({"event_id": ready[:, 2], "key": np.array(names, object)[ready[:, 0]], "allowed": allowed, "window_count": wcount, "window_no": wno})
            if evict:
                out["window_start_ns"] = starts
            yield out
        if evict:  # a key whose window has passed: whatever comes later opens a new one
            waits = set(held[:, 0].tolist())
            stay = [j for j, r in enumerate(reset) if j in waits or (r is not None and int(r) // 1_000_000 >= mark_ms)]
            if not stay:
                state.remove()
                return
            if len(stay) < len(names):
                to = np.full(len(names), -1, np.int64)
                to[stay] = np.arange(len(stay))
                names, reset, count, win = ([x[j] for j in stay] for x in (names, reset, count, win))
                held = np.column_stack([to[held[:, 0]], held[:, 1:]])
        state.update((names, [None if r is None else int(r) for r in reset], [int(c) for c in count], [int(w) for w in win], held.tobytes()))
        next_ms = (held[:, 1] // 1_000_000).tolist() + ([int(r) // 1_000_000 for r in reset if r is not None] if evict else [])
        if next_ms:
            state.setTimeoutTimestamp(max(min(next_ms), mark_ms) + 1)

    return fn


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id",
                      limit: int = fixed.RATE_LIMIT, window_s: float = fixed.RATE_WINDOW_S,
                      delay: str = "0 seconds", evict: bool = False) -> DataFrame:
    """Op 43 on a streaming DataFrame (``ts`` may be TIMESTAMP_NTZ: it is
    cast to TIMESTAMP with the session zone UTC for the watermark).  The key
    keeps its type.  A row comes out once the watermark has reached it; rows
    ahead of the last watermark stay in state until a later (closing) row moves it.

    ``evict`` removes a key's state when nothing is held and the watermark has passed its
    window's end.  Windows are then numbered from 1 again after each removal, so rows also carry
    ``window_start_ns``, from which ``numbered_windows`` gives the numbers of op 42."""
    kind = events.schema[key].dataType.simpleString()
    least = F.lit(NOTHING)  # of a null time or id
    s = (events.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").alias("et"), F.coalesce(F.col(id_).cast("long"), least).alias("i"))
         .withColumns({"t_ns": F.coalesce((F.unix_micros("et") * 1000).cast("long"), least), "bucket": _bucket("k")})
         .withWatermark("et", delay))
    out = "event_id long, key string, allowed boolean, window_count long, window_no long" + (", window_start_ns long" if evict else "")
    return s.groupBy("bucket").applyInPandasWithState(_rl_func(limit, window_s, evict), out, RL_STATE, "append",
                                                      GroupStateTimeout.EventTimeTimeout).withColumn("key", F.col("key").cast(kind))


def numbered_windows(rows: DataFrame) -> DataFrame:
    """Rows of an evicting op 43 with each key's windows numbered over its whole time.  Windows
    are numbered among themselves (one row each), so that a busy key's rows need not meet."""
    windows = rows.select(F.col("key").alias("_key"), F.col("window_start_ns").alias("_start")).distinct().withColumn(
        "number", F.row_number().over(Window.partitionBy("_key").orderBy("_start")).cast("long"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("window_start_ns") == F.col("_start"))
    return rows.join(windows, same).select("event_id", "key", "allowed", "window_count", F.col("number").alias("window_no"))


# ---- op 45 ------------------------------------------------------------------------
DF_OUT = "stream_id long, frame_no long, line_no long, data string"
DF_STATE = ("ids array<bigint>, next_no array<bigint>, tails array<string>, frames array<bigint>, until array<bigint>, "
            "held_of array<int>, held_no array<bigint>, held array<string>")
IDLE = "1 hour"


def _idle_ms(idle: str) -> int:
    return int(pd.Timedelta(idle).total_seconds() * 1000)


def _call_again(state: GroupState, until: list[int | None], mark_ms: int | None) -> None:
    """Ask for a call when the first of a bucket's streams has been quiet for too long."""
    if times := [t for t in until if t is not None]:
        state.setTimeoutTimestamp(max(min(times), mark_ms + 1))


def _timed(rows: DataFrame, ts: str | None, delay: str) -> tuple[DataFrame, str]:
    """``rows`` with column ``et_ms`` (null without ``ts``) under a watermark, and the kind of time-out."""
    if ts is None:
        return rows.withColumn("et_ms", F.lit(None).cast("long")), GroupStateTimeout.NoTimeout
    rows = rows.withColumn("et", F.col(ts).cast("timestamp")).withColumn("et_ms", F.unix_millis("et"))
    return rows.withWatermark("et", delay), GroupStateTimeout.EventTimeTimeout


def _decoder(idle_ms: int, timed: bool):
    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark_ms = state.getCurrentWatermarkMs() if timed else None
        ids, *own, of, held_no, held = state.get if state.exists else ([],) * 8
        known = {i: [*x, {}] for i, *x in zip(ids, *own, strict=True)}  # id -> next number, tail, frames, until, waiting
        for j, no, chunk in zip(of, held_no, held, strict=True):
            known[ids[j]][4][no] = chunk
        newest: dict[int | None, int | None] = {}  # of the streams that have rows now
        for p in pdfs:
            for i, none, no, chunk, ms in zip(p["stream_id"].tolist(), p["none"].tolist(), p["chunk_no"].astype(int).tolist(), p["chunk"].tolist(),
                                              p["et_ms"].tolist(), strict=True):
                i = None if none else i
                if i not in known:
                    known[i] = [0, "", 0, None, {}]
                if no >= known[i][0]:
                    known[i][4][no] = chunk
                ms, last = None if ms is None or ms != ms else int(ms), newest.get(i)
                newest[i] = last if ms is None else ms if last is None else max(ms, last)
        rows = []
        for i, ms in newest.items():
            x = known[i]
            next_no, tail, frames, _, waiting = x
            new = [tail]
            while next_no in waiting:
                new.append(waiting.pop(next_no) or "")
                next_no += 1
            *parts, tail = "".join(new).split("\n\n")
            for part in parts:
                rows += [(i, frames, j, line[6:]) for j, line in enumerate(part.split("\n")) if line.startswith("data: ")]
                frames += 1
            x[:4] = next_no, tail, frames, None if ms is None else max(ms + idle_ms, mark_ms + 1)
        if rows:
            out = pd.DataFrame(rows, columns=["stream_id", "frame_no", "line_no", "data"], dtype=object)
            yield out.astype({"stream_id": "Int64", "frame_no": "int64", "line_no": "int64"})
        if timed:
            known = {i: x for i, x in known.items() if i in newest or x[3] is None or x[3] >= mark_ms}
        if not known:
            state.remove()
            return
        waits = [(j, no, chunk) for j, x in enumerate(known.values()) for no, chunk in x[4].items()]
        columns = list(map(list, zip(*(x[:4] for x in known.values()), strict=True)))
        state.update((list(known), *columns, *([w[c] for w in waits] for c in range(3))))
        _call_again(state, columns[3], mark_ms)

    return fn


def decode_frames_stream(chunks: DataFrame, ts: str | None = None, delay: str = "0 seconds", idle: str = IDLE) -> DataFrame:
    """Op 45: chunks (stream_id, chunk_no, chunk) -> events, as op 13.  A chunk number seen before is ignored."""
    rows, timeout = _timed(chunks, ts, delay)
    id_ = F.col("stream_id").cast("long")
    raw = (rows.select(_bucket("stream_id"), F.coalesce(id_, F.lit(0)).alias("stream_id"), id_.isNull().alias("none"), F.col("chunk_no").cast("long").alias("chunk_no"),
                       "chunk", "et_ms", *(["et"] if ts else []))
           .groupBy("bucket").applyInPandasWithState(_decoder(_idle_ms(idle), ts is not None), DF_OUT, DF_STATE, "append", timeout))
    return events_of_lines(raw, ["stream_id", "frame_no", "line_no"])


# ---- op 44 ------------------------------------------------------------------------
FINAL = ["done", "error"]
TYPES = ["progress", "step_start", "step_done", "retry", "code_generated", "done", "error"]
STATUS = {"done": "ready", "error": "error"}
NO_END = np.iinfo(np.int64).max


def run_status_agg(events: DataFrame, run: str = "stream_id") -> DataFrame:
    """Op 44 in batch.  ``done`` and ``error`` are final: nothing after the
    first of them, by (frame, line), counts.  Two phases, both with partial
    aggregation and no list: the first final event of each run, then the counts of
    what is not after it (the join splits a skewed run: AQE)."""
    place = F.struct("frame_no", "line_no")
    final = F.col("type").isin(*FINAL)
    firsts = events.groupBy(F.col(run).alias("run_id")).agg(F.min(F.when(final, F.struct(place.alias("at"), "type"))).alias("first"))
    counted = (events.select(F.col(run).alias("run_id"), "type", place.alias("at")).join(firsts, "run_id")
               .where(F.col("first").isNull() | (F.col("at") <= F.col("first")["at"])))
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("first")["type"]), F.lit("busy"))
    return counted.groupBy("run_id", status.alias("status")).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES])


RS_OUT = "run_id long, status string, n_events long, " + ", ".join(f"n_{t} long" for t in TYPES)
RS_STATE = "ids array<bigint>, until array<bigint>, n_events array<bigint>, frames array<bigint>, lines array<bigint>, types array<int>"
FIRST_FINAL = TYPES.index("done")  # of a type's place in TYPES; -1 is any other type


def _status(idle_ms: int, timed: bool):
    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark_ms = state.getCurrentWatermarkMs() if timed else None
        ids, until, sizes, *places = map(list, state.get if state.exists else ([],) * 6)
        place, newest = {i: j for j, i in enumerate(ids)}, {}
        events = [(np.repeat(np.arange(len(ids)), np.array(sizes, np.int64)), *(np.array(x, np.int64) for x in places))]
        for p in pdfs:
            if not len(p):
                continue
            own = np.array([place.setdefault(None if none else i, len(place)) for i, none in zip(p["run_id"].tolist(), p["none"].tolist(), strict=True)], np.int64)
            events.append((own, *(p[x].to_numpy(np.int64) for x in ("frame_no", "line_no", "type"))))
            for j, ms in p["et_ms"].astype("float64").groupby(own).max().items():
                last = newest.get(j)
                newest[j] = last if ms != ms else int(ms) if last is None else max(int(ms), last)
        ids, until = list(place), until + [None] * (len(place) - len(ids))
        run, frame, line, kind = (np.concatenate(x) for x in zip(*events, strict=True))
        order = np.lexsort((kind, line, frame, run))
        run, frame, line, kind = (x[order] for x in (run, frame, line, kind))
        finals = np.flatnonzero(kind >= FIRST_FINAL)
        has, at = np.unique(run[finals], return_index=True)
        at = finals[at]  # each run's first final event by place: what comes after never counts again
        last_frame, last_line, status = np.full(len(ids), NO_END), np.full(len(ids), NO_END), np.full(len(ids), "busy", object)
        last_frame[has], last_line[has], status[has] = frame[at], line[at], [STATUS[TYPES[k]] for k in kind[at]]
        counts = (frame < last_frame[run]) | ((frame == last_frame[run]) & (line <= last_line[run]))
        run, frame, line, kind = (x[counts] for x in (run, frame, line, kind))
        sizes = np.bincount(run, minlength=len(ids))
        if newest:
            now = np.array(sorted(newest))
            by_type = np.bincount(run * (len(TYPES) + 1) + kind + 1, minlength=len(ids) * (len(TYPES) + 1)).reshape(len(ids), -1)[now, 1:]
            yield pd.DataFrame({"run_id": pd.array([ids[j] for j in now], dtype="Int64"), "status": status[now], "n_events": sizes[now]}
                               | {f"n_{t}": by_type[:, k] for k, t in enumerate(TYPES)})
        for j, ms in newest.items():
            until[j] = None if ms is None else max(ms + idle_ms, mark_ms + 1)
        stay = np.array([not timed or j in newest or t is None or t >= mark_ms for j, t in enumerate(until)], bool)
        if not stay.any():
            state.remove()
            return
        until, kept = [until[j] for j in np.flatnonzero(stay)], stay[run]
        state.update(([ids[j] for j in np.flatnonzero(stay)], until, sizes[stay].tolist(), *(x[kept].tolist() for x in (frame, line, kind))))
        _call_again(state, until, mark_ms)

    return fn


def run_status_stream(events: DataFrame, run: str = "stream_id", ts: str | None = None, delay: str = "0 seconds", idle: str = IDLE) -> DataFrame:
    """Op 44 on a streaming DataFrame of decoded events (update mode).  Events may come in any order
    within a run; the places of those that count are kept until the run has been quiet for ``idle``."""
    rows, timeout = _timed(events, ts, delay)
    id_ = F.col(run).cast("long")
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), F.lit(0)) - 1
    own = rows.select(_bucket(run), F.coalesce(id_, F.lit(0)).alias("run_id"), id_.isNull().alias("none"), "frame_no", "line_no", kind.alias("type"),
                      "et_ms", *(["et"] if ts else []))
    return own.groupBy("bucket").applyInPandasWithState(_status(_idle_ms(idle), ts is not None), RS_OUT, RS_STATE, "update", timeout)


# ---- op 5 -------------------------------------------------------------------------
def summary_view(events: DataFrame, mode: str = "summary") -> DataFrame:
    """Op 5: the progress feed.  Summary mode hides the detail-only types;
    unknown types take the ``progress`` style.  The two-entry hidden list and
    the five styles are literals in the plan: no join."""
    style = F.create_map(*[x for t, icon, css in fixed.EVENT_STYLE for x in (F.lit(t), F.struct(
        F.lit(icon).alias("icon"), F.lit(css).alias("css")))])
    st = F.coalesce(F.element_at(style, F.coalesce(F.col("type"), F.lit(""))), F.element_at(style, F.lit("progress")))
    out = events if mode == "detail" else events.where(~F.coalesce(F.col("type"), F.lit("")).isin(*fixed.DETAIL_ONLY))
    return out.select("stream_id", "frame_no", "type", "message", st["icon"].alias("icon"), st["css"].alias("css"),
                      F.coalesce(F.col("type"), F.lit("")).isin(*fixed.DETAIL_ONLY).alias("detail_only"))


# ---- running a stream to completion (for the registry and tests) -----------------------
def scratch_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint dir named by the session."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def run_available_now(stream: DataFrame, mode: str = "append", out: str | None = None, ckpt: str | None = None,
                      progress: list | None = None) -> str:
    """Drain a streaming DataFrame with ``availableNow`` into parquet under the
    checkpoint dir (every micro-batch appended with its batch id); return
    the output path.  Given ``out`` and ``ckpt`` of an earlier run, go on from there.
    The progress reports of its micro-batches are added to ``progress``."""
    spark = stream.sparkSession
    out = out or scratch_dir(spark, "out")
    ckpt = ckpt or scratch_dir(spark, "ckpt")

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return out


def state_rows(progress: list) -> int:
    """Rows of state after the last of these micro-batches, over all stateful steps."""
    return sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"]) if progress else 0


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark and were dropped."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])

"""Stream = batch equality for the stateful operators, over several
micro-batches, plus the batch rate limiter against a plain Python loop."""
import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codesieve.operators import extract
from codesieve.streaming import rate_limit as rl
from codesieve.streaming import streams
from tests.conftest import SF_SMALL


def _loop(rows, limit, window_s):
    state, out = {}, {}
    for eid, k, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        st = state.get(k)
        if st is None or ts > st[0]:
            state[k] = [ts + window_s, 1]
            out[eid] = True
        elif st[1] >= limit:
            out[eid] = False
        else:
            st[1] += 1
            out[eid] = True
    return out


def test_rate_limit_matches_loop(spark):
    rows = [(i, i % 3, float(t)) for i, t in enumerate([0, 1, 2, 3, 5, 61, 62, 62, 62, 200, 200, 201, 260, 261])]
    df = spark.createDataFrame([(i, k, t) for i, k, t in rows], "event_id bigint, user_id bigint, t double")
    df = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r.event_id: r.allowed for r in rl.rate_limit(df, limit=2, window_s=60, partitions=2).collect()}
    assert got == _loop(rows, 2, 60)


def test_rate_limit_of_a_hot_key(spark):
    """A key with nine tenths of all rows spreads over all ranges, and the states
    carried over the ranges give what the plain loop gives: windows longer and shorter
    than a range, gaps, ties, null keys and null times."""
    rng = np.random.default_rng(42)
    hot = np.cumsum(rng.choice([0, 0, 1, 2, 7, 300], 1800, p=[.2, .2, .3, .2, .09, .01]))
    rows = [(i, "hot", float(t)) for i, t in enumerate(hot)] + [(5000 + i, f"k{i % 7}", float(i)) for i in range(150)]
    rows += [(6000 + i, None, float(i * i)) for i in range(50)]
    df = spark.createDataFrame(rows + [(7000, "hot", None), (7001, "hot", None)], "event_id bigint, user_id string, t double")
    df = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).repartition(5)
    for limit, window in ((2, 5), (3, 400)):
        want = _loop([(i, k or "", t) for i, k, t in rows], limit, window)
        for fan in (2, 64)[window == 5:]:
            out = rl.rate_limit(df, limit=limit, window_s=window, partitions=12, fan=fan)
            got = {r.event_id: r for r in out.collect()}
            assert len(got) == 2002 and {i: got[i].allowed for i in want} == want, (limit, window, fan)
            assert got[7000].allowed and (got[7001].window_no, got[0].window_no) == (1, 2)
            own = [r for i, r in sorted(got.items()) if i < 1800]  # each window's count runs from 1 to its last
            assert all(b.window_count == (min(a.window_count + 1, limit) if a.window_no == b.window_no else 1) for a, b in zip(own, own[1:], strict=False))
            places = out.where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
            assert places >= 10


def test_rate_limit_stream_equals_batch(spark):
    q = entry.queries()
    batch = {(r.event_id, r.allowed, r.window_count) for r in q["rate_limit"](spark, SF_SMALL).collect()}
    stream = {(r.event_id, r.allowed, r.window_count) for r in q["rate_limit_stream"](spark, SF_SMALL).collect()}
    assert stream == batch


def test_decode_stream_equals_batch(spark):
    q = entry.queries()
    cols = ["stream_id", "frame_no", "line_no", "type", "payload"]
    batch = {tuple(r) for r in q["decode_frames"](spark, SF_SMALL).select(cols).collect()}
    stream = {tuple(r) for r in q["decode_frames_stream"](spark, SF_SMALL).select(cols).collect()}
    assert stream == batch and len(batch) > 0


def test_decode_stream_out_of_order_chunks(spark, tmp_path):
    rows = [(1, 1, 'ype":"done"}\n\n'), (1, 0, ': ping\n\ndata: {"t'), (2, 0, 'data: {"type":"x"}\n\ndata: {ro')]
    src = str(tmp_path / "chunks")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "stream_id bigint, chunk_no int, chunk string").write.mode("append").parquet(src)
    st = spark.readStream.schema("stream_id bigint, chunk_no int, chunk string").option("maxFilesPerTrigger", 1).parquet(src)
    out = spark.read.parquet(streams.run_available_now(streams.decode_frames_stream(st)))
    got = sorted((r.stream_id, r.type) for r in out.collect())
    assert got == [(1, "done"), (2, "x")]


def test_run_status_stream_equals_batch(spark):
    q = entry.queries()
    batch = {tuple(r) for r in q["run_status"](spark, SF_SMALL).collect()}
    stream = {tuple(r) for r in q["run_status_stream"](spark, SF_SMALL).collect()}
    assert stream == batch


def test_rate_limit_stream_over_many_batches(spark, tmp_path):
    """Five files out of order within the delay, idle gaps longer than the
    window, rows of one millisecond in two files, then a closing row."""
    times = [0, 1.0001, 1.0002, 1.0003, 90, 61, 200.5, 200.5, 150, 400.0004, 400.0001, 320, 500, 499, 900]
    rows = [(i, f"10.0.0.{i % 2}", 1e6 + t) for i, t in enumerate(times)]
    make = lambda part: spark.createDataFrame(part, "event_id bigint, ip string, t double").select(
        "event_id", "ip", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")).coalesce(1)
    batch = rl.rate_limit(make(rows), key="ip", limit=2, window_s=60).collect()
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for k in range(0, 15, 3):
        make(rows[k:k + 3]).write.mode("append").parquet(src)
    stream = spark.readStream.schema(make(rows).schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: streams.run_available_now(streams.rate_limit_stream(
        stream, key="ip", limit=2, window_s=60, delay="200 seconds"), out=out, ckpt=ckpt)
    run()
    make([(-1, "closing", 1e6 + 5000)]).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out).where("event_id >= 0").drop("_batch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_rate_limit_stream_of_unsorted_parts(spark, tmp_path):
    """An events folder of several parts, each with rows of the whole time."""
    q = entry.queries()
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    batch = sorted(map(tuple, q["rate_limit"](spark, str(tmp_path)).collect()))
    stream = sorted(map(tuple, q["rate_limit_stream"](spark, str(tmp_path)).collect()))
    assert stream == batch and len(batch) == events.count()


def _fed(spark, tmp_path, batches, schema, build, mode="append"):
    """Rows of a stream fed batch by batch, and its progress reports."""
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    progress: list = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.run_available_now(build(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src)), mode, out, ckpt, progress)
    return spark.read.parquet(out).collect(), progress


def test_rate_limit_state_goes_with_its_window(spark, tmp_path):
    """Expired windows leave no state, late rows are counted, and numbered windows equal the batch."""
    at = lambda t: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
    rows = [(i, f"k{i % 20}", at(i)) for i in range(100)] + [(200 + i, f"k{i % 20}", at(5000 + i)) for i in range(40)]
    batches = [rows[:60], rows[60:100], rows[100:], [(-1, "closing", at(90_000))], [(900, "k0", at(3))], [(-2, "closing", at(99_000))]]
    got, progress = _fed(spark, tmp_path, batches, "event_id long, ip string, ts timestamp",
                         lambda s: streams.rate_limit_stream(s, key="ip", limit=2, window_s=60, delay="10 seconds", evict=True))
    table = spark.createDataFrame([r for r in rows], "event_id long, ip string, ts timestamp")
    want = sorted(map(tuple, rl.rate_limit(table.withColumn("ts", F.col("ts").cast("timestamp_ntz")), key="ip", limit=2, window_s=60).collect()))
    done = spark.createDataFrame([r for r in got if r.event_id >= 0]).drop("_batch")
    assert sorted(map(tuple, streams.numbered_windows(done).collect())) == want
    assert streams.late_rows(progress) == 1
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) >= 20 and streams.state_rows(progress) <= 1


def test_status_takes_the_first_final_event(spark, tmp_path):
    rows = [(1, 0, 0, "error"), (1, 0, 1, "done"), (2, 0, 0, "done"), (2, 0, 1, "progress"), (3, 0, 0, "progress"), (3, 1, 0, "retry"),
            (4, 0, 0, "progress"), (4, 2, 0, "error"), (4, 1, 3, "done"), (4, 1, 2, "progress"), (5, 0, 0, None)]
    want = {1: ("error", 1), 2: ("ready", 1), 3: ("busy", 2), 4: ("ready", 3), 5: ("busy", 1)}
    schema = "stream_id long, frame_no long, line_no long, type string, ts timestamp"
    rows = [(*r, dt.datetime(2024, 1, 1)) for r in rows]
    batch = streams.run_status_agg(spark.createDataFrame(rows, schema)).collect()
    assert {r.run_id: (r.status, r.n_events) for r in batch} == want
    late = [(9, 0, 0, "done", dt.datetime(2024, 1, 3))]
    got, progress = _fed(spark, tmp_path, [rows[::-2], rows[-2::-2], late, [(9, 1, 0, "x", dt.datetime(2024, 1, 3))]], schema,
                         lambda s: streams.run_status_stream(s, ts="ts", delay="1 minute", idle="1 hour"), "update")
    last = {}
    for r in sorted(got, key=lambda r: r._batch):
        last[r.run_id] = (r.status, r.n_events)
    assert last == want | {9: ("ready", 1)}
    assert streams.state_rows(progress) == 1  # of the five old streams nothing is left


def test_decoder_state_goes_when_a_stream_is_quiet(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[(i, 0, 'data: {"type":"a"}\n\ndata: {"ty', at(0)) for i in range(30)] + [(99, 2, "gap", at(0))],
               [(i, 1, 'pe":"b"}\n\n', at(1)) for i in range(15)] + [(0, 0, "seen before", at(1))], [(77, 0, "x", at(9))], [(77, 1, "y", at(9))]]
    got, progress = _fed(spark, tmp_path, batches, "stream_id long, chunk_no long, chunk string, ts timestamp",
                         lambda s: streams.decode_frames_stream(s, ts="ts", delay="1 hour", idle="2 hours"))
    assert sorted((r.stream_id, r.type) for r in got) == sorted([(i, "a") for i in range(30)] + [(i, "b") for i in range(15)])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) >= 31 and streams.state_rows(progress) == 1


def _is_json(text):
    try:
        return bool(json.loads(text))
    except ValueError:
        return False


def _decoded_by_hand(rows):
    out = []
    for s in {r[0] for r in rows}:
        buffer = "".join(c or "" for _, _, c in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]))
        for k, frame in enumerate(buffer.split("\n\n")[:-1]):
            for j, line in enumerate(frame.split("\n")):
                if line.startswith("data: ") and line.startswith('data: {"type":"') and _is_json(line[6:]):
                    out.append((s, k, j, line[6:]))
    return sorted(out, key=str)


def test_decode_frames_over_ranges(spark):
    """One stream spread over all ranges: every cut of the text gives the frames of the whole,
    also between two line ends, within runs of them, and where a range holds no whole frame."""
    rng = np.random.default_rng(13)
    for n in range(3):
        parts = ["\n", "\n\n", "\n\n\n", ": ping", 'data: {"type":"a"}', 'data: {"type":"b"}\n', "data: {roto", "x" * 30]
        text = "".join(rng.choice(parts, 400))
        cuts = np.sort(rng.choice(len(text), 300, replace=False))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows = [("hot", i, c) for i, c in enumerate(chunks)] + [(f"s{i}", j, c) for i in range(8) for j, c in enumerate(chunks[5 * i:5 * i + 4])] + [("s1", 9, None), (None, 0, 'data: {"type":"n"}\n\n')]
        df = spark.createDataFrame(rows, "stream_id string, chunk_no long, chunk string").repartition(3)
        out = extract.decode_frames(df, partitions=[3, 40, 120][n])
        assert sorted(((r.stream_id, r.frame_no, r.line_no, r.payload) for r in out.collect()), key=str) == _decoded_by_hand(rows), n


def test_decode_frames_holds_no_stream(spark):
    """A long stream is decoded by many tasks, none of which gets more than its share."""
    chunks = spark.range(4000).select(F.lit(1).alias("stream_id"), F.col("id").alias("chunk_no"),
                                      F.concat(F.lit('data: {"type":"t","n":'), F.col("id"), F.lit("}\n\n"), F.repeat(F.lit("z"), 2000), F.lit("\n")).alias("chunk"))
    out = extract.decode_frames(chunks, partitions=16)
    assert out.agg(F.count("*"), F.max("frame_no")).first() == (4000, 3999)
    assert out.select(F.spark_partition_id()).distinct().count() >= 12


def test_streams_share_buckets(spark, tmp_path, monkeypatch):
    """Many keys to a group of state (here two groups): each has its own numbers, waiting chunks, window and
    time to go; null keys are keys, ids beyond 2^53 stay what they are."""
    monkeypatch.setattr(streams, "BUCKETS", 2)
    at = lambda h: dt.datetime(2024, 1, 1, h)
    big = (1 << 60) + 1
    keys = [None, big, *range(40)]
    schema = "stream_id long, chunk_no long, chunk string, ts timestamp"
    batches = [[(i, 1, 'pe":"b"}\n\n', at(0)) for i in keys], [(i, 0, f'data: {{"type":"a{i}"}}\n\ndata: {{"ty', at(1)) for i in keys[:20]],
               [(i, 0, f'data: {{"type":"a{i}"}}\n\ndata: {{"ty', at(2)) for i in keys[20:]], [(77, 0, "x", at(9))], [(77, 1, "y", at(9))]]
    got, progress = _fed(spark, tmp_path, batches, schema, lambda s: streams.decode_frames_stream(s, ts="ts", delay="1 hour", idle="2 hours"))
    want = [(i, f, f"a{i}" if f == 0 else "b") for i in keys for f in (0, 1)]
    assert sorted(((r.stream_id, r.frame_no, r.type) for r in got), key=str) == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) == 2 and streams.state_rows(progress) == 1
    rows = [(i, 0, k % 3, t) for i in keys for k, t in enumerate(["progress", "error" if i == 7 else "retry", None])]
    got, progress = _fed(spark, tmp_path / "s", [rows[::2], rows[1::2]], "stream_id long, frame_no long, line_no long, type string",
                         streams.run_status_stream, "update")
    last = {r.run_id: (r.status, r.n_events, r.n_progress, r.n_retry) for r in sorted(got, key=lambda r: r._batch)}
    assert last == {i: ("error", 2, 1, 0) if i == 7 else ("busy", 3, 1, 1) for i in keys} and streams.state_rows(progress) == 2
    rows = [(100 * j + n, i, at(n)) for j, i in enumerate(keys) for n in range(6)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    want = sorted(map(tuple, rl.rate_limit(table, limit=2, window_s=7200).collect()), key=str)
    batches = [[r for r in rows if r[0] % 100 in n] for n in ((0, 1), (2, 3), (4, 5))] + [[(-1, None, at(20))], [(-2, None, at(23))]]
    got, progress = _fed(spark, tmp_path / "r", batches, "event_id long, user_id long, ts timestamp_ntz",
                         lambda s: streams.rate_limit_stream(s, limit=2, window_s=7200, evict=True))
    done = spark.createDataFrame([r for r in got if r.event_id >= 0]).drop("_batch")
    assert sorted(map(tuple, streams.numbered_windows(done).collect()), key=str) == want and streams.state_rows(progress) <= 1

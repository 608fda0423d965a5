"""Unit cases of our own: fences, JSON lines, turns, patches."""
from pyspark.sql import functions as F

from codesieve.functions.fixed import TERMINATION_SIGNAL
from codesieve.operators import extract, patches, turns

FENCE = "```"


def test_extract_code_cases(spark):
    cases = [
        (f"see {FENCE}go\npackage tide\nvar low = 3\n{FENCE} and {FENCE}go\nlater\n{FENCE}", "package tide\nvar low = 3"),
        (f"{FENCE}\r\nx := 1\r\n{FENCE}", "x := 1"),
        ("plain words", ""),
        (f"{FENCE}\nnotes\n{FENCE}{FENCE}go\npackage reef\n{FENCE}", "package reef"),
        (f"{FENCE}\nopen to the end  ", "open to the end"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", extract.extract_code("t").alias("c")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_parse_findings_two_rows(spark):
    text = ('{"type":"UNSANITIZED_INPUT","line":3,"severity":"BAJO"}\n \t{"severity":"ALTO","type":"HIGH_COMPLEXITY","line":81} \n'
            'words\n' + TERMINATION_SIGNAL)
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = extract.parse_findings(df, "t", ["id"]).orderBy("seq").collect()
    assert [(r.line, r.type, r.severity) for r in rows] == [(3, "UNSANITIZED_INPUT", "BAJO"), (81, "HIGH_COMPLEXITY", "ALTO")]


def test_json_rules(spark):
    lines = ['{"type":"A"} trailing', '{"line":1.0,"type":"B"}', '{"line":"x","type":"C"}', '{"TYPE":"D","line":null}',
             "{'type':'E'}", '{"type":"F","extra":{"a":[1]}}', '{"line":99999999999999999999,"type":"G"}']
    df = spark.createDataFrame([(1, "\n".join(lines))], "id int, t string")
    rows = extract.parse_findings(df, "t", ["id"]).collect()
    assert sorted((r.type, r.line) for r in rows) == [("D", None), ("F", None)]


def test_strict_parse_stops_at_marker_line(spark):
    text = '{"severity":"S","type":"A"}\nx ---FINDINGS_END--- y\n{"severity":"S","type":"B"}\n ---FINDINGS_END--- \n{"severity":"S","type":"C"}\n{"type":"D"}'
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert [r.type for r in extract.parse_findings_strict(df, "t", ["id"]).orderBy("seq").collect()] == ["A", "B"]


def test_parse_and_apply_patches(spark):
    rep = ("---FIX_START---\nORIGINAL:\n  a := 1\nFIXED:\n  a := 2\n---FIX_END---\n"
           "---FIX_START---\nFIXED:\nz\nORIGINAL:\ny\n---FIX_END---\n---FIX_START---\nORIGINAL:\nb\nFIXED:\nc\n")
    df = spark.createDataFrame([(1, rep)], "file_id bigint, report string")
    ps = extract.parse_patches(df, "report", ["file_id"])
    assert [(r.original, r.fixed) for r in ps.collect()] == [("a := 1", "a := 2")]
    files = spark.createDataFrame([(1, "package main\na := 1\na := 1\n"), (2, "package x\n")], "file_id bigint, code string")
    out = {r.file_id: r.fixed_code for r in patches.apply_patches(files, ps).collect()}
    assert out == {1: "package main\na := 2\na := 1\n", 2: "package x\n"}


TURN_SCHEMA = "run_id bigint, attempt int, response string, exec_error string, exit_code int, stdout string, duration_s double, llm_error string"
GOOD = f"{FENCE}go\npackage main\nfunc main() {{}}\n{FENCE}"
REPORT = TERMINATION_SIGNAL + "\nTodo bien en el archivo analizado, sin hallazgos que reportar hoy."


def _turns(spark, rows):
    return spark.createDataFrame(rows, TURN_SCHEMA)


def test_turn_loops(spark):
    rows = [(1, 1, GOOD, None, 0, "ok", 1.0, None), (1, 2, REPORT, None, 0, "", 0.0, None),
            (2, 1, GOOD, None, 1, "", 1.0, None), (2, 2, GOOD, None, 0, "ok", 1.0, None), (2, 3, REPORT, None, 0, "", 0.0, None),
            (4, 1, "x", None, 0, "", 0.0, "boom"), (4, 2, REPORT, None, 0, "", 0.0, None)]
    rows += [(3, a, GOOD, None, 1, "", 1.0, None) for a in range(1, 7)]
    c = turns.classify_turns(_turns(spark, rows), max_steps=1, max_retries=5)
    got = {}
    for r in c.orderBy("run_id", "attempt").collect():
        got.setdefault(r.run_id, []).append(r.cls)
    assert got == {1: ["success", "terminal"], 2: ["failed", "success", "terminal"],
                   3: ["failed"] * 4 + ["failed_fatal"], 4: ["llm_error"]}
    out = {r.run_id: r.outcome for r in turns.run_outcomes(c, max_retries=5).collect()}
    assert out == {1: "done", 2: "done", 3: "code_failed", 4: "llm_error"}


def test_history(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (1, 2, "user", "ccc"), (1, 3, "user", "d")],
                                 "conv_id bigint, turn bigint, role string, text string")
    h = turns.history_prefix(msgs, with_messages=True).orderBy("turn").collect()
    assert [r.n_messages for r in h] == [1, 2, 3, 4] and h[2].bytes == 6
    assert [m.role for m in h[2].messages] == ["user", "assistant", "user"]
    s = turns.history_sessions(msgs, F.col("turn") == 3).orderBy("session").collect()
    assert [(r.session, r.n_messages) for r in s] == [(0, 3), (1, 1)]


def test_repeated_keys_and_whole_values(spark):
    """Of a repeated key the last value holds; a line that is not one whole value gives nothing."""
    from codesieve.functions.jsonline import json_value_ok
    from codesieve.streaming import streams
    good = ['{"type":"T","severity":"LOW","severity":"HIGH","line":1,"line":2,"x":{"a":1,"a":2}}', '{"line":7,"severity":"LOW","type":"T"}', "1", "[1,2]", '"a"', "null", "{}"]
    bad = ['{"type":"A"},"zq9":1', '{"type":"A"},"w":1', '{"type":"A"}],[1', '{"type":"A"}]', '{"type":"A"}}', '{"type":"A"},{"type":"B"}', '{"type":"A"} x',
           '1],[2', '1}', '1],"w":[2', "1,2", "", "{", '"a', "1]}", "1}]"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "i int, s string")
    assert [r.i for r in lines.where(json_value_ok(F.col("s"))).orderBy("i").collect()] == list(range(len(good)))
    docs = spark.createDataFrame([(1, "\n".join(good + bad))], "out_id bigint, output string")
    for parse in (extract.parse_findings, extract.parse_findings_strict):
        got = [(r.line, r.severity) for r in parse(docs, "output", ["out_id"]).collect()]
        assert {(2, "HIGH"), (7, "LOW")} <= set(got) and all(r != (1, "LOW") for r in got)
    frame = 'data: {"type":"progress","type":"done"}\n\ndata: {"type":"error"},"zq9":1\n\n'
    events = extract.decode_frames(spark.createDataFrame([(1, 0, frame)], "stream_id bigint, chunk_no int, chunk string"))
    assert [r.type for r in events.collect()] == ["done"]
    assert streams.run_status_agg(events).first().status == "ready"


def test_exec_stats_ranks_are_exact(spark):
    """A sketch that is far too coarse for the data does not change the ranks."""
    n = 20000
    rows = spark.range(n).select(
        (F.col("id") % 7).alias("run_id"), F.lit("success").alias("cls"), F.lit(None).cast("string").alias("exec_error"),
        F.lit(0).alias("exit_code"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 977).alias("duration_s"))
    rows = rows.union(rows.where("run_id = 3").withColumn("duration_s", F.lit(5.0))).repartition(9)
    values = {}
    for r in rows.collect():
        values.setdefault(r.run_id, []).append(r.duration_s)
        values.setdefault(None, []).append(r.duration_s)
    got = {r.run_id: (r.p50_duration_s, r.p95_duration_s) for r in turns.exec_stats(rows, accuracy=50).collect()}
    assert got == {k: tuple(sorted(v)[-(-len(v) * p // 100) - 1] for p in (50, 95)) for k, v in values.items()}
    one = turns.exec_stats(rows.where("duration_s = 5").limit(1)).collect()
    assert [(r.p50_duration_s, r.p95_duration_s) for r in one] == [(5.0, 5.0)] * 2


def test_fences_against_a_plain_loop(spark):
    """Blocks open and close as line by line, and many blocks take time in proportion."""
    import random
    import time
    rng = random.Random(14)
    texts = ["\n".join(rng.choice(["```", "```go", "``` ", "text", "```x```", "", "## h", "----"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, report string")
    got = {}
    for r in extract.report_lines(df, "report", ["i"]).collect():
        got.setdefault(r.i, []).append((r.line_no, r.kind == "code", r.lang))
    for i, text in enumerate(texts):
        want, lang, inside = [], None, False
        for n, line in enumerate(text.split("\n"), 1):
            if not inside and line.startswith("```"):
                inside, lang = True, line[3:].strip()
            elif inside and line.rstrip() == "```":
                inside = False
            elif inside or line.strip():
                want.append((n, inside, lang if inside else None))
        assert sorted(got.get(i, []), key=lambda r: r[0]) == want, text

    def seconds(n):
        big = spark.createDataFrame([(1, "```go\nx\n```\n" * n)], "i long, report string")
        at = time.perf_counter()
        assert extract.report_lines(big, "report", ["i"]).count() == n
        return time.perf_counter() - at

    seconds(10)
    small, large = seconds(10_000), seconds(80_000)
    assert large < 16 * small + 2, (small, large)


def test_patch_audit_of_each_text(spark):
    """Braces and start follow the text of each step: changed, left alone, changed back; nulls; braces in literals and comments."""
    code = 'package a\nfunc f() { x := "{{" } // }'
    files = spark.createDataFrame([(1, code), (2, None), (3, " \u2003package b {"), (4, "")], "file_id long, code string")
    edits = [(1, 1, "nowhere", "x"), (1, 2, "func f() {", "func f() {{"), (1, 3, "nowhere", "x"), (1, 4, "{{", "{"), (1, 5, "package", "pack"),
             (1, 6, "f()", "f()"), (2, 1, "a", "b"), (3, 1, "b", "b }"), (4, 1, "", "package"), (4, 2, "package", "")]
    ps = spark.createDataFrame(edits, "file_id long, seq long, original string, fixed string")
    out = patches.patch_audit(files, ps)
    got = {(r.file_id, r.seq): tuple(r)[2:] for r in out.collect()}
    assert got[1, 1] == (False, 0, False, True, True, False) and got[1, 2] == (True, 1, True, False, True, False)
    assert got[1, 3] == (False, 0, False, False, True, False) and got[1, 4] == (True, 2, True, True, True, False)
    assert got[1, 5] == (True, 1, True, True, False, False) and got[1, 6] == (True, 1, False, True, False, False)
    assert got[2, 1] == (None, None, None, None, None, None) and got[3, 1] == (True, 1, True, True, True, True)
    assert got[4, 1][2:5] == (True, True, True) and got[4, 2][2:5] == (True, True, False)
    assert {r.file_id: r.n_applied for r in patches.apply_patches(files, ps).collect()} == {1: 4, 2: None, 3: 1, 4: 2}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, "a text's tokens are found once a step"

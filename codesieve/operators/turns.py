"""Transcript and run analytics: ops 11 and 28-34.

The agent loop's counters are running sums over an ordered turn list, so a
run is replayed with window functions partitioned by ``run_id`` (one
shuffle, then sorts inside each partition) instead of a sequential UDF:
``ok`` never depends on the success count, so the loop has a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.functions.text import byte_len, go_trim
from codesieve.operators import extract

END_CLASSES = ["terminal", "llm_error", "exec_error_fatal", "failed_fatal"]


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def classify_turns(turns: DataFrame, max_steps: int = fixed.DEFAULT_MAX_STEPS,
                   max_retries: int = fixed.DEFAULT_MAX_RETRIES,
                   signal: str = fixed.TERMINATION_SIGNAL,
                   require_structured: bool = False) -> DataFrame:
    """Op 29: class per turn, successes so far, turns after the end dropped.

    Classes, first match: llm_error; guard (marker before ``max_steps``
    successes); terminal (marker, or a plain-text report when structured
    findings are not required); no_code; not_package; exec_error; failed;
    success.  exec_error and failed become ``*_fatal`` at the last attempt."""
    r = F.col("response")
    llm_err = _opt(turns, "llm_error").isNotNull()
    mk = r.contains(fixed.FINDINGS_END)
    txt = (F.lit(not require_structured) & r.contains(signal) & ~r.contains("```go")
           & ~r.contains("package main") & (byte_len(go_trim(r)) > 50))
    code = extract.extract_code(r)
    exec_err = F.col("exec_error").isNotNull()
    ok = (~llm_err & ~mk & ~txt & (code != "") & code.startswith("package") & ~exec_err
          & (F.col("exit_code") == 0))
    w_run = Window.partitionBy("run_id").orderBy("attempt")
    sc = F.coalesce(F.sum(ok.cast("int")).over(w_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("attempt") == max_retries
    cls = (F.when(llm_err, F.lit("llm_error"))
           .when(mk & (F.col("sc") < max_steps), F.lit("guard"))
           .when(mk | txt, F.lit("terminal"))
           .when(code == "", F.lit("no_code"))
           .when(~code.startswith("package"), F.lit("not_package"))
           .when(exec_err, F.when(last, F.lit("exec_error_fatal")).otherwise(F.lit("exec_error")))
           .when(F.col("exit_code") != 0, F.when(last, F.lit("failed_fatal")).otherwise(F.lit("failed")))
           .otherwise(F.lit("success")))
    base = (turns.where(F.col("attempt") <= max_retries)
            .select("*", *[_opt(turns, c).alias(c) for c in ("stderr", "llm_error") if c not in turns.columns],
                    code.alias("code"), ok.alias("ok")))
    with_sc = base.withColumn("sc", sc).withColumn("cls", cls)
    end = F.min(F.when(F.col("cls").isin(*END_CLASSES), F.col("attempt"))).over(Window.partitionBy("run_id"))
    return (with_sc.withColumn("end_attempt", end)
            .where(F.col("end_attempt").isNull() | (F.col("attempt") <= F.col("end_attempt")))
            .select("run_id", "attempt", "cls", "ok", F.col("sc").cast("bigint").alias("successes_before"),
                    (F.col("sc") + F.col("ok").cast("int")).cast("bigint").alias("successes"),
                    "code", "response", "exec_error", "exit_code", "stdout", "duration_s", "stderr", "llm_error",
                    F.coalesce(F.col("attempt") == F.col("end_attempt"), F.lit(False)).alias("is_end")))


def run_outcomes(classified: DataFrame, max_retries: int = fixed.DEFAULT_MAX_RETRIES) -> DataFrame:
    """Op 30: per run the outcome (done, llm_error, executor_failed,
    code_failed, exhausted; incomplete when the log stops before the cap),
    attempts used, steps done, report, last error (of the model, the executor or the
    code's stderr) and the message that a run ends with.  The grouping reuses
    the run partitioning of op 29's windows: no second shuffle."""
    last = F.max_by(F.struct("cls", "response", "exec_error", "stderr", "llm_error", "successes"), "attempt")
    g = classified.groupBy("run_id").agg(last.alias("l"), F.max("attempt").alias("attempts"))
    cls = F.col("l.cls")
    outcome = (F.when(cls == "terminal", F.lit("done")).when(cls == "llm_error", F.lit("llm_error"))
               .when(cls == "exec_error_fatal", F.lit("executor_failed"))
               .when(cls == "failed_fatal", F.lit("code_failed"))
               .when(F.col("attempts") >= max_retries, F.lit("exhausted")).otherwise(F.lit("incomplete")))
    last_error = (F.when(cls == "llm_error", F.col("l.llm_error")).when(cls == "exec_error_fatal", F.col("l.exec_error"))
                  .when(cls == "failed_fatal", F.coalesce("l.stderr", F.lit(""))))
    message = (F.when(cls == "llm_error", F.format_string(fixed.ERR_LLM, F.col("attempts"), F.col("l.llm_error")))
               .when(cls == "exec_error_fatal", F.format_string(fixed.ERR_EXECUTOR, F.lit(max_retries), F.col("l.exec_error")))
               .when(cls == "failed_fatal", F.format_string(fixed.ERR_CODE, F.lit(max_retries), F.coalesce("l.stderr", F.lit(""))))
               .when(outcome == "exhausted", F.format_string(fixed.ERR_EXHAUSTED, F.lit(max_retries))))
    return g.select("run_id", outcome.alias("outcome"), F.col("attempts").cast("bigint").alias("attempts"),
                    F.col("l.successes").alias("steps_done"),
                    F.when(cls == "terminal", F.col("l.response")).alias("report"),
                    last_error.alias("last_error"), message.alias("error_message"))


def next_prompts(classified: DataFrame, max_steps: int = fixed.DEFAULT_MAX_STEPS) -> DataFrame:
    """Op 31: the user message the loop appends after each turn (none after
    the end); after a failed one with its stderr."""
    sc = F.col("successes_before").cast("int")
    err_text = F.coalesce("stderr", F.lit(""))
    n = sc + 1
    msg = (F.when(F.col("cls") == "guard", F.format_string(fixed.MSG_GUARD, F.lit(max_steps), sc, sc + 1))
           .when(F.col("cls") == "no_code", F.lit(fixed.MSG_NO_CODE))
           .when(F.col("cls") == "not_package", F.lit(fixed.MSG_NOT_PACKAGE))
           .when(F.col("cls") == "exec_error", F.format_string(fixed.MSG_EXEC_ERROR.replace("%s", "%s", 1),
                                                               F.col("exec_error")))
           .when(F.col("cls") == "failed", F.format_string(fixed.MSG_FAILED, err_text))
           .when((F.col("cls") == "success") & (n >= max_steps),
                 F.format_string(fixed.MSG_FINAL, n, F.col("stdout"), F.lit(max_steps)))
           .when(F.col("cls") == "success",
                 F.format_string(fixed.MSG_CONTINUE, n, F.lit(max_steps), F.col("stdout"), n + 1)))
    return (classified.select("run_id", "attempt", "cls", msg.alias("message"))
            .where(F.col("message").isNotNull()))


def generated_code(classified: DataFrame) -> DataFrame:
    """Op 32: code of each turn that passed the package check (the code
    callback fires before execution), with step = successes so far + 1 and
    ``Paso i`` = its order in the run."""
    valid = classified.where(F.col("cls").isin("exec_error", "exec_error_fatal", "failed", "failed_fatal",
                                               "success"))
    w = Window.partitionBy("run_id").orderBy("attempt")
    i = F.row_number().over(w)
    return valid.select("run_id", "attempt", (F.col("successes_before") + 1).alias("step"),
                        i.cast("bigint").alias("paso"), F.concat(F.lit("Paso "), i.cast("string")).alias("label"),
                        "code")


def _exact_percentiles(values: DataFrame, accuracy: int) -> DataFrame:
    """(run_id, p50, p95) of ``values(run_id, v)`` per run and, under a null run,
    overall: the value of rank ``ceil(p * n)``.  Per run the counted values are
    ranked.  Overall a mergeable sketch gives bounds some ten of its errors about
    each rank; below them values are only counted, and only the distinct
    values between them (some 20 / ``accuracy`` of all) are ranked in one task."""
    counted = values.groupBy("run_id", "v").agg(F.count(F.lit(1)).alias("n"))

    def reached(p, total):  # whether a running count has reached the rank
        return F.col("upto") >= F.greatest(F.lit(1), F.floor((total * p + 99) / 100))

    own = Window.partitionBy("run_id")
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.where(F.col("run_id").isNotNull()).withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(own))
    runs = ranked.groupBy("run_id").agg(*[F.min(F.when(reached(p, F.col("total")), F.col("v"))).alias(f"p{p}") for p in (50, 95)])
    bounds = [min(1.0, max(0.0, p / 100 + side * 10 / accuracy)) for p in (50, 95) for side in (-1, 1)]
    sketch = values.agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("v", bounds, accuracy).alias("b"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("b")[i].alias("lo"), F.col("b")[i + 1].alias("hi"))
                               for p, i in ((50, 0), (95, 2))])).alias("e")
    near = (counted.groupBy("v").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(sketch.select("total", each)))
            .where(F.col("v") <= F.col("e.hi"))
            .groupBy("e.p", "total", F.when(F.col("v") >= F.col("e.lo"), F.col("v")).alias("v")).agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy(F.col("v").asc_nulls_first())
                                                .rowsBetween(Window.unboundedPreceding, 0))))
    overall = near.where(reached(F.col("p"), F.col("total"))).groupBy().agg(
        *[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in (50, 95)])
    return runs.union(overall.select(F.lit(None).cast(values.schema["run_id"].dataType).alias("run_id"), "p50", "p95"))


def exec_stats(classified: DataFrame, accuracy: int = 100000) -> DataFrame:
    """Op 28: executed turns per run and overall (ROLLUP): success = exit 0;
    failure kinds; duration mean and p50 / p95, both of exact rank however
    many values there are.  ``accuracy`` is that of the sketch that narrows down
    the overall ranks; it does not change the answer."""
    ex = classified.where(F.col("cls").isin("exec_error", "exec_error_fatal", "failed", "failed_fatal",
                                            "success"))
    e = F.coalesce(F.col("exec_error"), F.lit(""))
    is_err = F.col("exec_error").isNotNull()
    aggs = [F.count(F.lit(1)).alias("n_exec"),
            F.count_if(~is_err & (F.col("exit_code") == 0)).alias("n_success"),
            F.count_if(is_err & e.contains("timeout")).alias("n_timeout"),
            F.count_if(is_err & e.contains("validación de seguridad")).alias("n_rejected"),
            F.count_if(is_err & ~e.contains("timeout") & ~e.contains("validación de seguridad")).alias("n_exec_error"),
            F.count_if(~is_err & (F.col("exit_code") != 0)).alias("n_exit_nonzero"),
            F.avg(F.when(~is_err, F.col("duration_s"))).alias("mean_duration_s")]
    timed = ex.where(~is_err & F.col("duration_s").isNotNull()).select("run_id", F.col("duration_s").alias("v"))
    ranks = _exact_percentiles(timed, accuracy).select(
        F.col("run_id").alias("_run"), F.col("p50").alias("p50_duration_s"), F.col("p95").alias("p95_duration_s"))
    r = ex.rollup("run_id").agg(*aggs)
    r = r.join(ranks, r["run_id"].eqNullSafe(ranks["_run"]), "left")
    return r.select(F.when(F.col("run_id").isNull(), F.lit("total")).otherwise(F.lit("run")).alias("level"),
                    "run_id", "n_exec", "n_success",
                    F.round(F.col("n_success") / F.col("n_exec"), 6).alias("success_rate"),
                    "n_timeout", "n_rejected", "n_exec_error", "n_exit_nonzero",
                    F.round("mean_duration_s", 6).alias("mean_duration_s"), "p50_duration_s", "p95_duration_s")


def effective_findings(classified: DataFrame) -> DataFrame:
    """Op 11: a run's findings: from the final report if it has any; else
    those gathered from every successful step's stdout in step order; else
    the strict parse of the report.  Three parsed sets, per-run existence
    flags, union and a filter by the first non-empty source."""
    done = F.max((F.col("cls") == "terminal").cast("int")).over(Window.partitionBy("run_id"))
    c = classified.withColumn("done", done)
    report = c.where(F.col("cls") == "terminal").select("run_id", "response")
    steps = c.where((F.col("cls") == "success") & (F.col("done") == 1)).select("run_id", "attempt", "stdout")
    from_report = extract.parse_findings(report, "response", ["run_id"]).withColumn("attempt", F.lit(None).cast("int"))
    from_steps = extract.parse_findings(steps, "stdout", ["run_id", "attempt"])
    strict = extract.parse_findings_strict(report, "response", ["run_id"]).withColumn("attempt", F.lit(None).cast("int"))
    cols = ["run_id", "attempt", "seq", "line", "severity", "type", "description", "code_snippet",
            "function", "complexity", "threshold", "status", "message"]
    allf = (from_report.select(F.lit(1).alias("src"), *cols)
            .unionByName(from_steps.select(F.lit(2).alias("src"), *cols))
            .unionByName(strict.select(F.lit(3).alias("src"), *cols)))
    best = F.min("src").over(Window.partitionBy("run_id"))
    srcname = F.when(F.col("src") == 1, F.lit("report")).when(F.col("src") == 2, F.lit("steps")).otherwise(F.lit("strict"))
    return (allf.withColumn("best", best).where(F.col("src") == F.col("best"))
            .select("run_id", srcname.alias("source"), F.col("attempt").cast("bigint").alias("attempt"), *cols[2:]))


# ---- conversations ---------------------------------------------------------------
def history_prefix(msgs: DataFrame, with_messages: bool = False) -> DataFrame:
    """Op 33: what the model saw at each turn: the messages up to and
    including it, their count and bytes.  The counts form is linear; the
    message list itself is quadratic per conversation, so it is opt-in."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.count(F.lit(1)).over(w).alias("n_messages"),
            F.sum(byte_len("text")).over(w).alias("bytes"),
            F.count_if(F.col("role") == "user").over(w).alias("n_user"),
            F.count_if(F.col("role") != "user").over(w).alias("n_assistant")]
    if with_messages:
        cols.append(F.collect_list(F.struct("turn", "role", "text")).over(w).alias("messages"))
    return msgs.select("conv_id", "turn", "role", *cols)


def history_sessions(msgs: DataFrame, is_clear: Column) -> DataFrame:
    """Op 34: history since the last clear.  A clear row opens a new session
    (running sum of the marks), then sessions are counted and sized."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    s = msgs.select("conv_id", "turn", "text", F.sum(is_clear.cast("int")).over(w).alias("session"))
    return (s.groupBy("conv_id", "session")
            .agg(F.count(F.lit(1)).alias("n_messages"), F.sum(byte_len("text")).alias("bytes"),
                 F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
            .select("conv_id", F.col("session").cast("bigint").alias("session"), "n_messages", "bytes",
                    "first_turn", "last_turn"))

"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their
DuckDB oracles.  Every query reads whole tables of ``sf_dir`` (or views
Spark derives from them) so its work grows with the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codesieve.operators import findings, mask, scans
from codesieve.plans import scan_oracles as so
from codesieve.sources.fixtures import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILE_KEYS = ["file_id", "repo", "path"]


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def masked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.mask_source(view(spark, sf_dir, "src_files"))


@register("mask_source", so.MASK)
def q_mask(spark, sf_dir):
    return masked_files(spark, sf_dir).select("file_id", "code_nc", "code_ns")


@register("sql_concat_scan", so.SQL_CONCAT)
def q_sql(spark, sf_dir):
    return scans.sql_concat_scan(masked_files(spark, sf_dir))


@register("credential_scan", so.CREDENTIAL)
def q_cred(spark, sf_dir):
    return scans.credential_scan(masked_files(spark, sf_dir))


@register("unsanitized_input_scan", so.UNSANITIZED)
def q_input(spark, sf_dir):
    return scans.unsanitized_input_scan(view(spark, sf_dir, "src_files"))


@register("taint_flow", so.TAINT)
def q_taint(spark, sf_dir):
    return scans.taint_flow(masked_files(spark, sf_dir))


@register("forbidden_call_scan", so.FORBIDDEN)
def q_forbidden(spark, sf_dir):
    return scans.forbidden_call_scan(masked_files(spark, sf_dir))


@register("first_violation", so.FIRST_VIOLATION)
def q_first(spark, sf_dir):
    return scans.first_violation(scans.forbidden_call_scan(masked_files(spark, sf_dir)))


@register("complexity", so.COMPLEXITY)
def q_complexity(spark, sf_dir):
    return scans.complexity(masked_files(spark, sf_dir))


@register("complexity_findings", so.COMPLEXITY_FINDINGS)
def q_cx_findings(spark, sf_dir):
    return scans.complexity_findings(scans.complexity(masked_files(spark, sf_dir)))


@register("code_policy_check", so.POLICY)
def q_policy(spark, sf_dir):
    return scans.code_policy_check(masked_files(spark, sf_dir))


@register("prompt_injection_files", so.INJECTION_FILES)
def q_inj_files(spark, sf_dir):
    return scans.prompt_injection_scan(view(spark, sf_dir, "src_files"), "code", ["file_id"])


@register("prompt_injection_conversations", so.INJECTION_CONV)
def q_inj_conv(spark, sf_dir):
    return scans.prompt_injection_scan(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


@register("audit", so.AUDIT_ALL)
def q_audit(spark, sf_dir):
    return findings.audit(view(spark, sf_dir, "src_files"), mode="all")


@register("risk_rollup", so.ROLLUP)
def q_rollup(spark, sf_dir):
    return findings.risk_rollup(findings.audit(view(spark, sf_dir, "src_files"), mode="all"))


@register("file_reports", so.REPORTS)
def q_reports(spark, sf_dir):
    return findings.file_reports(findings.audit(view(spark, sf_dir, "src_files"), mode="all"))


@register("worst_functions", so.WORST)
def q_worst(spark, sf_dir):
    return findings.worst_functions(scans.complexity(masked_files(spark, sf_dir), FILE_KEYS), k=5)


# ---- extraction, patches, turns, prompts, sources ------------------------------
from pyspark.sql import functions as F  # noqa: E402

from codesieve.operators import extract, patches, prompts, turns  # noqa: E402
from codesieve.plans import text_oracles as to  # noqa: E402
from codesieve.sources import files as srcs  # noqa: E402


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("extract_code", to.EXTRACT_CODE)
def q_extract(spark, sf_dir):
    t = view(spark, sf_dir, "agent_turns")
    return t.select("run_id", "attempt", extract.extract_code("response").alias("code"))


@register("parse_findings", to.PARSE_FINDINGS)
def q_parse(spark, sf_dir):
    return extract.parse_findings(view(spark, sf_dir, "agent_outputs"), "output", ["out_id"])


@register("parse_findings_strict", to.PARSE_FINDINGS_STRICT)
def q_parse_strict(spark, sf_dir):
    return extract.parse_findings_strict(view(spark, sf_dir, "agent_outputs"), "output", ["out_id"])


def _patches(spark, sf_dir):
    return extract.parse_patches(view(spark, sf_dir, "fix_reports"), "report", ["file_id"])


@register("parse_patches", to.PARSE_PATCHES)
def q_patches(spark, sf_dir):
    return _patches(spark, sf_dir)


@register("diff_rows", to.DIFF_ROWS)
def q_diff(spark, sf_dir):
    return patches.diff_rows(_patches(spark, sf_dir))


@register("apply_patches", _recursive(to.APPLY))
def q_apply(spark, sf_dir):
    return patches.apply_patches(view(spark, sf_dir, "src_files"), _patches(spark, sf_dir))


@register("patch_audit", _recursive(to.PATCH_AUDIT))
def q_patch_audit(spark, sf_dir):
    return patches.patch_audit(view(spark, sf_dir, "src_files"), _patches(spark, sf_dir))


def _classified(spark, sf_dir):
    return turns.classify_turns(view(spark, sf_dir, "agent_turns"))


@register("classify_turns", to.CLASSIFY)
def q_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("run_id", "attempt", "cls", "ok", "successes_before",
                                             "successes", "is_end")


@register("run_outcomes", to.OUTCOMES)
def q_outcomes(spark, sf_dir):
    return turns.run_outcomes(_classified(spark, sf_dir))


@register("next_prompts", to.NEXT)
def q_next(spark, sf_dir):
    return turns.next_prompts(_classified(spark, sf_dir))


@register("generated_code", to.GENERATED)
def q_generated(spark, sf_dir):
    return turns.generated_code(_classified(spark, sf_dir))


@register("exec_stats", to.EXEC_STATS)
def q_exec_stats(spark, sf_dir):
    return turns.exec_stats(_classified(spark, sf_dir))


@register("effective_findings", to.EFFECTIVE)
def q_effective(spark, sf_dir):
    return turns.effective_findings(_classified(spark, sf_dir))


@register("history_prefix", to.HISTORY)
def q_history(spark, sf_dir):
    return turns.history_prefix(table(spark, sf_dir, "conversations"))


@register("history_sessions", to.SESSIONS)
def q_sessions(spark, sf_dir):
    return turns.history_sessions(table(spark, sf_dir, "conversations"), F.col("turn") % 3 == 0)


@register("report_lines")
def q_report_lines(spark, sf_dir):
    return extract.report_lines(view(spark, sf_dir, "agent_turns"), "response", ["run_id", "attempt"])


@register("report_findings")
def q_report_findings(spark, sf_dir):
    reports = findings.file_reports(findings.audit(view(spark, sf_dir, "src_files"), mode="all"))
    return extract.report_findings(reports, "report", ["file_id"])


# ---- events, streams, sources, sinks ------------------------------------------------
from codesieve.plans import stream_oracles as sto  # noqa: E402
from codesieve.streaming import rate_limit as rl  # noqa: E402
from codesieve.streaming import streams  # noqa: E402


def _decoded(spark, sf_dir):
    return extract.decode_frames(view(spark, sf_dir, "sse_chunks"))


@register("rate_limit", sto.RATE_LIMIT)
def q_rate(spark, sf_dir):
    return rl.rate_limit(table(spark, sf_dir, "events"), limit=3, window_s=86400)


@register("decode_frames", sto.DECODE)
def q_decode(spark, sf_dir):
    return _decoded(spark, sf_dir)


@register("summary_view", sto.SUMMARY)
def q_summary(spark, sf_dir):
    return streams.summary_view(_decoded(spark, sf_dir), "summary")


@register("run_status", sto.RUN_STATUS)
def q_status(spark, sf_dir):
    return streams.run_status_agg(_decoded(spark, sf_dir))


@register("rate_limit_stream", sto.RATE_LIMIT)
def q_rate_stream(spark, sf_dir):
    """Op 43 over the events in five slices in order of time, each a micro-batch
    however many files it is written to, and a closing row that moves the
    watermark past the last."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    src, out, ckpt = (streams.scratch_dir(spark, x) for x in ("events", "out", "ckpt"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return rl.rate_limit(events, limit=3, window_s=86400)
    step = (hi - lo) // 5 + 1
    closing = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.timestamp_micros(F.lit(hi + 7_200_000_000))
                                    .cast("timestamp_ntz").alias("ts"), F.lit(None).cast("bigint").alias("user_id"))
    for rows in [*(events.where((at >= lo + k * step) & (at < lo + (k + 1) * step)) for k in range(5)), closing]:
        rows.write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        streams.run_available_now(streams.rate_limit_stream(stream, limit=3, window_s=86400, delay="1 hour", evict=True),
                                  out=out, ckpt=ckpt)
    return streams.numbered_windows(spark.read.parquet(out).where("event_id >= 0"))


def _in_three(spark, src):
    """A folder as a stream of three micro-batches, however many files it has."""
    rows = spark.read.parquet(src)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-len(rows.inputFiles()) // 3) or 1).parquet(src)


@register("decode_frames_stream", sto.DECODE)
def q_decode_stream(spark, sf_dir):
    """Op 45 over the chunks with their events' time, in three micro-batches."""
    chunks, src = view(spark, sf_dir, "sse_chunks"), streams.scratch_dir(spark, "chunks")
    chunks.write.parquet(src)
    stream = _in_three(spark, src)
    out = streams.run_available_now(streams.decode_frames_stream(stream, ts="ts", delay="3650 days"))
    return spark.read.parquet(out).drop("_batch")


@register("run_status_stream", sto.RUN_STATUS)
def q_status_stream(spark, sf_dir):
    src = streams.scratch_dir(spark, "decoded")
    _decoded(spark, sf_dir).write.parquet(src)
    stream = _in_three(spark, src)
    out = streams.run_available_now(streams.run_status_stream(stream), mode="update")
    last = F.max_by(F.struct("*"), "_batch").alias("r")
    return spark.read.parquet(out).groupBy("run_id").agg(last).select("r.*").drop("_batch")


@register("admit_requests", sto.ADMIT)
def q_admit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return srcs.admit_requests(docs, "text", max_bytes=20000).select("doc_id", "body_bytes", "reason", "accepted")


@register("encode_frames", sto.ENCODE)
def q_encode(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    t = ev["event_type"]
    typ = (F.when(t == "purchase", "done").when(t == "signup", "code_generated").when(t == "error", "error")
           .when(t == "view", "progress").otherwise("step_start"))
    rows = ev.select("event_id", typ.alias("type"), F.col("props").alias("message"), F.col("props").alias("report"),
                     F.col("props").alias("code"), F.lit(None).cast("string").alias("fixed_code"),
                     F.lit(None).cast("string").alias("patches_json"), F.lit(None).cast("string").alias("findings_json"))
    return srcs.encode_frames(rows).select("event_id", "frame")


@register("mask_secrets", sto.MASK_SECRETS)
def q_mask_secrets(spark, sf_dir):
    return patches.mask_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@register("findings_jsonl", so.json_lines(to.PARSE_FINDINGS))
def q_jsonl(spark, sf_dir):
    pf = extract.parse_findings(view(spark, sf_dir, "agent_outputs"), "output", ["out_id"])
    return pf.select("out_id", "seq", srcs.findings_json(pf).alias("json"))


@register("load_sources")
def q_load(spark, sf_dir):
    return srcs.load_sources(spark, f"{sf_dir}/documents.parquet",
                             columns={"file_id": "doc_id", "repo": "source", "code": "text"})


@register("build_prompts")
def q_prompts(spark, sf_dir):
    return prompts.build_prompts(view(spark, sf_dir, "src_files"), "security")


@register("build_analyze_prompts")
def q_analyze_prompts(spark, sf_dir):
    return prompts.build_prompts(view(spark, sf_dir, "src_files"), "analyze")


@register("build_fix_prompts", so.FIX_PROMPTS)
def q_fix_prompts(spark, sf_dir):
    files = view(spark, sf_dir, "src_files")
    return prompts.build_fix_prompts(files, findings.audit(files, mode="security"))


@register("conversation_messages")
def q_conv_messages(spark, sf_dir):
    return prompts.conversation_messages(table(spark, sf_dir, "conversations"))


@register("credential_scan_documents", so.CREDENTIAL_DOCUMENTS)
def q_cred_docs(spark, sf_dir):
    return scans.credentials_in_text(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@register("propose_fixes")
def q_propose(spark, sf_dir):
    m = masked_files(spark, sf_dir)
    lines = mask.source_lines(m).where(F.col("ns").rlike(r"\bexec\.Command"))
    calls = lines.select("file_id", F.col("line_no").alias("line"), srcs_trim("raw").alias("text"))
    return patches.propose_fixes(scans.credential_scan(m), scans.sql_concat_scan(m), calls)


def srcs_trim(c):
    from codesieve.functions.text import go_trim
    return go_trim(c)


_SEV = "lower(coalesce(severity, ''))"
_NORM = (f"CASE {_SEV} WHEN 'crítico' THEN 'critical' WHEN 'critico' THEN 'critical' WHEN 'alto' THEN 'high' "
         f"WHEN 'medio' THEN 'medium' WHEN 'aceptable' THEN 'medium' WHEN 'bajo' THEN 'low' "
         f"ELSE coalesce(nullif({_SEV}, ''), 'low') END")
_KIND = ("CASE WHEN function IS NOT NULL AND complexity IS NOT NULL THEN 'complexity' "
         "WHEN status IS NOT NULL AND message IS NOT NULL THEN 'check' ELSE 'security' END")
CLASSIFY_FINDINGS_SQL = f"""SELECT *, {_NORM} AS severity_norm, {_KIND} AS kind,
  CASE WHEN {_KIND} = 'check' THEN CASE WHEN status = 'success' THEN 'ok' ELSE 'critical' END ELSE {_NORM} END AS css,
  CASE WHEN {_KIND} = 'check' THEN CASE WHEN status = 'success' THEN 'OK' ELSE 'ERROR' END
       ELSE upper(coalesce(nullif(severity, ''), {_NORM})) END AS badge,
  CASE WHEN {_KIND} = 'complexity' THEN function || '() — complejidad ' || CAST(complexity AS VARCHAR)
       WHEN {_KIND} = 'check' THEN coalesce(nullif(message, ''), type)
       ELSE coalesce(nullif(type, ''), 'Hallazgo') END AS title,
  CASE WHEN {_KIND} = 'complexity' THEN 'Umbral recomendado: ' || CAST(coalesce(nullif(threshold, 0), 10) AS VARCHAR)
       WHEN {_KIND} = 'security' THEN nullif(description, '') END AS detail,
  CASE WHEN {_KIND} = 'security' AND coalesce(line, 0) <> 0 THEN 'Línea ' || CAST(line AS VARCHAR) END AS line_label
FROM ({to.PARSE_FINDINGS}) pf"""


@register("classify_findings", CLASSIFY_FINDINGS_SQL)
def q_classify_findings(spark, sf_dir):
    pf = extract.parse_findings(view(spark, sf_dir, "agent_outputs"), "output", ["out_id"])
    return findings.classify_findings(pf)


# oracles for the simple rows-only entries
from codesieve.functions import tasks as _tasks  # noqa: E402
from codesieve.plans.duck import q as _q  # noqa: E402
from codesieve.sources.fixtures import SRC_FILES_SQL  # noqa: E402
from codesieve.functions.fixed import TERMINATION_SIGNAL as fixed_signal  # noqa: E402

ORACLES["load_sources"] = ("SELECT CAST(doc_id AS BIGINT) AS file_id, source AS repo, printf('src/f%d.go', doc_id) AS path, "
                           "text AS code FROM documents")
ORACLES["conversation_messages"] = (
    "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, "
    "CAST(to_json(list({'role': CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, 'content': text} "
    "ORDER BY turn)) AS VARCHAR) AS messages_json FROM conversations GROUP BY conv_id")


def _prompts_sql(system: str, task: str) -> str:
    return (f"WITH src_files AS ({SRC_FILES_SQL}) SELECT file_id, '{system}' AS system_prompt, replace(" + _q(task) + ", '%s', code) AS task, "
            "CAST(3 AS BIGINT) AS max_steps, " + _q(fixed_signal) + " AS termination_signal, "
            "contains(code, '---CODE_START---') OR contains(code, '---CODE_END---') AS code_has_delimiter FROM src_files")


ORACLES["build_prompts"] = _prompts_sql("security", _tasks.SECURITY_TASK)
ORACLES["build_analyze_prompts"] = _prompts_sql("system", _tasks.ANALYZE_TASK)

"""DuckDB oracles for extraction, turns, patches, prompts and sources."""

from __future__ import annotations

from codesieve.functions import fixed
from codesieve.plans.duck import TOKEN_RE2, WS, cte, gotrim, q, view

STR_FIELDS = ["severity", "type", "description", "code_snippet", "function", "status", "message"]
INT_FIELDS = ["line", "complexity", "threshold"]
ORDER = ["line", "severity", "type", "description", "code_snippet", "function", "complexity", "threshold",
         "status", "message"]


def _key(t: str, f: str) -> str:
    return (f"coalesce(CASE WHEN list_contains(json_keys({t}), {q(f)}) THEN {q(f)} END, "
            f"list_filter(json_keys({t}), lambda k: lower(k) = {q(f)})[1])")


def _path(t: str, f: str) -> str:
    return f"'$.\"' || {_key(t, f)} || '\"'"


def _jt(t: str, f: str) -> str:
    return f"coalesce(json_type({t}, {_path(t, f)}), 'ABSENT')"


def json_finding_select(t: str) -> str:
    """Columns of a finding parsed from JSON text ``t`` plus an ``ok`` flag."""
    checks = [f"{_jt(t, f)} IN ('ABSENT', 'NULL', 'VARCHAR')" for f in STR_FIELDS]
    checks += [f"({_jt(t, f)} IN ('ABSENT', 'NULL') OR ({_jt(t, f)} IN ('BIGINT', 'UBIGINT') "
               f"AND TRY_CAST(json_extract_string({t}, {_path(t, f)}) AS BIGINT) IS NOT NULL))" for f in INT_FIELDS]
    ok = f"(json_valid({t}) AND json_type({t}) = 'OBJECT' AND " + " AND ".join(checks) + ")"
    cols = []
    for f in ORDER:
        if f in STR_FIELDS:
            cols.append(f"CASE WHEN {_jt(t, f)} = 'VARCHAR' THEN json_extract_string({t}, {_path(t, f)}) END AS {f}")
        else:
            cols.append(f"CASE WHEN {_jt(t, f)} IN ('BIGINT', 'UBIGINT') THEN "
                        f"CAST(json_extract_string({t}, {_path(t, f)}) AS BIGINT) END AS {f}")
    return f"{ok} AS ok, " + ", ".join(cols)


def finding_lines(src: str, keys: str, text_expr: str) -> str:
    """Rows (keys, seq, t) of the trimmed lines of ``text_expr`` that start with '{'."""
    return f"""SELECT {keys}, seq, t FROM (
      SELECT {keys}, unnest(generate_series(0, len(ls) - 1)) AS seq, unnest(ls) AS raw
      FROM (SELECT {keys}, string_split({text_expr}, chr(10)) AS ls FROM {src}))
    CROSS JOIN LATERAL (SELECT {gotrim('raw')} AS t) WHERE starts_with(t, '{{')"""


def parsed(src: str, keys: str, text_expr: str, extra: str = "") -> str:
    return f"""SELECT {keys}, CAST(seq AS BIGINT) AS seq, {', '.join(ORDER)} FROM (
      SELECT {keys}, seq, {json_finding_select('t')} FROM ({finding_lines(src, keys, text_expr)}))
    WHERE ok {extra}"""


HEAD = f"split_part(output, {q(fixed.FINDINGS_END)}, 1)"
PARSE_FINDINGS = cte(view("agent_outputs")) + parsed("agent_outputs", "out_id", HEAD)
STRICT_TEXT = (f"array_to_string(list_slice(string_split(output, chr(10)), 1, coalesce(nullif(list_position("
               f"list_transform(string_split(output, chr(10)), lambda l: {gotrim('l')} = {q(fixed.FINDINGS_END)}), true), 0) - 1, 1000000000)), chr(10))")
PARSE_FINDINGS_STRICT = cte(view("agent_outputs")) + parsed(
    "agent_outputs", "out_id", STRICT_TEXT, "AND coalesce(severity, '') <> '' AND coalesce(type, '') <> ''")

# ---- op 8 -----------------------------------------------------------------
def _block(m: str) -> str:
    at = f"instr(response, {q(m)})"
    after = f"({at} + {len(m)})"
    nl = f"instr(substr(response, {after}), chr(10))"
    start = f"(CASE WHEN {nl} > 0 THEN {after} + {nl} ELSE {after} END)"
    end = f"instr(substr(response, {start}), '```')"
    return at, start, end


def _extract_expr() -> str:
    parts = []
    for m in fixed.GO_FENCES:
        at, start, end = _block(m)
        parts.append(f"CASE WHEN {at} > 0 AND {end} > 0 THEN {gotrim(f'substr(response, {start}, {end} - 1)')} END")
    at, start, end = _block("```")
    parts.append(f"CASE WHEN {at} = 0 THEN '' WHEN {end} = 0 THEN {gotrim(f'substr(response, {start})')} "
                 f"ELSE {gotrim(f'substr(response, {start}, {end} - 1)')} END")
    return "coalesce(" + ", ".join(parts) + ")"


EXTRACT = _extract_expr()
EXTRACT_CODE = cte(view("agent_turns")) + f"SELECT run_id, attempt, {EXTRACT} AS code FROM agent_turns"

# ---- op 12 / 38 -------------------------------------------------------------
PATCH_BLOCKS = f"""pb AS (
  SELECT file_id, seq, CASE WHEN instr(block, {q(fixed.FIX_END)}) > 0 THEN substr(block, 1, instr(block, {q(fixed.FIX_END)}) - 1) END AS body
  FROM (SELECT file_id, unnest(generate_series(0, len(bl) - 1)) AS seq, unnest(bl) AS block
        FROM (SELECT file_id, string_split(report, {q(fixed.FIX_START)}) AS bl FROM fix_reports)) WHERE seq > 0),
pp AS (
  SELECT file_id, CAST(seq AS BIGINT) AS seq,
    {gotrim("substr(body, instr(body, 'ORIGINAL:' || chr(10)) + 10, instr(body, 'FIXED:' || chr(10)) - instr(body, 'ORIGINAL:' || chr(10)) - 10)")} AS original,
    {gotrim("substr(body, instr(body, 'FIXED:' || chr(10)) + 7)")} AS fixed
  FROM pb WHERE body IS NOT NULL AND instr(body, 'ORIGINAL:' || chr(10)) > 0 AND instr(body, 'FIXED:' || chr(10)) > 0
    AND instr(body, 'FIXED:' || chr(10)) >= instr(body, 'ORIGINAL:' || chr(10)) + 10),
patches AS (SELECT * FROM pp WHERE original <> '' AND fixed <> '')"""
PARSE_PATCHES = cte(view("fix_reports"), PATCH_BLOCKS) + "SELECT file_id, seq, original, fixed FROM patches"
DIFF_ROWS = cte(view("fix_reports"), PATCH_BLOCKS) + """
SELECT file_id, seq, 0 AS k, '-' AS sign, '- ' || original AS text FROM patches
UNION ALL SELECT file_id, seq, 1, '+', '+ ' || fixed FROM patches"""

# ---- op 36 / 37 -------------------------------------------------------------
REPLACE1 = ("CASE WHEN length(p.original) = 0 THEN p.fixed || acc WHEN instr(acc, p.original) = 0 THEN acc "
            "ELSE substr(acc, 1, instr(acc, p.original) - 1) || p.fixed || substr(acc, instr(acc, p.original) + length(p.original)) END")
APPLY = cte(view("src_files"), view("fix_reports"), PATCH_BLOCKS) + f"""
, pl AS (SELECT file_id, list({{'seq': seq, 'original': original, 'fixed': fixed}} ORDER BY seq) AS ps FROM patches GROUP BY file_id),
steps AS (
  SELECT f.file_id, f.code, coalesce(pl.ps, []) AS ps FROM src_files f LEFT JOIN pl USING (file_id)),
rec AS (
  SELECT file_id, code, ps, 0 AS i, code AS acc, 0 AS n FROM steps
  UNION ALL
  SELECT file_id, code, ps, i + 1, (SELECT {REPLACE1} FROM (SELECT ps[i + 1] AS p)),
    n + (SELECT CASE WHEN instr(acc, p.original) > 0 THEN 1 ELSE 0 END FROM (SELECT ps[i + 1] AS p))
  FROM rec WHERE i < len(ps))
SELECT file_id, acc AS fixed_code, CAST(len(ps) AS BIGINT) AS n_patches, CAST(n AS BIGINT) AS n_applied, acc <> code AS changed
FROM rec WHERE i = len(ps)"""

OCC = "CASE WHEN length(p.original) = 0 THEN 0 ELSE (length(acc) - length(replace(acc, p.original, ''))) // length(p.original) END"
# Braces outside comments and literals.
BARE = f"""array_to_string(list_filter(regexp_extract_all(acc, {q(TOKEN_RE2)}), lambda t: NOT (t LIKE '//%' OR t LIKE '/*%'
    OR (length(t) >= 2 AND left(t, 1) IN ('"', '`', '\'\'')))), '')"""
bare = lambda ch: f"length({BARE}) - length(replace({BARE}, {q(ch)}, ''))"
PATCH_AUDIT = cte(view("src_files"), view("fix_reports"), PATCH_BLOCKS) + f"""
, pl AS (SELECT file_id, list({{'seq': seq, 'original': original, 'fixed': fixed}} ORDER BY seq) AS ps FROM patches GROUP BY file_id),
rec AS (
  SELECT f.file_id, pl.ps, 0 AS i, f.code AS acc, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS found,
    CAST(NULL AS BIGINT) AS occurrences, CAST(NULL AS BOOLEAN) AS changed, CAST(NULL AS VARCHAR) AS prev
  FROM src_files f JOIN pl USING (file_id)
  UNION ALL
  SELECT file_id, ps, i + 1, (SELECT {REPLACE1} FROM (SELECT ps[i + 1] AS p)),
    ps[i + 1].seq, instr(acc, ps[i + 1].original) > 0,
    (SELECT {OCC} FROM (SELECT ps[i + 1] AS p)), NULL, acc
  FROM rec WHERE i < len(ps))
SELECT file_id, seq, found, CAST(occurrences AS BIGINT) AS occurrences, acc <> prev AS changed,
  {bare('{')} = {bare('}')} AS balanced,
  starts_with({gotrim('acc')}, 'package') AS starts_package,
  bool_and(found) OVER (PARTITION BY file_id) AS all_applied
FROM rec WHERE i > 0"""

# ---- ops 28-32, 11 ------------------------------------------------------------
TURNS = f"""t0 AS (SELECT *, {EXTRACT} AS code FROM agent_turns WHERE attempt <= 10),
t1 AS (SELECT *, contains(response, {q(fixed.FINDINGS_END)}) AS mk,
  (contains(response, {q(fixed.TERMINATION_SIGNAL)}) AND NOT contains(response, '```go')
   AND NOT contains(response, 'package main') AND strlen({gotrim('response')}) > 50) AS txt FROM t0),
t2 AS (SELECT *, (llm_error IS NULL AND NOT mk AND NOT txt AND code <> '' AND starts_with(code, 'package') AND exec_error IS NULL
                  AND exit_code = 0) AS ok FROM t1),
t3 AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY run_id ORDER BY attempt
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sc FROM t2),
t4 AS (SELECT *, CASE WHEN llm_error IS NOT NULL THEN 'llm_error' WHEN mk AND sc < 3 THEN 'guard' WHEN mk OR txt THEN 'terminal' WHEN code = '' THEN 'no_code'
    WHEN NOT starts_with(code, 'package') THEN 'not_package'
    WHEN exec_error IS NOT NULL THEN CASE WHEN attempt = 10 THEN 'exec_error_fatal' ELSE 'exec_error' END
    WHEN exit_code <> 0 THEN CASE WHEN attempt = 10 THEN 'failed_fatal' ELSE 'failed' END
    ELSE 'success' END AS cls FROM t3),
t5 AS (SELECT *, min(CASE WHEN cls IN ('terminal', 'llm_error', 'exec_error_fatal', 'failed_fatal') THEN attempt END)
         OVER (PARTITION BY run_id) AS end_attempt FROM t4),
ct AS (SELECT * FROM t5 WHERE end_attempt IS NULL OR attempt <= end_attempt)"""
TURNS_CTE = cte(view("agent_turns"), TURNS)
CLASSIFY = TURNS_CTE + """SELECT run_id, attempt, cls, ok, CAST(sc AS BIGINT) AS successes_before,
  CAST(sc + CAST(ok AS INT) AS BIGINT) AS successes, coalesce(attempt = end_attempt, false) AS is_end FROM ct"""
OUTCOMES = TURNS_CTE + """SELECT run_id,
  CASE l.cls WHEN 'terminal' THEN 'done' WHEN 'llm_error' THEN 'llm_error' WHEN 'exec_error_fatal' THEN 'executor_failed'
    WHEN 'failed_fatal' THEN 'code_failed' ELSE CASE WHEN attempts >= 10 THEN 'exhausted' ELSE 'incomplete' END END AS outcome,
  CAST(attempts AS BIGINT) AS attempts, CAST(l.successes AS BIGINT) AS steps_done,
  CASE WHEN l.cls = 'terminal' THEN l.response END AS report,
  CASE l.cls WHEN 'llm_error' THEN l.llm_error WHEN 'exec_error_fatal' THEN l.exec_error WHEN 'failed_fatal' THEN l.stderr END AS last_error,
  CASE l.cls WHEN 'llm_error' THEN 'error consultando LLM en intento ' || attempts || ': ' || l.llm_error
    WHEN 'exec_error_fatal' THEN 'executor falló después de 10 intentos: ' || l.exec_error
    WHEN 'failed_fatal' THEN 'código generado falló después de 10 intentos.' || chr(10) || 'Último error:' || chr(10) || l.stderr
    WHEN 'terminal' THEN NULL ELSE CASE WHEN attempts >= 10 THEN 'se agotaron los 10 reintentos sin completar el análisis' END END AS error_message
FROM (SELECT run_id, arg_max({'cls': cls, 'response': response, 'exec_error': exec_error, 'llm_error': llm_error, 'stderr': stderr,
        'successes': sc + CAST(ok AS INT)}, attempt) AS l, max(attempt) AS attempts FROM ct GROUP BY run_id)"""
NEXT = TURNS_CTE + f"""SELECT run_id, attempt, cls, message FROM (SELECT run_id, attempt, cls, CASE
  WHEN cls = 'guard' THEN printf({q(fixed.MSG_GUARD)}, 3, sc, sc + 1)
  WHEN cls = 'no_code' THEN {q(fixed.MSG_NO_CODE)}
  WHEN cls = 'not_package' THEN {q(fixed.MSG_NOT_PACKAGE)}
  WHEN cls = 'exec_error' THEN printf({q(fixed.MSG_EXEC_ERROR)}, exec_error)
  WHEN cls = 'failed' THEN printf({q(fixed.MSG_FAILED)}, stderr)
  WHEN cls = 'success' AND sc + 1 >= 3 THEN printf({q(fixed.MSG_FINAL)}, sc + 1, stdout, 3)
  WHEN cls = 'success' THEN printf({q(fixed.MSG_CONTINUE)}, sc + 1, 3, stdout, sc + 2) END AS message FROM ct)
WHERE message IS NOT NULL"""
GENERATED = TURNS_CTE + """SELECT run_id, attempt, CAST(sc + 1 AS BIGINT) AS step, CAST(rn AS BIGINT) AS paso, 'Paso ' || CAST(rn AS VARCHAR) AS label, code
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt) AS rn FROM ct
      WHERE cls IN ('exec_error', 'exec_error_fatal', 'failed', 'failed_fatal', 'success'))"""
OK_D = "exec_error IS NULL"
EXEC_STATS = TURNS_CTE + f"""SELECT CASE WHEN GROUPING(run_id) = 1 THEN 'total' ELSE 'run' END AS level, run_id,
  count(*) AS n_exec, count(*) FILTER (WHERE {OK_D} AND exit_code = 0) AS n_success,
  round(count(*) FILTER (WHERE {OK_D} AND exit_code = 0) / count(*), 6) AS success_rate,
  count(*) FILTER (WHERE exec_error IS NOT NULL AND contains(exec_error, 'timeout')) AS n_timeout,
  count(*) FILTER (WHERE exec_error IS NOT NULL AND contains(exec_error, 'validación de seguridad')) AS n_rejected,
  count(*) FILTER (WHERE exec_error IS NOT NULL AND NOT contains(exec_error, 'timeout') AND NOT contains(exec_error, 'validación de seguridad')) AS n_exec_error,
  count(*) FILTER (WHERE {OK_D} AND exit_code <> 0) AS n_exit_nonzero,
  round(avg(duration_s) FILTER (WHERE {OK_D}), 6) AS mean_duration_s,
  list_sort(list(duration_s) FILTER (WHERE {OK_D}))[greatest(1, CAST(ceil(0.5 * count(*) FILTER (WHERE {OK_D})) AS BIGINT))] AS p50_duration_s,
  list_sort(list(duration_s) FILTER (WHERE {OK_D}))[greatest(1, CAST(ceil(0.95 * count(*) FILTER (WHERE {OK_D})) AS BIGINT))] AS p95_duration_s
FROM ct WHERE cls IN ('exec_error', 'exec_error_fatal', 'failed', 'failed_fatal', 'success')
GROUP BY ROLLUP (run_id)"""
EFFECTIVE = TURNS_CTE + f""", done AS (SELECT DISTINCT run_id FROM ct WHERE cls = 'terminal'),
rep AS (SELECT run_id, response FROM ct WHERE cls = 'terminal'),
stp AS (SELECT run_id, attempt, stdout FROM ct WHERE cls = 'success' AND run_id IN (SELECT run_id FROM done)),
a AS (
  SELECT 1 AS src, run_id, CAST(NULL AS INT) AS attempt, * EXCLUDE (run_id) FROM ({parsed('rep', 'run_id', f"split_part(response, {q(fixed.FINDINGS_END)}, 1)")})
  UNION ALL SELECT 2, run_id, attempt, * EXCLUDE (run_id, attempt) FROM ({parsed('stp', 'run_id, attempt', 'stdout')})
  UNION ALL SELECT 3, run_id, CAST(NULL AS INT), * EXCLUDE (run_id) FROM ({parsed('rep', 'run_id', STRICT_TEXT.replace('output', 'response'), "AND coalesce(severity, '') <> '' AND coalesce(type, '') <> ''")}))
SELECT run_id, CASE src WHEN 1 THEN 'report' WHEN 2 THEN 'steps' ELSE 'strict' END AS source, CAST(attempt AS BIGINT) AS attempt,
  seq, {', '.join(ORDER)}
FROM (SELECT *, min(src) OVER (PARTITION BY run_id) AS best FROM a) WHERE src = best"""

# ---- ops 33, 34 -------------------------------------------------------------
HISTORY = """SELECT conv_id, turn, role,
  count(*) OVER w AS n_messages, sum(strlen(text)) OVER w AS bytes,
  count(*) FILTER (WHERE role = 'user') OVER w AS n_user, count(*) FILTER (WHERE role <> 'user') OVER w AS n_assistant
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
SESSIONS = """SELECT conv_id, CAST(session AS BIGINT) AS session, count(*) AS n_messages, sum(strlen(text)) AS bytes,
  min(turn) AS first_turn, max(turn) AS last_turn
FROM (SELECT *, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM conversations)
GROUP BY conv_id, session"""

# ---- ops 14, 15 -------------------------------------------------------------
# (report_lines on agent_turns responses; report_findings on file reports)

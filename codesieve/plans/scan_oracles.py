"""DuckDB oracles for the code scans and the finding algebra (ops 6, 7,
16-27, 35).  Written as plain SQL over the same views; where Spark uses
array expressions inside a row, these use windows, unnests and joins."""

from __future__ import annotations

from codesieve.functions import fixed, tasks
from codesieve.plans.duck import LINES, MASKED, cte, gotrim, q, view

NULL_S, NULL_I = "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"


def fcols(line=NULL_I, severity=NULL_S, type_=NULL_S, description=NULL_S, code_snippet=NULL_S,
          function=NULL_S, complexity=NULL_I, threshold=NULL_I, status=NULL_S, message=NULL_S) -> str:
    return (f"CAST({line} AS BIGINT) AS line, {severity} AS severity, {type_} AS type, "
            f"{description} AS description, {code_snippet} AS code_snippet, {function} AS function, "
            f"CAST({complexity} AS BIGINT) AS complexity, CAST({threshold} AS BIGINT) AS threshold, "
            f"{status} AS status, {message} AS message")


BASE = cte(view("src_files"), MASKED, LINES)

# ---- op 16 ----------------------------------------------------------------
MASK = BASE + "SELECT file_id, code_nc, code_ns FROM masked"

# ---- op 17 ----------------------------------------------------------------
LINE_TOKENS = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"|`[^`]*`|'[^'\\]*(?:\\.[^'\\]*)*'|[^"'`]+|["'`])"""
SQL_WORDS = "|".join(fixed.SQL_KEYWORDS)
JOINED_LITERAL = f"""len(list_filter(generate_series(1, len(tk)), lambda i: regexp_matches(tk[i], '^["`]') AND regexp_matches(tk[i], {q(SQL_WORDS)})
      AND (coalesce(regexp_matches(tk[i - 1], {q(r'(^|[^+])\+\s*$')}), false)
           OR coalesce(regexp_matches(tk[i + 1], {q(r'^\s*\+([^+=]|$)')}), false)))) > 0"""
SQL_LINES = f"""sqll AS (
  SELECT * FROM (SELECT *, regexp_extract_all(nc, {q(LINE_TOKENS)}) AS tk FROM lines
                 WHERE contains(ns, '+') AND regexp_matches(ns, '["`]'))
  WHERE {JOINED_LITERAL})"""
# Operand chains: lines that end in + or = go on; a chain ends at a separator or an opening bracket of its own level.
CHAIN_TOKENS = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"|`[^`]*`|'[^'\\]*(?:\\.[^'\\]*)*'|&&|\|\||[=!<>]=|[(\[{)\]},;:=<>]|[^"'`()\[\]{},;:=<>&|!]+|["'`&|!])"""
GROUPS = rf"""going AS (
  SELECT *, regexp_matches(ns, '[+=]\s*$') AND NOT regexp_matches(ns, '\+\+\s*$') AS goes_on FROM lines),
grouped AS (
  SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS grp
  FROM (SELECT *, coalesce(lag(goes_on) OVER (PARTITION BY file_id ORDER BY line_no), false) AS before FROM going)),
logical AS (
  SELECT file_id, repo, path, grp, min(line_no) AS first, string_agg(nc, chr(10) ORDER BY line_no) AS nc, string_agg(ns, chr(10) ORDER BY line_no) AS ns
  FROM grouped GROUP BY ALL)"""
CHAINS = GROUPS + rf""",
tokens AS (
  SELECT file_id, grp, first, i, tk[i] AS t, coalesce(tk[i - 1], '') AS prior, coalesce(tk[i + 1], '') AS following
  FROM (SELECT *, unnest(generate_series(1, len(tk))) AS i
        FROM (SELECT *, regexp_extract_all(nc, {q(CHAIN_TOKENS)}) AS tk FROM logical WHERE contains(ns, '+') AND regexp_matches(nc, {q(SQL_WORDS)})))),
levels AS (
  SELECT *, sum(CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY file_id, grp ORDER BY i) AS depth,
    sum(length(t) - length(replace(t, chr(10), ''))) OVER (PARTITION BY file_id, grp ORDER BY i) - (length(t) - length(replace(t, chr(10), ''))) AS breaks FROM tokens),
bounds AS (SELECT * FROM levels WHERE t IN ('(', '[', '{{', ',', ';', ':', '=', '==', '!=', '<=', '>=', '<', '>', '&&', '||')),
hit AS (
  SELECT file_id, grp, first, i, depth FROM levels
  WHERE regexp_matches(t, '^["`]') AND regexp_matches(t, {q(SQL_WORDS)})
    AND (regexp_matches(prior, {q(r'(^|[^+])\+\s*$')}) OR regexp_matches(following, {q(r'^\s*\+([^+=]|$)')}))),
chained AS (
  SELECT DISTINCT h.file_id, h.grp, h.first, coalesce((SELECT max(b.i) FROM bounds b WHERE b.file_id = h.file_id AND b.grp = h.grp
    AND b.i < h.i AND b.depth <= h.depth), 0) AS since FROM hit h),
sqll AS (
  SELECT l.file_id, l.repo, l.path, l.line_no, l.raw
  FROM (SELECT c.file_id, c.grp, c.since, c.first + min(v.breaks + length(regexp_extract(v.t, '^\s*')) - length(replace(regexp_extract(v.t, '^\s*'), chr(10), ''))) AS line_no
        FROM chained c JOIN levels v ON v.file_id = c.file_id AND v.grp = c.grp AND v.i > c.since AND regexp_matches(v.t, '\S')
        GROUP BY c.file_id, c.grp, c.since, c.first) p JOIN lines l USING (file_id, line_no))"""
SQL_SELECT = (f"SELECT file_id, repo, path, {fcols(line='line_no', severity=q(fixed.SEV_CRITICAL), type_=q('SQL_INJECTION'), description=q(fixed.SQL_DESCRIPTION), code_snippet=gotrim('raw'))} FROM sqll")
SQL_CONCAT = cte(view("src_files"), MASKED, LINES, CHAINS) + \
    f"SELECT file_id, {fcols(line='line_no', severity=q(fixed.SEV_CRITICAL), type_=q('SQL_INJECTION'), description=q(fixed.SQL_DESCRIPTION), code_snippet=gotrim('raw'))} FROM sqll"

# ---- op 18 ----------------------------------------------------------------
IDLIST = r"[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*"
DECL_RE2 = rf"^(\s*(?:var|const)\s+)({IDLIST})(\s*[^=]*?=)([^=].*|)$"
PLAIN_RE2 = rf"^(\s*)({IDLIST})(\s*:?=)([^=].*|)$"
ELEM_TOKENS = (r"""(?:"(?:[^"\\]|\\.)*"|`[^`]*`|'(?:[^'\\]|\\.)*'|\((?:[^()"]|"(?:[^"\\]|\\.)*")*\)|"""
               r"""\[[^\[\]]*\]|\{[^{}]*\}|[^,"`'()\[\]{}]+|,|.)""")
KW_LIST = "[" + ", ".join(q(k) for k in fixed.CREDENTIAL_KEYWORDS) + "]"
LITERAL_RE2 = r'^\s*("(?:[^"\\]|\\.)*"|`[^`]*`)\s*(?:[;})]|$)'
PLAIN_HEAD = rf"(?:^|[;{{}}(:]|\b(?:if|for|switch|else)\b)\s*({IDLIST})\s*$"
DECL_HEAD = rf"(?:^|[;{{}}(:]|\b(?:if|for|switch|else)\b)\s*(?:var|const)\s+({IDLIST})(?:\s[^=;]*)?$"
STATEMENT_END = rf"((?:(?:var|const)\s+{IDLIST}(?:\s[^=;]*)?|{IDLIST})\s*)$"
# Every ``=`` that assigns, with the text before it and behind it; the names stand between a place where a statement may start and it.
CRED_LINES = rf"""eqs AS (
  SELECT *, regexp_replace(substr(ns, 1, p - 1), ':$', '') AS head, substr(nc, p + 1) AS tail
  FROM (SELECT *, unnest(generate_series(1, length(ns))) AS p FROM logical WHERE contains(ns, '='))
  WHERE substr(ns, p, 1) = '=' AND substr(ns, p + 1, 1) <> '=' AND (p = 1 OR NOT contains('=!<>+-*/%&|^', substr(ns, p - 1, 1)))),
asg AS (
  SELECT *, string_split_regex(CASE WHEN regexp_matches(head, {q(DECL_HEAD)}) THEN regexp_extract(head, {q(DECL_HEAD)}, 1)
      ELSE regexp_extract(head, {q(PLAIN_HEAD)}, 1) END, '\s*,\s*') AS names,
    substr(head, 1, length(head) - length(regexp_extract(head, {q(STATEMENT_END)}, 1))) AS earlier
  FROM eqs WHERE regexp_matches(head, {q(DECL_HEAD)}) OR regexp_matches(head, {q(PLAIN_HEAD)})),
parts AS (
  SELECT file_id, repo, path, first + length(earlier) - length(replace(earlier, chr(10), '')) AS line_no, names,
    CASE WHEN len(names) = 1 THEN [tail] ELSE string_split(array_to_string(list_transform(
        regexp_extract_all(tail, {q(ELEM_TOKENS)}), lambda t: CASE WHEN t = ',' THEN chr(1) ELSE t END), ''), chr(1)) END AS vals
  FROM asg),
credl AS (
  SELECT c.file_id, c.repo, c.path, line_no, raw, names[i] AS variable, regexp_extract(vals[i], {q(LITERAL_RE2)}, 1) AS value
  FROM (SELECT *, unnest(generate_series(1, len(names))) AS i FROM parts) c JOIN lines l USING (file_id, line_no)
  WHERE i <= len(vals) AND len(list_filter({KW_LIST}, lambda k: contains(lower(names[i]), k))) > 0
    AND regexp_matches(vals[i], {q(LITERAL_RE2)}))"""
CRED_FIELDS = fcols(line="line_no", severity=q(fixed.SEV_MEDIUM), type_=q("HARDCODED_CREDENTIAL"),
                    description="'credencial hardcodeada en variable ''' || variable || ''''",
                    code_snippet=gotrim("raw"))
CREDENTIAL = cte(view("src_files"), MASKED, LINES, GROUPS, CRED_LINES) + \
    f"SELECT file_id, {CRED_FIELDS}, variable, value FROM credl"

# In running text: each ``=`` with the name before it and the literal behind it.
CREDENTIAL_DOCUMENTS = rf"""WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents),
eqs AS (
  SELECT doc_id, line_no, raw, substr(raw, 1, p - 1) AS head, substr(raw, p + 1) AS tail
  FROM (SELECT *, unnest(generate_series(1, length(raw))) AS p FROM lines WHERE contains(raw, '=') AND regexp_matches(raw, '["`]'))
  WHERE substr(raw, p, 1) = '=' AND substr(raw, p + 1, 1) <> '='),
found AS (
  SELECT *, regexp_extract(head, '(?:^|\W)([A-Za-z_]\w*)\s*:?$', 1) AS variable,
    regexp_extract(tail, {q(r'^\s*("(?:[^"\\]|\\.)*"|`[^`]*`)')}, 1) AS value FROM eqs)
SELECT doc_id, {CRED_FIELDS}, variable, value FROM found
WHERE value <> '' AND len(list_filter({KW_LIST}, lambda k: contains(lower(variable), k))) > 0"""

# ---- op 19 ----------------------------------------------------------------
FILE_REQ = r"os\.(Open|ReadFile)\(\s*r\.(FormValue|URL\.Query|Header)"
INPUT_SELECT = f"""SELECT file_id, repo, path, {fcols(line='0', severity=q(fixed.SEV_MEDIUM), type_=q('UNSANITIZED_INPUT'), description=q(fixed.EXEC_DESCRIPTION), code_snippet=q(fixed.EXEC_SNIPPET))}
  FROM src_files WHERE contains(code, 'exec.Command')
UNION ALL
SELECT file_id, repo, path, {fcols(line='0', severity=q(fixed.SEV_MEDIUM), type_=q('UNSANITIZED_INPUT'), description=q(fixed.FILE_INPUT_DESCRIPTION), code_snippet=q('os.Open(r.FormValue(...))'))}
  FROM src_files WHERE regexp_matches(code, {q(FILE_REQ)})
UNION ALL
SELECT file_id, repo, path, {fcols(type_=q('INPUT_CHECK_OK'), status=q('success'), message=q(fixed.INPUT_OK_MESSAGE))}
  FROM src_files WHERE NOT contains(code, 'exec.Command') AND NOT regexp_matches(code, {q(FILE_REQ)})"""
UNSANITIZED = cte(view("src_files")) + \
    f"SELECT file_id, {', '.join(['line', 'severity', 'type', 'description', 'code_snippet', 'function', 'complexity', 'threshold', 'status', 'message'])} FROM ({INPUT_SELECT})"

# ---- op 22 / 23 ------------------------------------------------------------
FN_LINES = r"""fl AS (
  SELECT *, sum(CASE WHEN regexp_matches(ns, '^func\b') THEN 1 ELSE 0 END)
      OVER (PARTITION BY file_id ORDER BY line_no) AS fn_seq,
    CASE WHEN (regexp_matches(ns, '^func\b') AND regexp_matches(ns, '\}\s*$')) OR regexp_matches(ns, '^\}')
      THEN 1 ELSE 0 END AS closes
  FROM lines),
body AS (
  SELECT * FROM (SELECT *, coalesce(sum(closes) OVER (PARTITION BY file_id, fn_seq ORDER BY line_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed_before
                 FROM fl WHERE fn_seq > 0) WHERE closed_before = 0),
fns AS (
  SELECT file_id, repo, path, fn_seq, min(line_no) AS line,
    regexp_extract(arg_min(ns, line_no), '^func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)', 1) AS function,
    1 + sum(len(regexp_extract_all(ns, '\b(?:if|for|case)\b|&&|\|\|'))) AS complexity
  FROM body GROUP BY file_id, repo, path, fn_seq)"""
COMPLEXITY = cte(view("src_files"), MASKED, LINES, FN_LINES) + \
    "SELECT file_id, function, CAST(line AS BIGINT) AS line, CAST(complexity AS BIGINT) AS complexity FROM fns"
CX_FIELDS = fcols(line="line", severity=f"CASE WHEN complexity > 15 THEN {q(fixed.SEV_CRITICAL)} ELSE {q(fixed.SEV_HIGH)} END",
                  type_=q("HIGH_COMPLEXITY"), function="function", complexity="complexity", threshold="10")
COMPLEXITY_FINDINGS = cte(view("src_files"), MASKED, LINES, FN_LINES) + \
    f"SELECT file_id, {CX_FIELDS} FROM fns WHERE complexity > 10"

# ---- op 21 ----------------------------------------------------------------
DENY_ALT = "|".join(sorted((c.replace(".", r"\.") for c, _ in fixed.DENYLIST), key=len, reverse=True))
RISK_CASE = "CASE call " + " ".join(f"WHEN {q(c)} THEN {q(r)}" for c, r in fixed.DENYLIST) + " END"
CALLS = f"""calls AS (
  SELECT file_id, line_no AS line, i - 1 AS pos_in_line, hits[i] AS call
  FROM (SELECT file_id, line_no, hits, unnest(generate_series(1, len(hits))) AS i
        FROM (SELECT file_id, line_no, list_filter(list_transform(
                  regexp_extract_all(ns, '[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*\\s*\\('),
                  lambda c: regexp_replace(c, '\\s*\\($', '')), lambda c: regexp_matches(c, {q('^(' + DENY_ALT + ')$')})) AS hits
              FROM lines) WHERE len(hits) > 0))"""
FORBIDDEN = cte(view("src_files"), MASKED, LINES, CALLS) + \
    f"SELECT file_id, CAST(line AS BIGINT) AS line, CAST(pos_in_line AS INT) AS pos_in_line, call, {RISK_CASE} AS risk FROM calls"
FIRST_VIOLATION = cte(view("src_files"), MASKED, LINES, CALLS) + f"""
SELECT file_id, CAST(line AS BIGINT) AS line, call, {RISK_CASE} AS risk,
  'codigo rechazado por sguridad: uso de ' || call || ' (' || {RISK_CASE} || ') no permitido en el sandbox' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line, pos_in_line) AS rn FROM calls) WHERE rn = 1"""

# ---- op 20 ----------------------------------------------------------------
SOURCE_RE2 = (r"\bos\.Args\b|\b(?:r|req|request)\.(?:FormValue|PostFormValue|URL\.Query|URL\.Path|Header|"
              r"Body|Form|PostForm|Cookie)\b")
SINK_RE2 = (r"^(exec\.CommandContext|exec\.Command|os\.OpenFile|os\.Open|os\.ReadFile|os\.Create|os\.WriteFile|"
            r"os\.RemoveAll|os\.Remove|ioutil\.ReadFile|http\.Get)(\s*\()")
SQLSINK_RE2 = r"^(\.(?:QueryRowContext|QueryRow|QueryContext|Query|ExecContext|Exec|PrepareContext|Prepare))(\s*\()"
TAINT = cte(view("src_files"), MASKED, LINES, SQL_LINES, FN_LINES) + f"""
, inbody AS (SELECT b.*, f.function FROM body b JOIN fns f USING (file_id, fn_seq)),
asgn AS (
  SELECT *, regexp_extract(ns, pat, 2) AS lhs, regexp_extract(ns, pat, 4) AS rhs
  FROM (SELECT *, CASE WHEN regexp_matches(ns, {q(DECL_RE2)}) THEN {q(DECL_RE2)} ELSE {q(PLAIN_RE2)} END AS pat
        FROM inbody WHERE regexp_matches(ns, {q(DECL_RE2)}) OR regexp_matches(ns, {q(PLAIN_RE2)}))),
defs AS (
  SELECT file_id, fn_seq, line_no AS source_line, kind, unnest(string_split_regex(lhs, '\\s*,\\s*')) AS variable
  FROM (SELECT *, 'input' AS kind FROM asgn WHERE regexp_matches(rhs, {q(SOURCE_RE2)})
        UNION ALL SELECT *, 'sql' FROM asgn SEMI JOIN sqll USING (file_id, line_no))),
places AS (
  SELECT *, substr(ns, p) AS here FROM (SELECT *, unnest(generate_series(1, length(ns))) AS p FROM inbody
                                         WHERE contains(ns, '('))),
calls AS (
  SELECT file_id, fn_seq, function, line_no, nc, p, 'call' AS sort, regexp_extract(here, {q(SINK_RE2)}, 1) AS sink,
    p + length(regexp_extract(here, {q(SINK_RE2)}, 0)) AS opened, ns
  FROM places WHERE regexp_matches(here, {q(SINK_RE2)}) AND (p = 1 OR NOT regexp_matches(substr(ns, p - 1, 1), '\\w'))
  UNION ALL
  SELECT file_id, fn_seq, function, line_no, nc, p, 'query', regexp_extract(here, {q(SQLSINK_RE2)}, 1),
    p + length(regexp_extract(here, {q(SQLSINK_RE2)}, 0)), ns
  FROM places WHERE regexp_matches(here, {q(SQLSINK_RE2)})),
closed AS (
  SELECT *, coalesce(list_filter(generate_series(0, length(ns) - opened), lambda k:
      length(replace(substr(ns, opened, k + 1), ')', '')) + 1 = length(replace(substr(ns, opened, k + 1), '(', '')))[1],
      length(ns) - opened + 1) AS n
  FROM calls),
uses AS (
  SELECT *, substr(ns, opened, n) AS args, regexp_extract_all(substr(nc, opened, n), {q(LINE_TOKENS)}) AS tk FROM closed),
flows AS (
  SELECT file_id, fn_seq, function, 'input' AS kind, '' AS variable, line_no AS source_line, line_no AS sink_line, sink, p
  FROM uses WHERE regexp_matches(args, {q(SOURCE_RE2)})
  UNION ALL
  SELECT file_id, fn_seq, function, 'sql', '', line_no, line_no, sink, p FROM uses WHERE sort = 'query' AND {JOINED_LITERAL}
  UNION ALL
  SELECT u.file_id, u.fn_seq, u.function, d.kind, d.variable, d.source_line, u.line_no, u.sink, u.p
  FROM uses u JOIN defs d ON d.file_id = u.file_id AND d.fn_seq = u.fn_seq AND d.source_line < u.line_no
  WHERE d.variable <> '_' AND list_contains(regexp_extract_all(u.args, '\\b[A-Za-z_]\\w*\\b'), d.variable)
    AND (d.kind = 'input' OR u.sort = 'query'))
SELECT file_id, function, kind, variable, CAST(source_line AS BIGINT) AS source_line,
  CAST(sink_line AS BIGINT) AS sink_line, sink FROM flows"""

# ---- op 6 -----------------------------------------------------------------
POLICY = cte(view("src_files"), MASKED) + f"""
, imps AS (
  SELECT file_id, code_ns, unnest(regexp_extract_all(regexp_replace(sec, '^import\\s*', ''),
                                   '(?:[\\w.]+[ \\t]+)?"[^"]*"')) AS spec
  FROM (SELECT file_id, code_ns, unnest(regexp_extract_all(code_nc,
          '(?m)^import\\s*(?:\\([^)]*\\)|(?:[\\w.]+\\s+)?"[^"]*")')) AS sec FROM masked)),
named AS (
  SELECT file_id, code_ns, regexp_extract(spec, '"([^"]*)"', 1) AS path,
    coalesce(nullif(regexp_extract(spec, '^([\\w.]+)[ \\t]+', 1), ''),
             regexp_extract(spec, '"(?:[^"]*/)?([^"/]*)"', 1)) AS name
  FROM imps)
SELECT file_id, 'too_long' AS rule, CAST(len(string_split({gotrim('code')}, chr(10))) AS VARCHAR) AS detail
  FROM masked WHERE len(string_split({gotrim('code')}, chr(10))) > 60
UNION ALL SELECT file_id, 'os_args', NULL FROM masked WHERE regexp_matches(code_ns, '\\bos\\.Args\\b')
UNION ALL SELECT file_id, 'os_exit', NULL FROM masked WHERE regexp_matches(code_ns, '\\bos\\.Exit\\s*\\(')
UNION ALL SELECT file_id, 'no_package_main', NULL FROM masked WHERE NOT regexp_matches(code_ns, '(?m)^\\s*package\\s+main\\b')
UNION ALL SELECT file_id, 'no_func_main', NULL FROM masked WHERE NOT regexp_matches(code_ns, '(?m)^func\\s+main\\s*\\(\\s*\\)')
UNION ALL SELECT file_id, 'unused_import', path FROM named
  WHERE name NOT IN ('_', '.') AND NOT regexp_matches(code_ns, '\\b' || name || '\\.')"""

# ---- op 7 -----------------------------------------------------------------
PHRASE_RE = "(?i)(" + "|".join(p.replace(":", ":") for p in fixed.INJECTION_PHRASES) + ")"
INJ_FIELDS = lambda col: fcols(line="0", severity=q(fixed.SEV_CRITICAL), type_=q("PROMPT_INJECTION_ATTEMPT"),
                               description=q(fixed.INJECTION_DESCRIPTION),
                               code_snippet=f"regexp_extract({col}, {q(PHRASE_RE)}, 1)")
INJECTION_FILES = cte(view("src_files")) + \
    f"SELECT file_id, {INJ_FIELDS('code')} FROM src_files WHERE regexp_matches(code, {q(PHRASE_RE)})"
INJECTION_CONV = f"SELECT conv_id, turn, {INJ_FIELDS('text')} FROM conversations WHERE regexp_matches(text, {q(PHRASE_RE)})"

# ---- op 26 ----------------------------------------------------------------
COLS = "line, severity, type, description, code_snippet, function, complexity, threshold, status, message"
AUDIT_BODY = f"""
  SELECT file_id, repo, path, 1 AS step, {COLS} FROM ({SQL_SELECT})
  UNION ALL SELECT file_id, repo, path, 2, {COLS} FROM (SELECT file_id, repo, path, {CRED_FIELDS} FROM credl)
  UNION ALL SELECT file_id, repo, path, 3, {COLS} FROM ({INPUT_SELECT})
  UNION ALL SELECT file_id, repo, path, 4, {COLS} FROM (SELECT file_id, repo, path, {CX_FIELDS} FROM fns WHERE complexity > 10)"""
AUDIT_CTES = cte(view("src_files"), MASKED, LINES, CHAINS, CRED_LINES, FN_LINES)
AUDIT_ALL = AUDIT_CTES + f"SELECT file_id, repo, path, CAST(step AS INT) AS step, {COLS} FROM ({AUDIT_BODY})"

# ---- op 27 ----------------------------------------------------------------
RANK = (f"CASE severity WHEN {q(fixed.SEV_CRITICAL)} THEN 4 WHEN {q(fixed.SEV_HIGH)} THEN 3 "
        f"WHEN {q(fixed.SEV_MEDIUM)} THEN 2 WHEN {q(fixed.SEV_LOW)} THEN 1 ELSE 0 END")
RANK_NAME = lambda e: (f"CASE {e} WHEN 4 THEN {q(fixed.SEV_CRITICAL)} WHEN 3 THEN {q(fixed.SEV_HIGH)} "  # noqa: E731
                       f"WHEN 2 THEN {q(fixed.SEV_MEDIUM)} WHEN 1 THEN {q(fixed.SEV_LOW)} ELSE 'NINGUNO' END")
ROLLUP = AUDIT_CTES + f""", af AS ({AUDIT_BODY})
SELECT CASE GROUPING(repo, file_id) WHEN 0 THEN 'file' WHEN 1 THEN 'repo' ELSE 'total' END AS level,
  repo, file_id, count(*) AS n_findings, {RANK_NAME('max(' + RANK + ')')} AS worst_severity,
  count(*) FILTER (WHERE severity = {q(fixed.SEV_CRITICAL)}) AS n_critical,
  count(*) FILTER (WHERE severity = {q(fixed.SEV_HIGH)}) AS n_high,
  count(*) FILTER (WHERE severity = {q(fixed.SEV_MEDIUM)}) AS n_medium,
  count(*) FILTER (WHERE severity = {q(fixed.SEV_LOW)}) AS n_low,
  count(*) FILTER (WHERE type = 'SQL_INJECTION') AS n_sql_injection,
  count(*) FILTER (WHERE type = 'HARDCODED_CREDENTIAL') AS n_hardcoded_credential,
  count(*) FILTER (WHERE type = 'UNSANITIZED_INPUT') AS n_unsanitized_input,
  count(*) FILTER (WHERE type = 'HIGH_COMPLEXITY') AS n_high_complexity
FROM af WHERE status IS NULL GROUP BY ROLLUP (repo, file_id)"""

# ---- op 25 ----------------------------------------------------------------
LINE_TEXT = f"""CASE
  WHEN status IS NOT NULL THEN (CASE WHEN status = 'success' THEN '✓ ' ELSE '✗ ' END) || coalesce(message, type)
  WHEN function IS NOT NULL THEN '⚠ ' || function || '(): complejidad ' || CAST(complexity AS VARCHAR)
       || ' (máx recomendado: ' || CAST(threshold AS VARCHAR) || ')'
  ELSE (CASE WHEN severity IN ({q(fixed.SEV_CRITICAL)}, {q(fixed.SEV_HIGH)}) THEN '🔴' WHEN severity = {q(fixed.SEV_MEDIUM)} THEN '🟡' ELSE '🟢' END)
       || ' ' || severity || ' — ' || type
       || (CASE WHEN line > 0 THEN ' (línea ' || CAST(line AS VARCHAR) || ')' ELSE '' END)
       || (CASE WHEN code_snippet IS NOT NULL AND line > 0 THEN chr(10) || '   ' || code_snippet ELSE '' END) END"""
REPORTS = AUDIT_CTES + f""", af AS ({AUDIT_BODY}),
items AS (
  SELECT file_id, path, CASE WHEN step = 4 THEN 2 ELSE 1 END AS sec, step, coalesce(line, 0) AS ln, type,
    coalesce(function, '') AS fn, {LINE_TEXT} AS text,
    CASE WHEN status IS NULL THEN {RANK} ELSE 0 END AS rnk, CASE WHEN status IS NULL THEN 1 ELSE 0 END AS is_f
  FROM af),
ordered AS (
  SELECT *, CASE WHEN lag(sec) OVER w IS DISTINCT FROM sec
                 THEN (CASE WHEN sec = 1 THEN 'SEGURIDAD' ELSE 'CALIDAD' END) || chr(10) || text ELSE text END AS shown,
    row_number() OVER w AS k
  FROM items WINDOW w AS (PARTITION BY file_id ORDER BY sec, step, ln, type, fn, text))
SELECT file_id, path, {RANK_NAME('max(rnk)')} AS risk, CAST(sum(is_f) AS BIGINT) AS n_findings,
  {q(fixed.TERMINATION_SIGNAL + ' — ')} || path || chr(10) || '================================' || chr(10)
  || string_agg(shown, chr(10) ORDER BY k) || chr(10) || chr(10) || 'RESUMEN' || chr(10)
  || 'Nivel de riesgo: ' || {RANK_NAME('max(rnk)')} || ' (' || CAST(sum(is_f) AS VARCHAR) || ' hallazgos)' AS report
FROM ordered GROUP BY file_id, path"""

# ---- op 35 ----------------------------------------------------------------
WORST = cte(view("src_files"), MASKED, LINES, FN_LINES) + """
SELECT repo, CAST(rk AS BIGINT) AS rank, path, function, CAST(line AS BIGINT) AS line, CAST(complexity AS BIGINT) AS complexity
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY complexity DESC, path, line) AS rk FROM fns)
WHERE rk <= 5"""

# ---- ops 3, 41 --------------------------------------------------------------
def _json_object() -> str:
    """A finding as JSON text: null, zero and empty fields left out but for ``type``, in the fields' order."""
    parts = []
    for name in ("line", "severity", "type", "description", "code_snippet", "function", "complexity", "threshold", "status", "message"):
        key = q(f'"{name}":')
        if name == "type":
            parts.append(f"{key} || CAST(to_json(coalesce(type, '')) AS VARCHAR)")
        elif name in ("line", "complexity", "threshold"):
            parts.append(f"CASE WHEN {name} <> 0 THEN {key} || CAST({name} AS VARCHAR) END")
        else:
            parts.append(f"CASE WHEN {name} <> '' THEN {key} || CAST(to_json({name}) AS VARCHAR) END")
    return "'{' || array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ',') || '}'"


def json_lines(findings: str) -> str:
    return f"SELECT out_id, seq, {_json_object()} AS json FROM ({findings})"


_ESCAPED = f"replace(replace(replace({_json_object()}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
FIX_PROMPTS = AUDIT_CTES + f""", found AS (
  SELECT file_id, count(*) AS n, '[' || string_agg({_ESCAPED}, ',' ORDER BY coalesce(line, 0), coalesce(type, ''), coalesce(description, '')) || ']' AS listed
  FROM ({AUDIT_BODY}) WHERE step <= 3 GROUP BY file_id)
SELECT file_id, 'fix' AS system_prompt,
  {q(tasks.FIX_TASK.split('%s')[0])} || coalesce(listed, '[]') || {q(tasks.FIX_TASK.split('%s')[1])} || code || {q(tasks.FIX_TASK.split('%s')[2])} AS task,
  greatest(coalesce(n, 0) + 1, 2) AS max_steps, {q(fixed.FIX_END)} AS termination_signal, coalesce(listed, '[]') AS findings_json,
  contains(code, '---CODE_START---') OR contains(code, '---CODE_END---') AS code_has_delimiter
FROM src_files LEFT JOIN found USING (file_id)"""

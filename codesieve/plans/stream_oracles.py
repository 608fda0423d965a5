"""DuckDB oracles for sources, sinks, events and the batch forms of the
streaming operators."""

from __future__ import annotations

from codesieve.functions import fixed
from codesieve.plans.duck import cte, q, view
from codesieve.plans.text_oracles import PARSE_FINDINGS

RATE_LIMIT = """WITH RECURSIVE o AS (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, ts + INTERVAL 86400 SECOND AS reset_at, 1 AS cnt, true AS allowed, 1 AS win
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.event_id,
    CASE WHEN o.ts > r.reset_at THEN o.ts + INTERVAL 86400 SECOND ELSE r.reset_at END,
    CASE WHEN o.ts > r.reset_at THEN 1 WHEN r.cnt >= 3 THEN r.cnt ELSE r.cnt + 1 END,
    CASE WHEN o.ts > r.reset_at THEN true WHEN r.cnt >= 3 THEN false ELSE true END,
    CASE WHEN o.ts > r.reset_at THEN r.win + 1 ELSE r.win END
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT event_id, user_id AS key, allowed, CAST(cnt AS BIGINT) AS window_count, CAST(win AS BIGINT) AS window_no FROM r"""

DECODED = """b AS (SELECT stream_id, string_agg(chunk, '' ORDER BY chunk_no) AS buf FROM sse_chunks GROUP BY stream_id),
fr AS (SELECT stream_id, string_split(buf, chr(10) || chr(10)) AS parts FROM b),
f2 AS (SELECT stream_id, unnest(generate_series(0, len(parts) - 2)) AS frame_no,
         unnest(list_slice(parts, 1, len(parts) - 1)) AS frame FROM fr),
l2 AS (SELECT stream_id, frame_no, unnest(generate_series(0, len(string_split(frame, chr(10))) - 1)) AS line_no,
         unnest(string_split(frame, chr(10))) AS line FROM f2),
dec AS (SELECT stream_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(line_no AS BIGINT) AS line_no,
          json_extract_string(substr(line, 7), '$.type') AS type, json_extract_string(substr(line, 7), '$.message') AS message,
          substr(line, 7) AS payload
        FROM l2 WHERE starts_with(line, 'data: ') AND json_valid(substr(line, 7)))"""
DECODE = cte(view("sse_chunks"), DECODED) + "SELECT * FROM dec"

# The first of ``done`` and ``error`` by frame and line is final; what follows it does not count.
RUN_STATUS = cte(view("sse_chunks"), DECODED) + """, seen AS (
  SELECT *, coalesce(sum(CASE WHEN type IN ('done', 'error') THEN 1 ELSE 0 END) OVER (
    PARTITION BY stream_id ORDER BY frame_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS finals_before FROM dec)
SELECT stream_id AS run_id,
  coalesce(max(CASE type WHEN 'done' THEN 'ready' WHEN 'error' THEN 'error' END), 'busy') AS status,
  count(*) AS n_events,
""" + ",\n".join(f"  count(*) FILTER (WHERE type = {q(t)}) AS n_{t}"
                 for t in ["progress", "step_start", "step_done", "retry", "code_generated", "done", "error"]) + """
FROM seen WHERE finals_before = 0 GROUP BY stream_id"""

STYLE = "CASE coalesce(type, '') " + " ".join(f"WHEN {q(t)} THEN {q(i)}" for t, i, _ in fixed.EVENT_STYLE) + " ELSE '⚙' END"
CSS = "CASE coalesce(type, '') " + " ".join(f"WHEN {q(t)} THEN {q(c)}" for t, _, c in fixed.EVENT_STYLE) + " ELSE 'ev-progress' END"
SUMMARY = cte(view("sse_chunks"), DECODED) + f"""SELECT stream_id, frame_no, type, message, {STYLE} AS icon, {CSS} AS css,
  coalesce(type, '') IN ('step_start', 'retry') AS detail_only
FROM dec WHERE coalesce(type, '') NOT IN ('step_start', 'retry')"""

ADMIT = f"""SELECT doc_id, CAST(strlen(to_json({{'code': text}})) AS BIGINT) AS body_bytes,
  CASE WHEN strlen(to_json({{'code': text}})) > 20000 THEN {q(fixed.ERR_TOO_LARGE)}
       WHEN text IS NULL OR text = '' THEN {q(fixed.ERR_MISSING_CODE)} END AS reason,
  NOT (strlen(to_json({{'code': text}})) > 20000 OR text IS NULL OR text = '') AS accepted
FROM documents"""

ENCODE = f"""SELECT event_id, 'data: ' || replace(replace(replace(CASE
    WHEN event_type = 'purchase' THEN '{{"findings":[],"report":' || to_json(props) || ',"type":"done"}}'
    WHEN event_type = 'signup' THEN '{{"code":' || to_json(props) || ',"type":"code_generated"}}'
    ELSE '{{"message":' || to_json(props) || ',"type":' || to_json(CASE event_type WHEN 'error' THEN 'error'
        WHEN 'view' THEN 'progress' ELSE 'step_start' END) || '}}' END,
  '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || chr(10) || chr(10) AS frame
FROM events"""

SECRET_RE2 = r'(?i)\b([A-Za-z_]\w*)[ \t]*(?::=|=)[ \t]*"([^"\n]*)"'
KWS = "[" + ", ".join(q(k) for k in fixed.CREDENTIAL_KEYWORDS) + "]"
MASK_SECRETS = f"""SELECT doc_id, CAST(seq AS BIGINT) AS seq, regexp_extract(m, {q(SECRET_RE2)}, 1) AS variable,
  CAST(strlen(regexp_extract(m, {q(SECRET_RE2)}, 2)) AS BIGINT) AS value_bytes,
  CASE WHEN strlen(regexp_extract(m, {q(SECRET_RE2)}, 2)) > 8 THEN left(regexp_extract(m, {q(SECRET_RE2)}, 2), 8) || '...'
       ELSE '[VACIA]' END AS masked
FROM (SELECT doc_id, unnest(generate_series(0, len(ms) - 1)) AS seq, unnest(ms) AS m
      FROM (SELECT doc_id, regexp_extract_all(text, {q(SECRET_RE2)}) AS ms FROM documents))
WHERE len(list_filter({KWS}, lambda k: contains(lower(regexp_extract(m, {q(SECRET_RE2)}, 1)), k))) > 0"""

"""Shared DuckDB SQL pieces for the oracles (RE2 has no possessive
quantifiers and no look-around, so the patterns are written out plainly)."""

from __future__ import annotations

from codesieve.sources.fixtures import VIEWS

TOKEN_RE2 = (r"""//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|/\*[\s\S]*|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|"""
             r"""`[^`]*`|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[^"'`/]+|["'`/]""")
WS = r"[\s\x0B\p{Z}\x{85}]"


def q(s: str) -> str:
    """Quote a Python string as a DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


def gotrim(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def view(name: str) -> str:
    return f"{name} AS ({VIEWS[name][0]})"


MASKED = f"""masked AS (
  SELECT file_id, repo, path, code,
    array_to_string(list_transform(toks, lambda t: CASE WHEN t LIKE '//%' OR t LIKE '/*%'
        THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '') AS code_nc,
    array_to_string(list_transform(toks, lambda t: CASE WHEN t LIKE '//%' OR t LIKE '/*%'
        THEN regexp_replace(t, '[^\\n]', ' ', 'g')
        WHEN length(t) >= 2 AND left(t, 1) IN ('"', '`', '''')
        THEN left(t, 1) || regexp_replace(substr(t, 2, length(t) - 2), '[^\\n]', ' ', 'g') || right(t, 1)
        ELSE t END), '') AS code_ns
  FROM (SELECT *, regexp_extract_all(code, {q(TOKEN_RE2)}) AS toks FROM src_files))"""

LINES = """lines AS (
  SELECT file_id, repo, path,
    unnest(generate_series(1, len(string_split(code, chr(10))))) AS line_no,
    unnest(string_split(code, chr(10))) AS raw,
    unnest(string_split(code_nc, chr(10))) AS nc,
    unnest(string_split(code_ns, chr(10))) AS ns
  FROM masked)"""

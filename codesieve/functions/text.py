"""Column-expression helpers for the text semantics the audits rely on.

All of these are built-in Catalyst expressions: they stay in the JVM and
inside whole-stage code generation where Spark allows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Go's TrimSpace sees it: ASCII space class, \v, the Z
# categories and NEL.  Java's \s alone is ASCII only.
_WS = r"[\s\x0B\p{Z}\x{85}]"
TRIM_RE = rf"^{_WS}+|{_WS}+$"
RTRIM_RE = rf"{_WS}+$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """``body(v)`` where ``v`` stands for ``value`` computed once per row.  A
    lambda variable is not expanded in place as a named expression would be."""
    return F.get(F.transform(F.array(value), body), 0)


def rest(c: Column | str, start: Column | int) -> Column:
    """The text from the 1-based place ``start`` to its end."""
    c = col_(c)
    return F.substring(c, F.lit(start) if isinstance(start, int) else start, F.greatest(F.length(c), F.lit(1)))


def go_trim(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col_(c), TRIM_RE, "")


def go_rtrim(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), RTRIM_RE, "")


def byte_len(c: Column | str) -> Column:
    return F.octet_length(col_(c))


def byte_prefix(c: Column | str, n: int) -> Column:
    """First ``n`` bytes of a string (a cut inside a UTF-8 sequence keeps the
    broken bytes as U+FFFD, like printing a Go byte slice)."""
    return F.decode(F.substring(F.encode(col_(c), "UTF-8"), 1, n), "UTF-8")


def before_first(c: Column | str, marker: str) -> Column:
    """Text before the first literal ``marker`` (all of it when absent)."""
    return F.substring_index(col_(c), marker, 1)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Literal, first-occurrence replace (Go ``strings.Replace(s, old, new, 1)``).

    An empty ``old`` inserts ``new`` at the front, as Go does.
    """
    return bind(F.instr(text, old), lambda pos: F.when(F.length(old) == 0, F.concat(new, text))
                .when(pos == 0, text)
                .otherwise(F.concat(F.substring(text, F.lit(1), pos - 1), new,
                                    rest(text, pos + F.length(old)))))


def count_literal(text: Column, sub: Column) -> Column:
    """Non-overlapping occurrences of a literal ``sub`` in ``text``."""
    return F.when(F.length(sub) == 0, F.lit(0)).otherwise(
        F.floor((F.length(text) - F.length(F.replace(text, sub, F.lit("")))) / F.length(sub))
    ).cast("bigint")


def lines_of(c: Column | str) -> Column:
    """Split on ``\\n`` keeping empty lines (Go ``strings.Split``)."""
    return F.split(col_(c), "\n", -1)


def regex_quote(s: str) -> str:
    return "\\Q" + s + "\\E"

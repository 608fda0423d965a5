"""Op 16: comment and string masking of Go source, as column expressions.

The file is cut into lexical tokens with one ``regexp_extract_all`` (comments,
the three literal kinds, and a catch-all), each token is rewritten with
``transform`` and the pieces are joined back.  Masked characters become
spaces and newlines stay, so both outputs have the length and the line
breaks of the input: a line number found in a masked text is the line
number in the file.  No UDF, no shuffle; the work is one pass per row.

Java regexes use possessive quantifiers so long literals cannot overflow the
regex engine's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import col_

LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"  # an unclosed one runs to the end
INTERPRETED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
RAW = r"`[^`]*+`"
RUNE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
OTHER = r"[^\"'`/]++"
SINGLE = r"[\"'`/]"
TOKEN_RE = "|".join([LINE_COMMENT, BLOCK_COMMENT, INTERPRETED, RAW, RUNE, OTHER, SINGLE])


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\n]", " ")


def _is_comment(t: Column) -> Column:
    return t.startswith("//") | t.startswith("/*")


def _is_literal(t: Column) -> Column:
    return (F.length(t) >= 2) & F.substring(t, 1, 1).isin('"', "`", "'")


def tokens(code: Column | str) -> Column:
    return F.regexp_extract_all(col_(code), F.lit(TOKEN_RE), 0)


def mask_comments(code: Column | str) -> Column:
    """Comments blanked, literals kept."""
    return F.array_join(F.transform(tokens(code), lambda t: F.when(_is_comment(t), _blank(t))
                                    .otherwise(t)), "")


def _rewrite_ns(t: Column) -> Column:
    body = F.substring(t, F.lit(2), F.length(t) - 2)
    return (F.when(_is_comment(t), _blank(t))
            .when(_is_literal(t), F.concat(F.substring(t, 1, 1), _blank(body), F.substring(t, -1, 1)))
            .otherwise(t))


def mask_comments_and_strings(code: Column | str) -> Column:
    """Comments blanked and literal bodies blanked; the quotes stay."""
    return F.array_join(F.transform(tokens(code), _rewrite_ns), "")


def outside_comments_and_strings(code: Column | str) -> Column:
    """The text between comments and literals, put together: what is in no masked place, without the blanks."""
    return F.array_join(F.filter(tokens(code), lambda t: ~(_is_comment(t) | _is_literal(t))), "")


def mask_source(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``code_nc`` (comments blanked) and ``code_ns`` (comments and
    literal bodies blanked).  One tokenisation serves both outputs: the token
    array is an alias referenced twice, which Catalyst does not inline."""
    toks = "_cs_tokens"
    return (df.withColumn(toks, tokens(code))
            .withColumn("code_nc", F.array_join(F.transform(
                F.col(toks), lambda t: F.when(_is_comment(t), _blank(t)).otherwise(t)), ""))
            .withColumn("code_ns", F.array_join(F.transform(F.col(toks), _rewrite_ns), ""))
            .drop(toks))


def source_lines(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per line: ``line_no`` (1-based), ``raw``, ``nc`` and ``ns``.

    The explode happens inside each row's partition (no shuffle); only the
    ``keep`` columns are carried along.
    """
    keep = keep if keep is not None else ["file_id"]
    zipped = F.arrays_zip(F.split("code", "\n", -1).alias("raw"),
                          F.split("code_nc", "\n", -1).alias("nc"),
                          F.split("code_ns", "\n", -1).alias("ns"))
    return (masked.select(*keep, F.posexplode(zipped).alias("pos", "l"))
            .select(*keep, (F.col("pos") + 1).alias("line_no"),
                    F.col("l.raw").alias("raw"), F.col("l.nc").alias("nc"),
                    F.col("l.ns").alias("ns")))

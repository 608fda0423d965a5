"""Patch and masking work: ops 36-40.

Patches of a file are gathered per file (a file's patch list is bounded by
its findings) and folded over the file text with ``aggregate``: literal,
first-occurrence replaces in ``seq`` order, each on the last one's output.
The file side is joined on ``file_id``; AQE turns the join into a broadcast
at run time only when the measured patch side is small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.functions.text import _WS, bind, byte_len, byte_prefix, count_literal, replace_first
from codesieve.operators.mask import outside_comments_and_strings

PATCH_T = "array<struct<seq:bigint,original:string,fixed:string>>"
STARTS_PACKAGE = rf"^{_WS}*+package"


def _patch_lists(patches: DataFrame) -> DataFrame:
    return (patches.groupBy("file_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "original",
                                                      "fixed"))).alias("ps")))


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Op 36: the patched text of every file (no patch = identity)."""
    j = files.select("file_id", "code").join(_patch_lists(patches), "file_id", "left")
    ps = F.coalesce(F.col("ps"), F.array().cast(PATCH_T))
    out = F.aggregate(ps, F.col("code"), lambda acc, p: replace_first(acc, p["original"], p["fixed"]))
    applied = F.aggregate(ps, F.struct(F.col("code").alias("c"), F.lit(0).alias("n")),
                          lambda acc, p: F.struct(replace_first(acc["c"], p["original"], p["fixed"]).alias("c"),
                                                  (acc["n"] + (F.instr(acc["c"], p["original"]) > 0).cast("int")).alias("n")))
    return j.select("file_id", out.alias("fixed_code"), F.size(ps).cast("bigint").alias("n_patches"),
                    applied["n"].cast("bigint").alias("n_applied"),
                    (out != F.col("code")).alias("changed"))


def _balanced(c: Column) -> Column:
    """As many opening braces as closing ones outside comments and literals."""
    return bind(outside_comments_and_strings(c), lambda code: count_literal(code, F.lit("{")) == count_literal(code, F.lit("}")))


def patch_audit(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Op 37: per patch, against the text it is applied to: found exactly,
    occurrences, changed the file, braces still balance, still starts with
    ``package``; and per file whether all applied (``all_applied``).

    Each step's text is bound once, and what is known of a text (its braces, its
    start) is worked out again only after a patch that changed it."""
    j = files.select("file_id", "code").join(_patch_lists(patches), "file_id", "inner")
    res_t = "array<struct<seq:bigint,found:boolean,occurrences:bigint,changed:boolean,balanced:boolean,starts_package:boolean>>"

    def known(text: Column) -> Column:
        return F.struct(_balanced(text).alias("balanced"), text.rlike(STARTS_PACKAGE).alias("starts"))

    def step(acc: Column, p: Column) -> Column:
        before = acc["c"]

        def result(after: Column, changed: Column, of: Column) -> Column:
            r = F.struct(p["seq"].alias("seq"), (F.instr(before, p["original"]) > 0).alias("found"),
                         count_literal(before, p["original"]).alias("occurrences"), changed.alias("changed"),
                         of["balanced"].alias("balanced"), of["starts"].alias("starts_package"))
            return F.struct(after.alias("c"), of.alias("of"), F.concat(acc["r"], F.array(r)).alias("r"))

        return bind(replace_first(before, p["original"], p["fixed"]), lambda after: bind(after != before, lambda changed: bind(
            F.when(~changed & acc["of"].isNotNull(), acc["of"]).otherwise(known(after)), lambda of: result(after, changed, of))))

    start = F.struct(F.col("code").alias("c"), F.lit(None).cast("struct<balanced:boolean,starts:boolean>").alias("of"), F.array().cast(res_t).alias("r"))
    rows = j.select("file_id", F.aggregate(F.col("ps"), start, step, lambda acc: acc["r"]).alias("r"))
    return rows.select("file_id", F.inline_outer("r"),  # no list is empty; the plain form would work the fold out again in a filter
                       F.forall("r", lambda x: x["found"]).alias("all_applied"))


def diff_rows(patches: DataFrame) -> DataFrame:
    """Op 38: ``- original`` / ``+ fixed`` rows in order."""
    items = F.array(F.struct(F.lit(0).alias("k"), F.lit("-").alias("sign"),
                             F.concat(F.lit("- "), F.col("original")).alias("text")),
                    F.struct(F.lit(1).alias("k"), F.lit("+").alias("sign"),
                             F.concat(F.lit("+ "), F.col("fixed")).alias("text")))
    return (patches.where((F.col("original") != "") | (F.col("fixed") != ""))
            .select("file_id", "seq", F.inline(items))
            .where(((F.col("k") == 0) & (F.col("text") != "- ")) | ((F.col("k") == 1) & (F.col("text") != "+ ")))
            .select("file_id", "seq", F.col("k").cast("int").alias("k"), "sign", "text"))


SQL_ASSIGN = r'^([A-Za-z_]\w*)\s*:?=\s*"((?:[^"\\]|\\.)*)"\s*\+\s*([A-Za-z_]\w*)\s*$'
EXEC_ARG = r"exec\.Command(?:Context)?\((?:[^()]*,\s*)?([A-Za-z_]\w*)\)"
SQL_FIX = ('stmt, err := db.Prepare("%s?")\n'
           'if err != nil { log.Fatal(err) }\n'
           'row := stmt.QueryRow(%s)')
EXEC_FIX = ('if strings.ContainsAny(%s, ";&|") {\n'
            '    log.Fatal("input inválido")\n'
            '}\n%s')


def propose_fixes(credentials: DataFrame, sql: DataFrame, calls_lines: DataFrame) -> DataFrame:
    """Op 39: deterministic patch rows by finding type; ``original`` is the
    finding's line as written in the file (trimmed, like the parser trims).

    * HARDCODED_CREDENTIAL ``x := "v"`` -> ``x := os.Getenv("X")`` (a ``const`` becomes a ``var``: a call is no constant)
    * SQL_INJECTION ``q := "…" + v`` -> ``db.Prepare`` with ``?`` and ``QueryRow(v)``
    * exec.Command(.., v) -> a ``strings.ContainsAny(v, ";&|")`` guard first.
    """
    cred = credentials.select(
        "file_id", F.lit("HARDCODED_CREDENTIAL").alias("type"), "line", F.col("code_snippet").alias("original"),
        F.regexp_replace(replace_first(F.col("code_snippet"), F.col("value"), F.format_string('os.Getenv("%s")', F.upper("variable"))),
                         r"^const\b", "var").alias("fixed"))
    s = F.col("code_snippet")
    sq = (sql.where(s.rlike(SQL_ASSIGN))
          .select("file_id", F.lit("SQL_INJECTION").alias("type"), "line", s.alias("original"),
                  F.format_string(SQL_FIX, F.regexp_extract(s, SQL_ASSIGN, 2),
                                  F.regexp_extract(s, SQL_ASSIGN, 3)).alias("fixed")))
    t = F.col("text")
    ex = (calls_lines.where(t.rlike(EXEC_ARG))
          .select("file_id", F.lit("UNSANITIZED_INPUT").alias("type"), "line", t.alias("original"),
                  F.format_string(EXEC_FIX, F.regexp_extract(t, EXEC_ARG, 1), t).alias("fixed")))
    return (cred.unionByName(sq).unionByName(ex)
            .select("file_id", "type", F.col("line").cast("bigint").alias("line"), "original", "fixed"))


# ---- op 40 ------------------------------------------------------------------------
def mask_value(v: Column) -> Column:
    """First 8 bytes + ``...`` when longer than 8 bytes, else ``[VACIA]``."""
    return F.when(byte_len(v) > 8, F.concat(byte_prefix(v, 8), F.lit("..."))).otherwise(F.lit("[VACIA]"))


def secret_pattern(keywords: list[str] | None = None) -> str:
    kws = "|".join(keywords or fixed.CREDENTIAL_KEYWORDS)
    return rf'(?i)\b([A-Za-z_]\w*)[ \t]*(?::=|=)[ \t]*"([^"\n]*)"'


def mask_secrets(df: DataFrame, text: str, keys: list[str],
                 keywords: list[str] | None = None) -> DataFrame:
    """Op 40, corpus form: every literal assigned to a credential-like name
    in a text, shown masked; one row per secret with the text's masked form
    available through :func:`masked_text`."""
    kws = F.array(*[F.lit(k) for k in (keywords or fixed.CREDENTIAL_KEYWORDS)])
    pat = secret_pattern(keywords)
    m = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pat), 0)).alias("seq", "m"))
    name = F.regexp_extract("m", pat, 1)
    value = F.regexp_extract("m", pat, 2)
    return (m.where(F.exists(kws, lambda k: F.lower(name).contains(k)))
            .select(*keys, F.col("seq").cast("bigint").alias("seq"), name.alias("variable"),
                    byte_len(value).cast("bigint").alias("value_bytes"), mask_value(value).alias("masked")))

"""Corpus code scans: ops 6, 7 and 17-23.

All scans read the masked texts of op 16 (``code_nc``, ``code_ns``) so that
comments and literal bodies never match.  Per-file work is row-local: lines
are exploded inside the row's partition and function spans are computed with
array expressions, so no scan needs a shuffle to see a whole file.  Arrays that
a lambda reads (lines, starts, tokens) are bound once per row with ``bind``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.functions.text import bind, go_trim, rest
from codesieve.operators.mask import source_lines

# ---- finding rows -------------------------------------------------------------
FINDING_COLUMNS = [("line", "bigint"), ("severity", "string"), ("type", "string"),
                   ("description", "string"), ("code_snippet", "string"),
                   ("function", "string"), ("complexity", "bigint"), ("threshold", "bigint"),
                   ("status", "string"), ("message", "string")]


def finding_cols(**given: Column) -> list[Column]:
    """The ten finding columns in order; absent ones are typed nulls."""
    out = []
    for name, typ in FINDING_COLUMNS:
        c = given.get(name)
        out.append((c if c is not None else F.lit(None)).cast(typ).alias(name))
    return out


def finding_struct(**given: Column) -> Column:
    return F.struct(*finding_cols(**given))


FINDINGS_T = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FINDING_COLUMNS) + ">>"


def file_lines(raw: str = "code") -> Column:
    return F.arrays_zip(F.split(raw, "\n", -1).alias("raw"), F.split("code_nc", "\n", -1).alias("nc"),
                        F.split("code_ns", "\n", -1).alias("ns"))


def logical_lines(lines: Column) -> Column:
    """array<struct<first, lines, nc, ns>>: the lines of a file, those that go on (code ending in ``+`` or ``=``)
    together with what they go on to.  ``first`` is 1-based."""
    goes_on = lambda l: l["ns"].rlike(r"[+=]\s*$") & ~l["ns"].rlike(r"\+\+\s*$")

    def joined(on: Column, ls: Column) -> Column:
        starts = F.array_compact(F.transform(on, lambda _, i: F.when((i == 0) | ~F.get(on, i - 1), i)))
        return bind(starts, lambda at: F.transform(at, lambda s, k: bind(
            F.slice(ls, s + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - s), lambda part: F.struct(
                (s + 1).alias("first"), part.alias("lines"), F.array_join(F.transform(part, lambda l: l["nc"]), "\n").alias("nc"),
                F.array_join(F.transform(part, lambda l: l["ns"]), "\n").alias("ns")))))

    def alone(ls: Column) -> Column:
        return F.transform(ls, lambda l, i: F.struct((i + 1).alias("first"), F.array(l).alias("lines"), l["nc"].alias("nc"), l["ns"].alias("ns")))

    return bind(lines, lambda ls: bind(F.transform(ls, goes_on), lambda on: F.when(F.exists(on, lambda x: x), joined(on, ls)).otherwise(alone(ls))))


def logical_findings(lines: Column, builder) -> Column:
    """The findings that ``builder`` makes of each logical line of a file, row-locally."""
    return F.flatten(F.transform(logical_lines(lines), builder))


# ---- op 17 SQL built by concatenation -----------------------------------------
_LINE_TOKEN = (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`]*+`|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
               + r"|[^\"'`]++|[\"'`]")
_SQL_WORD = "|".join(fixed.SQL_KEYWORDS)


def sql_concat_flag(nc: Column, ns: Column) -> Column:
    """True when a line has a ``+`` with a direct string-literal operand that
    holds an SQL word.  Tokens of the comment-free line are checked with their
    neighbours: a literal counts when the code before it ends in a single
    ``+`` or the code after it starts with one (``++`` and ``+=`` excluded)."""
    def hits(toks: Column) -> Column:
        def hit(t: Column, i: Column) -> Column:
            prev_, next_ = F.get(toks, i - 1), F.get(toks, i + 1)
            is_kw_lit = t.rlike(r'^["`]') & t.rlike(_SQL_WORD)
            return is_kw_lit & (F.coalesce(prev_.rlike(r"(?:^|[^+])\+\s*$"), F.lit(False))
                                | F.coalesce(next_.rlike(r"^\s*\+(?![+=])"), F.lit(False)))
        return F.exists(F.transform(toks, hit), lambda x: x)

    candidate = ns.contains("+") & ns.rlike(r'["`]')
    return candidate & bind(F.regexp_extract_all(nc, F.lit(_LINE_TOKEN), 0), hits)


_CHAIN_TOKEN = (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`]*+`|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
                + r"|[(\[{]|[)\]}]|&&|\|\||[=!<>]=|[,;:=<>]|[^\"'`()\[\]{},;:=<>&|!]++|[\"'`&|!]")
CHAINS_T = "array<struct<id:int,line:int>>"


def sql_chains(nc: Column) -> Column:
    """array<struct<id, line>> of the operand chains of a logical line that hold a query literal next to a ``+``; ``line``
    counts from 0.  A chain is what stands between separators of its own bracket level: one fold over the line's
    tokens keeps the open chain of each level on a stack, with the line of its first token."""
    def marked(toks: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            joined = (F.coalesce(F.get(toks, i - 1).rlike(r"(?:^|[^+])\+\s*$"), F.lit(False))
                      | F.coalesce(F.get(toks, i + 1).rlike(r"^\s*\+(?![+=])"), F.lit(False)))
            return F.struct(t.alias("t"), (t.rlike(r'^["`]') & t.rlike(_SQL_WORD) & joined).alias("hit"))
        return F.transform(toks, one)

    def step(acc: Column, x: Column) -> Column:
        t, stack, new = x["t"], acc["stack"], acc["next"]
        fresh = F.array(F.struct(new.alias("id"), F.lit(None).cast("int").alias("line")))
        below = F.slice(stack, 1, F.size(stack) - 1)
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        parts = t.isin(",", ";", ":", "=", "==", "!=", "<=", ">=", "<", ">", "&&", "||")
        top = F.element_at(stack, -1)
        here = acc["line"] + F.regexp_count(F.regexp_extract(t, r"^\s*", 0), F.lit("\n"))
        begun = F.struct(top["id"].alias("id"), F.coalesce(top["line"], F.when(F.trim(F.translate(t, "\n\t\r", "   ")) != "", here)).alias("line"))
        hits = F.when(x["hit"] & ~F.exists(acc["hits"], lambda h: h["id"] == top["id"]), F.concat(acc["hits"], F.array(begun))).otherwise(acc["hits"])
        after = (F.when(opens, F.concat(below, F.array(begun), fresh)).when(closes, F.when(F.size(stack) > 1, below).otherwise(fresh))
                 .when(parts, F.concat(below, fresh)).otherwise(F.concat(below, F.array(begun))))
        return F.struct(after.cast(CHAINS_T).alias("stack"), F.when(opens | closes | parts, new + 1).otherwise(new).alias("next"),
                        (acc["line"] + F.regexp_count(t, F.lit("\n"))).alias("line"), hits.cast(CHAINS_T).alias("hits"))

    start = F.struct(F.array(F.struct(F.lit(0).alias("id"), F.lit(None).cast("int").alias("line"))).cast(CHAINS_T).alias("stack"),
                     F.lit(1).alias("next"), F.lit(0).alias("line"), F.array().cast(CHAINS_T).alias("hits"))
    return bind(F.regexp_extract_all(nc, F.lit(_CHAIN_TOKEN), 0), lambda toks: F.aggregate(marked(toks), start, step)["hits"])


def sql_concat_findings(l: Column) -> Column:
    """SQL_INJECTION findings of one logical line, one for each chain."""
    candidate = l["ns"].contains("+") & l["ns"].rlike(r'["`]') & l["nc"].rlike(_SQL_WORD)

    def one(h: Column) -> Column:
        return finding_struct(line=l["first"] + h["line"], severity=F.lit(fixed.SEV_CRITICAL), type=F.lit("SQL_INJECTION"),
                              description=F.lit(fixed.SQL_DESCRIPTION), code_snippet=go_trim(F.get(l["lines"], h["line"])["raw"]))

    return F.when(candidate, F.transform(sql_chains(l["nc"]), one)).otherwise(F.array().cast(FINDINGS_T))


def sql_concat_scan(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 17: one CRÍTICO SQL_INJECTION row per operand chain that concatenates a
    query literal, at the line where the chain begins.  A chain ``"SELECT…" + x + "'"`` is one row, two chains on a line are
    two, and a chain goes on over lines that end in ``+``.  A raw literal of several lines is no operand (known limit)."""
    keep = keep or ["file_id"]
    return masked.select(*keep, F.inline(logical_findings(file_lines(), sql_concat_findings)))


# ---- op 18 hard-coded credentials ---------------------------------------------
_IDLIST = r"[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*"
ASSIGN_DECL = rf"^(\s*(?:var|const)\s+)({_IDLIST})(\s*[^=]*?=(?!=)\s*)(.*)$"
ASSIGN_PLAIN = rf"^(\s*)({_IDLIST})(\s*:?=(?!=)\s*)(.*)$"
STRING_LIT_MASKED = r'^"\s*"$|^`\s*`?$'
ANY_LIT_MASKED = STRING_LIT_MASKED + r"|^'\s*'$|^\.?[0-9][\w.]*(?:[eEpP][+-]?\w+)?$"


def _assignment(ns: Column, i: int) -> Column:
    """Group ``i`` of the assignment pattern that the masked line matches."""
    return F.when(ns.rlike(ASSIGN_DECL), F.regexp_extract(ns, ASSIGN_DECL, i)) \
        .otherwise(F.regexp_extract(ns, ASSIGN_PLAIN, i))


def assigned_names(ns: Column) -> Column:
    return F.split(_assignment(ns, 2), r"\s*,\s*")


def value_list(rhs: Column) -> Column:
    """The masked right side split at the commas outside all brackets.  The
    fold keeps the bracket depth and marks those commas with U+0001."""
    def step(acc: Column, p: Column) -> Column:
        depth = acc["depth"] + F.regexp_count(p, F.lit(r"[(\[{]")) - F.regexp_count(p, F.lit(r"[)\]}]"))
        mark = F.when(acc["text"].isNull(), "").when(acc["depth"] > 0, ",").otherwise("\u0001")
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"),
                        F.concat(F.coalesce(acc["text"], F.lit("")), mark, p).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("text"))
    marked = F.aggregate(F.split(rhs, ",", -1), start, step)["text"]
    return F.when(rhs.rlike(r"[(\[{]"), F.split(marked, "\u0001", -1)).otherwise(F.split(rhs, ",", -1))


def _is_assignment(ns: Column) -> Column:
    return ns.contains("=") & (ns.rlike(ASSIGN_DECL) | ns.rlike(ASSIGN_PLAIN))


#: Behind these a statement may start; literal bodies are blanked, so none of them lies in one.
_STATEMENT_START = r"[;{}(]|:(?!=)|\b(?:if|for|switch|else)\b"


def credential_findings(l: Column, keywords: list[str] | None = None, any_literal: bool = False, with_value: bool = False) -> Column:
    """HARDCODED_CREDENTIAL findings of one logical line: of every statement on it, in blocks, behind ``if`` and ``;``."""
    kws = keywords or fixed.CREDENTIAL_KEYWORDS
    named_re = "(?i)" + "|".join(re.escape(k) for k in kws)
    lit_re = ANY_LIT_MASKED if any_literal else STRING_LIT_MASKED
    none = F.array().cast(_struct_type(with_value))
    candidate = l["ns"].contains("=") & l["ns"].rlike(named_re) & (F.lit(any_literal) | l["ns"].rlike(r'["`]'))
    ends = lambda text: F.regexp_replace(text, r"(?s)[;})].*$", "")

    def of_piece(pieces: Column, p: Column, k: Column) -> Column:
        def found(at: Column, names: Column) -> Column:
            head = F.length(_assignment(p, 1)) + F.length(_assignment(p, 2)) + F.length(_assignment(p, 3))
            more = F.size(names) > 1  # later values may lie behind brackets of earlier ones
            values = F.when(more, value_list(rest(l["ns"], at + head + 1))).otherwise(F.array(_assignment(p, 4)))
            begins = l["first"] + F.regexp_count(F.concat(F.substring(l["ns"], F.lit(1), at), F.regexp_extract(p, r"^\s*", 0)), F.lit("\n"))
            return bind(values, lambda parts: F.transform(
                F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("i"))),
                         lambda h: (h["i"] < F.size(parts)) & h["name"].rlike(named_re)
                         & F.regexp_replace(ends(F.get(parts, h["i"])), r"^\s+|\s+$", "").rlike(lit_re)),
                lambda h: one(h, parts, at + head, begins)))

        at = F.length(F.array_join(F.slice(pieces, 1, k), ""))
        return F.when(_is_assignment(p) & _assignment(p, 2).rlike(named_re), bind(at, lambda n: bind(assigned_names(p), lambda names: found(n, names)))).otherwise(none)

    def one(h: Column, parts: Column, start: Column, begins: Column) -> Column:
        cols = finding_cols(line=begins, severity=F.lit(fixed.SEV_MEDIUM), type=F.lit("HARDCODED_CREDENTIAL"),
                            description=F.format_string(fixed.CRED_DESCRIPTION, h["name"]),
                            code_snippet=go_trim(F.get(l["lines"], (begins - l["first"]).cast("int"))["raw"]))
        if with_value:  # cut from the comment-free line at the place in the masked one
            before = F.length(F.array_join(F.slice(parts, 1, h["i"]), ",")) + F.when(h["i"] > 0, 1).otherwise(0)
            text = F.substring(l["nc"], start + before + 1, F.length(ends(F.get(parts, h["i"]))))
            cols += [h["name"].alias("variable"), go_trim(text).alias("value")]
        return F.struct(*cols)

    pieces = F.split(F.regexp_replace(l["ns"], _STATEMENT_START, "$0\u0001"), "\u0001", -1)
    return F.when(candidate, bind(pieces, lambda ps: F.flatten(F.transform(ps, lambda p, k: of_piece(ps, p, k))))).otherwise(none)


def _struct_type(with_value: bool) -> str:
    fields = [f"{n}: {t}" for n, t in FINDING_COLUMNS]
    if with_value:
        fields += ["variable: string", "value: string"]
    return "array<struct<" + ", ".join(fields) + ">>"


def credential_scan(masked: DataFrame, keywords: list[str] | None = None,
                    any_literal: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Op 18: a name holding a keyword (case-insensitive substring) assigned a
    literal by ``:=``, ``=``, ``var`` or ``const``, in any statement of the file; pairs by position.  A call
    such as ``os.Getenv(..)`` is not a literal and is not reported."""
    keep = keep or ["file_id"]
    return masked.select(*keep, F.inline(logical_findings(file_lines(), lambda l: credential_findings(l, keywords, any_literal, True))))


PROSE_ASSIGNMENT = r"""(?<![A-Za-z0-9_])([A-Za-z_]\w*)\s*:?=(?!=)\s*("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|`[^`\n]*+`)"""


def credentials_in_text(df: DataFrame, text: str, keep: list[str], keywords: list[str] | None = None) -> DataFrame:
    """Op 18 for running text: ``name = "literal"`` wherever it stands on a line, whatever is about it.
    Prose has no statements, comments or code quotes to mask."""
    named_re = "(?i)" + "|".join(re.escape(k) for k in keywords or fixed.CREDENTIAL_KEYWORDS)
    lines = df.where(F.col(text).rlike(named_re)).select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    hits = lines.where(F.col("raw").rlike(PROSE_ASSIGNMENT)).select(*keep, "pos", "raw", F.explode(F.regexp_extract_all("raw", F.lit(PROSE_ASSIGNMENT), 0)).alias("m"))
    name = F.regexp_extract("m", PROSE_ASSIGNMENT, 1)
    return hits.where(name.rlike(named_re)).select(
        *keep, *finding_cols(line=F.col("pos") + 1, severity=F.lit(fixed.SEV_MEDIUM), type=F.lit("HARDCODED_CREDENTIAL"),
                             description=F.format_string(fixed.CRED_DESCRIPTION, name), code_snippet=go_trim("raw")),
        name.alias("variable"), F.regexp_extract("m", PROSE_ASSIGNMENT, 2).alias("value"))


# ---- op 19 unsanitized input ----------------------------------------------------
FILE_FROM_REQUEST = r"os\.(?:Open|ReadFile)\(\s*r\.(?:FormValue|URL\.Query|Header)"


def unsanitized_input_scan(df: DataFrame, code: str = "code",
                           keep: list[str] | None = None) -> DataFrame:
    """Op 19: raw-text rules on purpose (no masking).  A: ``exec.Command``;
    B: ``os.Open``/``os.ReadFile`` handed a request value.  A file with no hit
    gets one INPUT_CHECK_OK row."""
    keep = keep or ["file_id"]
    return df.select(*keep, F.inline(unsanitized_input_findings(F.col(code))))


def unsanitized_input_findings(c: Column) -> Column:
    """array of op 19 findings for one file (never empty)."""
    item = lambda d, s: F.struct(F.lit(d).alias("d"), F.lit(s).alias("s"))
    hits = F.filter(F.array(
        F.when(c.contains("exec.Command"), item(fixed.EXEC_DESCRIPTION, fixed.EXEC_SNIPPET)),
        F.when(c.rlike(FILE_FROM_REQUEST), item(fixed.FILE_INPUT_DESCRIPTION,
                                                 "os.Open(r.FormValue(...))"))),
        lambda x: x.isNotNull())
    ok = F.array(F.struct(F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("s")))

    def one(h: Column) -> Column:
        is_ok = h["d"].isNull()
        return finding_struct(
            line=F.when(~is_ok, F.lit(0)),
            severity=F.when(~is_ok, F.lit(fixed.SEV_MEDIUM)),
            type=F.when(is_ok, F.lit("INPUT_CHECK_OK")).otherwise(F.lit("UNSANITIZED_INPUT")),
            description=h["d"], code_snippet=h["s"],
            status=F.when(is_ok, F.lit("success")),
            message=F.when(is_ok, F.lit(fixed.INPUT_OK_MESSAGE)))
    return F.transform(F.when(F.size(hits) > 0, hits).otherwise(ok), one)


# ---- function spans (ops 20, 22) ----------------------------------------------
FUNC_HEADER = r"^func\b"
FUNC_NAME = r"^func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"


def function_spans(ns_lines: Column) -> Column:
    """array<struct<fn_seq, function, fn_line, n_lines>> for a file.

    A function starts at a ``func`` line in column 0 (gofmt layout) and ends
    at the first ``}`` in column 0, or on its own line when that line closes
    the body.  Function literals belong to the enclosing function."""
    return bind(ns_lines, lambda lines: bind(_starts(lines), lambda starts: _spans(lines, starts)))


def _starts(lines: Column) -> Column:
    marked = F.transform(lines, lambda line, i: F.when(line.rlike(FUNC_HEADER), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def _spans(lines: Column, starts: Column) -> Column:
    def span(s: Column, k: Column) -> Column:
        nxt = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
        ends = F.transform(F.slice(lines, s, nxt - s), lambda line, j: F.when(j == 0, line.rlike(r"\}\s*$"))
                           .otherwise(line.rlike(r"^\}")))
        end = F.array_position(ends, True)
        return F.struct((k + 1).cast("bigint").alias("fn_seq"),
                        F.regexp_extract(F.get(lines, s - 1), FUNC_NAME, 1).alias("function"),
                        s.cast("bigint").alias("fn_line"),
                        F.when(end > 0, end).otherwise(nxt - s).cast("int").alias("n_lines"))

    return F.transform(starts, span)


COMPLEXITY_RE = r"\b(?:if|for|case)\b|&&|\|\|"


def complexity(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 22: per function 1 + if (else-if included) + for + case + && + ||,
    counted on the masked text.  Row-local: no shuffle."""
    keep = keep or ["file_id"]
    return masked.select(*keep, F.inline(function_complexity()))


def function_complexity() -> Column:
    """array<struct<function, line, complexity>> of a masked file."""
    return bind(F.split("code_ns", "\n", -1), lambda lines: F.transform(
        function_spans(lines), lambda sp: F.struct(
            sp["function"].alias("function"), sp["fn_line"].alias("line"),
            (F.regexp_count(F.array_join(F.slice(lines, sp["fn_line"].cast("int"), sp["n_lines"]), "\n"),
                            F.lit(COMPLEXITY_RE)) + 1).cast("bigint").alias("complexity"))))


def complexity_findings(fns: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 23: > 15 CRÍTICO, > 10 ALTO, else no row."""
    keep = keep or ["file_id"]
    return (fns.where(F.col("complexity") > fixed.COMPLEXITY_THRESHOLD)
            .select(*keep, *finding_cols(**_complexity_fields(F.col("function"), F.col("line"),
                                                              F.col("complexity")))))


def _complexity_fields(function: Column, line: Column, cx: Column) -> dict:
    sev = (F.when(cx > fixed.COMPLEXITY_CRITICAL, F.lit(fixed.SEV_CRITICAL))
           .when(cx > fixed.COMPLEXITY_THRESHOLD, F.lit(fixed.SEV_HIGH)))
    return dict(line=line, severity=sev, type=F.lit("HIGH_COMPLEXITY"), function=function,
                complexity=cx, threshold=F.lit(fixed.COMPLEXITY_THRESHOLD))


def complexity_finding_array() -> Column:
    """array of op 23 findings of a masked file."""
    return F.transform(F.filter(function_complexity(),
                                lambda f: f["complexity"] > fixed.COMPLEXITY_THRESHOLD),
                       lambda f: finding_struct(**_complexity_fields(f["function"], f["line"],
                                                                     f["complexity"])))


# ---- op 20 taint flow ---------------------------------------------------------
TAINT_SOURCE = (r"\bos\.Args\b|\b(?:r|req|request)\.(?:FormValue|PostFormValue|URL\.Query|"
                r"URL\.Path|Header|Body|Form|PostForm|Cookie)\b")
TAINT_SINK = (r"\b(exec\.CommandContext|exec\.Command|os\.OpenFile|os\.Open|os\.ReadFile|"
              r"os\.Create|os\.WriteFile|os\.RemoveAll|os\.Remove|ioutil\.ReadFile|http\.Get)\s*\(")
SQL_SINK = r"(\.(?:QueryRowContext|QueryRow|QueryContext|Query|ExecContext|Exec|PrepareContext|Prepare))\s*\("
IDENT = r"\b[A-Za-z_]\w*\b"
USE_T = "array<struct<kind:string,sink:string,args:string,nc:string>>"


def call_args(text: Column) -> Column:
    """Length of the arguments at the start of ``text``: up to the bracket that
    closes the call, or all of it when the call runs on to the next line."""
    toks = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), 0)

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(
            depth.alias("depth"), (acc["n"] + F.when(depth == 0, 0).otherwise(F.length(t))).alias("n")))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    return F.aggregate(toks, start, step)["n"]


def _sinks(nc: Column, ns: Column, pattern: str, kind: str) -> Column:
    """Every call of one kind on a line with its own arguments.  The line is split
    before each sink; the piece behind a sink's bracket starts its arguments."""
    heads = F.regexp_extract_all(ns, F.lit(pattern), 0)
    names = F.regexp_extract_all(ns, F.lit(pattern), 1)

    def use(name: Column, i: Column, gaps: Column, heads_: Column) -> Column:
        upto = lambda arr, n: F.length(F.array_join(F.slice(arr, 1, n), ""))
        at = upto(gaps, i + 1) + upto(heads_, i + 1) + 1
        return bind(rest(ns, at), lambda tail: bind(call_args(tail), lambda n: F.struct(
            F.lit(kind).alias("kind"), name.alias("sink"), F.substring(tail, F.lit(1), n).alias("args"),
            F.substring(nc, at, n).alias("nc"))))

    every = bind(F.split(ns, pattern, -1), lambda gaps: bind(heads, lambda hs: F.transform(
        names, lambda name, i: use(name, i, gaps, hs))))
    return F.when(ns.rlike(pattern), every).otherwise(F.array().cast(USE_T))


def taint_flow(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 20: request or ``os.Args`` input reaching a sensitive call, and input or
    a concatenated query reaching ``Query``/``Exec``/``Prepare``, directly or
    through one variable of the same function.

    A definition line carries each kind that fits it; kind ``input`` is tainted
    data at any sink, kind ``sql`` a concatenated query at an SQL sink, and every
    sink on a line is matched with its own arguments.  All of it lies within one
    function of one file, so definitions and uses are arrays in the file's row:
    one scan, no shuffle."""
    keep = keep or ["file_id"]

    def line_facts(l: Column, line_no: Column) -> Column:
        nc, ns = l["nc"], l["ns"]
        is_sql = sql_concat_flag(nc, ns)
        is_input = _assignment(ns, 4).rlike(TAINT_SOURCE)
        kinds = F.array_compact(F.array(F.when(is_input, F.lit("input")), F.when(is_sql, F.lit("sql"))))
        defs = F.when(_is_assignment(ns) & (F.size(kinds) > 0), F.flatten(F.transform(
            F.filter(assigned_names(ns), lambda v: v != "_"), lambda v: F.transform(kinds, lambda k: F.struct(
                v.alias("variable"), k.alias("kind"), line_no.alias("line_no"))))))
        uses = F.concat(_sinks(nc, ns, TAINT_SINK, "call"), _sinks(nc, ns, SQL_SINK, "query"))
        return F.struct(line_no.alias("line_no"), defs.alias("defs"), uses.alias("uses"))

    z = F.arrays_zip(F.split("code_nc", "\n", -1).alias("nc"), F.split("code_ns", "\n", -1).alias("ns"))
    maybe = F.col("code_ns").rlike(TAINT_SINK) | F.col("code_ns").rlike(SQL_SINK)

    def per_function(lines: Column) -> Column:
        return F.transform(function_spans(F.transform(lines, lambda l: l["ns"])), lambda sp: F.struct(
            sp["fn_seq"].alias("fn_seq"), sp["function"].alias("function"),
            F.filter(F.transform(F.slice(lines, sp["fn_line"].cast("int"), sp["n_lines"]),
                                 lambda l, j: line_facts(l, sp["fn_line"] + j)),
                     lambda f: f["defs"].isNotNull() | (F.size(f["uses"]) > 0)).alias("facts")))

    fns = masked.where(maybe).select(*keep, F.inline(bind(z, per_function)))
    fns = fns.select(*keep, "function", F.flatten(F.transform("facts", lambda f: F.coalesce(
        f["defs"], F.array().cast("array<struct<variable:string,kind:string,line_no:bigint>>")))).alias("defs"), "facts")
    use = fns.select(*keep, "function", "defs", F.explode("facts").alias("f")).select(
        *keep, "function", "defs", F.col("f.line_no").alias("sink_line"), F.explode("f.uses").alias("u"))
    fits = lambda kind: (kind == "input") | (F.col("u.kind") == "query")
    direct = F.array_compact(F.array(F.when(F.col("u.args").rlike(TAINT_SOURCE), F.lit("input")),
                                     F.when((F.col("u.kind") == "query") & sql_concat_flag(F.col("u.nc"), F.col("u.args")),
                                            F.lit("sql"))))
    direct = F.transform(direct, lambda k: F.struct(k.alias("kind"), F.lit("").alias("variable"),
                                                    F.col("sink_line").alias("source_line")))
    names = F.array_distinct(F.regexp_extract_all(F.col("u.args"), F.lit(IDENT), 0))
    via = bind(names, lambda own: F.transform(
        F.filter("defs", lambda d: (d["line_no"] < F.col("sink_line")) & fits(d["kind"]) & F.array_contains(own, d["variable"])),
        lambda d: F.struct(d["kind"].alias("kind"), d["variable"].alias("variable"), d["line_no"].alias("source_line"))))
    return use.select(*keep, "function", "sink_line", F.col("u.sink").alias("sink"), F.inline(F.concat(direct, via))) \
        .select(*keep, "function", "kind", "variable", "source_line", "sink_line", "sink")


# ---- op 21 forbidden calls ------------------------------------------------------
def _deny_regex() -> str:
    calls = sorted((c for c, _ in fixed.DENYLIST), key=len, reverse=True)
    return r"(?<![\w.])(" + "|".join(re.escape(c) for c in calls) + r")\s*\("


DENY_RE = _deny_regex()


def _risk_map() -> Column:
    return F.create_map(*[x for c, r in fixed.DENYLIST for x in (F.lit(c), F.lit(r))])


def forbidden_call_scan(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 21: selector calls ``pkg.Name(`` on the denylist, with their risk
    text.  The 13-entry list is a map literal in the plan: no join at all."""
    keep = keep or ["file_id"]
    lines = source_lines(masked, keep).where(F.col("ns").rlike(DENY_RE))
    return (lines.select(*keep, "line_no", F.posexplode(
        F.regexp_extract_all("ns", F.lit(DENY_RE), 1)).alias("pos_in_line", "call"))
        .select(*keep, F.col("line_no").alias("line"), "pos_in_line", "call",
                F.element_at(_risk_map(), F.col("call")).alias("risk")))


def first_violation(calls: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The violation the validator would report: first in source order.
    ``min`` of a struct led by (line, position) is a partial aggregate, so
    each map task sends one row per file."""
    keep = keep or ["file_id"]
    first = F.min(F.struct("line", "pos_in_line", "call", "risk")).alias("v")
    return (calls.groupBy(*keep).agg(first)
            .select(*keep, F.col("v.line").alias("line"), F.col("v.call").alias("call"),
                    F.col("v.risk").alias("risk"),
                    F.format_string(fixed.REJECT_MESSAGE, F.col("v.call"), F.col("v.risk")).alias("message")))


# ---- op 6 code policy -----------------------------------------------------------
IMPORT_SECTION = r"(?m)^import\s*(?:\([^)]*\)|(?:[\w.]+\s+)?\"[^\"]*\")"
IMPORT_SPEC = r"(?:[\w.]+[ \t]+)?\"[^\"]*\""


def code_policy_check(masked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Op 6: one row per broken program rule: over 60 lines, ``os.Args``,
    ``os.Exit``, no ``package main``, no ``func main()``, unused import."""
    keep = keep or ["file_id"]
    ns, nc = F.col("code_ns"), F.col("code_nc")
    n_lines = F.size(F.split(go_trim("code"), "\n", -1))
    specs = F.flatten(F.transform(F.regexp_extract_all(nc, F.lit(IMPORT_SECTION), 0),
                                  lambda sec: F.regexp_extract_all(
                                      F.regexp_replace(sec, r"^import\s*", ""), F.lit(IMPORT_SPEC), 0)))
    imports = F.transform(specs, lambda s: F.struct(
        F.regexp_extract(s, r'"([^"]*)"', 1).alias("path"),
        F.coalesce(F.nullif(F.regexp_extract(s, r"^([\w.]+)[ \t]+", 1), F.lit("")),
                   F.regexp_extract(s, r'"(?:[^"]*/)?([^"/]*)"', 1)).alias("name")))
    unused = F.transform(F.filter(imports, lambda i: ~i["name"].isin("_", ".")
                                  & ~F.regexp_like(ns, F.concat(F.lit(r"\b"), i["name"], F.lit(r"\.")))),
                         lambda i: F.struct(F.lit("unused_import").alias("rule"), i["path"].alias("detail")))
    rule = lambda name, cond, detail=None: F.when(cond, F.struct(
        F.lit(name).alias("rule"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))
    fixed_rules = F.filter(F.array(
        rule("too_long", n_lines > fixed.MAX_PROGRAM_LINES, n_lines.cast("string")),
        rule("os_args", ns.rlike(r"\bos\.Args\b")),
        rule("os_exit", ns.rlike(r"\bos\.Exit\s*\(")),
        rule("no_package_main", ~ns.rlike(r"(?m)^\s*package\s+main\b")),
        rule("no_func_main", ~ns.rlike(r"(?m)^func\s+main\s*\(\s*\)"))), lambda x: x.isNotNull())
    return masked.select(*keep, F.inline(F.concat(fixed_rules, unused)))


# ---- op 7 prompt injection ------------------------------------------------------
def prompt_injection_scan(df: DataFrame, text: str, keep: list[str],
                          phrases: list[str] | None = None) -> DataFrame:
    """Op 7: any text holding an injection phrase (case-insensitive) gives one
    CRÍTICO PROMPT_INJECTION_ATTEMPT row at line 0; the snippet is the first
    phrase found, as written.  The phrase list compiles into one regex."""
    phrases = phrases or fixed.INJECTION_PHRASES
    pat = "(?iu)(" + "|".join(re.escape(p) for p in phrases) + ")"
    return (df.where(F.col(text).rlike(pat))
            .select(*keep, *finding_cols(line=F.lit(0), severity=F.lit(fixed.SEV_CRITICAL),
                                         type=F.lit("PROMPT_INJECTION_ATTEMPT"),
                                         description=F.lit(fixed.INJECTION_DESCRIPTION),
                                         code_snippet=F.regexp_extract(text, pat, 1))))

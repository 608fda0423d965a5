"""Text extraction, semi-structured -> rows: ops 8-10 and 12-15.

Everything is row-local: a transcript, report or stream buffer is split and
exploded inside its own row, so no operator here shuffles except op 13,
which ranges a stream's chunks by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions import fixed
from codesieve.functions.jsonline import parse_objects, whole_value_ok, wrapped
from codesieve.functions.text import bind, col_, go_rtrim, go_trim, regex_quote, rest
from codesieve.operators.scans import FINDING_COLUMNS
from codesieve.session import ensure_checkpoint_dir


# ---- op 8 -----------------------------------------------------------------
def _locate(sub: str, text: Column, start: Column) -> Column:
    """1-based position of literal ``sub`` at or after ``start`` (0 if none)."""
    return F.call_function("locate", F.lit(sub), text, start)


def _after_marker_line(text: Column, start: Column) -> Column:
    """1-based position just past the rest of the marker's line."""
    nl = _locate("\n", text, start)
    return F.when(nl > 0, nl + 1).otherwise(start)


def extract_code(text: Column | str) -> Column:
    """First fenced block: ```go, ```Go, ```golang in that order (closed
    ones only), else the first ``` of any kind; an unclosed one runs to the
    end; no fence gives ''.  All literal ``instr``/``substring`` arithmetic."""
    t = col_(text)
    result = None
    for m in fixed.GO_FENCES:
        at = F.instr(t, m)
        body_start = _after_marker_line(t, at + len(m))
        end = _locate(fixed.FENCE, t, body_start)
        cand = F.when((at > 0) & (end > 0), go_trim(F.substring(t, body_start, end - body_start)))
        result = cand if result is None else F.coalesce(result, cand)
    at = F.instr(t, fixed.FENCE)
    body_start = _after_marker_line(t, at + 3)
    end = _locate(fixed.FENCE, t, body_start)
    any_block = (F.when(at == 0, F.lit(""))
                 .when(end == 0, go_trim(rest(t, body_start)))
                 .otherwise(go_trim(F.substring(t, body_start, end - body_start))))
    return F.coalesce(result, any_block)


# ---- ops 9, 10 ---------------------------------------------------------------
FINDING_FIELDS = [(n, "bigint" if t == "bigint" else "string") for n, t in FINDING_COLUMNS]


def _finding_rows(keys: list[str], df: DataFrame, lines: Column, keep_pred=None) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(lines).alias("seq", "raw"))
    t = go_trim(F.col("raw"))
    cand = exploded.where(t.startswith("{")).select(*keys, "seq", t.alias("_t"))
    parsed = parse_objects(cand, F.col("_t"), FINDING_FIELDS)
    out = parsed.where(F.col("f.ok"))
    if keep_pred is not None:
        out = out.where(keep_pred(F.col("f")))
    return out.select(*keys, F.col("seq").cast("bigint").alias("seq"),
                      *[F.col(f"f.{n}").alias(n) for n, _ in FINDING_COLUMNS])


def parse_findings(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Op 9: lines before the first ``---FINDINGS_END---`` (anywhere in the
    text), trimmed, starting with ``{``, valid JSON that fits the schema.
    ``seq`` is the line's index, so row order is recoverable."""
    head = F.substring_index(F.col(text), fixed.FINDINGS_END, 1)
    return _finding_rows(keys, df, F.split(head, "\n", -1))


def parse_findings_strict(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Op 10: stop only at a line equal to the marker after trim; keep rows
    with non-empty severity and type."""
    lines = F.split(F.col(text), "\n", -1)
    stop = F.array_position(F.transform(lines, lambda l: go_trim(l) == fixed.FINDINGS_END), True)
    kept = F.when(stop > 0, F.slice(lines, 1, stop - 1)).otherwise(lines)
    return _finding_rows(keys, df, kept, lambda f: (F.coalesce(f["severity"], F.lit("")) != "")
                         & (F.coalesce(f["type"], F.lit("")) != ""))


# ---- op 12 ------------------------------------------------------------------
def parse_patches(df: DataFrame, report: str, keys: list[str]) -> DataFrame:
    """Op 12: blocks after each ``---FIX_START---`` up to ``---FIX_END---``;
    skipped without an end, without ``ORIGINAL:\\n`` or ``FIXED:\\n``, or
    when FIXED comes first; both sides trimmed and non-empty."""
    blocks = F.split(F.col(report), regex_quote(fixed.FIX_START), -1)
    ex = df.select(*keys, F.posexplode(blocks).alias("seq", "block")).where(F.col("seq") > 0)
    b = F.col("block")
    end = F.instr(b, fixed.FIX_END)
    body = F.col("body")
    o = F.instr(body, fixed.ORIGINAL_TAG)
    f = F.instr(body, fixed.FIXED_TAG)
    o_start = o + len(fixed.ORIGINAL_TAG)
    good = (o > 0) & (f > 0) & (f >= o_start)
    original = F.when(good, go_trim(F.substring(body, o_start, f - o_start)))
    fixed_ = F.when(good, go_trim(rest(body, f + len(fixed.FIXED_TAG))))
    return (ex.where(end > 0)
            .select(*keys, "seq", F.substring(b, F.lit(1), end - 1).alias("body"))
            .select(*keys, "seq", original.alias("original"), fixed_.alias("fixed"))
            .where((F.coalesce(F.col("original"), F.lit("")) != "") & (F.coalesce(F.col("fixed"), F.lit("")) != ""))
            .select(*keys, F.col("seq").cast("bigint").alias("seq"), "original", "fixed"))


# ---- op 13 ------------------------------------------------------------------
SEPARATOR = "\n\n"
LINES = "s string, part int, kind string, n bigint, frame_no bigint, line_no bigint, data string, tail string"


def _data_lines(frame: str):
    """(line number, what follows ``data: ``) of a frame's data lines."""
    return ((j, line[6:]) for j, line in enumerate(frame.split("\n")) if line.startswith("data: "))


def _joined_up(text: str) -> int:
    """Where, in a text that may go on from another, its first frame of its own starts: behind the first separator after a
    character that is no line end (from there on the pairing of line ends depends on this text only).  0 if there is none yet."""
    start = len(text) - len(text.lstrip("\n"))
    at = text.find(SEPARATOR, start) if start < len(text) else -1
    return at + len(SEPARATOR) if at >= 0 else 0


def _range_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted range of chunks -> its data lines (``kind`` line, frames counted from the range's first own frame of the
    stream) and, for the first and the last stream of the range, what its neighbours need: ``head`` (text before the first own
    frame, and the tail), ``middle`` (text without an own frame) or ``open`` (a stream that starts here), with the number of
    own frames in ``n``.  Only an unfinished frame is held."""
    part, now, held, own, frames, first, out = TaskContext.get().partitionId(), None, "", False, 0, True, []
    head = ""

    def closed(last: bool):
        if first:
            out.append((now, part, "head", frames, None, None, head, held) if own else (now, part, "middle", 0, None, None, held, ""))
        elif last:
            out.append((now, part, "open", frames, None, None, "", held))

    for b in batches:
        for s, chunk in zip(b["s"], b["c"], strict=True):
            if s != now:
                if now is not None:
                    closed(False)
                    first = False
                now, held, own, frames = s, "", not first, 0
            if chunk:
                seen = max(0, len(held) - 1)
                held += chunk
                if not own:
                    at = _joined_up(held)
                    if at:
                        head, held, own, seen = held[:at - len(SEPARATOR)], held[at:], True, 0
                if own and held.find(SEPARATOR, seen) >= 0:
                    *done, held = held.split(SEPARATOR)
                    for frame in done:
                        out += [(s, part, "line", 0, frames, j, d, "") for j, d in _data_lines(frame)]
                        frames += 1
        if len(out) >= 4096:
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in LINES.split(", ")], dtype=object)
            out.clear()
    if now is not None:
        closed(True)
    if out:
        yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in LINES.split(", ")], dtype=object)


STITCHED = "s string, part int, frame_no bigint, line_no bigint, data string"


def _stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Border pieces in order of stream and range -> the data lines of frames that cross borders (``part`` null), and for each
    range with own frames the number of frames before them (``data`` null)."""
    now, tail, frames = None, "", 0

    def lines(parts):
        nonlocal frames
        for frame in parts:
            yield from ((now, None, frames, j, d) for j, d in _data_lines(frame))
            frames += 1

    for b in batches:
        out = []
        for s, part, kind, n, text, after in zip(b["s"], b["part"], b["kind"], b["n"], b["data"], b["tail"], strict=True):
            if s != now:
                out += lines(tail.split(SEPARATOR)[:-1])
                now, tail, frames = s, "", 0
            if kind == "middle":
                tail += text
                continue
            if kind == "head":
                out += lines((tail + text).split(SEPARATOR))
                out.append((s, part, frames, None, None))
            tail, frames = after, frames + int(n)
        if out:
            yield pd.DataFrame(out, columns=["s", "part", "frame_no", "line_no", "data"], dtype=object)
    rest_ = list(lines(tail.split(SEPARATOR)[:-1]))
    if rest_:
        yield pd.DataFrame(rest_, columns=["s", "part", "frame_no", "line_no", "data"], dtype=object)


def events_of_lines(lines: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Data lines that are valid JSON, with type and message; each is parsed once."""
    rows = lines.select(*keys, F.col(data).alias("payload"), wrapped(F.col(data)).alias("_w"))
    return (rows.where(whole_value_ok(F.col("_w"), F.col("payload")))
            .select(*keys, F.try_variant_get("_w", "$[0].type", "string").alias("type"),
                    F.try_variant_get("_w", "$[0].message", "string").alias("message"), "payload"))


def decode_frames(chunks: DataFrame, key: str = "stream_id", no: str = "chunk_no",
                  chunk: str = "chunk", partitions: int | None = None) -> DataFrame:
    """Op 13 (batch): chunks of a stream in order -> buffer -> frames ->
    events.  The tail after the last blank line is dropped, as a reader
    that stops there would.

    The chunks are ranged by (stream, number), so that a stream of any size spreads over many tasks, which hold one
    unfinished frame each.  A range's first stream may go on from the range before: its text up to its first own frame is
    put together with the tail left there, and frame numbers are offset by what came before, from at most two border
    rows a range.  The decoded lines are written to the checkpoint folder."""
    spark, kind = chunks.sparkSession, chunks.schema[key].dataType.simpleString()
    ensure_checkpoint_dir(spark)
    src = chunks.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"), F.col(no).alias("n"), F.col(chunk).alias("c"))
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = src.repartitionByRange(width, "s", "n").sortWithinPartitions("s", "n").select("s", "c").mapInPandas(_range_lines, LINES).checkpoint(eager=True)
    border = found.where("kind <> 'line'").repartition("s").sortWithinPartitions("s", "part")
    pieces = border.mapInPandas(_stitched, STITCHED).checkpoint(eager=True)
    before = F.broadcast(pieces.where("data is null").select("s", "part", F.col("frame_no").alias("before")))  # at most a row a range
    own = found.where("kind = 'line'").join(before, ["s", "part"], "left").select(
        "s", (F.col("frame_no") + F.coalesce("before", F.lit(0))).alias("frame_no"), "line_no", "data")
    lines = own.unionByName(pieces.where("data is not null").select("s", "frame_no", "line_no", "data"))
    return events_of_lines(lines.select(F.nullif("s", F.lit("")).cast(kind).alias(key), "frame_no", "line_no", "data"), [key, "frame_no", "line_no"])


# ---- op 14 ------------------------------------------------------------------
def fence_marks(lines: Column) -> Column:
    """array<struct<i, opens, lang>>: the lines that open or close a block, with
    the language that an opening one names.  A block opens at a line starting with ``` and closes at the next line that
    is exactly ``` after a right trim; an unclosed one runs to the end.

    Written as letters, bare fences B and named ones N, the fences fall into runs ``NB*`` (and ``B+`` before the first N).  Behind an N a block is
    open whatever came before, so within a run the bare ones close and open by turns, and the N itself opens unless the run before it left a block
    open: the labels of all fences follow run by run, in time proportional to their number."""
    cand = F.array_compact(F.transform(lines, lambda line, i: F.when(line.startswith(fixed.FENCE), F.struct(
        (i + 1).alias("i"), (go_rtrim(line) == fixed.FENCE).alias("bare"), go_trim(rest(line, 4)).alias("lang")))))
    named = lambda run: run.startswith("N")

    def left_open(run: Column) -> Column:  # N and an even number of bare ones, or an odd number of bare ones alone
        return F.length(run) % 2 == 1

    def labels(run: Column, before: Column) -> Column:  # 1 opens, 0 closes, null is text within a block
        first = F.when(named(run), F.when(F.coalesce(left_open(before), F.lit(False)), F.lit(None).cast("int")).otherwise(1)).otherwise(1)
        return F.transform(F.sequence(F.lit(0), F.length(run) - 1), lambda k: F.when(k == 0, first).otherwise(F.when(k % 2 == 1, 0).otherwise(1)))

    def marks(fences: Column) -> Column:
        letters = F.array_join(F.transform(fences, lambda c: F.when(c["bare"], "B").otherwise("N")), "")
        each = bind(F.regexp_extract_all(letters, F.lit("NB*+|B++"), 0), lambda runs: F.flatten(
            F.transform(runs, lambda run, k: labels(run, F.get(runs, k - 1)))))
        return bind(each, lambda own: F.array_compact(F.transform(fences, lambda c, k: F.when(F.get(own, k).isNotNull(), F.struct(
            c["i"].alias("i"), (F.get(own, k) == 1).alias("opens"), c["lang"].alias("lang"))))))

    return bind(cand, marks)


def report_lines(df: DataFrame, report: str, keys: list[str]) -> DataFrame:
    """Op 14: each report line labelled code / hr / summary / h3 / h4 /
    finding_critical / finding_medium / finding_low / paragraph; blank lines
    outside code and the fence lines themselves give no row.

    The report is cut into the stretches between its fence lines; each stretch
    is one row with its own lines, which are then exploded."""
    def stretches(lines: Column, marks: Column) -> Column:
        ends = F.concat(F.transform(marks, lambda m: m["i"]), F.array(F.size(lines) + 1))
        return F.transform(ends, lambda e, k: bind(
            F.coalesce(F.get(marks, k - 1)["i"], F.lit(0)), lambda s: F.struct(
                s.alias("from"), F.coalesce(F.get(marks, k - 1)["opens"], F.lit(False)).alias("in_code"),
                F.get(marks, k - 1)["lang"].alias("lang"), F.slice(lines, s + 1, e - s - 1).alias("ls"))))

    cut = bind(F.split(F.col(report), "\n", -1), lambda lines: bind(
        fence_marks(lines), lambda marks: stretches(lines, marks)))
    ex = (df.select(*keys, F.explode(cut).alias("st"))
          .select(*keys, F.col("st.from").alias("from"), F.col("st.in_code").alias("in_code"),
                  F.col("st.lang").alias("lang"), F.posexplode("st.ls").alias("pos", "raw")))
    in_code, raw, trimmed = F.col("in_code"), F.col("raw"), go_trim(F.col("raw"))
    kind = (F.when(in_code, F.lit("code"))
            .when(trimmed == "", F.lit(None))
            .when(trimmed.rlike(r"^-{3,}$"), F.lit("hr"))
            .when(trimmed == "**RESUMEN**", F.lit("summary"))
            .when(raw.startswith("### "), F.lit("h4"))
            .when(raw.startswith("## "), F.lit("h3"))
            .when(raw.startswith("🔴"), F.lit("finding_critical"))
            .when(raw.startswith("🟡"), F.lit("finding_medium"))
            .when(raw.startswith("🟢"), F.lit("finding_low"))
            .otherwise(F.lit("paragraph")))
    text = (F.when(raw.startswith("### ") & ~in_code, rest(raw, 5))
            .when(raw.startswith("## ") & ~in_code, rest(raw, 4)).otherwise(raw))
    return (ex.select(*keys, (F.col("from") + F.col("pos") + 1).cast("bigint").alias("line_no"), kind.alias("kind"),
                      F.when(in_code, F.col("lang")).alias("lang"), text.alias("text"))
            .where(F.col("kind").isNotNull()))


# ---- op 15 ------------------------------------------------------------------
FINDING_LINE = r"^\s*(🔴|🟡|🟢)\s*(\S+)\s+—\s+(.*?)(?:\s*\(línea (\d+)\))?\s*$"
COMPLEXITY_LINE = r"^\s*⚠\s*([\w.]+)\(\):\s*complejidad\s+(\d+)"
OK_LINE = r"^\s*✓\s*(.*?)\s*$"
FIX_LINE = r"^\s+Fix:\s*(.*?)\s*$"


def report_findings(df: DataFrame, report: str, keys: list[str]) -> DataFrame:
    """Op 15: report-format lines back to rows; an indented ``Fix:`` line is
    bound to the nearest finding line above it (row-local, no window)."""
    marked = lambda line: (F.when(line.rlike(FINDING_LINE) | line.rlike(COMPLEXITY_LINE)
                                  | line.rlike(OK_LINE), F.lit("head"))
                           .when(line.rlike(FIX_LINE), F.lit("fix")))
    items = bind(F.split(F.col(report), "\n", -1), lambda lines: F.filter(
        F.transform(lines, lambda line, i: F.struct((i + 1).alias("i"), marked(line).alias("what"), line.alias("line"))),
        lambda x: x["what"].isNotNull()))

    def heads(found: Column) -> Column:  # the first fix line below a head is the next item, or none
        rows = F.transform(found, lambda x, k: F.struct(
            x["i"].alias("i"), x["what"].alias("what"), x["line"].alias("line"),
            F.when(F.get(found, k + 1)["what"] == "fix", F.get(found, k + 1)["line"]).alias("fix")))
        return F.filter(rows, lambda x: x["what"] == "head")

    base = df.select(*keys, F.inline(bind(items, heads)))
    i, line = F.col("i"), F.col("line")
    fix = F.when(F.col("fix").isNotNull(), F.regexp_extract("fix", FIX_LINE, 1))
    kind = (F.when(line.rlike(FINDING_LINE), F.lit("finding"))
            .when(line.rlike(COMPLEXITY_LINE), F.lit("complexity")).otherwise(F.lit("ok")))
    sev = F.when(kind == "finding", F.regexp_extract(line, FINDING_LINE, 2))
    title = (F.when(kind == "finding", F.regexp_extract(line, FINDING_LINE, 3))
             .when(kind == "ok", F.regexp_extract(line, OK_LINE, 1)))
    ln = F.when(kind == "finding", F.nullif(F.regexp_extract(line, FINDING_LINE, 4), F.lit(""))).cast("bigint")
    return base.select(*keys, i.cast("bigint").alias("report_line"), kind.alias("kind"), sev.alias("severity"),
                       title.alias("title"), ln.alias("line"),
                       F.when(kind == "complexity", F.regexp_extract(line, COMPLEXITY_LINE, 1)).alias("function"),
                       F.when(kind == "complexity", F.regexp_extract(line, COMPLEXITY_LINE, 2))
                       .cast("bigint").alias("complexity"),
                       fix.alias("fix"))

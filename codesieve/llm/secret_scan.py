"""Secret scan: fixed patterns, and novelty against primed zstandard dictionaries.

Kinds, in this order at equal starts:

* ``assign``: ``password``/``passwd``/``secret``/``token``/``api_key`` (any
  case), ``:`` or ``=``, and a value of six characters or more;
* ``access``: ``AKIA`` and upper-case letters or digits, 20 or more in all;
* ``hex``: 24 or more lower-case hex digits;
* ``novel``: a run of 16 or more code-like characters that mixes digits and
  letters and is more than names (hosts, paths and identifiers: words, perhaps with a few digits behind them, between
  marks), has a sensitive word in the 64 characters before it or in the ``REACH`` characters of its line on either side,
  overlaps no span above, and is incompressible: the bytes it adds to a zstandard frame, primed with the
  identifier dictionary and filled with the surrounding 512 characters, are at
  least ``novelty`` of its own length.  A run is divided at ``=``: each part of 16 or
  more characters is looked at (padding belongs to the part before it), and the
  whole run if none of them is a span.  In a private key block every body line is
  such a span, also the short last one, if any line of it is incompressible beside
  the text around the block (line breaks may be written ``\\n``).

Every reported span carries its novelty.  Offsets are code points, end exclusive.

Edge cases: a null or empty text has no spans (an empty list, not null).  Rows
are independent, so ties and repeated rows simply repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
PART = re.compile(r"[A-Za-z0-9+/_.~-]{16,}(?:={1,2}(?![A-Za-z0-9+/_.=~-]))?")
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr])*[A-Za-z-]+:\x20[^\n\\]*+)*")
BODY = re.compile(r"""(?:[A-Za-z0-9+/=\s"',#*>|]|\\[nr])*+""")
BODY_LINE = re.compile(r"(?:(?<=\\)[nr])?+((?=[+/]*[A-Za-z0-9=])[A-Za-z0-9+/]+={0,2}|=[A-Za-z0-9+/]{4})")
NAMED = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]{2,12})?[0-9]{0,4}|(?:[A-Z]?[a-z]{2,}|[A-Z]{2,12}(?![a-z]))+[0-9]{0,4}")
MARK = re.compile(r"[+/_=.~-]+")
REACH = 256
SENSITIVE = re.compile(r"passw|pwd|secret|token|credential|private|bearer|auth|signature|api[ _-]?key|access[ _-]?key|\bkey\b", re.I | re.A)

#: What source files name often: common identifiers, prefixes and suffixes.
IDENTIFIERS = (
    "abstract address algorithm application argument array assert async attribute authenticate authorization await base64 "
    "boolean buffer button callback certificate channel checksum class client collection column command component config "
    "configuration connection constant container content context controller cookie counter credential database dataset "
    "datetime debug default delegate dependency description destination developer directory document domain element "
    "enabled encoding endpoint environment error event example exception expected export expression factory false field "
    "file filter finally foreach format function generator getter global handler hash header history hostname html http "
    "https identifier image implements import index initialize input instance integer interface internal iterator json "
    "keyword label lambda language length library listener localhost location logger manager mapping message metadata "
    "method middleware migration model module namespace network nullable number object observer operator option output "
    "package parameter parent parser password path pattern permission pipeline plugin pointer port postgres prefix "
    "primary private process production profile promise property protected protocol provider proxy public python query "
    "queue readme receiver record reference registry release repository request resource response result return router "
    "schema scheduler secret security select sequence serializer server service session setting signature singleton "
    "source specification staging static status storage stream string struct suffix switch synchronized system table "
    "template testing thread timeout timestamp token transaction transform true tuple typename undefined unicode update "
    "username utility validate value variable vector version virtual visitor volatile webhook widget window worker "
    "workspace wrapper yaml 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ com/ www. org/ .git/ v1/ "
)

SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"


class _Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, identifiers: str):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._size = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, text: str, start: int, end: int, around: int = 512, block: tuple[int, int] | None = None) -> float:
        """``block``: the part of the text whose outside counts as the surroundings."""
        lo, hi = block or (start, end)
        near = (text[max(0, lo - around):lo] + "\n" + text[hi:hi + around]).encode()
        size = lambda raw: len(self._size.compress(raw))
        own = text[start:end].encode()
        return max(0, size(near + own) - size(near)) / len(own)


def key_blocks(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, lines) of the body of each private key block.  Without an end mark the
    body is as many lines of 16 or more characters as follow one another."""
    at = 0
    while mark := BEGIN.search(text, at):
        at = mark.end()
        body = BODY.match(text, at)
        lines = [m.span(1) for m in BODY_LINE.finditer(text, *body.span())]
        if not text.startswith("-----END", body.end()):
            whole = [e - s >= 16 for s, e in lines] + [False]
            lines = lines[:whole.index(False)]
        if lines:
            yield lines[0][0], lines[-1][1], lines
            at = lines[-1][1]


def _apart(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, overlapping ones as one, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(apart: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether a span of ``_apart`` overlaps a to b."""
    starts, ends = apart
    at = bisect_right(ends, a)
    return at < len(starts) and starts[at] < b


def spans_of(text: str | None, novelty: float, score: _Novelty) -> list[tuple[str, int, int, float]]:
    """All spans of one whole text, by start and kind."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()  # only to see whether a keyword may occur at all
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    runs = list(RUN.finditer(text))  # access and hex spans lie within such runs
    for run in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, run.start(), run.end())]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    base = _apart((s, e) for s, _, e in found)
    scores: dict[tuple[int, int], float] = {}
    blocks: list[tuple[int, int]] = []
    for a, b, lines in key_blocks(text) if "PRIVATE KEY" in text else ():
        own = {x: score(text, *x, block=(a, b)) for x in lines}
        if any(v >= novelty and e - s >= 16 for (s, e), v in own.items()):
            found += [(s, 3, e) for s, e in lines]
            scores |= own
            blocks.append((a, b))
    bodies = _apart(blocks)

    def novel(a: int, b: int) -> bool:
        own = text[a:b]
        if not (any(c.isdigit() for c in own) and any(c.isalpha() for c in own)):
            return False
        if all(NAMED.fullmatch(x) for x in MARK.split(own)) or _meets(base, a, b):
            return False
        line = max(text.rfind("\n", max(0, a - REACH), a) + 1, a - REACH, 0)
        end = text.find("\n", b, b + REACH)
        if not SENSITIVE.search(text, line, end if end >= 0 else b + REACH) and not SENSITIVE.search(text, max(0, a - 64), a):
            return False
        return score(text, a, b) >= novelty

    for run in runs:
        if _meets(bodies, *run.span()):
            continue
        parts = [m.span() for m in PART.finditer(text, *run.span())]
        hits = [x for x in parts if novel(*x)]
        if not hits and run.span() not in parts and novel(*run.span()):
            hits = [run.span()]
        found += [(a, 3, b) for a, b in hits]
    return [(KINDS[k], s, e, scores[s, e] if k == 3 and (s, e) in scores else score(text, s, e)) for s, k, e in sorted(found)]


def scan_secrets(docs: DataFrame, novelty: float = 0.75, identifiers: str = IDENTIFIERS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per document."""
    def run(batches):
        score = _Novelty(identifiers)
        for b in C.frames(batches):
            rows = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in spans_of(t, novelty, score)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": rows})

    return C.texts(docs, id_col, text_col).mapInPandas(run, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, novelty: float = 0.75, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans as one)
    and ``n_chars``, if there is one, counted again; a null text stays null."""
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = _Novelty(IDENTIFIERS)
        for batch in batches:
            out = []
            for t in batch:
                parts, at = [], 0
                for _, s, e, _ in spans_of(t, novelty, score):
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                out.append("".join(parts) + t[at:] if parts else t)
            yield pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(text_col).isNotNull(), F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out

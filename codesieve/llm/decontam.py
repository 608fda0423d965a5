"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters has an error budget k = int(m * rate).
It is cut into k + 1 pieces: text within k edits of the item holds one of
them unchanged.  One Aho-Corasick pass over each whole document finds all
pieces.  A hit is verified from small to large: n neighbouring pieces are halved
again and again, and if they lie in the text with n - 1 edits, so does one half with
one edit less than it has pieces.  So from the piece upwards each such range must
lie about its place within its own budget, and most hits end at two pieces.  For
the whole item Myers' bit-parallel algorithm, which also serves the ranges,
computes the smallest edit distance there.  Distances up to k are leaks.

Items shorter than ``min_chars`` are searched exactly and between word borders
(no edits: they would match by chance).

Characters are compared after lower-casing (where that keeps the length) and with
every white-space character as a space, so places are code points of the text itself.

The items are loaded in blocks of at most ``block_bytes``; each block is one
pass over the documents, so no automaton grows with the benchmark.

Edge cases: null ids take part; null, empty and blank items are not searched; null and empty
texts have no leaks; repeated documents and items give repeated rows; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codesieve.llm import common as C

LEAKS = "doc_id long, item_id long, start long, end long, distance int"
BLANK = re.compile(r"\s")
WORD = re.compile(r"\w")


def folded(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return BLANK.sub(" ", low)


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _closest(m: int, masks: dict[str, int], text: str, enough: int = -1) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any part of ``text`` and where that part
    ends (the first such end), by bit-parallel columns; stops at a distance of ``enough``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (~(x | up) & full), up & x
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        v = eq | down
        up, down = fall | (~(v | rise) & full), rise & v
        if score < best:
            best, end = score, j + 1
            if best <= enough:
                break
    return best, end


class Pattern:
    """One test item: its pieces and the bit masks of its characters.  An item shorter
    than ``min_chars`` is ``exact``.  No piece is shorter than ``piece``."""

    def __init__(self, item_id, text: str, rate: float, piece: int = 1, min_chars: int = 0):
        self.exact = len(text) < min_chars
        self.item_id, self.text = item_id, text.strip(" ") if self.exact else text
        m = len(self.text)
        self.budget = 0 if self.exact else max(0, min(int(m * rate), m // piece - 1))
        self.edges = [m * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.masks = {} if self.exact else _masks(self.text)
        self._range_masks: dict[tuple[int, int], dict[str, int]] = {}

    def closest(self, text: str) -> tuple[int, int]:
        """Smallest edit distance of the item to any part of ``text`` and
        where that part ends (the first such end)."""
        return _closest(len(self.text), self.masks, text)

    def ranges(self, i: int) -> list[tuple[int, int, int]]:
        """(start, end, budget) of the ranges of pieces about piece ``i``, the
        smallest first, without the piece and the whole item."""
        lo, hi, out = 0, self.budget + 1, []
        while hi - lo > 1:
            out.append((self.edges[lo], self.edges[hi], hi - lo - 1))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if i < mid else (mid, hi)
        return out[:0:-1]

    def possible(self, text: str, i: int, start: int) -> bool:
        """Whether every range about piece ``i`` lies near its place when the item would lie at ``start``."""
        for a, b, k in self.ranges(i):
            near = text[max(0, start + a - k):max(0, start + b + k)]
            if (a, b) not in self._range_masks:
                self._range_masks[a, b] = _masks(self.text[a:b])
            if _closest(b - a, self._range_masks[a, b], near, k)[0] > k:
                return False
        return True

    def stands(self, text: str, start: int) -> bool:
        """Whether the exact item at ``start`` is between word borders."""
        end = start + len(self.text)
        return not (start and WORD.match(self.text) and WORD.match(text, start - 1)
                    or WORD.match(self.text, len(self.text) - 1) and WORD.match(text, end))


def automaton(patterns: list[Pattern]) -> ahocorasick.Automaton:
    holders: dict[str, list[tuple[int, int, int]]] = {}
    for p, pattern in enumerate(patterns):
        for i, (at, piece) in enumerate(pattern.pieces):
            holders.setdefault(piece, []).append((p, i, at))
    out = ahocorasick.Automaton()
    for piece, where in holders.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def leaks_of(text: str | None, patterns: list[Pattern], found: ahocorasick.Automaton):
    """(pattern, start, end, distance) of every leak in one whole text."""
    if not text:
        return
    text = folded(text)
    looked: dict[int, int] = {}  # pattern -> last place looked at
    over: dict[int, int] = {}  # pattern -> end of its last leak
    for last, (size, where) in found.iter(text):
        for p, i, at in where:
            pattern = patterns[p]
            k, start = pattern.budget, last + 1 - size - at
            if pattern.exact:
                if start >= over.get(p, 0) and pattern.stands(text, start):
                    over[p] = last + 1
                    yield p, start, last + 1, 0
                continue
            if p in looked and abs(start - looked[p]) <= k or last < over.get(p, 0) or not pattern.possible(text, i, start):
                continue
            looked[p] = start
            lo, hi = max(0, start - 2 * k), start + len(pattern.text) + 2 * k
            distance, end = pattern.closest(text[lo:hi])
            if distance <= k:
                over[p] = lo + end
                yield p, max(lo, lo + end - len(pattern.text)), lo + end, distance


def _blocks(benchmark: DataFrame, block_bytes: int, item_id_col: str, item_text_col: str):
    """The items as lists of (id, folded text), each of at most ``block_bytes`` and one more item;
    one list if all fit in it, since a filter by two takes two Python workers in each task."""
    items = C.texts(benchmark, item_id_col, item_text_col).where(F.col("text").rlike(r"(?U)\S"))
    sums = F.sum(F.octet_length("text")).over(W.partitionBy("part").orderBy("doc_id", "text").rowsBetween(W.unboundedPreceding, -1))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if size <= block_bytes else 2 * -(-size // block_bytes)
    blocks = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).withColumn(
        "block", F.floor(F.coalesce(sums, F.lit(0)) / F.lit(block_bytes)))
    for part, block in sorted((r.part, r.block) for r in blocks.select("part", "block").distinct().collect()):
        rows = blocks.where((F.col("part") == part) & (F.col("block") == block)).select("doc_id", "text").collect()
        yield sorted(((r.doc_id, folded(r.text)) for r in rows), key=lambda r: (r[0] is None, r))


def _patterns(items: list, rate: float, piece: int, min_chars: int) -> list[Pattern]:
    return [Pattern(i, t, rate, piece, min_chars) for i, t in items if t.strip(" ")]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 1, min_chars: int = 32,
               block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance): one row per leak.  ``start`` is
    the end less the item's length, exact for a distance of 0.  The documents are
    read once for each block of the benchmark."""
    docs = C.texts(docs, id_col, text_col)
    spark, out = docs.sparkSession, None
    for items in _blocks(benchmark, block_bytes, item_id_col, item_text_col):
        held = spark.sparkContext.broadcast(items)

        def run(batches, held=held):
            patterns = _patterns(held.value, rate, piece, min_chars)
            found = automaton(patterns)
            for b in C.frames(batches):
                rows = [(i, patterns[p].item_id, s, e, d) for i, t in zip(b["doc_id"], b["text"], strict=True)
                        for p, s, e, d in leaks_of(t, patterns, found)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "distance"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        leaks = docs.mapInPandas(run, LEAKS)
        out = leaks if out is None else out.union(leaks)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, piece: int = 1, min_chars: int = 32,
                  block_bytes: int = 8 << 20, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a leak.  Each row is judged where
    it lies, by one filter for each block of the benchmark: nothing is shuffled."""
    def clean(held):
        @F.pandas_udf("boolean")
        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            patterns = _patterns(held.value, rate, piece, min_chars)
            found = automaton(patterns)
            for texts in batches:
                yield pd.Series([next(leaks_of(t, patterns, found), None) is None for t in texts], dtype=bool)

        return judge(F.col(text_col).cast("string"))

    for items in _blocks(benchmark, block_bytes, item_id_col, item_text_col):
        docs = docs.where(clean(docs.sparkSession.sparkContext.broadcast(items)))
    return docs

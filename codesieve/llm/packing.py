"""Packing into sequences by minimum bin slack.

A document's ids (with the end id) are cut into pieces of ``capacity`` and a
rest.  The rests are known by their lengths: a histogram of at most
``capacity`` counts.  The plan takes the longest length left, and a bitset
subset-sum dynamic program over the remaining multiset finds the fill closest to
capacity; backtracking gives how many of each length it uses.  That pattern is
repeated as long as the counts allow.  Patterns and segments are bounded by the capacity,
not by the data, and are all that the driver holds.

Pieces of one length are interchangeable: each is numbered within its length
(salted, so that a length shared by a third of all documents is numbered by many tasks) and
its number decides pattern, repetition and offset.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C
from codesieve.llm.tokenizing import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``ids`` (little-endian unsigned 32-bit) if asked."""
    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in C.frames(batches, enc):
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                raw = enc.ids(t) + end
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    part = raw[4 * at:4 * (at + capacity)]
                    rows.append((i, at, len(part) // 4, zlib.crc32(part), n, part)[:6 if with_ids else 5])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:6 if with_ids else 5]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))


def closest_fill(counts: np.ndarray, room: int) -> dict[int, int]:
    """length -> count of the multiset within ``counts`` whose sum comes closest
    to ``room`` from below.  Bit s of the set says that sum s can be made; the
    program stops at the first exact fill."""
    mask, states = (1 << (room + 1)) - 1, [1]
    parts: list[tuple[int, int]] = []  # (length, copies): counts in binary parts
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            copies = min(copies, left)
            states.append((states[-1] | (states[-1] << (length * copies))) & mask)
            parts.append((length, copies))
            left, copies = left - copies, copies * 2
            if states[-1] >> room & 1:
                break
        if states[-1] >> room & 1:
            break
    at, used = states[-1].bit_length() - 1, {}
    for k in range(len(parts), 0, -1):  # back from the best sum through the states
        if not states[k - 1] >> at & 1:
            length, copies = parts[k - 1]
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Segments (length, first, times, per, sequence, offset): the pieces of one
    length numbered from ``first`` on go, ``per`` at a time, into ``times``
    sequences from ``sequence`` on, the first of them at ``offset``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    taken, segments, sequence = np.zeros_like(counts), [], 0
    while left := np.flatnonzero(counts).tolist():
        longest = left[-1]
        counts[longest] -= 1
        used = closest_fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[x]) // n for x, n in used.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            segments.append((x, int(taken[x]), times, n, sequence, offset))
            counts[x] -= times * n
            taken[x] += times * n
            offset += x * n
        sequence += times
    return pd.DataFrame(segments, columns=["length", "first", "times", "per", "sequence", "offset"])


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    seg = plan(histogram, capacity).sort_values(["length", "first"], ignore_index=True)
    columns = {c: seg[c].to_numpy(np.int64) for c in seg.columns}
    first_of = np.searchsorted(columns["length"], np.arange(capacity + 2))

    def run(batches):
        for b in C.frames(batches):
            length, number = b["length"].to_numpy(), b["number"].to_numpy()
            k = np.empty(len(b), np.int64)
            for x in np.unique(length):
                lo, hi = first_of[x], first_of[x + 1]
                own = length == x
                k[own] = lo + np.searchsorted(columns["first"][lo:hi], number[own], "right") - 1
            times, within = np.divmod(number - columns["first"][k], columns["per"][k])
            b["sequence_id"], b["offset"] = columns["sequence"][k] + times, columns["offset"][k] + within * length
            yield b.drop(columns=["number"]).astype({"doc_id": "Int64"})

    hashed = pieces.withColumn("place", F.xxhash64("doc_id", "start"))
    numbered = C.numbered(hashed, ["length"], "place", ["place", "doc_id", "start", "ids_crc32", "doc_tokens"], "number").drop("place")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number").mapInPandas(
        run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and offset."""
    return place(C.cut(tokenized_pieces(C.texts(docs, id_col, text_col), tokenizer, capacity, end_id)), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, n_ids, ids binary): the packed ids themselves, for writing;
    a reader pads each to ``capacity`` unless its length is a power of two."""
    key = ["doc_id", "start", "length", "ids_crc32"]
    own = tokenized_pieces(C.texts(docs, id_col, text_col), tokenizer, capacity, end_id, True).select(*key, "ids")
    own = own.dropDuplicates(key)
    match = [packed[c].eqNullSafe(own[c]) for c in key]
    cond = match[0] & match[1] & match[2] & match[3]
    rows = packed.join(own, cond).select("sequence_id", "offset", packed["length"].alias("n"), "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.sum("n").alias("n_ids"), parts.alias("parts")).select(
        "sequence_id", "n_ids", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

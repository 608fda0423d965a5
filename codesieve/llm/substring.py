"""Removal of word windows that already occurred, with a count-min prefilter.

A window is ``size`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts earlier (smaller document, or the same
document at an earlier start) is removed.

Pass 1 counts.  A window's stand-in is its minimizer: the smallest hash among
its ``gram``-word pieces.  Equal windows have equal minimizers at equal offsets,
so the number of places a minimizer is picked never falls below the number of
places of any window it stands for.  Each task adds its picked places to a
count-min sketch (two rows, saturating at 2), sent as delta-coded cell lists per
stripe of cells; merged stripes give one bit per cell: "counted twice or more".

Pass 2 groups exactly, by 128 bits of hash over the whole window, the windows
whose minimizer is over 1 in both rows.  The sketch overestimates, so no
repeated window is lost.  Tasks first settle repeats among their own windows and send
the first place of each, so a passage that a third of the documents share
costs one row per task.

The sketch has eight cells per picked place, at most ``max_cells`` (2**29: the
bits broadcast are 64 MB at most in all).  Beyond some billion words per run
it fills up and pass 2 groups ever more windows: slower, never wrong.

Edge cases: null, empty and shorter texts have no window and lose nothing.
Rows that repeat an id with another text are ordered after it by text hash; rows
that repeat id and text are one document, and each gets the same result.  Null
ids come first.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

ROWS = 2
STRIPE_BITS = 20
FLUSH_WINDOWS = 1 << 18


def _words(text: str | None) -> list[bytes]:
    return C.ascii_words(text, False)


def _picks(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window the place of its minimizer, and the hashes of all pieces."""
    g = C.window_hashes(h, gram)
    span = size - gram + 1
    best = np.arange(len(g))
    low, step, have = g, 1, 1
    while have < span:  # best[i]: leftmost smallest of the pieces i .. i + have - 1
        step = min(have, span - have)
        n = len(best) - step
        a, b = low[:n], low[step:step + n]
        take = b < a
        best, low, have = np.where(take, best[step:step + n], best[:n]), np.where(take, b, a), have + step
    return best, g


def _cells(g: np.ndarray, cells: int) -> list[np.ndarray]:
    return [C.mixed(g * C.MIX + C.U64(r)) % C.U64(cells) for r in range(ROWS)]


def _delta_coded(sorted_cells: np.ndarray) -> bytes:
    """Sorted cells of a stripe as 16-bit steps; 65535 means "go on"."""
    steps = np.diff(sorted_cells, prepend=0).astype(np.int64)
    wide = steps // 65535
    out = np.full(int(len(steps) + wide.sum()), 65535, "<u2")
    out[np.cumsum(wide + 1) - 1] = (steps % 65535).astype("<u2")
    return out.tobytes()


def _delta_decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(raw)[raw < 65535]


def _partition_sketches(docs: DataFrame, size: int, gram: int, cells: int) -> DataFrame:
    """(stripe, once, more): for a part of a task's input, the cells of one
    stripe that it counted once, and those it counted more often."""
    def rows(picked):
        for r, c in enumerate(_cells(np.concatenate(picked), cells)):
            cell, count = np.unique(c, return_counts=True)
            stripe = (cell >> C.U64(STRIPE_BITS)).astype(np.int64)
            cell = (cell & C.U64((1 << STRIPE_BITS) - 1)).astype(np.int64)
            edges = np.flatnonzero(np.diff(stripe, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(stripe)], strict=True):
                part, many = cell[a:b], count[a:b] > 1
                yield (int(stripe[a]) * ROWS + r, _delta_coded(part[~many]), _delta_coded(part[many]))

    def run(batches):
        picked, held = [], 0
        for b in C.frames(batches):
            for t in b["text"]:
                h = C.word_hashes(_words(t))
                if len(h) >= size:
                    best, g = _picks(h, size, gram)
                    picked.append(g[np.unique(best)])
                    held += len(picked[-1])
            if held >= FLUSH_WINDOWS:
                yield pd.DataFrame(rows(picked), columns=["stripe", "once", "more"])
                picked, held = [], 0
        if held:
            yield pd.DataFrame(rows(picked), columns=["stripe", "once", "more"])

    return docs.mapInPandas(run, "stripe long, once binary, more binary")


def _merged(sketches: DataFrame) -> DataFrame:
    """(stripe, bits): per stripe the cells that all parts together count
    twice or more.  A task keeps 2**STRIPE_BITS bytes for each stripe it holds."""
    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for b in C.frames(batches):
            for stripe, once, more in zip(b["stripe"], b["once"], b["more"], strict=True):
                counts = seen.setdefault(stripe, np.zeros(1 << STRIPE_BITS, np.uint8))
                cell = _delta_decoded(once)
                counts[cell] = np.minimum(counts[cell] + 1, 2)
                counts[_delta_decoded(more)] = 2
        if seen:
            yield pd.DataFrame({"stripe": list(seen), "bits": [np.packbits(c > 1).tobytes() for c in seen.values()]})

    stripes = sketches.repartition(C.shuffle_width(sketches.sparkSession), "stripe")
    return stripes.mapInPandas(run, "stripe long, bits binary")


def hot_cells(docs: DataFrame, size: int, gram: int, max_cells: int) -> tuple[int, np.ndarray]:
    """The merged sketch: cells per row, and a bit array of shape (ROWS, cells / 8)."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = n_bytes // 6 * 2 // (size - gram + 2) + 1  # about one pick in (span + 1) / 2 words
    stripes = -(-min(8 * places, max_cells) // (ROWS << STRIPE_BITS))
    cells = stripes << STRIPE_BITS
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    width = (1 << STRIPE_BITS) // 8
    for row in _merged(_partition_sketches(docs, size, gram, cells)).toLocalIterator():
        s, r = divmod(row.stripe, ROWS)
        bits[r, s * width:(s + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return cells, bits


RUNS = "pick long, id long, text_key long, at long, back binary, keys binary"


def _runs(pick, ids, text_keys, at, back, keys) -> pd.DataFrame:
    """One row per picked place (a run of windows with one minimizer): how far
    ``back`` from it each window starts, and the windows' 16-byte keys."""
    order = np.lexsort((-back, at, text_keys, ids, pick))
    pick, ids, text_keys, at, back = (x[order] for x in (pick, ids, text_keys, at, back))
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (ids[1:] != ids[:-1]) | (text_keys[1:] != text_keys[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    ends = [*head[1:].tolist(), len(at)]
    raw, far = (keys[order].tobytes() if keys is not None else None), back.astype(np.uint8).tobytes()
    return pd.DataFrame({
        "pick": pick[head], "id": ids[head], "text_key": text_keys[head], "at": at[head],
        "back": [far[x:y] for x, y in zip(head.tolist(), ends, strict=True)],
        "keys": [raw[16 * x:16 * y] if raw is not None else None for x, y in zip(head.tolist(), ends, strict=True)]})


def _again(ids, text_keys, pos, keys) -> np.ndarray:
    """Which windows start after an equal one (not the same place given twice)."""
    k1, k2 = keys[:, 0], keys[:, 1]
    order = np.lexsort((pos, text_keys, ids, k2, k1))
    k1, k2, i, t, p = k1[order], k2[order], ids[order], text_keys[order], pos[order]
    new = np.ones(len(p), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    out = np.empty(len(p), bool)
    out[order] = (i != i[head]) | (t != t[head]) | (p != p[head])
    return out


def _estimated_repeats(docs: DataFrame, size: int, gram: int, cells: int, bits) -> DataFrame:
    """Pass 2, per task: runs of windows estimated repeated.  Rows without
    ``keys`` start after an equal window of the same task and are settled."""
    def settle(ids, text_keys, pick, at, pos, keys):
        n = [len(p) for p in pos]
        ids, text_keys = np.repeat(ids, n), np.repeat(text_keys, n)
        pick, at, pos, keys = (np.concatenate(x) for x in (pick, at, pos, keys))
        again = _again(ids, text_keys, pos, keys)
        for own, kept in ((~again, keys), (again, None)):
            if own.any():
                yield _runs(pick[own], ids[own], text_keys[own], at[own], (at - pos)[own], kept[own] if kept is not None else None)

    def run(batches):
        hot, held, total = bits.value, [[] for _ in range(6)], 0
        for b in C.frames(batches):
            for i, key, t in zip(b["id"], b["text_key"], b["text"], strict=True):
                h = C.word_hashes(_words(t))
                if len(h) < size:
                    continue
                best, g = _picks(h, size, gram)
                over = np.ones(len(g), bool)
                for r, c in enumerate(_cells(g, cells)):
                    over &= (hot[r][(c >> C.U64(3)).astype(np.int64)] >> (C.U64(7) - (c & C.U64(7))).astype(np.uint8)) & 1 == 1
                pos = np.flatnonzero(over[best])
                if len(pos):
                    keys = np.stack([C.window_hashes(h, size)[pos], C.window_hashes(h, size, 0x2545F4914F6CDD1D)[pos]], axis=1)
                    for x, v in zip(held, (i, key, g[best[pos]].view(np.int64), best[pos], pos, keys), strict=True):
                        x.append(v)
                    total += len(pos)
            if total >= FLUSH_WINDOWS:
                yield from settle(*held)
                held, total = [[] for _ in range(6)], 0
        if total:
            yield from settle(*held)

    return docs.mapInPandas(run, RUNS)


def _repeats(runs: DataFrame) -> DataFrame:
    """(id, text_key, at, back): the windows that occurred earlier, by picked
    place.  Equal windows have equal minimizers, so they meet in the minimizer's task."""
    def run(batches):
        parts = list(C.frames(batches))
        if not parts:
            return
        w = pd.concat(parts, ignore_index=True)
        settled = w["keys"].isna()
        if settled.any():
            yield w[settled]
        w = w[~settled]
        if not len(w):
            return
        n = w["back"].map(len).to_numpy()
        spread = lambda c: np.repeat(w[c].to_numpy(), n)
        back = np.frombuffer(b"".join(w["back"]), np.uint8).astype(np.int64)
        keys = np.frombuffer(b"".join(w["keys"]), np.uint64).reshape(-1, 2)
        pick, ids, text_keys, at = (spread(c) for c in ("pick", "id", "text_key", "at"))
        again = _again(ids, text_keys, at - back, keys)
        if again.any():
            yield _runs(pick[again], ids[again], text_keys[again], at[again], back[again], None)

    to = F.when(F.col("keys").isNull(), F.xxhash64("id", "text_key")).otherwise(F.col("pick"))  # settled rows only pass
    met = runs.repartition(C.shuffle_width(runs.sparkSession), to).mapInPandas(run, RUNS)
    return met.select("id", "text_key", "at", "back")


def deduplicate_windows(docs: DataFrame, size: int = 20, gram: int = 8, max_cells: int = 1 << 29,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_words array<string>) per document."""
    if not 1 <= gram <= size < gram + 256:
        raise ValueError("1 <= gram <= size < gram + 256")
    spark = docs.sparkSession
    none = -(1 << 63)  # null ids come first
    docs = C.texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(none)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "text")
    cells, bits = hot_cells(docs, size, gram, max_cells)
    runs = _estimated_repeats(docs, size, gram, cells, spark.sparkContext.broadcast(bits))
    found = _repeats(runs).groupBy("id", "text_key").agg(F.collect_list(F.struct("at", "back")).alias("found"))

    def run(batches):
        for b in C.frames(batches):
            rows = []
            for i, t, found in zip(b["id"], b["text"], b["found"], strict=True):
                words = _words(t)
                gone = np.zeros(len(words) + 1, np.int64)
                if found is not None:
                    starts = [x["at"] - np.frombuffer(x["back"], np.uint8).astype(np.int64) for x in found]
                    s = np.unique(np.concatenate(starts))  # an id and text given twice names each start twice
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + size, -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = [w.decode() for w, k in zip(words, keep, strict=True) if k]
                rows.append((None if i == none else i, len(words), len(words) - len(kept), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_words"]).astype({"doc_id": "Int64"})

    return docs.join(found, ["id", "text_key"], "left").mapInPandas(
        run, "doc_id long, n_words long, n_removed long, kept_words array<string>")


def sha256_of(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()

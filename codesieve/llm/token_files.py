"""Token-id files of patched frame-of-reference blocks.

A file is a sequence of segments, each followed by one line-end byte:

    header   magic, ids, documents, block size, bytes of the rest (little-endian)
    docs     document ids (8 bytes each; the smallest value stands for null),
             then ids per document (8 bytes each)
    index    start of each block in the body (8 bytes each)
    blocks   minimum (4 bytes), width (1), exceptions (2), the values less the
             minimum packed at ``width`` bits, exception places (2 bytes each) and
             their values less the minimum (4 bytes each)

A block's width is that of the ``percentile`` smallest value; what needs more
bits is an exception.  Blocks run across documents, the last one is filled up with its own last id.

Documents are ranged by id, each task writes files of ``segments_per_file``
segments (about 0.5 MB each) in ascending order under ``kind=data``, and Spark's text sink carries the
bytes, so any store that Spark can write will do.  The same job writes the manifest under
``kind=manifest``: task, number of the file within it, and its ids, a line for each file.  The ``binaryFile`` source reads
files whole, so their size bounds a reading task's memory; raise it with the
executors.  A document's start is its place within its file plus the ids of the
files before it, which the manifest tells: the files themselves are read once.

Edge cases: a null or empty text is its end id alone; null document ids come
first; rows that repeat an id are ordered by text; an empty table gives no documents.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import common as C
from codesieve.llm.tokenizing import encoder

HEADER = struct.Struct("<4sQQIQ")
BLOCK = struct.Struct("<IBH")
MAGIC = b"PFR1"
NULL_ID = -(1 << 63)
SEGMENT_IDS = 1 << 18
KEPT_BYTES = 128_000_000  # of pre-tokens, twice what other operators keep: fewer are encoded again


def _word(width: int) -> type:
    """A type that holds ``width`` bits shifted by up to 7."""
    return np.uint32 if width <= 24 else np.uint64


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each of the rows of ``values`` (a multiple of 8 of them), lowest
    bits first: eight values are ``width`` bytes."""
    out, word = np.zeros((len(values), values.shape[1] // 8, width), np.uint8), _word(width)
    values = values.astype(word) & word((1 << width) - 1)
    for j in range(8 if width else 0):
        at, shift = divmod(j * width, 8)
        shifted = values[:, j::8] << word(shift)
        for k in range((shift + width + 7) // 8):
            out[:, :, at + k] |= (shifted >> word(8 * k)).astype(np.uint8)
    return out.reshape(len(values), -1)


def _unpacked(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    """The rows of ``block`` values that ``_packed`` packed."""
    out, word = np.zeros((len(packed), block), np.uint32), _word(width)
    if width:
        raw = packed.reshape(len(packed), -1, width)
        for j in range(8):
            at, shift = divmod(j * width, 8)
            value = raw[:, :, at].astype(word)
            for k in range(1, (shift + width + 7) // 8):
                value |= raw[:, :, at + k].astype(word) << word(8 * k)
            out[:, j::8] = (value >> word(shift)) & word((1 << width) - 1)
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``lengths[i]`` numbers from ``starts[i]`` on, one range after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def encode_blocks(ids: np.ndarray, block: int, percentile: float) -> list[bytes]:
    n = len(ids)
    if not n:
        return []
    blocks = np.concatenate([ids, np.repeat(ids[-1:], -n % block)]).reshape(-1, block)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    at = int(percentile * (block - 1))
    widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)  # bits that each value needs
    out: list[bytes] = [b""] * len(blocks)
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        values = rest[own]
        packed = _packed(values, int(w)).tobytes()
        in_block, where = np.nonzero(values > np.uint32((1 << int(w)) - 1))
        places, more = where.astype("<u2").tobytes(), values[in_block, where].astype("<u4").tobytes()
        size, ends = block * int(w) // 8, np.searchsorted(in_block, np.arange(len(own) + 1)).tolist()
        for j, (b, least) in enumerate(zip(own.tolist(), low[own].tolist(), strict=True)):
            p, q = ends[j], ends[j + 1]
            out[b] = b"".join((BLOCK.pack(least, w, q - p), packed[j * size:(j + 1) * size], places[2 * p:2 * q], more[4 * p:4 * q]))
    return out


def decode_blocks(body: np.ndarray, starts: np.ndarray, n: int, block: int) -> np.ndarray:
    out = np.empty((len(starts), block), np.uint32)
    heads = body[starts[:, None] + np.arange(BLOCK.size)].view([("low", "<u4"), ("width", "u1"), ("over", "<u2")])[:, 0]
    widths, n_over = heads["width"].astype(np.int64), heads["over"].astype(np.int64)
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        packed = body[starts[own, None] + BLOCK.size + np.arange(block * w // 8)]
        out[own] = _unpacked(packed, int(w), block)
    at = starts + BLOCK.size + block * widths // 8
    if n_over.any():
        where = body[_ranges(at, 2 * n_over)].view("<u2")
        out[np.repeat(np.arange(len(starts)), n_over), where] = body[_ranges(at + 2 * n_over, 4 * n_over)].view("<u4")
    out += heads["low"][:, None]
    return out.reshape(-1)[:n]


def encode_segment(doc_ids: list[int], docs: list[bytes], block: int, percentile: float) -> bytes:
    """One segment of whole documents, each the bytes of its ids (unsigned 32-bit)."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    blocks = encode_blocks(ids, block, percentile)
    starts = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1]
    rest = b"".join([np.array(doc_ids, "<i8").tobytes(), np.array([len(d) // 4 for d in docs], "<u8").tobytes(),
                     starts.astype("<u8").tobytes(), *blocks])
    return HEADER.pack(MAGIC, len(ids), len(docs), block, len(rest)) + rest


def segments(content: bytes):
    """(ids, documents, block size, view of the rest) of each segment."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, n, n_docs, block, size = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at += HEADER.size
        yield n, n_docs, block, view[at:at + size]
        at += size + 1  # the sink's line end


def decode_segment(n: int, n_docs: int, block: int, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    n_blocks = -(-n // block)
    doc_ids = np.frombuffer(rest, "<i8", n_docs)
    lengths = np.frombuffer(rest, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    starts = np.frombuffer(rest, "<u8", n_blocks, 16 * n_docs).astype(np.int64)
    body = np.frombuffer(rest, np.uint8, offset=16 * n_docs + 8 * n_blocks)
    return doc_ids, lengths, decode_blocks(body, starts, n, block)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 256,
                      percentile: float = 0.9, segments_per_file: int = 16, partitions: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the files of folder ``path``."""
    if block % 8 or block > 1 << 16:
        raise ValueError("block must be a multiple of 8 up to 65536")

    def run(batches):
        enc, end = encoder(tokenizer, kept_bytes=KEPT_BYTES), np.array([end_id], "<u4").tobytes()
        ids, held, size, n_ids = [], [], 0, []

        def segment():
            n_ids.append(size)
            return pd.DataFrame({"kind": "data", "seq": len(n_ids), "value": [encode_segment(ids, held, block, percentile)]})

        for b in C.frames(batches, enc):
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                ids.append(NULL_ID if pd.isna(i) else int(i))
                held.append(enc.ids(t) + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    ids, held, size = [], [], 0
        if held:
            yield segment()
        if n_ids:
            task, per_file = TaskContext.get().partitionId(), np.add.reduceat(n_ids, np.arange(0, len(n_ids), segments_per_file))
            yield pd.DataFrame([("manifest", j, f"{task} {j} {n}".encode()) for j, n in enumerate(per_file)], columns=["kind", "seq", "value"])

    spark = docs.sparkSession
    rows = C.texts(docs, id_col, text_col)
    ranged = rows.repartitionByRange(partitions or C.shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInPandas(run, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq") \
        .select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind") \
        .option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", segments_per_file).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in ``path``;
    ``ids`` as little-endian unsigned 32-bit integers."""
    listed = sorted(tuple(map(int, r.value.split())) for r in spark.read.text(f"{path}/kind=manifest").collect())  # one row per file
    base = dict(zip([f[:2] for f in listed], np.cumsum([0, *[f[2] for f in listed]]).tolist(), strict=False))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind=data").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    place = re.compile(r"part-(\d+)-.*\bc(\d+)\.")

    def run(batches):
        for b in C.frames(batches):
            for file, content in zip(b["file"], b["content"], strict=True):
                start = base[tuple(map(int, place.match(file).groups()))]
                for n, n_docs, block, rest in segments(content):
                    doc_ids, lengths, ids = decode_segment(n, n_docs, block, rest)
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4").tobytes()
                    yield pd.DataFrame({
                        "doc_id": pd.Series([None if i == NULL_ID else i for i in doc_ids.tolist()], dtype="Int64"),
                        "start": start + ends - lengths, "n_tokens": lengths,
                        "ids": [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]})
                    start += n

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")

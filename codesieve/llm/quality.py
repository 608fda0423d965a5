"""Quality selection by importance resampling over hashed n-gram models.

Tokens are runs of letters and digits, or of other marks.  Features are the hashed whole
tokens without regard to case (unigrams) and the hashed pairs of neighbours (bigrams).  In
a pair a word of more than three letters stands as its shape (small, capital, other), the others as
they are: nearly every pair of long words occurs once, whatever the corpus, and says nothing.
Two generative models count these features: the raw model over all documents, the target
model over documents labelled good (quality 1, not toxic).

A feature's log ratio target / raw takes the target count at its upper bound (``bounds`` standard errors of a
Poisson count, unigrams and bigrams), so that chance absences from a small sample weigh nothing, and counts
as zero above one (truncated importance weights): otherwise fluent words buy back insults, since the raw
model holds bad texts and every good word has a ratio above one.  A token that no target document holds
backs off to its hashed byte trigrams: it counts ``-unseen`` times the share of them that no target document holds
either, so a new word of known make is about neutral, and a text of strange words far below any good one.  Figures are in the README.

A document's log weight is the sum of its features' log ratios, bigrams counting ``pairs``, divided by its tokens
plus ``prior``.

Documents are drawn without replacement by Gumbel top-k: key = log weight /
(``temperature`` times the cut's size) + Gumbel noise hashed from id and seed, and the ``k`` largest keys
are selected.  ``k`` is the number of documents whose log weight reaches the cut that
divides the held-out labels best; near the cut the draw decides.

The target model is fitted on at most ``max_labels`` labelled rows (those with
the smallest id hash); the raw counts, the held-out calibration, the weights and
the selection cover all rows.  The driver sees the merged counts (``2 * BUCKETS`` of
each model), ``BINS`` calibration rows and a few histograms.

Edge cases: a null, empty or blank text has no tokens, no weight, and is not
selected.  Without labels of both kinds every text with tokens is selected.
Rows with conflicting labels for an id count as bad; null labels are ignored.
Rows with a null id are weighed and may be selected; rows that repeat an id are judged each by its own text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
BUCKETS = 1 << 18
CELLS = 3 * BUCKETS  # unigrams, bigrams, and in the target model character trigrams
STRIPE = 1 << 12
BINS = 4000
LOWEST = -1.0  # log weights below share a calibration bin
KNOWN = 200_000
WELL = 10
AT_ONCE = 1 << 18


class Features(dict):
    """token -> bucket of its unigram, above it a hash of what it is in a pair, and above that how strange it is (in 255ths, with the
    trigrams ``known``); at most ``KNOWN`` are kept."""

    def __init__(self, unseen: np.ndarray | None = None, known: np.ndarray | None = None):
        super().__init__()
        self._unseen, self._known = unseen, known

    def __missing__(self, token: str) -> int:
        low = token.lower().encode()
        bucket = zlib.crc32(low) % BUCKETS
        if len(token) < 4 or not token[0].isalnum():
            shape = token.encode()
        else:
            shape = b"small" if token.islower() else b"capital" if token[0].isupper() else b"other"
        value = bucket | (zlib.crc32(b"pair " + shape) & 0xFFFFFF) << 18
        if self._known is not None and self._unseen[bucket]:  # of other tokens it is not asked
            own = trigrams(low)
            value |= 255 * sum(not self._known[t] for t in own) // len(own) << 42
        if len(self) >= KNOWN:
            self.clear()
        if len(token) <= 40:
            self[token] = value
        return value

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature buckets of a whole text (bigrams from ``BUCKETS`` on), and how strange each token is (0 to 255)."""
        all_ = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        shape = all_ >> 18 & 0xFFFFFF
        pairs = ((shape[:-1] * 0x9E3779B1 + shape[1:] * 0x85EBCA77) >> 7) % BUCKETS + BUCKETS
        return np.concatenate([all_ & (BUCKETS - 1), pairs]), all_ >> 42


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def trigrams(low: bytes) -> list[int]:
    """Buckets of the byte trigrams of a token in small letters, its borders counting as blanks."""
    padded = b" " + low + b" "
    return [zlib.crc32(padded[i:i + 3]) % BUCKETS for i in range(len(low))]


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good boolean, at): one row per labelled id, at a hash of it."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good")).withColumn(
        "at", F.xxhash64("doc_id", F.lit(11)))


def _counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all documents and of the target documents (these with trigrams)."""
    def count(batches):
        sums, held, size, known, seen = np.zeros((2, CELLS), np.int64), ([], []), 0, Features(), False
        marked: set[str] = set()  # tokens whose trigrams are in the sums

        def add():
            for k, parts in enumerate(held):
                if parts:
                    sums[k] += np.bincount(np.concatenate(parts), minlength=CELLS)
                parts.clear()

        for b in C.frames(batches):
            ids = b["doc_id"].fillna(-1).astype("int64").to_numpy()
            at = np.minimum(np.searchsorted(target_ids, ids), max(0, len(target_ids) - 1))
            chosen = (target_ids[at] == ids) & b["doc_id"].notna().to_numpy() if len(target_ids) else np.zeros(len(b), bool)
            for t, is_target in zip(b["text"], chosen, strict=True):
                tokens = tokens_of(t)
                n = len(tokens)
                if not n:
                    continue
                held[0].append(known.of(tokens)[0])
                if is_target:
                    held[1].append(held[0][-1])
                    new = set(tokens) - marked
                    if len(marked) > KNOWN:
                        marked.clear()
                    marked |= new
                    for w in new:
                        sums[1, [x + 2 * BUCKETS for x in trigrams(w.lower().encode())]] = 1
                size += 2 * n
                if size >= AT_ONCE:
                    add()
                    size = 0
            seen = True
        add()
        if seen:
            yield pd.DataFrame([(s, sums[0, a:a + STRIPE].tobytes(), sums[1, a:a + STRIPE].tobytes())
                                for s, a in enumerate(range(0, CELLS, STRIPE))], columns=["stripe", "raw", "target"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in C.frames(batches):
            for s, raw, target in zip(b["stripe"], b["raw"], b["target"], strict=True):
                own = sums.setdefault(s, np.zeros((2, STRIPE), np.int64))
                own[0] += np.frombuffer(raw, np.int64)
                own[1] += np.frombuffer(target, np.int64)
        if sums:
            yield pd.DataFrame([(s, v[0].tobytes(), v[1].tobytes()) for s, v in sums.items()], columns=["stripe", "raw", "target"])

    schema, width = "stripe int, raw binary, target binary", C.shuffle_width(docs.sparkSession)
    out = np.zeros((2, CELLS), np.int64)
    for r in docs.mapInPandas(count, schema).repartition(width, "stripe").mapInPandas(merge, schema).toLocalIterator():
        for k, data in enumerate((r.raw, r.target)):
            out[k, r.stripe * STRIPE:(r.stripe + 1) * STRIPE] = np.frombuffer(data, np.int64)
    return out[0], out[1]


class Ratios:
    """Log ratio target / raw of each bucket with the target count at its upper bound, what counts at least against unseen
    unigrams, and the plain log ratio of the well-known ones (NaN for others)."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, bounds: tuple[float, float], unseen: float, pairs: float):
        self.trigrams = target[2 * BUCKETS:] > 0
        raw, target = (x[:2 * BUCKETS].reshape(2, BUCKETS).astype(np.float64) for x in (raw, target))
        expected = raw * (target.sum(axis=1, keepdims=True) / np.maximum(1, raw.sum(axis=1, keepdims=True)))
        z, self.pairs = np.array(bounds)[:, None], pairs
        self.upper = np.log((target + z * np.sqrt(target + 1) + z * z / 2) / np.maximum(expected, 1e-9)).reshape(-1).astype(np.float32)
        self.unseen = np.where(target[0] == 0, -unseen, 0.0).astype(np.float32)
        self.known = np.where(target[0] >= WELL, np.log(np.maximum(target[0], 1) / np.maximum(expected[0], 1e-9)), np.nan).astype(np.float32)

    def features(self) -> Features:
        return Features(self.unseen < 0, self.trigrams)

    def log_weight(self, own: np.ndarray, strange: np.ndarray, prior: int) -> float:
        """Of a document with feature buckets ``own`` (a unigram for each token first)."""
        n = len(strange)
        known = self.known[own[:n]]
        known = known[~np.isnan(known)]
        shift = known.mean() if len(known) >= WELL else 0.0
        ratio = np.minimum(0, self.upper[own] - shift)
        single = np.minimum(ratio[:n], self.unseen[own[:n]] * (strange / 255))
        return (float(single.sum(dtype=np.float64)) + self.pairs * float(ratio[n:].sum(dtype=np.float64))) / (n + prior)


def _log_weights(texts, ratios: Ratios | None, known: Features | None, prior: int) -> tuple[list[int], list[float | None]]:
    counts, out = [], []
    for t in texts:
        tokens = tokens_of(t)
        counts.append(len(tokens))
        out.append((ratios.log_weight(*known.of(tokens), prior) if ratios else 0.0) if tokens else None)
    return counts, out


def _calibrated_cut(weighted: DataFrame, held_out: DataFrame) -> float | None:
    """The log weight that divides the held-out labels with the fewest errors;
    of equal ones the middle of the widest gap; None without both kinds."""
    at = F.floor(F.greatest(F.col("log_weight"), F.lit(LOWEST)) * BINS).cast("int")
    rows = weighted.where("log_weight is not null").join(held_out, "doc_id").groupBy(at.alias("at")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        good[r["at"] + BINS], bad[r["at"] + BINS] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return None
    below = np.concatenate([[0], np.cumsum(good)[:-1]])  # good ones lost by a cut at the bin's lower edge
    errors = below + bad.sum() - np.concatenate([[0], np.cumsum(bad)[:-1]])
    best = np.flatnonzero(errors == errors.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return (int(widest[len(widest) // 2]) - BINS) / BINS


def _kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of column ``key`` (long), by histograms."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while lo < hi:
        shift = max(0, ((hi - lo) >> 12).bit_length())
        rows = keys.where(F.col("key").between(lo, hi)).groupBy(F.shiftrightunsigned(F.col("key") - lo, shift).alias("at")) \
            .agg(F.count("*").alias("n")).collect()
        for r in sorted(rows, key=lambda r: -r["at"]):
            if k <= r["n"]:
                lo, hi = lo + (r["at"] << shift), min(hi, lo + ((r["at"] + 1) << shift) - 1)
                break
            k -= r["n"]
    return lo


class Selector:
    """Models and cut fitted on ``docs`` and ``labels``.  ``weighted``: (doc_id, n_tokens, log_weight) per
    document; ``cut``: None without labels of both kinds; ``least``: the smallest selected key as a whole number."""

    def __init__(self, docs: DataFrame, labels: DataFrame, bounds: tuple[float, float] = (1.0, 2.0), unseen: float = 1.0,
                 pairs: float = 0.5, prior: int = 20, temperature: float = 0.05, max_labels: int = 100_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text"):
        self.prior, self.temperature, self.seed = prior, temperature, seed
        docs = C.texts(docs, id_col, text_col)
        known = C.cut(good_labels(labels))
        fit = known.where("at % 4 <> 0").orderBy("at").limit(max_labels)
        target_ids = np.sort(np.array([r.doc_id for r in fit.where("good").select("doc_id").collect()], np.int64))
        raw, target = _counts(docs, target_ids)
        self.sent = docs.sparkSession.sparkContext.broadcast(Ratios(raw, target, bounds, unseen, pairs) if len(target_ids) else None)  # 4 MB
        self.weighted = C.cut(self._weigh(docs))
        self.cut = _calibrated_cut(self.weighted, known.where("at % 4 = 0"))
        self.least = None
        if self.cut is not None:
            k = self.weighted.where(F.col("log_weight") >= self.cut).count()
            keys = self.weighted.where("log_weight is not null").select(self._whole_key(F.col("doc_id"), F.col("log_weight")).alias("key"))
            self.least = _kth_largest(keys, k) if k else 1 << 62

    def _weigh(self, docs: DataFrame) -> DataFrame:
        sent, prior = self.sent, self.prior

        def run(batches):
            known = sent.value and sent.value.features()
            for b in C.frames(batches):
                n, own = _log_weights(b["text"], sent.value, known, prior)
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": n, "log_weight": pd.array(own, "Float64")})

        return docs.mapInPandas(run, "doc_id long, n_tokens long, log_weight double")

    def key(self, doc_id: Column, log_weight: Column) -> Column:
        """Log weight over temperature (relative to the cut's size), and Gumbel noise of the id and the seed."""
        uniform = (F.pmod(F.xxhash64(doc_id, F.lit(self.seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return log_weight / F.lit(self.temperature * max(abs(self.cut or 0.0), 1 / BINS)) - F.log(-F.log(uniform))

    def _whole_key(self, doc_id: Column, log_weight: Column) -> Column:
        return F.round(self.key(doc_id, log_weight) * F.lit(1e6)).cast("long")  # a key's order as an integer

    def selected(self, doc_id: Column, log_weight: Column) -> Column:
        if self.cut is None:
            return log_weight.isNotNull()
        return F.coalesce(self._whole_key(doc_id, log_weight) >= self.least, F.lit(False))

    def keep(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that are selected, each weighed again where it lies: no text is shuffled."""
        sent, prior = self.sent, self.prior

        @F.pandas_udf("double")
        def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = sent.value and sent.value.features()
            for texts in batches:
                yield pd.Series(pd.array(_log_weights(texts, sent.value, known, prior)[1], "Float64"))

        return docs.where(self.selected(F.col(id_col).cast("long"), weight(F.col(text_col).cast("string"))))


def select_quality(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_tokens, log_weight, key, selected) per document; ``settings`` of ``Selector``."""
    own = Selector(docs, labels, **settings)
    at = F.col("doc_id"), F.col("log_weight")
    return own.weighted.withColumns({"key": own.key(*at), "selected": own.selected(*at)})


def keep_selected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that are not selected."""
    return Selector(docs, labels, **settings).keep(docs)

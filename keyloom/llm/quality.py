"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k.

The target is the text of documents labelled good, the raw text that of all documents. N-grams are taken over words and over
the words' shapes (which kinds of bytes a word holds, how it begins and ends), so that the models carry over to words never
seen. A document's log weight is the sum of log(target / raw) over its n-grams, less a cut for each word, so that long texts don't win by length. The
documents that stay are sampled without replacement by these weights: the top k of log weight plus standard Gumbel noise. Unless k is given, it follows from the
labels: as many as score at or above the cut, which is the one that parts labelled good from bad documents best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, materialize, table

#: At most about so many labelled documents serve as target and to find the cut, picked by a hash of doc_id.
LABELLED = 20_000
#: log2 of the number of buckets of word unigrams, shape unigrams, bigrams and trigrams.
BITS = (14, 12, 14, 14)
#: Added to each bucket's count.
SMOOTHING = 0.5

_STARTS = tuple(int(x) for x in np.concatenate(([0], np.cumsum([1 << b for b in BITS]))))
_PIECE = 1 << 19
_MIX = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_kinds() -> np.ndarray:
    """A bit for each kind of byte: a-z, A-Z, 0-9, beyond ASCII, sentence punctuation, other signs; 0 for white space."""
    kinds = np.full(256, 32, np.uint8)
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 4
    kinds[128:] = 8
    kinds[[ord(c) for c in ".,;:'\"()?"]] = 16
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    return kinds


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(_MIX)) >> np.uint64(64 - BITS[kind])).astype(np.int64) + _STARTS[kind]


def ngrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (one column per n-gram kind) and document of every word in texts laid end to end; ``ends`` are the texts' ends."""
    kind = _byte_kinds()[data]
    word = kind > 0
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[ends] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])) | word & first[:-1])
    if not len(starts):
        return np.empty((0, 4), np.int64), np.empty(0, np.int64)
    last = np.flatnonzero(word & np.concatenate((~word[1:], [True])) | word & first[1:])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + 1) * _powers(_BASE, len(data))[:-1], dtype=np.uint64, out=sums[1:])
    h = (sums[last + 1] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    kinds = np.bitwise_or.reduceat(kind, starts).astype(np.uint64)
    tail = np.where(kind[last] & 48, data[last], 0).astype(np.uint64)
    size = np.minimum(last - starts + 1, 12).astype(np.uint64) // np.uint64(4)
    shape = ((kinds << np.uint64(8) | tail) << np.uint64(8) | kind[starts].astype(np.uint64)) << np.uint64(2) | size
    doc = np.searchsorted(ends, starts, "right")
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
    shape = (shape << np.uint64(1) | same) + np.uint64(1)
    back = [np.concatenate((np.zeros(k, np.uint64), shape[:-k]))[: len(shape)] for k in (1, 2)]
    for k, b in enumerate(back, 1):
        b[k:][doc[k:] != doc[:-k]] = 0
        b[:k] = 0
    two = shape * np.uint64(_BASE) + back[0]
    return np.stack([_bucket(h, 0), _bucket(shape, 1), _bucket(two, 2), _bucket(two * np.uint64(_BASE) + back[1], 3)], 1), doc


def pieces(texts: pa.Array, most: int = _PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first, end, their bytes end to end, and the end of each text. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at]
        at = end


def good_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, good) for about ``most`` labelled documents at most; of contradicting labels the better one counts."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    share = most / max(one.count(), 1)
    return one if share >= 1 else one.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.lit(int(share * (1 << 53))))


def fit(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """log(target / raw) of every bucket: raw counts cover all of ``docs`` (doc_id, text), target counts those labelled good."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(labelled.where("good")), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(_STARTS[-1], np.int64) for _ in range(2))
        for b in batches:
            good = np.array(b.column(1).to_pylist(), bool)
            for at, end, data, ends in pieces(b.column(0)):
                buckets, doc = ngrams(data, ends)
                raw += np.bincount(buckets.ravel(), minlength=len(raw))
                target += np.bincount(buckets[good[at:end][doc]].ravel(), minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], target[used])], ["bucket", "raw", "target"])

    rows = map_texts(texts, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = (np.zeros(_STARTS[-1]) for _ in range(2))
    at = rows["bucket"].to_numpy()
    raw[at], target[at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    out = np.zeros(_STARTS[-1])
    if target.any():
        for i, j in zip(_STARTS, _STARTS[1:], strict=False):
            p, q = target[i:j] + SMOOTHING, raw[i:j] + SMOOTHING
            out[i:j] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with log_weight (sum of log ratios, by kind on average) and n_words of its string column ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for at, end, data, ends in pieces(b.column(at_text)):
                buckets, doc = ngrams(data, ends)
                weight[at:end] = np.bincount(doc, sent.value[buckets].sum(1) / len(BITS), end - at)
                n[at:end] = np.bincount(doc, minlength=end - at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(weight), pa.array(n)], [*b.schema.names, "log_weight", "n_words"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "log_weight double, n_words long"])
    return map_texts(docs, run, schema)


def _mean() -> Column:
    return F.when(F.col("n_words") > 0, F.col("log_weight") / F.col("n_words")).otherwise(0.0)


def _key(cut: float) -> Column:
    """Log weight above the cut, plus standard Gumbel noise from a hash of doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.col("log_weight") - F.lit(cut) * F.col("n_words") - F.log(-F.log(u))


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest sum of the shares of good documents at or above it and of bad ones below; the lowest of equal ones."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    below_bad = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    below_good = np.concatenate(([0], np.cumsum(g))) / g.sum()
    value = below_bad - below_good
    value[1:-1][s[1:] == s[:-1]] = -2
    i = int(np.argmax(value))
    return -np.inf if i == 0 else float((s[i - 1] + s[min(i, len(s) - 1)]) / 2)


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of (v), by ever narrower histograms; -inf if there are no more than k."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            return low
        inside = values.where(F.col("v").between(low, high))
        at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        rows = inside.groupBy(at).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["low"], r["high"]


class QualityModel:
    """Fitted ratios, the cut, and the least key that stays; ``k`` documents stay, or as many as score at or above the cut."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int = LABELLED, k: int | None = None):
        labelled = materialize(good_labels(labels, most))
        self.ratios = fit(docs, labelled)
        self.scored = materialize(score(docs.select("doc_id", F.col("text").cast("string").alias("text")), self.ratios).drop("text"))
        known = self.scored.join(F.broadcast(labelled), "doc_id").select(_mean().alias("s"), "good").toArrow()
        self.cut = best_cut(known["s"].to_numpy(), known["good"].to_numpy(zero_copy_only=False).astype(bool)) if len(known) else -np.inf
        if k is None and self.cut > -np.inf:
            k = self.scored.where(_mean() >= self.cut).count()
        self.least = -np.inf if k is None else kth_largest(self.scored.select(self.key().alias("v")), k)

    def key(self) -> Column:
        return _key(self.cut if self.cut > -np.inf else 0.0)

    def judged(self, scored: DataFrame) -> DataFrame:
        """Adds score, key and kept to (doc_id, log_weight, n_words)."""
        return scored.withColumns({"score": _mean(), "key": self.key()}).withColumn("kept", F.col("key") >= F.lit(self.least))


def classify(docs: DataFrame, labels: DataFrame, most: int = LABELLED, k: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score (mean log ratio), log_weight, n_words, key, kept.

    ``labels`` holds doc_id and quality (0 bad, else good). A null or wordless text has the score 0. Equal keys at the k-th place all stay. Repeated rows
    are judged alike. ``k`` documents stay, by default as many as score at or above the cut; without labels, or with labels of one kind only, there is no cut, and by default
    every document stays. An empty table gives no rows.
    """
    model = QualityModel(docs, labels, most, k)
    return model.judged(model.scored).select("doc_id", "score", "log_weight", "n_words", "key", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED, k: int | None = None) -> DataFrame:
    """``docs`` without the rows that classify rejects. Texts don't move: the rows are scored again where they are."""
    model = QualityModel(docs, labels, most, k)
    at, names = docs.columns.index("text"), docs.columns  # columns are renamed meanwhile, so that none clashes
    named = docs.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") if i == at else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    scored = score(named, model.ratios, f"c{at}").withColumn("doc_id", F.col(f"c{names.index('doc_id')}"))
    return model.judged(scored).where("kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal.

Words are lower-cased, ASCII punctuation separates them. A document's features are the buckets of its words (whole, and
as stems of STEMS bytes, which stand for inflected and compound forms), of its neighbouring pairs and of its pairs one
word apart, each bucket once. FTRL-proximal keeps a learning rate a coordinate
and an L1 threshold, so most weights are exactly zero; the few others are broadcast, and scoring touches only features
with a weight. The fit reads a bounded sample, the SAMPLE labelled documents whose ids have the smallest keyed hash, one after
the other in a single task, as the method is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import WordTable, binary_texts, column, hash_words, map_arrow, mix, save, spans

SAMPLE, BUCKET_BITS, EPOCHS, STEMS = 12_000, 20, 2, (4, 6)
ALPHA, BETA, L1, L2 = 0.8, 1.0, 4.0, 0.5
THRESHOLD = 0.3
_BLANK = bytes(ord(" ") if (chr(i).isascii() and i < 128 and not chr(i).isalnum()) else (i + 32 if 65 <= i <= 90 else i) for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A row a word: its hash, and those of its stems; 0 where it is no longer than the stem."""
    out = np.zeros((len(words), 1 + len(STEMS)), np.uint64)
    out[:, 0] = mix(hash_words(words)[:, 0])
    for i, n in enumerate(STEMS):
        long = np.fromiter((len(w) > n for w in words), bool, len(words))
        out[long, i + 1] = hash_words([w[:n] for w in words if len(w) > n], n)[:, 0]
    return out


def features(docs: list[list[bytes]], table: WordTable, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word, stem, neighbouring pair and pair one word apart, repeats included."""
    ids, counts = table.step(docs)
    rows = table.values[ids]
    h, doc = rows[:, 0], np.repeat(np.arange(len(docs)), counts)
    out_doc, out = [doc], [h]
    for i in range(1, 1 + len(STEMS)):
        has = rows[:, i] != 0
        out_doc.append(doc[has])
        out.append(rows[has, i])
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        same = doc[gap:] == doc[:-gap]
        pair = mix(h[:-gap] * np.uint64(salt) + h[gap:])
        out_doc.append(doc[gap:][same])
        out.append(pair[same])
    return np.concatenate(out_doc), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; the last coordinate is the intercept, without L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: Iterator[tuple[int, np.ndarray]], bits: int = BUCKET_BITS) -> np.ndarray:
    """Weights from (label, buckets) rows, taken one by one in the order given; the last is the intercept."""
    model = Ftrl(1 << bits)
    for label, at in rows:
        model.learn(at, label)
    return model.weights()


def sample_features(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int) -> DataFrame:
    """(h, toxic, id, t, at): hash, label and distinct buckets of at most `sample` labelled documents, those of the smallest
    hashes. A document is an (id, text): equal rows count once, and texts of one id each. t: the text's hash."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold
    chosen = labels.where(learn & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(29)).alias("h"))
    chosen = chosen.distinct().orderBy("h", "id", "toxic").limit(sample)  # at most `sample` narrow rows
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("t"))
    found = keyed.select("id", "t").join(F.broadcast(chosen), "id").distinct().orderBy("h", "id", "toxic", "t").limit(sample)
    found = save(found, "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(word_hashes)
        for batch in batches:
            texts = binary_texts(batch)
            for lo, hi in spans(texts):
                doc, bucket = features([words_of(t) for t in texts[lo:hi]], table)
                key = np.unique(doc << BUCKET_BITS | bucket)
                sizes = np.bincount(key >> BUCKET_BITS, minlength=hi - lo)
                flat = (key & (1 << BUCKET_BITS) - 1).astype("<i4").tobytes()
                ends = 4 * np.cumsum(sizes)
                own = pa.array([flat[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("h", "toxic", "id", "t")), own], ["h", "toxic", "id", "t", "at"])

    joined = keyed.join(F.broadcast(found), ["id", "t"]).select("h", "toxic", "id", "t", "text")
    table = map_arrow(joined, run, "h long, toxic int, id long, t long, at binary")
    return table.groupBy("h", "toxic", "id", "t").agg(F.first("at").alias("at"))  # equal rows once


def fitted(rows: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the nonzero weights. One task reads the written sample once an epoch, sorted by hash; it holds
    the model, 16 bytes a bucket, and a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((y, np.frombuffer(at, "<i4").astype(np.int64)) for batch in batches for y, at in zip(column(batch, "toxic").to_pylist(), (x.as_py() for x in column(batch, "at"))))
        weights = train(pairs)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], ["at", "w"])

    every = save(rows, "features").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    one = every.repartition(1).sortWithinPartitions("epoch", "h", "id", "toxic", "t").select("toxic", "at")
    got = map_arrow(one, run, "at long, w double").toArrow()  # 2**BUCKET_BITS rows at most, few after L1
    return got["at"].to_numpy(), got["w"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labels whose crc32(doc_id) mod folds is not `fold`; a null id is held out, and labels other than 0 and 1
    are passed over. Null and empty texts get the score of no features, any text is scored whole, equal texts alike.
    Without labels every score is 0.5. Columns of `documents` other than doc_id and text play no part.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(sample_features(src, labels, folds, fold, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = WordTable(word_hashes), np.zeros((1 << BUCKET_BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            texts, out = binary_texts(batch), []
            for lo, hi in spans(texts):
                doc, bucket = features([words_of(t) for t in texts[lo:hi]], table)
                hit = w[bucket] != 0
                key = np.unique(doc[hit] << BUCKET_BITS | bucket[hit])
                out.append(np.bincount(key >> BUCKET_BITS, w[key & (1 << BUCKET_BITS) - 1], hi - lo) + w[-1])
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -500, 500)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))
    return map_arrow(src.withColumn("held", held), run, "doc_id long, held_out boolean, score double, predicted int")

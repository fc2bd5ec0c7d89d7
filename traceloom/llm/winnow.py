"""Document fingerprints by winnowing.

Every run of GRAM code points has a rolling hash; of every WINDOW neighbouring hashes the smallest is selected, the
rightmost of ties. Two texts that share GRAM + WINDOW - 1 code points in a row share a selected hash, whose place is
kept. A text with fewer hashes than a window is one window; one shorter than a gram has the hash of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import STEP_BYTES, column, map_arrow, mix, prefix_sums, quoted, sliding_argmin

GRAM, WINDOW = 16, 32
BASE = 0xC2B2AE3D27D4EB4F
#: Ids whose hashes are smallest, for cutting the table into ranges.
CUT_SAMPLE = 4096


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Selected hashes (uint64) and their places (code points), in order of place, a pair a text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    values = mix(np.frombuffer(b"".join(raw), "<u4").astype(np.uint64) + np.uint64(1))
    begins = np.cumsum(sizes) - sizes
    sums, inverse = prefix_sums(values, BASE)
    n = max(len(values) - gram + 1, 0)
    hashes = mix((sums[gram:] - sums[:n]) * inverse[:n])
    full = sliding_argmin(hashes, window) if n >= window else np.zeros(0, np.int64)
    out = []
    for b, size in zip(begins.tolist(), sizes.tolist()):
        grams = size - gram + 1
        if size == 0:
            at, got = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        elif grams <= 0:
            at, got = np.zeros(1, np.int64), mix((sums[b + size : b + size + 1] - sums[b : b + 1]) * inverse[b : b + 1])
        else:
            if grams < window:
                own = hashes[b : b + grams][::-1]
                pick = np.array([b + grams - 1 - int(own.argmin())], np.int64)
            else:
                pick = full[b : b + grams - window + 1]
                pick = pick[np.r_[True, pick[1:] != pick[:-1]]]
            at, got = pick - b, hashes[pick]
        out.append((got, at))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' sets of hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits (the upper half) a selected hash, in order of place."""
    return (hashes >> np.uint64(32)).astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, hashes array<long>, places array<int>. A null text is empty and has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, total = lo, 0
                while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= STEP_BYTES // 8):
                    total += len(texts[hi])
                    hi += 1
                got = winnow(texts[lo:hi], gram, window)
                offsets = pa.array(np.r_[0, np.cumsum([len(h) for h, _ in got])].astype(np.int32))
                hashes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h for h, _ in got]).view(np.int64)))
                places = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for _, p in got]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), hashes, places], ["doc_id", "n_chars", "hashes", "places"])
                lo = hi

    src = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    return map_arrow(src, run, "doc_id long, n_chars long, hashes array<long>, places array<int>")


def with_next(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, tail, id, text) sorted by bucket, tail, descending id (nulls last), then text: within a bucket every
    row is followed by the next of the whole order, the last one by the tail rows, which stand for the next bucket's
    first id (after the last bucket: the first bucket's). Cut points come from the ids with the smallest hashes, so that
    the same ids give the same buckets; equal ids share a bucket.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = src.select("id").where("id is not null")
    sample = sorted({r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").limit(CUT_SAMPLE).collect()})
    cuts = np.array(sample[:: max(1, len(sample) // parts)][1:], np.int64)

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series) -> pd.Series:
        none = x.isna().to_numpy()
        at = len(cuts) - np.searchsorted(cuts, x.fillna(0).astype("int64").to_numpy(), side="right")
        return pd.Series(np.where(none, len(cuts) + 1, at).astype("int32"))

    firsts = src.select("id", bucket_of("id").alias("bucket")).groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()  # a row a bucket
    pairs = [(firsts[(i + 1) % len(firsts)]["id"], firsts[i]["bucket"]) for i in range(len(firsts))]
    table = F.broadcast(spark.createDataFrame(pairs, "first long, at int"))
    placed = src.withColumn("bucket", bucket_of("id")).join(table, F.col("id").eqNullSafe(F.col("first")), "left")
    copies = F.explode(F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("tail")), F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("bucket"), F.lit(1).alias("tail"))))))
    placed = placed.select(copies.alias("x"), "id", "text").select("x.bucket", "x.tail", "id", "text")
    dealt = placed.repartitionById(len(cuts) + 2, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "tail", F.col("id").desc_nulls_last(), "text")


def fingerprint_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of an edited text and of the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document by
    descending id (then by text; null ids last; after the last the first; a single row is its own next). Null texts are
    empty; an empty text has the empty fingerprint. Equal rows give a row each. places and edited_places are the code points
    at which the selected grams begin, one a hash of the fingerprint. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []  # rows (id, text) of one bucket whose next is not known yet: one, between steps
        ready: list = []  # (id, text, next text)
        bucket, chars, done = None, 0, False

        def flush():
            texts = [t for _, t, _ in ready]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in ready]
            prints, edits, nexts = winnow(texts, gram, window), winnow(edited, gram, window), {}
            for i, (_, _, n) in enumerate(ready):
                nexts[i] = prints[i + 1][0] if i + 1 < len(ready) and ready[i + 1][1] == n else winnow([n], gram, window)[0][0]
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
            cols = [
                pa.array([i for i, _, _ in ready], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(sha, pa.string()),
                pa.array([as_text(h) for h, _ in prints], pa.string()),
                pa.array([as_text(h) for h, _ in edits], pa.string()),
                pa.array([likeness(a[0], b[0]) for a, b in zip(prints, edits)], pa.float64()),
                pa.array([likeness(a[0], nexts[i]) for i, a in enumerate(prints)], pa.float64()),
                *(pa.array([at.astype(np.int32) for _, at in x], pa.list_(pa.int32())) for x in (prints, edits)),
            ]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "places", "edited_places"])

        for batch in batches:
            for b, tail, i, text in zip(*(column(batch, c).to_pylist() for c in ("bucket", "tail", "id", "text"))):
                text = text or ""
                if b != bucket:
                    bucket, done = b, False
                    waiting.clear()
                if done:
                    continue
                if waiting:
                    ready.append((*waiting.pop(), text))
                    chars += len(ready[-1][1]) + len(text)
                if tail:
                    done = True
                else:
                    waiting.append((i, text))
                if chars > STEP_BYTES // 8:
                    yield flush()
                    chars = 0
        if ready:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, places array<int>, edited_places array<int>"
    return map_arrow(with_next(docs, parts, id_col, text_col), run, schema)

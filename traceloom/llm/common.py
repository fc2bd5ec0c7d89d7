"""Helpers that the corpus operators share: shared-folder tables, text batches, hashing."""

from __future__ import annotations

import ctypes
import uuid
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles; a longer single text is handled alone.
STEP_BYTES = 2 << 20
#: Words that a task remembers between steps.
REMEMBERED = 300_000
#: Largest table, in bytes of its rows, that an operator broadcasts.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch for Python where small_batches() holds; Spark's own bound is 64 MB, at which JVM and worker both hold
#: a batch of whole texts several times over.
BATCH_BYTES = 2 * STEP_BYTES
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/checkpoints/traceloom"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        warnings.warn(f"spark.checkpoint.dir is unset: tables between steps go to {base}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int | None = None) -> tuple[DataFrame, int]:
    """Hint a broadcast if rows * row_bytes is within the limit; otherwise leave the join to shuffle. Counts the rows."""
    rows = df.count()
    return (F.broadcast(df) if rows * row_bytes <= (BROADCAST_BYTES if limit is None else limit) else df), rows


def joinable(df: DataFrame, tag: str, rows: int, row_bytes: int = 32) -> DataFrame:
    """An aggregate to be joined: broadcast if it has at most `rows` rows and they are within the bound; otherwise written,
    since only a join whose sides are plain shuffles may be split where a key is hot."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else save(df, tag)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches for Python have about BATCH_BYTES at most. It cannot end with the caller, as
    plans are run later; a bound that the session was given stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def usual_batches(spark: SparkSession) -> Iterator[None]:
    """Batches as they were before small_batches(), for a result that depends on where batches end."""
    small = spark.conf.get(_BATCH, None) == str(BATCH_BYTES)
    spark.conf.unset(_BATCH) if small else None
    try:
        yield
    finally:
        small_batches(spark) if small else None


def release() -> None:
    """Give what a finished task has freed back to the system: a Python worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame):
    """A struct `row` of all columns, for operators that hand their input's rows on unchanged."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]).alias("row")


def unpacked(names: list[str], **other):
    """The columns of struct `row` again, those in `other` replaced."""
    return [(other[c] if c in other else F.col("row").getField(c)).alias(c) for c in names]


def row_field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A field of the struct column `row`, null where the row is."""
    row = column(batch, "row")
    return row.field(row.type.get_field_index(name))


def times_taken(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, those of one id and text `c` times together. counts: id, text_key (xxhash64 of the text), n (rows
    of that id and text) and c, a row an id and text; rows without an entry, or with c = 0, are left out.

    Texts are not shuffled where counts is measured small; beyond that they meet it in hash joins, which sort no text and
    whose built side, counts, is a small part of each partition's texts. Where n > 1, rows that are equal in all columns
    are counted together, and c is dealt to the different ones in proportion: floor(c * k / n) copies go to the first k
    rows by hash. Those places are found in cells of a hash, so no group of copies meets in one task.
    """
    names = docs.columns
    counts = counts.where("c > 0").select(F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("o"), F.col("text_key").alias("t"), "n", "c")
    counts = save(counts, "counts")
    rows, many = counts.agg(F.count("*"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0))).first()
    held = F.broadcast(counts) if rows * 64 <= BROADCAST_BYTES else counts.hint("shuffle_hash")
    own = F.col(quoted(id_col)).cast("long")
    keyed = docs.select(whole_row(docs), F.coalesce(own, F.lit(0)).alias("i"), own.isNull().alias("o"), F.xxhash64(F.col(quoted(text_col))).alias("t"))
    joined = keyed.join(held, ["i", "o", "t"])
    copies = F.explode(F.array_repeat(F.lit(0), F.col("c").cast("int"))).alias("copy")
    out = joined.where("n = 1").select("row", copies).select(*unpacked(names))
    if not many:
        return out
    key, cells = ["i", "o", "t"], ["i", "o", "t", "cell"]
    equal = joined.where("n > 1").groupBy(*key, "n", "c", "row").agg(F.count("*").alias("m")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(1024)))
    equal = save(equal, "equal")
    sums = equal.groupBy(*cells).agg(F.sum("m").alias("cell_m"))
    before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cells, F.coalesce(F.sum("cell_m").over(before), F.lit(0)).alias("at"))
    within = Window.partitionBy(*cells).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    placed = equal.withColumn("k", F.sum("m").over(within)).join(sums, cells).withColumn("k", F.col("k") + F.col("at"))
    dealt = placed.withColumn("c", F.expr("c * k div n - c * (k - m) div n"))
    return out.union(dealt.select("row", copies).select(*unpacked(names)))


def with_row(schema: str, df: DataFrame) -> T.StructType:
    """The schema and a last column `row` of the input's columns."""
    return T.StructType(T._parse_datatype_string(schema).fields + [T.StructField("row", df.schema)])


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def binary_texts(batch: pa.RecordBatch | pa.Array, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty bytes."""
    col = batch if isinstance(batch, pa.Array) else column(batch, name)
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def spans(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to at most limit bytes, one row at least."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class WordTable:
    """Numbers words and keeps what `compute` gives for each: an array with a row a word. Between steps it forgets all
    words if it holds more than `limit`, so its memory is bounded by that and one step's words."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = REMEMBERED):
        self.compute, self.limit = compute, limit
        self.words: list[bytes] = []
        self.table: dict = {}
        self.values = np.zeros(0)

    def step(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The flat word numbers of all documents, and each document's word count."""
        if not self.words or len(self.words) > self.limit:
            self.table = defaultdict()
            self.table.default_factory = self.table.__len__
            self.words = []
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter(map(self.table.__getitem__, chain.from_iterable(docs)), np.int64, int(counts.sum()))
        new = list(islice(self.table, len(self.words), None))
        fresh = self.compute(new)
        self.values = np.concatenate([self.values, fresh]) if self.words else fresh
        self.words += new
        return ids, counts


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    """Two independent 64-bit hashes a word, as an array of shape (words, 2)."""
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(w, seed) for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of uint64 values modulo 2**64, and the inverse powers that align windows."""
    n = len(values)
    powers = np.full(n + 1, np.uint64(base), np.uint64)
    inverse = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers[:-1], dtype=np.uint64, out=sums[1:])
    return sums, inverse


def window_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hashes of the windows [start, start + length), equal for equal contents wherever they stand."""
    return mix((sums[starts + lengths] - sums[starts]) * inverse[starts])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each run of width values, the rightmost of ties."""
    index = np.arange(len(values), dtype=np.int64)
    done = 1
    while done < width:
        step = min(done, width - done)
        right = values[step:] <= values[:-step]
        index = np.where(right, index[step:], index[:-step])
        values = np.where(right, values[step:], values[:-step])
        done += step
    return index

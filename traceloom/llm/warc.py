"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by key into ranges whose bounds come from the keys with the smallest hashes, so equal input gives
equal shards. A range's records go to files of about ROLL compressed bytes, one gzip member a record, with headers and
digests made anew. A task writes under a temporary name and renames when the file is whole; the list of files is written
to a temporary manifest that is renamed last. A task that runs again writes the same names with the same bytes; files
that the manifest does not list are not read.

Of records with equal payloads of at least DEDUP bytes, the one with the largest key is a response and the others are
revisits without payload that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.common import column, fresh_path, map_arrow, quoted, save, small

ROLL, DEDUP, LEVEL, CUT_SAMPLE = 8 << 20, 1000, 6, 4096
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("9a4f7bd6-0b0e-5d6c-9a57-0f6f1c7f6a11")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def header_value(text: str | None) -> str:
    """One line: line ends and other controls are percent-encoded."""
    return "".join(c if c.isprintable() or c == " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text or "")


def response_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(key, url: str | None, payload: bytes, sha1: bytes, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is the response's head alone. A null url is written as about:blank."""
    digest = "sha1:" + base64.b32encode(sha1).decode()
    block = response_head(len(payload)) + (payload if refers is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url) or 'about:blank'}",
        f"WARC-Payload-Digest: {digest}",
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        f"X-Page-Id: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page: {refers}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without name or time, so that equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive of gzip members; a digest that does not fit is an error."""
    at = 0
    while at < len(archive):
        z = zlib.decompressobj(31)
        data = z.decompress(archive[at : at + (1 << 16)])
        at += 1 << 16
        parts = [data]
        while not z.eof:
            if at >= len(archive):
                raise ValueError("archive ends within a record")
            parts.append(z.decompress(archive[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, len(archive)) - len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def _open(folder: str):
    """Filesystem and path of a folder given as URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def marked(pages: DataFrame, dedup: int = DEDUP, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(key, url, html, refers): refers is the response's key for revisits.

    Only digests that occur more than once are joined, and revisits come back by key and digest. A digest's count and
    largest key are partial aggregates, which are written before the join: its sides are then plain shuffles, and one that
    a third of the pages share may be split. Pages with a null key are responses of their own.
    """
    html = F.coalesce(F.col(quoted(payload_col)), F.lit(""))
    src = pages.select(F.col(quoted(key_col)).cast("long").alias("key"), F.col(quoted(url_col)).cast("string").alias("url"), html.alias("html"))
    src = src.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = (F.octet_length("html") >= dedup) & F.col("key").isNotNull()
    ids = src.where(long).select("key", "digest")
    groups = ids.groupBy("digest").agg(F.max("key").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers")
    groups = save(groups, "digests")
    revisits = ids.join(groups, "digest").where("key < refers").select("key", "digest", "refers").distinct()
    revisits, _ = small(save(revisits, "revisits"), 80)  # beyond the bound the pages are shuffled for the join
    return src.join(revisits, ["key", "digest"], "left").drop("digest")


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, roll: int = ROLL, **columns) -> DataFrame:
    """Write the archives and their manifest; returns the manifest (path, records, bytes, first_key, last_key).

    Rows of one key stay together, in order of url and payload; null keys come first. An empty table writes a manifest
    without files. A folder that was written before gets the new manifest in place of the old one, and what a failed
    run left of a manifest is overwritten; files that the new manifest does not list are left, and not read.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = marked(pages, **columns)
    key_col = columns.get("key_col", "page_id")
    ids = pages.select(F.col(quoted(key_col)).cast("long").alias("key")).where("key is not null")
    sample = sorted({r["key"] for r in ids.orderBy(F.xxhash64("key"), "key").limit(CUT_SAMPLE).collect()})
    cuts = np.array(sample[:: max(1, len(sample) // shards)][1:], np.int64)

    @F.pandas_udf("int")
    def shard_of(x: pd.Series) -> pd.Series:
        none = x.isna().to_numpy()
        return pd.Series(np.where(none, 0, np.searchsorted(cuts, x.fillna(0).astype("int64").to_numpy(), side="right")).astype("int32"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(f"{base}/data", recursive=True)
        part, seq, held, size, first, last = None, 0, [], 0, None, None

        def close():
            name = f"{base}/data/shard-{part:05d}-{seq:05d}.warc.gz"
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(temporary) as f:
                for x in held:
                    f.write(x)
            files.move(temporary, name)
            return pa.RecordBatch.from_arrays([pa.array([name.removeprefix(base + "/")]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64())], ["path", "records", "bytes", "first_key", "last_key"])

        for batch in batches:
            for shard, key, url, html, refers in zip(*(column(batch, c).to_pylist() for c in ("shard", "key", "url", "html", "refers"))):
                if held and (shard != part or size >= roll):
                    yield close()
                    held, size, seq = [], 0, seq + 1
                if shard != part:
                    part, seq = shard, 0
                if not held:
                    first = key
                payload = html.encode("utf-8", "surrogatepass")
                held.append(member(record(key, url, payload, hashlib.sha1(payload).digest(), refers)))
                size += len(held[-1])
                last = key
        if held:
            yield close()

    dealt = rows.withColumn("shard", shard_of("key")).repartitionById(len(cuts) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "url", "html", "refers")
    manifest = map_arrow(dealt, write, "path string, records long, bytes long, first_key long, last_key long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest.tmp")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(f"{folder}/manifest.tmp"), hadoop(f"{folder}/manifest")
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(target, True)  # a rename onto a folder would move the new manifest into the old one
    if not files.rename(source, target):
        raise OSError(f"cannot commit {folder}")
    spark.catalog.refreshByPath(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record of the files that the manifest lists: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, and for responses the payload. A response's length and digest are of the payload as read; a file
    whose size is not the manifest's is an error."""
    manifest = spark.read.parquet(f"{folder}/manifest").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data") if manifest.limit(1).count() else None
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    if files is None:
        return spark.createDataFrame([], schema)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    listed = files.join(F.broadcast(manifest) if manifest.count() <= 100_000 else manifest, "name").select("name", "bytes", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                content = column(batch, "content")[j].as_py()
                if len(content) != column(batch, "bytes")[j].as_py():
                    raise ValueError(f"{column(batch, 'name')[j].as_py()} is not the file that was committed")
                rows, held = [], 0
                for fields, block in records(content):
                    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if payload is not None and (hashlib.sha1(payload).digest() != sha1 or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                    refers = fields.get("X-Refers-To-Page")
                    rows.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, int(fields["X-Payload-Length"]), sha1.hex(), fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], payload))
                    held += len(payload or b"")
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return map_arrow(listed, parse, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back, one row a page."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)


#: DuckDB form of the query over the view pages.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {DEDUP} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {DEDUP} AND page_id < last THEN last END AS refers_to
FROM m
"""

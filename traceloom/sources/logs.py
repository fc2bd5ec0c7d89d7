"""Event logs: JSON-lines source, tabular sources, generator, and sinks.

A log is a table of EVENT columns and `arrival`, the order in which events came. Time is kept as `us`, whole
microseconds since 1970, so that gaps are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["timestamp", "service_name", "trace_id", "span_id", "parent_span_id", "event_type", "message"]
SCHEMA = "timestamp double, service_name string, trace_id string, span_id string, parent_span_id string, event_type string, message string"


def event_key(kind="event_type", message="message"):
    return F.concat(F.col(kind), F.lit(": "), F.col(message))


def split_key(key):
    """(event_type, message) of an event key: parts at the first ': '; without one the message is empty."""
    parts = F.split(key, ": ", 2)
    return F.struct(parts[0].alias("event_type"), F.when(F.size(parts) > 1, parts[1]).otherwise("").alias("message"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed events of JSON lines; all other columns stay.

    Left out are blank lines, what is not JSON or not an object, and events whose timestamp is null or no number; a
    missing timestamp is 0, numbers in strings count. Missing strings are empty, a JSON null is the text 'None'.
    """
    v = F.try_parse_json(F.regexp_replace(F.col(value), r"^\s+|\s+$", ""))
    rows = lines.withColumn("_v", v).where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("OBJECT"))

    def text(name: str):
        field = F.try_variant_get("_v", f"$.{name}", "variant")
        return F.when(field.isNull(), "").when(F.is_variant_null(field), "None").otherwise(F.try_variant_get("_v", f"$.{name}", "string"))

    stamp = F.try_variant_get("_v", "$.timestamp", "variant")
    time = F.when(stamp.isNull(), F.lit(0.0)).otherwise(F.try_variant_get("_v", "$.timestamp", "double"))
    cols = [time.alias("timestamp"), *(text(f).alias(f) for f in FIELDS[1:])]
    others = [c for c in lines.columns if c != value]
    return rows.select(*others, *cols).where("timestamp is not null").withColumn("us", F.round(F.col("timestamp") * 1e6).cast("long")).withColumn("event_key", event_key())


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files as events; `arrival` follows file name and place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return parse_lines(lines).withColumn("arrival", F.struct("_file", "_line")).drop("_file", "_line")


def traced(log: DataFrame) -> DataFrame:
    """Events that belong to a trace."""
    return log.where("trace_id <> ''")


def events_log(events: DataFrame) -> DataFrame:
    """The table `events` as a log: a user's day is a trace, the event type the key, the id the order of arrival."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    trace = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.to_date("ts").cast("string"))
    return events.select(trace.alias("trace_id"), F.col("event_type").alias("event_key"), us.alias("us"), F.col("event_id").alias("arrival"), F.lit("").alias("span_id"))


def conversations_log(turns: DataFrame) -> DataFrame:
    """The table `conversations` as a log: a conversation is a trace, the role the key, turns a second apart."""
    return turns.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("role").alias("event_key"), (F.col("turn") * 1_000_000).alias("us"), F.col("turn").alias("arrival"), F.lit("").alias("span_id"))


def json_lines(log: DataFrame) -> DataFrame:
    """One JSON text a row, for a text sink."""
    return log.select(F.to_json(F.struct(*[c for c in FIELDS if c in log.columns])).alias("value"))


def write_sorted(log: DataFrame, path: str) -> None:
    """JSON lines by trace, time, span and arrival over all files, in order of their names."""
    json_lines(log.orderBy("trace_id", "us", "span_id", "arrival")).write.mode("overwrite").text(path)


def batches(log: DataFrame, size: int = 50) -> Iterator[list[dict]]:
    """A log's events in order of time, then arrival, `size` at once; the driver holds one partition at most."""
    rows = log.orderBy("us", "arrival").select(*[c for c in FIELDS if c in log.columns]).toLocalIterator()
    while part := [r.asDict() for r in islice(rows, size)]:
        yield part


#: Planted pairs of the generator: cause, effect, probability, milliseconds from and to.
PLANTED = [
    ("db_query: lock wait", "http_request: gateway timeout", 0.85, 150, 400),
    ("cache_miss: profile", "db_query: select profile", 0.9, 5, 30),
    ("queue: consumer lag", "alert: order delayed", 0.75, 500, 1500),
    ("auth: token expired", "http_request: retry login", 0.8, 20, 90),
    ("gc: long pause", "http_request: slow response", 0.2, 50, 900),
]


def generate(spark: SparkSession, traces: int, seed: int = 42, per_trace: int = 8, start: float = 1_700_000_000.0, ratio: float = 1.0, start_at: int = 0) -> DataFrame:
    """A synthetic log with planted pairs: background events, then for every planted pair a cause in some traces and its
    effect with the pair's probability times ratio, from trace number start_at on. The same arguments give the same rows."""
    kinds = F.array(*[F.lit(k) for k in ("api_call: list", "api_call: get", "db_query: select", "cache_hit: page", "log: info", "rpc: send")])
    u = lambda *salt: F.pmod(F.xxhash64("id", *[F.lit(s) for s in (seed, *salt)]), F.lit(1_000_003)) / 1_000_003.0
    base = spark.range(traces).withColumn("t0", F.lit(start) + F.col("id") * 0.5)
    n = F.col("n")
    noise = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(per_trace - 1))))
    roll = lambda s: F.pmod(F.xxhash64("id", "n", F.lit(seed), F.lit(s)), F.lit(1_000_003)) / 1_000_003.0
    noise = noise.select("id", (F.col("t0") + n * 0.1 + roll(1) * 0.05).alias("timestamp"), F.element_at(kinds, (F.floor(roll(2) * 6) + 1).cast("int")).alias("key"))
    out = noise
    for i, (cause, effect, p, lo, hi) in enumerate(PLANTED):
        at = base.where(u(10, i) < 0.4).withColumn("tc", F.col("t0") + u(11, i))
        out = out.union(at.select("id", "tc", F.lit(cause)))
        out = out.union(at.where((u(12, i) < p * ratio) & (F.col("id") >= start_at)).select("id", F.col("tc") + (F.lit(lo) + u(13, i) * (hi - lo)) / 1000.0, F.lit(effect)))
    parts = F.split("key", ": ", 2)
    trace = F.format_string("trace-%08d", "id")
    span = F.concat(trace, F.lit("-"), F.hex(F.xxhash64("id", "key", "timestamp")))
    return out.select(F.round("timestamp", 6).alias("timestamp"), F.concat(F.lit("service-"), F.pmod("id", F.lit(6))).alias("service_name"), trace.alias("trace_id"), span.alias("span_id"), F.lit("").alias("parent_span_id"), parts[0].alias("event_type"), parts[1].alias("message"))

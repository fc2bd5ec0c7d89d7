"""Traces as ordered rows, and statistics of events, traces and ordered pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.scoring import d

#: Order within a trace: by time then arrival, by time then span then arrival, or as events arrived.
ORDERS = {"mem": ("us", "arrival"), "ext": ("us", "span_id", "arrival"), "rt": ("arrival",)}

#: Whole microseconds and counts, and sums of their products.
WHOLE, WIDE = "decimal(19,0)", "decimal(38,0)"


def sequence(log: DataFrame, order: str = "mem") -> DataFrame:
    """(trace_id, event_key, us, pos from 1, len): one exchange on trace_id, whose sort serves all that follows."""
    w = Window.partitionBy("trace_id").orderBy(*ORDERS[order])
    whole = Window.partitionBy("trace_id")
    rows = log.where("trace_id <> ''").withColumn("pos", F.row_number().over(w)).withColumn("len", F.count(F.lit(1)).over(whole))
    return rows.select("trace_id", "event_key", "us", "pos", "len")


def external_sort(log: DataFrame) -> DataFrame:
    """Events by trace, time, span and arrival, over the whole table; the shuffle's sorter spills by itself."""
    return log.orderBy("trace_id", "us", "span_id", "arrival")


def event_stats(log: DataFrame) -> DataFrame:
    """(event_key, n_events, n_traces, coverage_pct). Counts per trace and key come first, so no key is hot."""
    rows = log.where("trace_id <> ''")
    per = rows.groupBy("event_key", "trace_id").agg(F.count("*").alias("n"))
    total = rows.select("trace_id").distinct().agg(F.count("*").alias("total"))
    stats = per.groupBy("event_key").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_traces"))
    joined = stats.join(F.broadcast(total))  # one row
    return joined.select("event_key", "n_events", "n_traces", F.round(d(F.col("n_traces")) / F.col("total") * 100, 4).alias("coverage_pct"))


def trace_stats(seq: DataFrame) -> DataFrame:
    per = seq.groupBy("trace_id", "event_key").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return per.groupBy("trace_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_keys"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def gap_parts(seq: DataFrame) -> DataFrame:
    """(trace_id, cause, effect, us, n, g1, g2): for every event and every key of its trace that came before it, the number
    and the first and second sums of the gaps from that key's events, whole microseconds as decimals; us: the event's time.

    Pairs are not listed: running counts and sums of the key's earlier times give the sums, so a trace costs its events
    times its keys.
    """
    keys = seq.groupBy("trace_id", "event_key").agg(F.min("us").alias("zero")).select("trace_id", F.col("event_key").alias("cause"))
    origin = seq.groupBy("trace_id").agg(F.min("us").alias("zero"))
    rows = seq.join(origin, "trace_id").join(keys, "trace_id").withColumn("t", (F.col("us") - F.col("zero")).cast(WHOLE))
    before = Window.partitionBy("trace_id", "cause").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("event_key") == F.col("cause")
    none = F.lit(0).cast(WHOLE)
    square = (F.col("t") * F.col("t")).cast(WIDE)
    rows = rows.select(
        "trace_id", "cause", F.col("event_key").alias("effect"), "us", "t",
        F.sum(F.when(hit, 1).otherwise(0)).over(before).cast(WHOLE).alias("c"),
        F.sum(F.when(hit, F.col("t")).otherwise(none)).over(before).cast(WIDE).alias("s"),
        F.sum(F.when(hit, square).otherwise(none)).over(before).cast(WIDE).alias("q"),
    )
    t, c, s, q = (F.col(x) for x in "tcsq")
    wide = lambda x: x.cast(WIDE)
    first = wide(wide(c * t) - s)
    second = wide(wide(wide(wide(c * t) * t) - wide(wide(t * s) * 2)) + q)
    return rows.where("c > 0").select("trace_id", "cause", "effect", "us", c.cast("long").alias("n"), first.alias("g1"), second.alias("g2"))


def mean_and_deviation(n, g1, g2):
    """Mean and population deviation, in milliseconds, of n gaps with sums g1 and g2 in microseconds. The deviation is taken
    about the mean's whole part, in decimals, so both are exact before the last division."""
    wide = lambda x: x.cast(WIDE)
    count, m = n.cast(WHOLE), F.floor(g1 / n).cast(WHOLE)
    off = d(wide(g1 - wide(m * count))) / d(n)
    about = g2 - wide(wide(m * g1) * 2) + wide(wide(m * m) * count)
    return (d(m) + off) / 1000, F.sqrt(F.greatest(d(about) / d(n) - off * off, F.lit(0.0))) / 1000


def edge_stats(seq: DataFrame) -> DataFrame:
    """(cause, effect, n_traces, n_pairs, avg_ms, std_ms) over all ordered pairs of events of a trace."""
    per = gap_parts(seq).groupBy("trace_id", "cause", "effect").agg(*[F.sum(x).alias(x) for x in ("n", "g1", "g2")])
    out = per.groupBy("cause", "effect").agg(F.count("*").alias("n_traces"), *[F.sum(x).alias(x) for x in ("n", "g1", "g2")])
    mean, deviation = mean_and_deviation(F.col("n"), F.col("g1"), F.col("g2"))
    return out.select("cause", "effect", "n_traces", F.col("n").alias("n_pairs"), F.round(mean, 2).alias("avg_ms"), F.round(deviation, 2).alias("std_ms"))


def log_stats(seq: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: n_lines, n_traces, n_keys, n_edges."""
    per = seq.groupBy("trace_id", "event_key").agg(F.min("pos").alias("fpos"), F.max("pos").alias("lpos"))
    a, b = per.alias("a"), per.alias("b")
    edges = a.join(b, "trace_id").where("a.fpos < b.lpos").select(F.col("a.event_key"), F.col("b.event_key")).distinct()
    counts = [lines.agg(F.count("*").alias("n_lines")), seq.select("trace_id").distinct().agg(F.count("*").alias("n_traces")), seq.select("event_key").distinct().agg(F.count("*").alias("n_keys")), edges.agg(F.count("*").alias("n_edges"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def top_events(log: DataFrame, n: int = 10) -> DataFrame:
    return event_stats(log).orderBy(F.desc("n_events"), "event_key").limit(n)

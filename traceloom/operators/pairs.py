"""Cause-effect pairs: contingency counts, gaps under three rules, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import scoring as S
from traceloom.operators.traces import WHOLE, WIDE, gap_parts, mean_and_deviation


def firsts(seq: DataFrame) -> DataFrame:
    """(trace_id, event_key, fpos, fus, len): a row a key of a trace, its first place and time."""
    return seq.groupBy("trace_id", "event_key").agg(F.min("pos").alias("fpos"), F.min_by("us", "pos").alias("fus"), F.first("len").alias("len"))


def contingency(seq: DataFrame) -> DataFrame:
    """(cause, effect, total, cause_traces, effect_traces, both, cause_only, effect_only) of all pairs of different keys
    that share a trace, in either order. Work per trace is its keys squared, not its events."""
    keys = seq.select("trace_id", "event_key").distinct()
    both = keys.alias("a").join(keys.alias("b"), "trace_id").where("a.event_key <> b.event_key")
    both = both.groupBy(F.col("a.event_key").alias("cause"), F.col("b.event_key").alias("effect")).agg(F.count("*").alias("both"))
    return with_counts(both, keys)


def with_counts(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds the counts of traces; keys: distinct (trace_id, event_key)."""
    n = keys.groupBy("event_key").agg(F.count("*").alias("n"))
    total = keys.select("trace_id").distinct().agg(F.count("*").alias("total"))
    out = pairs.join(n.select(F.col("event_key").alias("cause"), F.col("n").alias("cause_traces")), "cause")
    out = out.join(n.select(F.col("event_key").alias("effect"), F.col("n").alias("effect_traces")), "effect").join(F.broadcast(total))
    return out.select("cause", "effect", "total", "cause_traces", "effect_traces", "both", (F.col("cause_traces") - F.col("both")).alias("cause_only"), (F.col("effect_traces") - F.col("both")).alias("effect_only"))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds support, confidence and lift, unrounded."""
    c = {x: F.col(x) for x in ("both", "cause_traces", "effect_traces", "total")}
    return counts.select("*", S.ratio(c["both"], c["total"]).alias("support"), S.ratio(c["both"], c["cause_traces"]).alias("confidence"), S.lift(c["both"], c["cause_traces"], c["effect_traces"], c["total"]).alias("lift"))


def gaps_mem(seq: DataFrame) -> DataFrame:
    """(trace_id, cause, effect, gap_ms): from the first cause to the first effect after it."""
    f, s = firsts(seq).alias("f"), seq.alias("s")
    later = f.join(s, "trace_id").where("s.pos > f.fpos and s.event_key <> f.event_key")
    first = later.groupBy("trace_id", F.col("f.event_key").alias("cause"), F.col("s.event_key").alias("effect")).agg(F.min_by("s.us", "s.pos").alias("e"), F.min("f.fus").alias("c"))
    return first.select("trace_id", "cause", "effect", (S.d(F.col("e") - F.col("c")) / 1000).alias("gap_ms"))


def gaps_ext(seq: DataFrame) -> DataFrame:
    """From the first cause to the first effect of the trace, where that is not earlier."""
    f = firsts(seq)
    pair = f.alias("a").join(f.alias("b"), "trace_id").where("a.event_key <> b.event_key and a.fus <= b.fus")
    return pair.select("trace_id", F.col("a.event_key").alias("cause"), F.col("b.event_key").alias("effect"), (S.d(F.col("b.fus") - F.col("a.fus")) / 1000).alias("gap_ms"))


def gaps_rt(seq: DataFrame) -> DataFrame:
    """From every event to every later arrival that is not earlier in time; seq in order of arrival. Of equal keys too."""
    pair = seq.alias("a").join(seq.alias("b"), "trace_id").where("a.pos < b.pos and a.us <= b.us")
    return pair.select("trace_id", F.col("a.event_key").alias("cause"), F.col("b.event_key").alias("effect"), (S.d(F.col("b.us") - F.col("a.us")) / 1000).alias("gap_ms"))


def ordered_pairs(seq: DataFrame) -> DataFrame:
    """(trace_id, cause, effect, since) for keys with an event of the one arriving before one of the other that is not
    earlier in time; since: the least time of such a later one. seq in order of arrival. For every event and key, the
    key's least time among earlier arrivals decides, so a trace costs its events times its keys and no pairs of events are
    listed."""
    keys = seq.select("trace_id", F.col("event_key").alias("cause")).distinct()
    before = Window.partitionBy("trace_id", "cause").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("event_key") == F.col("cause"), F.col("us"))).over(before)
    rows = seq.join(keys, "trace_id").withColumn("least", least).where("least <= us")
    return rows.groupBy("trace_id", "cause", F.col("event_key").alias("effect")).agg(F.min("us").alias("since"))


def live_parts(seq: DataFrame) -> DataFrame:
    """gap_parts under the live rule: gaps to later arrivals that are not earlier in time; seq in order of arrival. Pairs
    of events are listed only in traces whose events did not arrive in order of time."""
    earlier = F.lag("us").over(Window.partitionBy("trace_id").orderBy("pos"))
    mixed = seq.withColumn("before", earlier).where("before > us").select("trace_id").distinct()
    straight, rest = seq.join(mixed, "trace_id", "left_anti"), seq.join(mixed, "trace_id", "left_semi")
    pair = rest.alias("a").join(rest.alias("b"), "trace_id").where("a.pos < b.pos and a.us <= b.us")
    gap = (F.col("b.us") - F.col("a.us")).cast(WHOLE)
    listed = pair.select("trace_id", F.col("a.event_key").alias("cause"), F.col("b.event_key").alias("effect"), F.col("b.us").alias("us"), F.lit(1).cast("long").alias("n"), gap.cast(WIDE).alias("g1"), (gap * gap).cast(WIDE).alias("g2"))
    return gap_parts(straight).unionByName(listed)


def live_stats(seq: DataFrame) -> DataFrame:
    """interval_stats of gaps_rt, without its rows."""
    per = live_parts(seq).groupBy("trace_id", "cause", "effect").agg(*[F.sum(x).alias(x) for x in ("n", "g1", "g2")])
    out = per.groupBy("cause", "effect").agg(F.count("*").alias("n_traces"), *[F.sum(x).alias(x) for x in ("n", "g1", "g2")])
    mean, deviation = mean_and_deviation(F.col("n"), F.col("g1"), F.col("g2"))
    return out.select("cause", "effect", "n_traces", F.col("n").alias("n_gaps"), mean.alias("avg_ms"), deviation.alias("std_ms"))


def gap_stats(seq: DataFrame, mode: str) -> DataFrame:
    """(cause, effect, n_traces, n_gaps, avg_ms, std_ms) under a mode's rule; seq in the mode's order."""
    return live_stats(seq) if mode == "rt" else interval_stats(GAPS[mode](seq))


GAPS = {"mem": gaps_mem, "ext": gaps_ext, "rt": gaps_rt}


def interval_stats(gaps: DataFrame) -> DataFrame:
    """(cause, effect, n_traces, n_gaps, avg_ms, std_ms): population deviation, unrounded. Means and squared deviations are
    merged, never squares subtracted, so gaps of days that differ by microseconds keep their deviation. The distinct count
    makes Spark aggregate a trace's gaps first, so no pair is hot."""
    return gaps.groupBy("cause", "effect").agg(
        F.countDistinct("trace_id").alias("n_traces"),
        F.count("*").alias("n_gaps"),
        F.avg("gap_ms").alias("avg_ms"),
        F.stddev_pop("gap_ms").alias("std_ms"),
    )

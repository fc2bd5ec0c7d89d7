"""The live window: snapshots of the traces whose first-arrived event is not older than the window, at ticks.

A trace enters at its first event's time and leaves, whole, one window later; at a tick its events up to the tick count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import scoring as S
from traceloom.operators.pairs import interval_stats, live_parts, ordered_pairs
from traceloom.operators.traces import mean_and_deviation, sequence


def snapshot(log: DataFrame, now_us: int, window_s: float = 300.0) -> DataFrame:
    """Events of the window at one moment, in order of arrival (as sequence(..., 'rt'))."""
    seq = sequence(log.where(F.col("us") <= now_us), "rt")
    alive = seq.where((F.col("pos") == 1) & (F.col("us") >= now_us - int(window_s * 1e6))).select("trace_id")
    return seq.join(alive, "trace_id", "left_semi")


def active_traces(log: DataFrame, now_us: int, window_s: float = 300.0, timeout_s: float = 30.0) -> DataFrame:
    """(trace_id, first_us, last_us, n_events, completed): last is the last arrival's time; completed after the timeout."""
    seq = snapshot(log, now_us, window_s)
    per = seq.groupBy("trace_id").agg(F.min_by("us", "pos").alias("first_us"), F.max_by("us", "pos").alias("last_us"), F.count("*").alias("n_events"))
    return per.withColumn("completed", F.col("last_us") < now_us - int(timeout_s * 1e6))


def _ticks(first, since, window_us: int, slide_us: int):
    """The ticks of the grid from `since` to the trace's end; empty if there is none."""
    lo, hi = F.ceil(since / slide_us) * slide_us, F.floor((first + window_us) / slide_us) * slide_us
    return F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(slide_us).cast("long")))


def _born(seq: DataFrame) -> DataFrame:
    return seq.where("pos = 1").select("trace_id", F.col("us").alias("first"))


def window_stats(log: DataFrame, window_s: float, slide_s: float) -> DataFrame:
    """(tick, total_traces, total_events, unique_event_types, pair_count) at every tick with a trace."""
    w, s = int(window_s * 1e6), int(slide_s * 1e6)
    seq = sequence(log, "rt")
    born = _born(seq)
    keyed = seq.join(born, "trace_id").withColumn("tick", F.explode(_ticks(F.col("first"), F.greatest("first", "us"), w, s)))
    per = keyed.groupBy("tick", "event_key", "trace_id").agg(F.count("*").alias("n"))
    events = per.groupBy("tick").agg(F.sum("n").alias("total_events"))
    traces = per.select("tick", "trace_id").distinct().groupBy("tick").agg(F.count("*").alias("total_traces"))
    kinds = per.select("tick", "event_key").distinct().groupBy("tick").agg(F.count("*").alias("unique_event_types"))
    births = ordered_pairs(seq).join(born, "trace_id").withColumn("tick", F.explode(_ticks(F.col("first"), F.greatest("first", "since"), w, s)))
    pairs = births.select("tick", "cause", "effect").distinct().groupBy("tick").agg(F.count("*").alias("pair_count"))
    out = traces.join(events, "tick").join(kinds, "tick").join(pairs, "tick", "left")
    return out.select("tick", "total_traces", "total_events", "unique_event_types", F.coalesce("pair_count", F.lit(0)).cast("long").alias("pair_count"))


def _running(changes: DataFrame, slide_us: int, *sums: str) -> DataFrame:
    """(tick, cause, effect and the sums) at every tick of the grid at which a pair is there; changes: what is added at a
    tick, and taken away again after another. One row a pair and change goes through the window, not one a pair and tick."""
    by = Window.partitionBy("cause", "effect").orderBy("tick")
    each = changes.groupBy("cause", "effect", "tick").agg(*[F.sum(x).alias(x) for x in sums])
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = each.select("cause", "effect", "tick", *[F.sum(x).over(upto).cast(each.schema[x].dataType).alias(x) for x in sums], F.lead("tick").over(by).alias("next"))
    until = F.col("next") - slide_us
    rows = rows.where((F.col(sums[0]) > 0) & (until >= F.col("tick")))
    return rows.withColumn("tick", F.explode(F.sequence("tick", until, F.lit(slide_us).cast("long")))).drop("next")


def _stays(rows: DataFrame, since, window_us: int, slide_us: int, *sums: str) -> DataFrame:
    """Rows (cause, effect, sums, first) as changes: added at the first tick that sees them, taken away after the last."""
    lo = (F.ceil(since / slide_us) * slide_us).cast("long")
    hi = (F.floor((F.col("first") + window_us) / slide_us) * slide_us).cast("long")
    both = F.array(F.struct(lo.alias("tick"), *[F.col(x).alias(x) for x in sums]), F.struct((hi + slide_us).alias("tick"), *[(-F.col(x)).alias(x) for x in sums]))
    return rows.where(lo <= hi).select("cause", "effect", F.explode(both).alias("x")).select("cause", "effect", "x.*")


def tick_pairs(seq: DataFrame, window_us: int, slide_us: int) -> DataFrame:
    """(tick, cause, effect, n_traces, n_gaps, avg_ms, std_ms) of different keys; seq in order of arrival."""
    born = _born(seq)
    earliest = Window.partitionBy("trace_id", "cause", "effect").orderBy("us")
    parts = live_parts(seq).where("cause <> effect").join(born, "trace_id")
    parts = parts.withColumn("n_traces", (F.row_number().over(earliest) == 1).cast("long"))  # a trace counts from its first gap on
    sums = ("n_traces", "n", "g1", "g2")
    at = _running(_stays(parts, F.greatest("first", "us"), window_us, slide_us, *sums), slide_us, *sums)
    mean, deviation = mean_and_deviation(F.col("n"), F.col("g1"), F.col("g2"))
    return at.select("tick", "cause", "effect", "n_traces", F.col("n").alias("n_gaps"), mean.alias("avg_ms"), deviation.alias("std_ms"))


def tick_scores(log: DataFrame, window_s: float, slide_s: float, min_support: int = 2) -> DataFrame:
    """(tick, cause, effect, score, co_occurrence, total): scores of all pairs seen in order, at every tick."""
    w, s = int(window_s * 1e6), int(slide_s * 1e6)
    seq = sequence(log, "rt")
    born = _born(seq)
    keys = seq.groupBy("trace_id", "event_key").agg(F.min("us").alias("since")).join(born, "trace_id")
    keys = keys.select("trace_id", "event_key", F.explode(_ticks(F.col("first"), F.greatest("first", "since"), w, s)).alias("tick"))
    n = keys.groupBy("tick", "event_key").agg(F.count("*").alias("n"))
    total = keys.select("tick", "trace_id").distinct().groupBy("tick").agg(F.count("*").alias("total"))
    g = tick_pairs(seq, w, s)
    g = g.join(n.select("tick", F.col("event_key").alias("cause"), F.col("n").alias("ca")), ["tick", "cause"])
    g = g.join(n.select("tick", F.col("event_key").alias("effect"), F.col("n").alias("ef")), ["tick", "effect"]).join(total, "tick")
    both, ca, ef, t = F.col("n_traces"), F.col("ca"), F.col("ef"), F.col("total")
    interval = S.interval_score(F.col("n_gaps"), F.col("avg_ms"), F.col("std_ms"))
    score = S.total_score(S.ratio(both, ca), S.lift(both, ca, ef, t), F.lit(S.LIVE_PATTERN), interval, both, ca, ef, min_support)
    return g.select("tick", "cause", "effect", score.alias("score"), both.alias("co_occurrence"), t.alias("total"))


def pair_samples(log: DataFrame, pairs: list[tuple[str, str]], first_us: int, last_us: int, window_s: float, slide_s: float, min_support: int = 2) -> DataFrame:
    """(ts in seconds, cause, effect, score, co_occurrence): a sample of every given pair at every tick of the grid from
    first_us to last_us, also where the pair does not occur. One job for all pairs and ticks; events of other keys count
    in the number of traces only."""
    spark = log.sparkSession
    w, s = int(window_s * 1e6), int(slide_s * 1e6)
    seq = sequence(log, "rt")
    born = _born(seq)
    wanted = F.broadcast(spark.createDataFrame(pairs, "cause string, effect string").distinct())
    named = F.broadcast(spark.createDataFrame([(k,) for p in pairs for k in p], "event_key string").distinct())

    def ticks(since):
        lo = F.greatest(F.ceil(since / s) * s, F.lit(first_us))
        hi = F.least(F.floor((F.col("first") + w) / s) * s, F.lit(last_us))
        return F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(s).cast("long")))).alias("tick")

    total = born.select("trace_id", ticks(F.col("first"))).groupBy("tick").agg(F.count("*").alias("total"))
    rows = seq.join(named, "event_key", "left_semi")
    keys = rows.groupBy("trace_id", "event_key").agg(F.min("us").alias("since")).join(born, "trace_id")
    n = keys.select("event_key", ticks(F.greatest("first", "since"))).groupBy("tick", "event_key").agg(F.count("*").alias("n"))
    pair = rows.alias("a").join(rows.alias("b"), "trace_id").where("a.pos < b.pos and a.us <= b.us")
    pair = pair.select("trace_id", F.col("a.event_key").alias("cause"), F.col("b.event_key").alias("effect"), F.col("b.us").alias("since"), (S.d(F.col("b.us") - F.col("a.us")) / 1000).alias("gap_ms"))
    pair = pair.join(wanted, ["cause", "effect"], "left_semi").join(born, "trace_id")
    gaps = pair.select("cause", "effect", "trace_id", "gap_ms", ticks(F.greatest("first", "since")))
    gaps = gaps.where("cause <> effect").select(F.struct("tick", "cause").alias("cause"), "effect", "trace_id", "gap_ms")
    stats = interval_stats(gaps).select("cause.tick", "cause.cause", "effect", "n_traces", "n_gaps", "avg_ms", "std_ms")
    grid = spark.range(first_us, last_us + 1, s).withColumnRenamed("id", "tick")
    grid = grid.withColumn("p", F.explode(F.array(*[F.struct(F.lit(c).alias("cause"), F.lit(e).alias("effect")) for c, e in dict.fromkeys(pairs)]))).select("tick", "p.*")
    out = grid.join(stats, ["tick", "cause", "effect"], "left").join(total, "tick", "left")
    out = out.join(n.select("tick", F.col("event_key").alias("cause"), F.col("n").alias("ca")), ["tick", "cause"], "left")
    out = out.join(n.select("tick", F.col("event_key").alias("effect"), F.col("n").alias("ef")), ["tick", "effect"], "left")
    both, ca, ef, t, gaps_n = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_traces", "ca", "ef", "total", "n_gaps"))
    interval = S.interval_score(gaps_n, F.col("avg_ms"), F.col("std_ms"))
    score = S.total_score(S.ratio(both, ca), S.lift(both, ca, ef, t), F.lit(S.LIVE_PATTERN), interval, both, ca, ef, min_support)
    return out.select((F.col("tick") / 1e6).cast("double").alias("ts"), "cause", "effect", score.alias("score"), both.alias("co_occurrence"))

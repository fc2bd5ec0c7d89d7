"""Scores of cause-effect pairs under the three rules: mem, ext and rt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import scoring as S
from traceloom.operators import pairs as P
from traceloom.operators import patterns as M
from traceloom.operators.traces import sequence

MODES = {"mem": "in-memory", "ext": "streaming", "rt": "real-time"}


def infer_pairs(log: DataFrame, mode: str = "mem", min_support: int = 2, max_len: int = 10, cause: str | None = None, effect: str | None = None) -> DataFrame:
    """A row a pair: counts, rounded metrics, score and explanation. With cause and effect, that pair alone, also if it
    never occurs; traces without the cause are then not mined."""
    seq = sequence(log, mode)
    keys = seq.select("trace_id", "event_key").distinct()
    one = cause is not None and effect is not None
    if one:
        seq_pair = seq.where(F.col("event_key").isin(cause, effect))
    else:
        seq_pair = seq
    gaps = P.gap_stats(seq_pair, mode).where(F.col("cause") != F.col("effect"))
    if mode == "rt":
        counts = P.with_counts(gaps.select("cause", "effect", F.col("n_traces").alias("both")), keys)
    else:
        counts = P.contingency(seq).where((F.col("cause") == cause) & (F.col("effect") == effect)) if one else P.contingency(seq)
    if one:
        named = log.sparkSession.createDataFrame([(cause, effect)], "cause string, effect string")
        total = keys.agg(F.countDistinct("trace_id").alias("total"))
        has = lambda k, name: keys.where(F.col("event_key") == k).agg(F.count("*").alias(name))
        counts = named.join(counts.where((F.col("cause") == cause) & (F.col("effect") == effect)).select("cause", "effect", "both"), ["cause", "effect"], "left")
        counts = counts.join(F.broadcast(total)).join(F.broadcast(has(cause, "cause_traces"))).join(F.broadcast(has(effect, "effect_traces"))).withColumn("both", F.coalesce("both", F.lit(0)))
        counts = counts.select("cause", "effect", "total", "cause_traces", "effect_traces", "both", (F.col("cause_traces") - F.col("both")).alias("cause_only"), (F.col("effect_traces") - F.col("both")).alias("effect_only"))
    rows = P.metrics(counts).join(gaps.drop("n_traces"), ["cause", "effect"], "left")
    if mode == "rt":
        pattern = F.lit(S.LIVE_PATTERN)
    else:
        if mode == "mem":
            found = M.pattern_pairs(M.patterns(seq, min_support, max_len))
        else:
            found = M.ngram_evidence(seq, keys)
        if one:
            found = found.where((F.col("cause") == cause) & (F.col("effect") == effect))
        rows = rows.join(M.best_pattern(found), ["cause", "effect"], "left")
        pattern = S.pattern_score(F.col("pattern_confidence"), F.col("pattern_lift"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.coalesce(F.col("n_gaps"), F.lit(0))
    interval = S.interval_score(n, F.col("avg_ms"), F.col("std_ms"))
    score = S.total_score(F.col("confidence"), F.col("lift"), pattern, interval, F.col("both"), F.col("cause_traces"), F.col("effect_traces"), min_support)
    rows = rows.withColumn("confidence_score", score).withColumn("avg_ms", zero("avg_ms")).withColumn("std_ms", zero("std_ms"))
    c = {x: F.col(x) for x in ("cause", "effect", "total", "cause_traces", "effect_traces", "both", "avg_ms", "std_ms", "confidence", "lift")} | {"score": F.col("confidence_score")}
    if mode != "rt":
        c |= {x: F.col(x) for x in ("pattern", "pattern_support", "pattern_confidence")}
    return rows.select(
        F.lit(MODES[mode]).alias("mode"), "cause", "effect", "confidence_score",
        F.col("both").alias("co_occurrence_traces"), F.col("total").alias("total_traces"),
        F.round("avg_ms", 1).alias("avg_time_interval_ms"), F.round("std_ms", 1).alias("std_time_interval_ms"),
        F.col("cause_only").alias("cause_only_traces"), F.col("effect_only").alias("effect_only_traces"),
        F.round("support", 4).alias("support"), F.round("confidence", 4).alias("confidence"), F.round("lift", 4).alias("lift"),
        S.explanation(c, mode).alias("explanation"),
    )


def infer(log: DataFrame, cause: str, effect: str, mode: str = "mem", min_support: int = 2, max_len: int = 10) -> DataFrame:
    return infer_pairs(log, mode, min_support, max_len, cause, effect)

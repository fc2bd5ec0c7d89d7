"""Frequent sequences by tail support, contiguous n-grams, and ranked pairs.

A trace supports a sequence if the leftmost embedding of it ends before the trace's last event. Mining grows one event a
level: rows (pattern, trace, end) extend by the smallest later place of every key; a level's table is written to the
checkpoint folder, and patterns under min_support do not grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import scoring as S
from traceloom.operators.pairs import firsts

#: Largest table, in bytes of its rows, that mining broadcasts.
BROADCAST_BYTES = 64 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in spark.checkpoint.dir; a local folder is set only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/traceloom")
    return df.checkpoint()


def tail_supports(seq: DataFrame, min_support: int = 2, max_len: int = 10, cause: str | None = None) -> DataFrame:
    """(pattern array<string>, support) of length 1 to max_len; with `cause`, mined in traces that hold it only, which
    leaves the support of every pattern that contains it unchanged."""
    rows = seq.select("trace_id", "event_key", "pos", "len")
    if cause is not None:
        rows = rows.join(rows.where(F.col("event_key") == cause).select("trace_id").distinct(), "trace_id", "left_semi")
    min_support = max(1, min_support)
    current = rows.groupBy("trace_id", "len", F.array("event_key").alias("pattern")).agg(F.min("pos").alias("end")).where("end < len")
    levels = []
    for n in range(1, max_len + 1):
        current = checkpointed(current)
        support = checkpointed(current.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= min_support))
        size = support.agg(F.coalesce(F.sum(F.length(F.array_join("pattern", " ")) + 32), F.lit(0))).first()[0]
        if not size:
            break
        levels.append(support)
        if n == max_len:
            break
        own = support.select("pattern")  # a few patterns hold most rows: without a shuffle on them where they are measured small
        grown = current.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "pattern", "left_semi").join(rows.drop("len"), "trace_id").where("pos > end")
        current = grown.groupBy("trace_id", "len", F.concat("pattern", F.array("event_key")).alias("pattern")).agg(F.min("pos").alias("end")).where("end < len")
    if not levels:
        return seq.sparkSession.createDataFrame([], "pattern array<string>, support long")
    return reduce(DataFrame.union, levels)


def item_tails(seq: DataFrame) -> DataFrame:
    """(event_key, tail_support): traces in which the key occurs before the last event."""
    return firsts(seq).where("fpos < len").groupBy("event_key").agg(F.count("*").alias("tail_support"))


def n_traces(seq: DataFrame) -> DataFrame:
    return seq.select("trace_id").distinct().agg(F.count("*").alias("n"))


def patterns(seq: DataFrame, min_support: int = 2, max_len: int = 10) -> DataFrame:
    """(pattern, support, confidence, lift) of length 2 and more, unrounded."""
    found = tail_supports(seq, min_support, max_len)
    prefix = found.select(F.col("pattern").alias("prefix"), F.col("support").alias("prefix_support"))
    tails = item_tails(seq).select(F.col("event_key").alias("last"), F.col("tail_support").alias("last_support"))
    long = found.where(F.size("pattern") > 1).withColumn("prefix", F.slice("pattern", 1, F.size("pattern") - 1)).withColumn("last", F.element_at("pattern", -1))
    out = long.join(prefix, "prefix").join(tails, "last").join(F.broadcast(n_traces(seq)))
    n, sup, pre, last = S.d(F.col("n")), F.col("support"), F.col("prefix_support"), F.col("last_support")
    return out.select("pattern", "support", S.ratio(sup, pre).alias("confidence"), ((S.d(sup) / n) / ((S.d(pre) / n) * (S.d(last) / n))).alias("lift"))


def pattern_pairs(found: DataFrame) -> DataFrame:
    """Adds (cause, effect) for every pair of different keys whose first places in the pattern are in that order."""
    p = found.withColumn("keys", F.array_distinct("pattern"))
    p = p.withColumn("cause", F.explode("keys")).withColumn("effect", F.explode("keys"))
    return p.where(F.array_position("pattern", F.col("cause")) < F.array_position("pattern", F.col("effect"))).drop("keys")


def best_pattern(rows: DataFrame) -> DataFrame:
    """The first of each pair's patterns by confidence, support and lift, then the shorter and smaller one."""
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), (-F.col("lift")).alias("c"), F.size("pattern").alias("d"), F.col("pattern").alias("e"))
    best = rows.groupBy("cause", "effect").agg(F.min(order).alias("x"))
    return best.select("cause", "effect", F.col("x.e").alias("pattern"), (-F.col("x.b")).alias("pattern_support"), (-F.col("x.a")).alias("pattern_confidence"), (-F.col("x.c")).alias("pattern_lift"))


def pairs_of_two(seq: DataFrame, min_support: int = 2) -> DataFrame:
    """(cause, effect, support, confidence, lift) of the sequences of length two, in closed form: a trace counts if the
    first effect after the first cause is not its last event. One exchange on the trace, no mining."""
    f, s = firsts(seq).alias("f"), seq.alias("s")
    later = f.join(s, "trace_id").where("s.pos > f.fpos")
    ends = later.groupBy("trace_id", F.col("f.event_key").alias("cause"), F.col("s.event_key").alias("effect")).agg(F.min("s.pos").alias("e"), F.min("s.len").alias("len"))
    sup = ends.where("e < len").groupBy("cause", "effect").agg(F.count("*").alias("support")).where(F.col("support") >= max(1, min_support))
    tails = item_tails(seq)
    out = sup.join(tails.select(F.col("event_key").alias("cause"), F.col("tail_support").alias("ca")), "cause")
    out = out.join(tails.select(F.col("event_key").alias("effect"), F.col("tail_support").alias("ef")), "effect").join(F.broadcast(n_traces(seq)))
    n = S.d(F.col("n"))
    return out.select("cause", "effect", "support", S.ratio(F.col("support"), F.col("ca")).alias("confidence"), ((S.d(F.col("support")) / n) / ((S.d(F.col("ca")) / n) * (S.d(F.col("ef")) / n))).alias("lift"))


def top_pairs(seq: DataFrame, n: int = 20, min_support: int = 2) -> DataFrame:
    """(cause, effect, score, support, confidence, lift), the n best; ties by support, confidence and names."""
    sup = F.least(F.col("support"), F.lit(100)).cast("double") / 100
    score = F.round((F.col("confidence") * 0.5 + F.least(F.col("lift"), F.lit(5.0)) / 5 * 0.3 + sup * 0.2) * 100, 1)
    rows = pairs_of_two(seq, min_support).select("cause", "effect", score.alias("score"), "support", F.round("confidence", 4).alias("confidence"), F.round("lift", 4).alias("lift"))
    return rows.orderBy(F.desc("score"), F.desc("support"), F.desc("confidence"), "cause", "effect").limit(n)


def ngrams(seq: DataFrame, longest: int = 8) -> DataFrame:
    """(pattern, n): occurrences of every run of 2 to `longest` events, counted a partition first."""
    w = Window.partitionBy("trace_id").orderBy("pos")
    rows = seq.select("event_key", *[F.lead("event_key", i).over(w).alias(f"k{i}") for i in range(1, longest)])
    whole = F.array("event_key", *[f"k{i}" for i in range(1, longest)])
    sizes = sum((F.col(f"k{i}").isNotNull().cast("int") for i in range(1, longest)), F.lit(1))
    runs = rows.select(whole.alias("a"), sizes.alias("m")).where("m > 1")
    runs = runs.groupBy("a", "m").agg(F.count("*").alias("c"))  # equal runs once, before they are cut
    cut = runs.select(F.explode(F.transform(F.sequence(F.lit(2), F.col("m")), lambda i: F.slice("a", 1, i))).alias("pattern"), "c")
    return cut.groupBy("pattern").agg(F.sum("c").alias("n"))


def ngram_evidence(seq: DataFrame, keys: DataFrame, longest: int = 8, listed: int = 100) -> DataFrame:
    """(cause, effect, pattern, support, confidence, lift) of n-grams in which the cause's first place precedes the
    effect's, a pair's `listed` most frequent ones. The prefix counts if it holds the pair too, else confidence is 0;
    lift counts if the n-gram ends in the effect. keys: distinct (trace_id, event_key)."""
    grams = ngrams(seq, longest)
    pairs = pattern_pairs(grams)
    rank = F.row_number().over(Window.partitionBy("cause", "effect").orderBy(F.desc("n"), "pattern"))
    top = pairs.withColumn("r", rank).where(F.col("r") <= listed)
    known = pairs.select("cause", "effect", F.col("pattern").alias("prefix"), F.col("n").alias("prefix_n"))
    n = keys.groupBy("event_key").agg(F.count("*").alias("effect_n")).withColumnRenamed("event_key", "effect")
    total = keys.select("trace_id").distinct().agg(F.count("*").alias("total"))
    rows = top.withColumn("prefix", F.slice("pattern", 1, F.size("pattern") - 1)).join(known, ["cause", "effect", "prefix"], "left").join(n, "effect").join(F.broadcast(total))
    pre = F.coalesce(F.col("prefix_n"), F.lit(0))
    t = S.d(F.col("total"))
    lift = F.when((pre > 0) & (F.element_at("pattern", -1) == F.col("effect")), (S.d(F.col("n")) / t) / ((S.d(pre) / t) * (S.d(F.col("effect_n")) / t))).otherwise(F.lit(0.0))
    return rows.select("cause", "effect", "pattern", F.col("n").alias("support"), S.ratio(F.col("n"), pre).alias("confidence"), lift.alias("lift"))


def heavy_hitters(grams: DataFrame, k: int = 100) -> DataFrame:
    """The k most frequent patterns, exactly; ties to the smaller pattern."""
    return grams.orderBy(F.desc("n"), "pattern").limit(k)


def approximate_hitters(items: DataFrame, column: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """(item, count) estimates of the k most frequent values in bounded memory."""
    top = items.agg(F.expr(f"approx_top_k({column}, {k}, {tracked})").alias("x"))
    return top.select(F.inline("x"))


def count_min(items: DataFrame, column: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 42) -> DataFrame:
    """One row with a Count-Min sketch (binary) of a column; see estimate()."""
    return items.agg(F.count_min_sketch(F.col(column), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def estimate(sketch: DataFrame, items: list[str]) -> dict[str, int]:
    """Point queries on a Count-Min sketch."""
    blob = sketch.first()["sketch"]
    jvm = sketch.sparkSession._jvm
    read = jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(jvm.java.io.ByteArrayInputStream(bytes(blob)))
    return {x: read.estimateCount(x) for x in items}

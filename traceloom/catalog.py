"""The registered queries of the trace analytics over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import scoring
from traceloom.operators import anomaly, pairs, patterns, traces, window
from traceloom.plans.infer import infer_pairs
from traceloom.sources import logs

#: The live window of the table `events`, whose traces are days: seven days, a tick a day.
DAY = 86_400.0
WINDOW, SLIDE = 7 * DAY, DAY
#: Longest mined pattern.
MAX_LEN = 10
BAD_LINES = ["", "   ", "{bad", "[1]", "42", '{"timestamp":null,"trace_id":"t"}', '{"timestamp":"x","trace_id":"t"}']


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _seq(spark, sf_dir, order="mem"):
    return traces.sequence(_log(spark, sf_dir), order)


def log_normalise(spark, sf_dir):
    log = _log(spark, sf_dir)
    line = F.to_json(F.struct((F.col("us") / 1e6).cast("decimal(20,6)").cast("string").alias("timestamp"), "trace_id", F.col("event_key").alias("event_type"), F.lit("m").alias("message")))
    bad = spark.createDataFrame([(x,) for x in BAD_LINES], "value string")
    return logs.traced(logs.parse_lines(log.select(line.alias("value")).union(bad))).select("trace_id", "event_key", "us")


def event_stats(spark, sf_dir):
    return traces.event_stats(_log(spark, sf_dir))


def log_stats(spark, sf_dir):
    return traces.log_stats(_seq(spark, sf_dir), _log(spark, sf_dir))


def top_events(spark, sf_dir):
    return traces.top_events(_log(spark, sf_dir), 10)


def trace_stats(spark, sf_dir):
    return traces.trace_stats(_seq(spark, sf_dir))


def edge_stats_all_pairs(spark, sf_dir):
    return traces.edge_stats(_seq(spark, sf_dir))


def ext_sorted(spark, sf_dir):
    return traces.external_sort(_log(spark, sf_dir)).select("trace_id", "event_key", "us", "arrival")


def pair_contingency(spark, sf_dir):
    return pairs.contingency(_seq(spark, sf_dir))


def pair_metrics(spark, sf_dir):
    m = pairs.metrics(pairs.contingency(_seq(spark, sf_dir)))
    return m.select("cause", "effect", *[F.round(c, 4).alias(c) for c in ("support", "confidence", "lift")])


def _intervals(mode):
    def query(spark, sf_dir):
        g = pairs.gap_stats(_seq(spark, sf_dir, mode), mode)
        score = scoring.interval_score(F.col("n_gaps"), F.col("avg_ms"), F.col("std_ms"))
        return g.select("cause", "effect", "n_traces", "n_gaps", F.round("avg_ms", 1).alias("avg_ms"), F.round("std_ms", 1).alias("std_ms"), F.round(score, 4).alias("interval_score"))

    return query


def item_tail_support(spark, sf_dir):
    return patterns.item_tails(_seq(spark, sf_dir))


def pattern_len2(spark, sf_dir):
    return patterns.pairs_of_two(_seq(spark, sf_dir)).select("cause", "effect", "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def mine_patterns(spark, sf_dir):
    found = patterns.patterns(_seq(spark, sf_dir), 2, MAX_LEN)
    return found.select(F.array_join("pattern", " > ").alias("pattern"), "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def mine_conversations(spark, sf_dir):
    seq = traces.sequence(logs.conversations_log(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return patterns.tail_supports(seq, 2, MAX_LEN).select(F.array_join("pattern", " > ").alias("pattern"), "support")


def top_pairs(spark, sf_dir):
    return patterns.top_pairs(_seq(spark, sf_dir), 20)


def ngram_counts(spark, sf_dir):
    return patterns.ngrams(_seq(spark, sf_dir, "ext")).select(F.array_join("pattern", " > ").alias("pattern"), "n")


def heavy_hitters(spark, sf_dir):
    return patterns.heavy_hitters(patterns.ngrams(_seq(spark, sf_dir, "ext")), 50).select(F.array_join("pattern", " > ").alias("pattern"), "n")


def sketch_hitters(spark, sf_dir):
    top = patterns.approximate_hitters(_log(spark, sf_dir), "event_key", 10)
    return top.select(F.col("item").alias("event_key"), F.col("count").alias("n"))


def count_min_sketch(spark, sf_dir):
    return patterns.count_min(_log(spark, sf_dir), "event_key").select(F.length("sketch").alias("sketch_bytes"), F.sha2("sketch", 256).alias("sketch_sha256"))


def _infer(mode):
    def query(spark, sf_dir):
        out = infer_pairs(_log(spark, sf_dir), mode, 2, MAX_LEN)
        return out.drop("explanation", "mode")

    return query


def explain(spark, sf_dir):
    out = infer_pairs(_log(spark, sf_dir), "mem", 2, MAX_LEN)
    return out.select("cause", "effect", "explanation", scoring.level(F.col("confidence_score")).alias("level"), scoring.bar(F.col("confidence_score")).alias("bar"))


def score_levels(spark, sf_dir):
    score = F.col("confidence_score")
    return infer_pairs(_log(spark, sf_dir), "ext", 2, MAX_LEN).select("cause", "effect", scoring.level(score).alias("level"), scoring.bar(score).alias("bar"))


def window_snapshot(spark, sf_dir):
    return window.window_stats(_log(spark, sf_dir), WINDOW, SLIDE)


def rt_scores(spark, sf_dir):
    return window.tick_scores(_log(spark, sf_dir), WINDOW, SLIDE)


def _samples(spark, sf_dir):
    s = window.tick_scores(_log(spark, sf_dir), WINDOW, SLIDE)
    return s.select("cause", "effect", (F.col("tick") / 1e6).cast("double").alias("ts"), "score", "co_occurrence")


def score_baseline(spark, sf_dir):
    b = anomaly.baseline(_samples(spark, sf_dir))
    return b.select("cause", "effect", F.col("ts").cast("long").alias("ts"), "score", F.col("n").cast("long").alias("n"), F.round("baseline_mean", 6).alias("baseline_mean"), F.round("baseline_std", 6).alias("baseline_std"))


def cusum_noreset(spark, sf_dir):
    b = anomaly.cusum(_samples(spark, sf_dir))
    return b.select("cause", "effect", F.col("ts").cast("long").alias("ts"), F.round("cusum_pos", 3).alias("cusum_pos"), F.round("cusum_neg", 3).alias("cusum_neg"))


#: Scores of the table `events` are low; the rule is scaled to them.
EVENTS_RULE = anomaly.Rule(min_samples=5, threshold=4.0, min_rising=25.0, change=5.0, cooldown=2 * DAY, breaches=1)


def _flat(found):
    """Alerts with their details as columns of their own."""
    return found.select(*[c for c in found.columns if c != "details"], "details.*")


def alerts(spark, sf_dir):
    return _flat(anomaly.detect(_samples(spark, sf_dir), EVENTS_RULE))


#: Three breaches in a row, as the default rule asks for, on the scale of the table.
LASTING_RULE = anomaly.Rule(min_samples=5, threshold=4.0, min_rising=25.0, change=5.0, cooldown=2 * DAY, breaches=3)


def lasting_alerts(spark, sf_dir):
    return _flat(anomaly.detect(_samples(spark, sf_dir), LASTING_RULE))


def recent_alerts(spark, sf_dir):
    return _flat(anomaly.recent_alerts(anomaly.detect(_samples(spark, sf_dir), EVENTS_RULE), 10))


def active_traces(spark, sf_dir):
    log = _log(spark, sf_dir)
    now = log.agg(F.max("us")).first()[0]
    return window.active_traces(log, now, WINDOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [log_normalise, event_stats, log_stats, top_events, trace_stats, edge_stats_all_pairs, ext_sorted, pair_contingency, pair_metrics, item_tail_support, pattern_len2, mine_patterns, mine_conversations, top_pairs, ngram_counts, heavy_hitters, sketch_hitters, count_min_sketch, explain, window_snapshot, rt_scores, score_baseline, cusum_noreset, alerts, lasting_alerts, recent_alerts, active_traces, score_levels]
    made = {f"interval_{m}": _intervals(m) for m in ("mem", "ext", "rt")} | {f"infer_{m}": _infer(m) for m in ("mem", "ext", "rt")}
    return {f.__name__: f for f in own} | made


_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trace_id, event_type AS event_key, epoch_us(ts) AS us, event_id AS arrival FROM events)"""
_SEQ = f"""{_LOG},
seq AS MATERIALIZED (SELECT trace_id, event_key, us, arrival, row_number() OVER (PARTITION BY trace_id ORDER BY us, arrival) AS pos, count(*) OVER (PARTITION BY trace_id) AS len FROM log),
rt AS (SELECT trace_id, event_key, us, row_number() OVER (PARTITION BY trace_id ORDER BY arrival) AS pos FROM log),
firsts AS MATERIALIZED (SELECT trace_id, event_key, min(pos) AS fpos, arg_min(us, pos) AS fus, any_value(len) AS len FROM seq GROUP BY ALL),
keys AS (SELECT DISTINCT trace_id, event_key FROM log),
total AS MATERIALIZED (SELECT count(DISTINCT trace_id) AS total FROM log),
n AS (SELECT event_key, count(*) AS n FROM keys GROUP BY ALL),
tails AS MATERIALIZED (SELECT event_key, count(*) AS tail_support FROM firsts WHERE fpos < len GROUP BY ALL)"""
_BOTH = """both_ AS (SELECT a.event_key AS cause, b.event_key AS effect, count(*) AS both_n FROM keys a JOIN keys b USING (trace_id) WHERE a.event_key <> b.event_key GROUP BY ALL),
counts AS (SELECT cause, effect, total, c.n AS cause_traces, e.n AS effect_traces, both_n FROM both_ JOIN n c ON c.event_key = cause JOIN n e ON e.event_key = effect, total)"""
_GAPS = {
    "mem": "gaps AS (SELECT f.trace_id, f.event_key AS cause, s.event_key AS effect, (arg_min(s.us, s.pos) - min(f.fus)) / 1000.0::DOUBLE AS gap FROM firsts f JOIN seq s USING (trace_id) WHERE s.pos > f.fpos AND s.event_key <> f.event_key GROUP BY ALL)",
    "ext": "gaps AS (SELECT a.trace_id, a.event_key AS cause, b.event_key AS effect, (b.fus - a.fus) / 1000.0::DOUBLE AS gap FROM firsts a JOIN firsts b USING (trace_id) WHERE a.event_key <> b.event_key AND a.fus <= b.fus)",
    "rt": "gaps AS (SELECT a.trace_id, a.event_key AS cause, b.event_key AS effect, (b.us - a.us) / 1000.0::DOUBLE AS gap FROM rt a JOIN rt b USING (trace_id) WHERE a.pos < b.pos AND a.us <= b.us)",
}
_STATS = "stats AS (SELECT cause, effect, count(DISTINCT trace_id) AS n_traces, count(*) AS n_gaps, avg(gap) AS avg_ms, stddev_pop(gap) AS std_ms FROM gaps GROUP BY ALL)"
_ISCORE = "CASE WHEN n_gaps < 2 OR avg_ms <= 0 OR avg_ms IS NULL THEN 0 ELSE greatest(0, 1 - least(std_ms / avg_ms, 3) / 3) END"


def _levels(seq: str = "seq", n: int = MAX_LEN) -> str:
    """l1 to ln: traces and ends of the sequences of each length; s1 to sn: those of enough support, which alone grow."""
    out = [f"l1 AS MATERIALIZED (SELECT trace_id, len, [event_key] AS pattern, min(pos) AS e FROM {seq} GROUP BY ALL HAVING min(pos) < len)"]
    for i in range(1, n + 1):
        out.append(f"s{i} AS MATERIALIZED (SELECT pattern, count(*) AS support FROM l{i} GROUP BY ALL HAVING count(*) >= 2)")
        if i < n:
            out.append(f"""l{i + 1} AS MATERIALIZED (SELECT l.trace_id, l.len, list_append(l.pattern, s.event_key) AS pattern, min(s.pos) AS e
  FROM l{i} l JOIN s{i} USING (pattern) JOIN {seq} s ON s.trace_id = l.trace_id AND s.pos > l.e GROUP BY ALL HAVING min(s.pos) < l.len)""")
    union = " UNION ALL ".join(f"SELECT pattern, support FROM s{i}" for i in range(1, n + 1))
    return ",\n".join([*out, f"sup AS MATERIALIZED ({union})"])


def _patterns(n: int = MAX_LEN) -> str:
    return f"""{_levels(n=n)},
pat AS MATERIALIZED (SELECT s.pattern, s.support, s.support / p.support::DOUBLE AS confidence, (s.support / total::DOUBLE) / ((p.support / total::DOUBLE) * (t.tail_support / total::DOUBLE)) AS lift
  FROM sup s JOIN sup p ON p.pattern = s.pattern[:-2] JOIN tails t ON t.event_key = s.pattern[-1], total WHERE len(s.pattern) > 1)"""


_PATTERNS = _patterns()
_NGRAMS = """lists AS (SELECT trace_id, list(event_key ORDER BY pos) AS k FROM seq GROUP BY ALL),
starts AS (SELECT k, unnest(range(1, len(k))) AS i FROM lists),
sized AS (SELECT k, i, unnest(range(2, least(8, len(k) - i + 1) + 1)) AS m FROM starts),
grams AS (SELECT list_slice(k, i, i + m - 1) AS pattern, count(*) AS n FROM sized GROUP BY ALL)"""
_PAIRED = "paired AS (SELECT g.*, c.event_key AS cause, e.event_key AS effect FROM {0} g JOIN n c ON list_contains(g.pattern, c.event_key) JOIN n e ON list_contains(g.pattern, e.event_key) WHERE list_position(g.pattern, c.event_key) < list_position(g.pattern, e.event_key))"
_BEST = "best AS (SELECT cause, effect, confidence AS pc, lift AS pl FROM (SELECT *, row_number() OVER (PARTITION BY cause, effect ORDER BY confidence DESC, {0} DESC, lift DESC, len(pattern), pattern) AS r FROM {1}) WHERE r = 1)"
_EVIDENCE = f"""{_PAIRED.format('grams')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cause, effect ORDER BY n DESC, pattern) AS r FROM paired),
ev AS (SELECT a.cause, a.effect, a.pattern, a.n AS support, CASE WHEN p.n > 0 THEN a.n / p.n::DOUBLE ELSE 0 END AS confidence,
  CASE WHEN p.n > 0 AND a.pattern[-1] = a.effect THEN (a.n / total::DOUBLE) / ((p.n / total::DOUBLE) * (e.n / total::DOUBLE)) ELSE 0 END AS lift
  FROM ranked a LEFT JOIN paired p ON p.cause = a.cause AND p.effect = a.effect AND p.pattern = a.pattern[:-2] JOIN n e ON e.event_key = a.effect, total WHERE a.r <= 100)"""


def _score(pattern: str) -> str:
    return f"""SELECT cause, effect, least(100, greatest(0, round(CASE WHEN cause_traces = 0 OR effect_traces = 0 THEN 0 ELSE (confidence * 0.45::DOUBLE + least(lift, 5) / 5.0::DOUBLE * 0.25::DOUBLE + {pattern} + iscore * 0.1::DOUBLE) * CASE WHEN both_n < 2 THEN greatest(0, 1 - both_n / 2.0::DOUBLE * 0.5::DOUBLE) ELSE 1 END END * 100, 1))) AS confidence_score,
  both_n AS co_occurrence_traces, total AS total_traces, round(coalesce(avg_ms, 0), 1) AS avg_time_interval_ms, round(coalesce(std_ms, 0), 1) AS std_time_interval_ms, cause_traces - both_n AS cause_only_traces, effect_traces - both_n AS effect_only_traces, round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 4) AS lift FROM scored"""


_SCORED = f"""scored AS (SELECT c.*, avg_ms, std_ms, {_ISCORE.replace('n_gaps < 2', 'coalesce(n_gaps, 0) < 2')} AS iscore, both_n / total::DOUBLE AS support, both_n / cause_traces::DOUBLE AS confidence, (both_n / total::DOUBLE) / ((cause_traces / total::DOUBLE) * (effect_traces / total::DOUBLE)) AS lift"""
_PSCORE = "coalesce(least(pc * 0.3::DOUBLE + least(pl, 5) * 0.1::DOUBLE, 0.4::DOUBLE), 0)"
_W, _S = int(WINDOW * 1e6), int(SLIDE * 1e6)
_TICKS = f"""{_LOG}, rt AS (SELECT trace_id, event_key, us, row_number() OVER (PARTITION BY trace_id ORDER BY arrival) AS pos FROM log),
born AS (SELECT trace_id, us AS first FROM rt WHERE pos = 1),
grid AS (SELECT unnest(range((SELECT min(us) // {_S} * {_S} FROM log), (SELECT max(us) + {_W + _S} FROM log), {_S})) AS tick),
alive AS (SELECT trace_id, tick FROM born JOIN grid ON tick BETWEEN first AND first + {_W}),
ev AS (SELECT tick, trace_id, event_key, us, pos FROM rt JOIN alive USING (trace_id) WHERE us <= tick),
tgaps AS (SELECT a.tick, a.trace_id, a.event_key AS cause, b.event_key AS effect, (b.us - a.us) / 1000.0::DOUBLE AS gap FROM ev a JOIN ev b ON a.tick = b.tick AND a.trace_id = b.trace_id WHERE a.pos < b.pos AND a.us <= b.us)"""
_RT = f"""{_TICKS},
tn AS (SELECT tick, event_key, count(DISTINCT trace_id) AS n FROM ev GROUP BY ALL), tt AS (SELECT tick, count(DISTINCT trace_id) AS total FROM ev GROUP BY ALL),
g AS (SELECT tick, cause, effect, count(DISTINCT trace_id) AS both_n, count(*) AS n_gaps, avg(gap) AS avg_ms, stddev_pop(gap) AS std_ms FROM tgaps WHERE cause <> effect GROUP BY ALL),
s AS (SELECT g.*, c.n AS ca, e.n AS ef, total, {_ISCORE} AS iscore, both_n / c.n::DOUBLE AS confidence, (both_n / total::DOUBLE) / ((c.n / total::DOUBLE) * (e.n / total::DOUBLE)) AS lift FROM g JOIN tn c ON c.tick = g.tick AND c.event_key = cause JOIN tn e ON e.tick = g.tick AND e.event_key = effect JOIN tt ON tt.tick = g.tick),
rts AS (SELECT tick, cause, effect, least(100, greatest(0, round((confidence * 0.45::DOUBLE + least(lift, 5) / 5.0::DOUBLE * 0.25::DOUBLE + 0.05::DOUBLE + iscore * 0.1::DOUBLE) * CASE WHEN both_n < 2 THEN 0.75::DOUBLE ELSE 1 END * 100, 1))) AS score, both_n AS co_occurrence, total FROM s)"""
_BASE = f"""{_RT},
b0 AS (SELECT cause, effect, tick, score, row_number() OVER w AS n, avg(score) OVER p AS m, stddev_pop(score) OVER p AS sd FROM rts
  WINDOW w AS (PARTITION BY cause, effect ORDER BY tick), p AS (PARTITION BY cause, effect ORDER BY tick ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
base AS (SELECT cause, effect, tick // 1000000 AS ts, score, n, CASE WHEN n > 10 THEN m ELSE 0 END AS baseline_mean, CASE WHEN n > 10 THEN sd ELSE 0 END AS baseline_std FROM b0)"""


def _alerts(rule: anomaly.Rule) -> str:
    """The rule as a recursion over a pair's samples, one at a time; figures are rounded as printed."""
    shown = lambda x: f"CAST(format('{{:.1f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"
    spike = f"x.mean < {rule.min_rising - 10}::DOUBLE AND x.score >= {rule.min_rising}::DOUBLE AND abs(x.score - x.mean) >= {rule.change}::DOUBLE"
    return f"""{_RT.replace("log AS (", "log AS MATERIALIZED (")},
s0 AS MATERIALIZED (SELECT cause, effect, (tick / 1e6)::DOUBLE AS ts, score, co_occurrence AS co, row_number() OVER w AS n, avg(score) OVER p AS m, stddev_pop(score) OVER p AS sd FROM rts
  WINDOW w AS (PARTITION BY cause, effect ORDER BY tick), p AS (PARTITION BY cause, effect ORDER BY tick ROWS BETWEEN {rule.baseline} PRECEDING AND 1 PRECEDING)),
samples AS MATERIALIZED (SELECT cause, effect, ts, score, co, n, CASE WHEN n > {rule.min_samples} THEN round(m, 9) ELSE 0 END AS mean, CASE WHEN n > {rule.min_samples} THEN round(sd, 9) ELSE 0 END AS std FROM s0),
fold AS (
  SELECT DISTINCT cause, effect, 0::BIGINT AS n, 0::DOUBLE AS up, 0::DOUBLE AS down, 0 AS breaches, -1e18::DOUBLE AS quiet, NULL::DOUBLE AS ts, NULL::DOUBLE AS score, NULL::BIGINT AS co, 0::DOUBLE AS mean, 0::DOUBLE AS std, false AS spike, false AS fired FROM samples
  UNION ALL
  SELECT cause, effect, n, up, down, breaches, CASE WHEN live AND breaches >= {rule.breaches} THEN ts ELSE quiet END, ts, score, co, mean, std, spike, live AND breaches >= {rule.breaches} FROM (
    SELECT *, CASE WHEN NOT live THEN was ELSE CASE WHEN spike OR (up >= {rule.threshold} AND score >= {rule.min_rising}) THEN was + 1 ELSE greatest(0, was - 1) END END AS breaches FROM (
      SELECT x.cause, x.effect, x.n, x.ts, x.score, x.co, x.mean, x.std, f.quiet, CASE WHEN f.fired THEN 0 ELSE f.breaches END AS was, {spike} AS spike,
        x.n >= {rule.min_samples} AND x.ts - f.quiet >= {rule.cooldown} AS live,
        CASE WHEN x.n >= {rule.min_samples} AND x.ts - f.quiet >= {rule.cooldown} THEN greatest(0::DOUBLE, CASE WHEN f.fired THEN 0 ELSE f.up END + (x.score - x.mean) - greatest(5::DOUBLE, 1.5::DOUBLE * x.std)) ELSE CASE WHEN f.fired THEN 0 ELSE f.up END END AS up,
        CASE WHEN x.n >= {rule.min_samples} AND x.ts - f.quiet >= {rule.cooldown} THEN greatest(0::DOUBLE, CASE WHEN f.fired THEN 0 ELSE f.down END - (x.score - x.mean) - greatest(5::DOUBLE, 1.5::DOUBLE * x.std)) ELSE CASE WHEN f.fired THEN 0 ELSE f.down END END AS down
      FROM fold f JOIN samples x ON x.cause = f.cause AND x.effect = f.effect AND x.n = f.n + 1))),
found AS (SELECT 'alert_' || CAST(ts AS BIGINT) || '_' || cause || '_' || effect AS alert_id, ts AS "timestamp", cause, effect, {shown("mean")} AS old_score, {shown("score")} AS new_score, {shown("abs(score - mean)")} AS change_magnitude,
  CASE WHEN spike THEN 'spike' ELSE 'cusum' END AS alert_type,
  cause || ' -> ' || effect || ': score ' || CASE WHEN spike THEN format('rose from {{:.1f}} to {{:.1f}}, by {{:.1f}}', mean, score, abs(score - mean)) ELSE format('stayed high for {{}} samples, now {{:.1f}} over a baseline of {{:.1f}}', breaches, score, mean) END AS message,
  {shown("mean")} AS baseline_mean, {shown("std")} AS baseline_std, {shown("up")} AS cusum_pos, {shown("down")} AS cusum_neg, breaches AS consec_breaches, co AS current_co_occurrence FROM fold WHERE fired)"""


def oracle_sql() -> dict[str, str]:
    cont = "cause_traces - both_n AS cause_only, effect_traces - both_n AS effect_only"
    out = {
        "log_normalise": f"WITH {_LOG} SELECT trace_id, event_key || ': m' AS event_key, us FROM log",
        "event_stats": f"WITH {_SEQ} SELECT event_key, count(*) AS n_events, count(DISTINCT trace_id) AS n_traces, round(count(DISTINCT trace_id) / (SELECT total FROM total)::DOUBLE * 100, 4) AS coverage_pct FROM log GROUP BY event_key",
        "log_stats": f"WITH {_SEQ} SELECT (SELECT count(*) FROM log) AS n_lines, total AS n_traces, (SELECT count(*) FROM n) AS n_keys, (SELECT count(*) FROM (SELECT DISTINCT a.event_key, b.event_key AS x FROM seq a JOIN seq b USING (trace_id) WHERE a.pos < b.pos)) AS n_edges FROM total",
        "trace_stats": f"WITH {_LOG} SELECT trace_id, count(*) AS n_events, count(DISTINCT event_key) AS n_keys, min(us) AS first_us, max(us) AS last_us FROM log GROUP BY trace_id",
        "edge_stats_all_pairs": f"WITH {_SEQ} SELECT a.event_key AS cause, b.event_key AS effect, count(DISTINCT a.trace_id) AS n_traces, count(*) AS n_pairs, round(avg((b.us - a.us) / 1000.0::DOUBLE), 2) AS avg_ms, round(stddev_pop((b.us - a.us) / 1000.0::DOUBLE), 2) AS std_ms FROM seq a JOIN seq b USING (trace_id) WHERE a.pos < b.pos GROUP BY ALL",
        "ext_sorted": f"WITH {_LOG} SELECT trace_id, event_key, us, arrival FROM log ORDER BY trace_id, us, arrival",
        "pair_contingency": f"WITH {_SEQ}, {_BOTH} SELECT cause, effect, total, cause_traces, effect_traces, both_n AS both, {cont} FROM counts",
        "pair_metrics": f"WITH {_SEQ}, {_BOTH} SELECT cause, effect, round(both_n / total::DOUBLE, 4) AS support, round(both_n / cause_traces::DOUBLE, 4) AS confidence, round((both_n / total::DOUBLE) / ((cause_traces / total::DOUBLE) * (effect_traces / total::DOUBLE)), 4) AS lift FROM counts",
        "item_tail_support": f"WITH {_SEQ} SELECT event_key, tail_support FROM tails",
        "pattern_len2": f"WITH {_SEQ}, {_patterns(2)} SELECT pattern[1] AS cause, pattern[2] AS effect, support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM pat WHERE len(pattern) = 2",
        "mine_patterns": f"WITH {_SEQ}, {_PATTERNS} SELECT array_to_string(pattern, ' > ') AS pattern, support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM pat",
        "mine_conversations": "WITH c AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS trace_id, role AS event_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS len FROM conversations), " + _levels("c") + " SELECT array_to_string(pattern, ' > ') AS pattern, support FROM sup",
        "top_pairs": f"WITH {_SEQ}, {_levels(n=2)}, p AS (SELECT s.pattern[1] AS cause, s.pattern[2] AS effect, s.support, s.support / c.tail_support::DOUBLE AS confidence, (s.support / total::DOUBLE) / ((c.tail_support / total::DOUBLE) * (e.tail_support / total::DOUBLE)) AS lift FROM sup s JOIN tails c ON c.event_key = s.pattern[1] JOIN tails e ON e.event_key = s.pattern[2], total WHERE len(s.pattern) = 2) SELECT cause, effect, round((confidence * 0.5::DOUBLE + least(lift, 5) / 5 * 0.3::DOUBLE + least(support, 100) / 100.0::DOUBLE * 0.2::DOUBLE) * 100, 1) AS score, support, round(confidence, 4) AS confidence, round(lift, 4) AS lift FROM p ORDER BY score DESC, support DESC, confidence DESC, cause, effect LIMIT 20",
        "ngram_counts": f"WITH {_SEQ}, {_NGRAMS} SELECT array_to_string(pattern, ' > ') AS pattern, n FROM grams",
        "heavy_hitters": f"WITH {_SEQ}, {_NGRAMS} SELECT array_to_string(pattern, ' > ') AS pattern, n FROM grams ORDER BY n DESC, grams.pattern LIMIT 50",
        "sketch_hitters": f"WITH {_LOG} SELECT event_key, count(*) AS n FROM log GROUP BY event_key ORDER BY n DESC LIMIT 10",
        "infer_mem": f"WITH {_SEQ}, {_BOTH}, {_GAPS['mem']}, {_STATS}, {_PATTERNS}, {_PAIRED.format('pat')}, {_BEST.format('support', 'paired')}, {_SCORED}, pc, pl FROM counts c LEFT JOIN stats USING (cause, effect) LEFT JOIN best USING (cause, effect)) {_score(_PSCORE)}",
        "infer_ext": f"WITH {_SEQ}, {_BOTH}, {_GAPS['ext']}, {_STATS}, {_NGRAMS}, {_EVIDENCE}, {_BEST.format('support', 'ev')}, {_SCORED}, pc, pl FROM counts c LEFT JOIN stats USING (cause, effect) LEFT JOIN best USING (cause, effect)) {_score(_PSCORE)}",
        "infer_rt": f"WITH {_SEQ}, {_GAPS['rt']}, {_STATS}, counts AS (SELECT cause, effect, total, c.n AS cause_traces, e.n AS effect_traces, n_traces AS both_n FROM stats JOIN n c ON c.event_key = cause JOIN n e ON e.event_key = effect, total WHERE cause <> effect), {_SCORED} FROM counts c LEFT JOIN stats USING (cause, effect)) {_score('0.05::DOUBLE')}",
        "window_snapshot": f"WITH {_TICKS} SELECT e.tick, e.total_traces, e.total_events, e.unique_event_types, coalesce(p.pair_count, 0) AS pair_count FROM (SELECT tick, count(DISTINCT trace_id) AS total_traces, count(*) AS total_events, count(DISTINCT event_key) AS unique_event_types FROM ev GROUP BY ALL) e LEFT JOIN (SELECT tick, count(DISTINCT (cause, effect)) AS pair_count FROM tgaps GROUP BY ALL) p USING (tick)",
        "rt_scores": f"WITH {_RT} SELECT * FROM rts",
        "score_baseline": f"WITH {_BASE} SELECT cause, effect, ts, score, n, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std FROM base",
        "cusum_noreset": f"WITH {_BASE}, r AS (SELECT *, score - baseline_mean - greatest(5, 1.5::DOUBLE * baseline_std) AS p, baseline_mean - score - greatest(5, 1.5::DOUBLE * baseline_std) AS m FROM base WHERE n >= 10), c AS (SELECT cause, effect, ts, sum(p) OVER w AS cp, sum(m) OVER w AS cm FROM r WINDOW w AS (PARTITION BY cause, effect ORDER BY ts)) SELECT cause, effect, ts, round(cp - least(0, min(cp) OVER w), 3) AS cusum_pos, round(cm - least(0, min(cm) OVER w), 3) AS cusum_neg FROM c WINDOW w AS (PARTITION BY cause, effect ORDER BY ts)",
        "active_traces": f"WITH {_LOG}, now AS (SELECT max(us) AS t FROM log), p AS (SELECT trace_id, arg_min(us, arrival) AS first_us, arg_max(us, arrival) AS last_us, count(*) AS n_events FROM log GROUP BY ALL) SELECT trace_id, first_us, last_us, n_events, last_us < t - 30000000 AS completed FROM p, now WHERE first_us >= t - {_W}",
    }
    for name, rule, tail in (("alerts", EVENTS_RULE, ""), ("lasting_alerts", LASTING_RULE, ""), ("recent_alerts", EVENTS_RULE, ' ORDER BY "timestamp" DESC, alert_id DESC LIMIT 10')):
        out[name] = f"WITH RECURSIVE {_alerts(rule)} SELECT * FROM found{tail}"
    score = "confidence_score"
    out["score_levels"] = f"SELECT cause, effect, CASE WHEN {score} >= 80 THEN 'high' WHEN {score} >= 50 THEN 'medium' ELSE 'low' END AS level, rpad(repeat('#', CAST(trunc({score} * 40 / 100) AS INTEGER)), 40, '-') AS bar FROM ({out['infer_ext']})"
    out["top_events"] = out["event_stats"] + " ORDER BY n_events DESC, event_key LIMIT 10"
    for m in ("mem", "ext", "rt"):
        out[f"interval_{m}"] = f"WITH {_SEQ}, {_GAPS[m]}, {_STATS} SELECT cause, effect, n_traces, n_gaps, round(avg_ms, 1) AS avg_ms, round(std_ms, 1) AS std_ms, round({_ISCORE}, 4) AS interval_score FROM stats"
    return out

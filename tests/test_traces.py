"""Scripted logs with known results, and brute-force models of the rules."""

import itertools
import json
import math
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from traceloom.operators import anomaly, pairs, patterns, traces, window
from traceloom.plans.infer import infer, infer_pairs
from traceloom.sources import logs

MINI = {
    "t01": "1.0A 1.2B 1.5C", "t02": "2.0B 2.1A 2.4B 2.6C", "t03": "3.0A 3.0B 3.1C", "t04": "4.0A 4.2C", "t05": "5.0B 5.3A 5.5C",
    "t06": "6.0C 6.5B", "t07": "7.0A 7.3B", "t08": "8.4B 8.0A 8.9C", "t09": "9.0A 9.1B 9.2A 9.4B 9.5C", "t10": "10.0B 10.0A 10.1C",
}


def make(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, event_key string, us long, arrival long, span_id string")


@pytest.fixture(scope="module")
def mini(spark):
    rows, n = [], 0
    for trace, text in MINI.items():
        for i, part in enumerate(text.split()):
            n += 1
            span = f"s{2 - i}" if trace == "t10" and i < 2 else f"s{i + 1}"
            rows.append((trace, part[-1], round(float(part[:-1]) * 1e6), n, span))
    return make(spark, rows)


@pytest.mark.parametrize(
    "mode, score, both, support, confidence, lift, avg, std",
    [("mem", 77.5, 8, 0.8, 0.8889, 0.9877, 216.7, 134.4), ("ext", 92.0, 8, 0.8, 0.8889, 0.9877, 166.7, 149.1), ("rt", 41.1, 5, 0.5, 0.5556, 0.6173, 214.3, 124.5)],
)
def test_mini_log(mini, mode, score, both, support, confidence, lift, avg, std):
    for row in (infer(mini, "A", "B", mode).first(), infer_pairs(mini, mode).where("cause = 'A' and effect = 'B'").first()):
        got = (row.confidence_score, row.co_occurrence_traces, row.support, row.confidence, row.lift, row.avg_time_interval_ms, row.std_time_interval_ms)
        assert got == (score, both, support, confidence, lift, avg, std)
        assert row.total_traces == 10 and row.explanation


def test_mini_patterns_and_top_pairs(mini):
    seq = traces.sequence(mini)
    got = {"".join(r.pattern): r.support for r in patterns.tail_supports(seq, 2).collect()}
    assert got == {"A": 9, "B": 7, "AB": 5, "BA": 4, "BAB": 2, "BB": 2}
    cut = {"".join(r.pattern): r.support for r in patterns.tail_supports(seq, 2, cause="A").collect()}
    assert cut["AB"] == 5 and cut["BAB"] == 2
    assert [(r.cause, r.effect, r.score) for r in patterns.top_pairs(seq).collect()] == [("A", "B", 33.5), ("B", "A", 33.2), ("B", "B", 17.1)]


def test_pair_that_never_occurs(mini):
    row = infer(mini, "X", "B").first()
    assert row.confidence_score == 0 and row.co_occurrence_traces == 0 and "No link" in row.explanation


def brute_tail(trace, pattern):
    at = -1
    for item in pattern:
        at = next((i for i in range(at + 1, len(trace)) if trace[i] == item), None)
        if at is None:
            return False
    return at < len(trace) - 1


def half_up(x, digits="0.01"):
    """As Spark rounds: the printed decimal, ties away from zero."""
    return float(Decimal(repr(float(x))).quantize(Decimal(digits), ROUND_HALF_UP))


def test_gaps_of_days_keep_their_deviation(spark):
    """Gaps of a day, half of them 0.25 ms longer and half shorter: the squares' difference would be lost in doubles."""
    day = 86_400_000_000
    rows = [(f"t{i}", k, t, j, "") for i in range(40) for j, (k, t) in enumerate([("A", 0), ("B", day + (250 if i % 2 else -250))])]
    log = make(spark, rows)
    for mode in ("mem", "ext", "rt"):
        row = pairs.interval_stats(pairs.GAPS[mode](traces.sequence(log, mode)).where("cause = 'A' and effect = 'B'")).first()
        assert (row.n_traces, row.n_gaps, row.avg_ms) == (40, 40, 86_400_000.0) and row.std_ms == pytest.approx(0.25)
    edge = traces.edge_stats(traces.sequence(log)).first()
    assert (edge.n_pairs, edge.avg_ms, edge.std_ms) == (40, 86_400_000.0, 0.25)
    wide = make(spark, [("t", "A", 0, 0, ""), ("t", "B", 10**15, 1, ""), ("u", "A", 0, 2, ""), ("u", "B", 10**15 + 2, 3, "")])
    assert traces.edge_stats(traces.sequence(wide)).first().std_ms == 0.0  # one microsecond


def test_sketch_estimates(spark):
    items = spark.createDataFrame([("a",)] * 50 + [("b",)] * 7, "k string")
    assert patterns.estimate(patterns.count_min(items, "k"), ["a", "b", "c"]) == {"a": 50, "b": 7, "c": 0}


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12))
def test_mining_and_ngrams_by_brute_force(spark, seqs):
    log = make(spark, [(str(i), k, j * 1000, j, "") for i, s in enumerate(seqs) for j, k in enumerate(s)])
    seq = traces.sequence(log)
    want = {}
    for n in range(1, 5):
        for p in itertools.product("abc", repeat=n):
            if (c := sum(brute_tail(s, p) for s in seqs)) >= 2:
                want["".join(p)] = c
    assert {"".join(r.pattern): r.support for r in patterns.tail_supports(seq, 2, 4).collect()} == want
    grams = Counter(s[i : i + n] for s in seqs for n in range(2, 9) for i in range(len(s) - n + 1))
    assert {"".join(r.pattern): r.n for r in patterns.ngrams(seq).collect()} == dict(grams)
    edges = defaultdict(list)
    for s in seqs:
        for i, j in itertools.combinations(range(len(s)), 2):
            edges[s[i], s[j]].append(j - i)
    got = {(r.cause, r.effect): (r.n_pairs, r.avg_ms, r.std_ms) for r in traces.edge_stats(seq).collect()}
    assert got == {k: (len(v), half_up(np.mean(v)), half_up(np.std(v))) for k, v in edges.items()}


def test_registered_queries_mine_to_ten(spark, tmp_path):
    """Registered patterns of every length up to ten, against all subsequences."""
    from traceloom import catalog

    seqs = ["abcdefghijkl", "abcdefghijklx", "abcabcab", "abcabcabc", "dcba"]
    want = Counter(q for s in seqs for q in {"".join(c) for n in range(1, 11) for c in itertools.combinations(s, n)} if brute_tail(s, q))
    want = {" > ".join(q): c for q, c in want.items() if c >= 2}
    assert max(map(len, want)) == 37
    talk = [(i, j, k, "") for i, s in enumerate(seqs) for j, k in enumerate(s)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    events = spark.createDataFrame([(n, i, k, 1_700_000_000 + j) for n, (i, j, k, _) in enumerate(talk)], "event_id long, user_id long, event_type string, t long")
    events.selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(t) ts").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.pattern: r.support for r in catalog.mine_conversations(spark, str(tmp_path)).collect()} == want
    found = {r.pattern: (r.support, r.confidence) for r in catalog.mine_patterns(spark, str(tmp_path)).collect()}
    assert found == {q: (c, round(c / want[q[:-4]], 6)) for q, c in want.items() if len(q) > 1}


def test_live_window_script(spark):
    rows = [(f"t{i % 20}", "D" if i % 3 == 0 else "H", 1_000_000_000 + i * 10_000, i, "") for i in range(100)]
    log = make(spark, rows)
    now = 1_000_000_000 + 990_000
    assert window.active_traces(log, now).count() == 20
    gaps = pairs.interval_stats(pairs.gaps_rt(window.snapshot(log, now)))
    by = {(r.cause, r.effect): r for r in gaps.collect()}
    assert {k: r.n_traces for k, r in by.items()} == {("D", "H"): 20, ("D", "D"): 14, ("H", "H"): 20, ("H", "D"): 20}
    assert (by["D", "H"].n_gaps, round(by["D", "H"].avg_ms, 2), round(by["D", "H"].std_ms, 2)) == (54, 351.85, 196.02)


@pytest.mark.parametrize(
    "scores, want",
    [
        ([20] * 12 + [90] * 30, [(15, "spike", 30.0, 90.0, 60.0, 129.9), (29, "spike", 60.0, 90.0, 30.0, 0.0)]),
        ([55] * 12 + [85] * 30, [(15, "cusum", 59.3, 85.0, 25.7, 90.7)]),
        ([20] * 9 + [90] + [20] * 3 + [90] * 4, [(16, "spike", 34.0, 90.0, 56.0, 73.9)]),
    ],
)
def test_detector_series(spark, scores, want):
    m, got = anomaly.Monitor("a", "b"), []
    for n, s in enumerate(scores, 1):
        if a := anomaly.Monitor.load(m.dump()) and m.add(5.0 * n, s, 1, anomaly.Rule()):
            got.append((n, a["alert_type"], a["old_score"], a["new_score"], a["change_magnitude"], round(a["details"]["cusum_pos"], 1)))
    assert got == want
    samples = spark.createDataFrame([(5.0 * n, "a", "b", float(s), 1) for n, s in enumerate(scores, 1)], "ts double, cause string, effect string, score double, co_occurrence long")
    batch = anomaly.detect(samples).collect()
    assert sorted((round(r.timestamp / 5), r.alert_type) for r in batch) == [(g[0], g[1]) for g in got]
    assert [r.alert_id for r in anomaly.recent_alerts(anomaly.detect(samples), 5).collect()] == [r.alert_id for r in sorted(batch, key=lambda r: r.timestamp)]


def test_parse_corner_cases(spark):
    good = {"timestamp": 1.5, "trace_id": "t", "event_type": "a", "message": "m"}
    lines = ["", "  ", "{bad", "[1]", "42", '{"timestamp":null}', '{"timestamp":"x"}', json.dumps(good), json.dumps(good | {"timestamp": "2.5", "extra": [1]}), '{"event_type":"b"}', '{"timestamp":3,"trace_id":null,"message":"q"}', '{"timestamp":4,"trace_id":7}']
    rows = logs.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("timestamp").collect()
    assert [(r.timestamp, r.trace_id, r.event_key) for r in rows] == [(0.0, "", "b: "), (1.5, "t", "a: m"), (2.5, "t", "a: m"), (3.0, "None", ": q"), (4.0, "7", ": ")]


def test_generated_log_shows_planted_pairs(spark):
    a, b = logs.generate(spark, 200), logs.generate(spark, 200)
    assert a.exceptAll(b).count() == 0
    log = logs.parse_lines(logs.json_lines(a)).withColumn("arrival", logs.F.monotonically_increasing_id())
    cause, effect, *_ = logs.PLANTED[1]
    row = infer(logs.traced(log), cause, effect, max_len=2).first()
    assert row.confidence > 0.75 and row.lift > 2 and row.confidence_score > 50


def test_live_gaps_of_a_long_trace_and_of_mixed_arrivals(spark):
    """One trace of 20,000 events, whose 200 million pairs are not listed; and arrivals out of order, against the listed pairs."""
    n = 20_000
    long = spark.range(n).selectExpr("'t' trace_id", "if(id % 2 = 0, 'A', 'B') event_key", "id * 1000 us", "id arrival", "'' span_id")
    got = {(r.cause, r.effect): r for r in pairs.live_stats(traces.sequence(long, "rt")).collect()}
    h = n // 2
    assert got["A", "B"].n_gaps == h * (h + 1) // 2 and got["B", "A"].n_gaps == got["A", "A"].n_gaps == h * (h - 1) // 2
    odd = np.arange(1, n, 2)
    many = (n - odd + 1) // 2  # gaps of 1, 3, 5, ... ms
    mean = (odd * many).sum() / many.sum()
    assert got["A", "B"].avg_ms == pytest.approx(mean) and got["A", "B"].std_ms == pytest.approx(math.sqrt((many * (odd - mean) ** 2).sum() / many.sum()))
    rng = np.random.default_rng(8)
    rows = [(f"t{i % 9}", "ABC"[rng.integers(3)], int(rng.integers(0, 50) * 250 + i * (100 if i % 9 < 5 else 20_000)), i, "") for i in range(220)]
    seq = traces.sequence(make(spark, rows), "rt")
    shown = lambda df: {(r.cause, r.effect): (r.n_traces, r.n_gaps, round(r.avg_ms, 6), round(r.std_ms, 6)) for r in df.collect()}
    assert shown(pairs.live_stats(seq)) == shown(pairs.interval_stats(pairs.gaps_rt(seq)))

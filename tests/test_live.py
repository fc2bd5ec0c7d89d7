"""The live engine, its server and clients, and the command line."""

import json
import urllib.error
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from traceloom import cli
from traceloom.operators import anomaly, window
from traceloom.plans.infer import infer
from traceloom.sources import logs
from traceloom.streaming.realtime import Engine, detect_stream, event_windows
from traceloom.streaming.server import Api, BadRequest, drop, serve
from traceloom.streaming.storage import Files
from traceloom.streaming.websocket import LARGEST, connect, xor


def event(ts, trace, message):
    return {"timestamp": ts, "trace_id": trace, "event_type": "e", "message": message}


def lines(spark, events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "value string")


def test_engine_replays_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    log = [event(100.0 + i * 0.1, f"t{i % 30}", "c" if i < 30 else "f") for i in range(55)]
    (src / "a.json").write_text("\n".join(map(json.dumps, log[:30])))
    (src / "b.json").write_text(json.dumps(log[30:]))
    engine = Engine(spark, str(tmp_path / "state"), window_s=200, min_support=3)
    engine.watch("e: c", "e: f")
    engine.start(str(src), once=True).awaitTermination()
    got = engine.query("e: c", "e: f")
    assert (got["co_occurrence_traces"], got["total_traces"], got["confidence"], got["mode"]) == (25, 30, 0.8333, "real-time")
    stats = engine.stats()
    assert (stats["total_events"], stats["pair_count"]) == (55, 1) and engine.health()["ingest_events"] == 55
    assert engine.pair_state("e: c", "e: f")["samples_collected"] == 2  # at 100 and 105 seconds
    again = Engine(spark, str(tmp_path / "state"))
    assert (again.window_s, again.min_support) == (200, 3)
    assert engine.unwatch("e: c", "e: f") and engine.watched() == [] and engine.alerts().count() == 0
    assert engine.pair_state("e: c", "e: f")["watched"] is False and engine.pair_state("x", "y") is None


def test_expired_events_leave_the_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), window_s=10)
    for b in range(4):
        engine.process(lines(spark, [event(100.0 * b + i, f"t{i}", "c") for i in range(20)]), b)
        assert engine.events().count() == 11 and engine.stats()["total_events"] == 11  # 9 to 19 seconds after the start
    engine.process(lines(spark, [event(310.0, "t3", "late"), event(318.0, "t3", "later"), event(5.0, "t4", "old")]), 4)
    rows = {(r.trace_id, r.event_key) for r in engine.events().collect()}
    assert ("t3", "e: late") in rows and ("t3", "e: later") in rows and ("t4", "e: old") not in rows  # t3 begins anew
    before = engine.state()
    engine.process(lines(spark, [event(900.0, "x", "y")]), 4)  # a batch that runs again changes nothing
    assert engine.state() == before
    assert len(Files(spark, str(tmp_path)).names("events")) == 2


def test_samples_stand_on_the_grid_and_equal_single_queries(spark, tmp_path):
    rng = np.random.default_rng(3)
    times = np.sort(rng.random(160) * 60)
    log = [event(float(t), f"t{rng.integers(25)}", "abc"[rng.integers(3)]) for t in times]
    frame = logs.parse_lines(lines(spark, log).withColumn("arrival", logs.F.monotonically_increasing_id()))
    pairs = [("e: a", "e: b"), ("e: b", "e: a"), ("e: c", "e: never")]
    got = {(r.ts, r.cause, r.effect): (r.score, r.co_occurrence) for r in window.pair_samples(frame, pairs, 0, 60_000_000, 20.0, 20.0).collect()}
    assert len(got) == 4 * 3
    for ts in (20.0, 60.0):
        now = int(ts * 1e6)
        own = window.snapshot(frame, now, 20.0).withColumn("arrival", logs.F.col("pos"))
        for c, e in pairs:
            row = infer(own, c, e, "rt").first()
            assert got[ts, c, e] == (row.confidence_score, row.co_occurrence_traces)
    engine = Engine(spark, str(tmp_path), window_s=20, sample_s=20)
    for p in pairs:
        engine.watch(*p)
    engine.process(lines(spark, log), 0)  # one batch of a minute: a sample at every tick
    for c, e in pairs:
        assert engine.pair_state(c, e)["recent_scores"] == [got[t, c, e][0] for t in (20.0, 40.0)][: engine.pair_state(c, e)["samples_collected"]]
        assert engine.pair_state(c, e)["recent_timestamps"] == [20.0, 40.0]


def test_alerts_reach_the_sink_and_late_callbacks(spark, tmp_path):
    said = []
    rule = anomaly.Rule(min_samples=2, threshold=5, min_rising=40, change=10, breaches=1, cooldown=5)
    engine = Engine(spark, str(tmp_path), window_s=50, rule=rule, sample_s=5, on_alert=said.append)
    engine.watch("e: c", "e: f")
    quiet = [event(i * 1.0, f"q{i}", "c") for i in range(30)] + [event(0.5, "z", "f")]
    engine.process(lines(spark, quiet), 0)
    engine.process(lines(spark, [e for i in range(30) for e in (event(31.0 + i, f"l{i}", "c"), event(31.2 + i, f"l{i}", "f"))]), 1)
    found = engine.alerts().collect()
    assert found and [a["alert_id"] for a in said] == [r.alert_id for r in sorted(found, key=lambda r: r.timestamp)]
    engine.files.put_json("state.json", engine.state() | {"undelivered": said[:1]})  # a driver lost before its callbacks
    engine.process(lines(spark, []), 1)
    assert len(said) == len(found) + 1 and engine.state()["undelivered"] == []


def test_stream_detector_equals_the_batch_fold(spark, tmp_path):
    scores = [20] * 12 + [90] * 30
    rows = [(5.0 * n, "a", c, float(s), 1) for c in "bc" for n, s in enumerate(scores, 1)]
    schema = "ts double, cause string, effect string, score double, co_occurrence long"
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[0] // 75 == i], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = detect_stream(stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination()
    got = sorted((r.effect, r.timestamp, r.alert_type) for r in spark.table("found").collect())
    want = sorted((r.effect, r.timestamp, r.alert_type) for r in anomaly.detect(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(got) == 4


def test_watermarked_windows(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    frame = spark.createDataFrame([(at + timedelta(seconds=s), "k") for s in (0, 30, 90, 2000)], "ts timestamp, event_key string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = event_windows(stream, "1 minute", "1 minute", "1 minute").writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("wins").collect()) == [1, 2]  # the last window is still open


def test_http_routes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    server = serve(engine, str(tmp_path / "in"), port=0)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    at = cli.Remote(base)
    pair = {"cause": "e: c", "effect": "e: f"}
    try:
        assert at.call("POST", "/api/watch", pair) == {"status": "ok", **pair, "watched": True}
        assert at.call("GET", "/api/watch") == {"count": 1, "pairs": [pair]}
        assert at.call("POST", "/api/ingest", [event(100.0, "t", "c"), event(100.2, "t", "f"), 7])["events"] == 2
        assert at.call("POST", "/api/ingest", 7)["events"] == 0
        engine.start(str(tmp_path / "in"), once=True).awaitTermination()
        assert at.call("POST", "/api/query", pair)["co_occurrence_traces"] == 1
        assert at.call("GET", "/api/health")["engine"]["total_traces"] == at.call("GET", "/api/stats")["total_traces"] == 1
        assert at.call("GET", "/api/pair_state?cause=e:%20c&effect=e:%20f")["samples_collected"] == 1
        assert at.call("GET", "/api/alerts?limit=5") == {"count": 0, "alerts": []}
        assert at.call("DELETE", "/api/watch", pair)["watched"] is False
        for method, url, body, status in (("GET", "/api/pair_state?cause=x&effect=y", None, 404), ("GET", "/api/alerts?limit=0", None, 422), ("POST", "/api/query", {"cause": "x"}, 422), ("GET", "/nothing", None, 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                at.call(method, url, body)
            assert e.value.code == status and "error" in json.loads(e.value.read())
        assert cli.main(["rt-query", "-s", base, "--cause", "e: c", "--effect", "e: f"]) == 0
        assert cli.main(["watch", "-s", base, "--list"]) == 0
    finally:
        server.shutdown()
    assert cli.main(["rt-query", "-s", "http://127.0.0.1:9", "--cause", "a", "--effect", "b", "--json"]) == 15
    with pytest.raises(BadRequest):
        Api(engine, str(tmp_path / "in")).call("POST", "/api/watch", "[]")


def test_sockets(spark, tmp_path):
    mine = []
    engine = Engine(spark, str(tmp_path / "state"), on_alert=mine.append, sample_s=3600.0)
    server = serve(engine, str(tmp_path / "in"), port=0)
    base = f"ws://127.0.0.1:{server.server_address[1]}"
    pair = {"cause": "e: c", "effect": "e: f"}
    take = lambda s: json.loads(s.receive())
    alerts, sender = connect(f"{base}/ws/alerts"), connect(f"{base}/ws/ingest")
    try:
        assert take(alerts)["type"] == take(sender)["type"] == "welcome"
        alerts.send(json.dumps({"action": "watch", **pair}))
        assert take(alerts) == {"type": "watch_ack", **pair, "watched": True} and engine.watched() == [["e: c", "e: f"]]
        for odd in ("{bad", "[1]", '{"action": "watch", "cause": 1, "effect": "x"}', '{"action": "none"}', "null"):
            alerts.send(odd)  # ignored
        alerts.send(json.dumps({"action": "unwatch", **pair}))
        assert take(alerts) == {"type": "unwatch_ack", **pair, "watched": False} and engine.watched() == []
        alerts.send(json.dumps({"action": "ping"}))
        assert take(alerts)["type"] == "pong"
        health = cli.Remote(f"{base}/ws/ingest").call("GET", "/api/health")
        assert health["ingest_clients"] == health["alert_clients"] == 1
        sender.send("{bad")
        assert take(sender) == {"type": "error", "message": "Invalid JSON payload"}
        sender.send(json.dumps([event(100.0, "t", "c"), 7, event(100.2, "t", "f")]))
        sender.send("3")
        half = json.dumps(event(100.4, "ü" * 70_000, "c")).encode()  # a long message, in two frames with a ping between
        sender._put(9, b"here")
        for first, data in ((0x01, half[:130]), (0x89, b"?"), (0x80, half[130:])):
            key, n = b"abcd", len(data)
            size = bytes([0x80 | n]) if n < 126 else b"\xfe" + n.to_bytes(2, "big") if n < 1 << 16 else b"\xff" + n.to_bytes(8, "big")
            sender.write(bytes([first]) + size + key + xor(data, key))
        sender.send("{bad")
        assert take(sender)["type"] == "error"  # all before it has been taken
        engine.on_alert({"alert_id": "x", "message": "ä"})
        assert take(alerts) == {"type": "alert", "data": {"alert_id": "x", "message": "ä"}} and mine == [{"alert_id": "x", "message": "ä"}]
        for first in (b"\x82\x80abcd", b"\x81\x01x", b"\x80\x80abcd", b"\x81\xff" + (LARGEST + 1).to_bytes(8, "big"), b"\x81\x81\0\0\0\0\xff"):
            wrong = connect(f"{base}/ws/ingest")
            take(wrong)
            wrong.write(first)  # binary, not masked, continues nothing, too large, no UTF-8
            assert wrong.receive() is None and not wrong.open
        with pytest.raises(ConnectionError):
            connect(f"{base}/ws/nothing")
        assert cli.main(["push", "-n", "4", "-i", "0", "-s", base]) == 0
        sender.finish()
    finally:
        server.shutdown()
    assert alerts.receive() is None and engine.on_alert == mine.append
    sent = [json.loads(x) for p in sorted((tmp_path / "in").glob("*.json")) for x in p.read_text().splitlines()]
    assert [e["timestamp"] for e in sent[:3]] == [100.0, 100.2, 100.4] and sent[2]["trace_id"] == "ü" * 70_000
    assert len({e["trace_id"] for e in sent}) == 6


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    log = tmp_path / "a.json"
    log.write_text("\n".join(json.dumps(event(100.0 - i, f"t{i % 5}", "fc"[i % 2])) for i in range(20)))
    (tmp_path / "bad.json").write_text("{bad\n[1]\n")
    (tmp_path / "free.json").write_text(json.dumps(event(1.0, "", "c")))
    run = lambda *a: cli.main(["analyze", *map(str, a)])
    assert run("-f", log, "--cause", "e: c") == 6 and run("-f", tmp_path / "none") == 2  # the file comes first in memory
    assert run("-s", "-f", tmp_path / "none") == 6 and run("-s", "-f", tmp_path / "none", "--cause", "a", "--effect", "b") == 2
    assert run("-f", tmp_path / "bad.json", "--list-pairs") == 4 and run("--log-file", tmp_path / "free.json", "--list-pairs") == 5
    assert run("-f", log, "-s", "--list-pairs") == 11
    capsys.readouterr()
    assert run("-f", log, "--list-pairs", "--top-n", 3, "--json") == 0
    assert 0 < len(json.loads(capsys.readouterr().out)) <= 3
    assert run("-f", log, "--cause", "e: c", "--effect", "e: f") == 0
    text = capsys.readouterr().out
    assert "explanation: " in text and text.startswith("[#") and text.index("]") == 41
    monkeypatch.setattr("sys.stdin", open(log))
    assert run("--cause", "e: c", "--effect", "e: f", "--json") == 0
    assert json.loads(capsys.readouterr().out)["total_traces"] == 5
    assert cli.main(["sort", "-f", str(log), "-o", str(tmp_path / "sorted")]) == 0
    rows = [json.loads(x) for p in sorted((tmp_path / "sorted").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (r["trace_id"], r["timestamp"]))
    assert cli.main(["push", "-m", "replay", "-f", str(log), "--source", str(tmp_path / "src"), "--speed", "0"]) == 0
    sent = [json.loads(x) for p in sorted((tmp_path / "src").glob("*.json")) for x in p.read_text().splitlines()]
    assert [e["timestamp"] for e in sent] == sorted(e["timestamp"] for e in sent) and len(sent) == 20
    assert cli.main(["push", "-n", "6", "-i", "0", "--anomaly-start", "3", "--source", str(tmp_path / "gen")]) == 0
    assert cli.main(["serve", "--source", str(tmp_path / "src"), "--state", str(tmp_path / "state"), "-w", "500", "--once"]) == 0
    capsys.readouterr()
    assert cli.main(["watch", "--state", str(tmp_path / "state"), "--add", "--cause", "e: c", "--effect", "e: f"]) == 0
    assert cli.main(["watch", "--state", str(tmp_path / "state"), "--add"]) == 6
    capsys.readouterr()
    assert cli.main(["rt-query", "--state", str(tmp_path / "state"), "--cause", "e: c", "--effect", "e: f", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["total_traces"] == 5


def test_anomaly_starts_at_a_trace(spark):
    rows = logs.generate(spark, 60, start_at=40).collect()
    effects = {e for _, e, *_ in logs.PLANTED} - {c for c, *_ in logs.PLANTED}
    at = {int(r.trace_id[-8:]) for r in rows if f"{r.event_type}: {r.message}" in effects}
    assert at and min(at) >= 40


def test_payloads_that_are_no_events_are_ignored(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert [drop(files, x) for x in ("", "{bad", "3", "[1, 2]", '[{"a": 1}, 4]', '{"a": 1}')] == [0, 0, 0, 0, 1, 1]
    assert len(files.names("")) == 2

"""Command line: analyze, sort, generate, push, serve, rt-query, watch.

Exit codes: 0; 2 no file; 3 run failure; 4 no valid rows; 5 no trace; 6 cause or effect missing; 11 --list-pairs with
--streaming; 15 no connection. In memory the log is looked at before the pair is asked for; with --streaming after it.
A negative --top-n counts as 0. Options of serve that are not given come from TRACELOOM_WINDOW_SECONDS,
TRACELOOM_SAMPLE_INTERVAL and TRACELOOM_MIN_SUPPORT; rt-query and watch use what serve was started with.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from traceloom import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="traceloom")
    p.add_argument("--version", action="version", version=f"traceloom {__version__}")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        own = sub.add_parser(name)
        for *names, kind in options:
            own.add_argument(*names, **(kind if isinstance(kind, dict) else {"type": kind}))

    flag, pair = {"action": "store_true"}, [("--cause", str), ("--effect", str)]
    place = [("--state", str), ("-s", "--server", str)]
    number = lambda kind, default: {"type": kind, "default": default}
    command(
        "analyze", ("-f", "--log-file", "--file", {"dest": "file"}), *pair, ("--min-support", number(int, 2)), ("--max-pattern-len", number(int, 10)),
        ("--list-pairs", flag), ("-n", "--top-n", number(int, 20)), ("--json", flag), ("-v", "--verbose", flag), ("-s", "--streaming", flag),
        ("--chunk-size", number(int, 50_000) | {"help": "accepted; Spark sorts and spills by itself"}), ("--tmp-dir", {"help": "accepted; spark.local.dir is what counts"}),
    )
    command("sort", ("-f", "--log-file", {"dest": "file"}), ("-o", "--output", {"required": True}))
    command("generate", ("-o", "--output", {"required": True}), ("-n", "--num-traces", number(int, 200)), ("--seed", number(int, 42)))
    command(
        "push", ("-s", "--server", str), ("--source", str), ("-m", "--mode", {"choices": ["generate", "replay"], "default": "generate"}), ("-f", "--file", str),
        ("-n", "--num-traces", number(int, 3000)), ("-i", "--interval", number(int, 10)), ("--speed", number(float, 10.0)),
        ("--anomaly-ratio", number(float, 0.85)), ("--anomaly-start", number(int, 1000)),
    )
    setting = lambda name, kind: {"type": kind, "default": kind(os.environ[name]) if name in os.environ else None}
    command(
        "serve", ("-H", "--host", number(str, "127.0.0.1")), ("-p", "--port", number(int, 8765)), ("--source", {"required": True}), ("--state", {"required": True}),
        ("-w", "--window-seconds", "--window", setting("TRACELOOM_WINDOW_SECONDS", float) | {"dest": "window"}),
        ("--sample-interval", setting("TRACELOOM_SAMPLE_INTERVAL", float)), ("--min-support", setting("TRACELOOM_MIN_SUPPORT", int)), ("--alert-file", str), ("--once", flag),
    )
    command("rt-query", *place, *pair, ("--json", flag), ("-v", "--verbose", flag))
    command("watch", *place, *pair, ("--add", flag), ("--remove", flag), ("--list", flag), ("--alerts", number(int, 0)), ("--follow", flag), ("-o", "--output", str))
    return p


def say(value) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False))


def spooled(path: str | None) -> tuple[str, bool]:
    """A path to read, and whether it is a copy of the standard input that is to be deleted afterwards."""
    if path is not None:
        return path, False
    with tempfile.NamedTemporaryFile("w", suffix=".jsonl", delete=False, encoding="utf-8") as f:
        f.writelines(sys.stdin)
    return f.name, True


def report(row: dict) -> str:
    """A result for people: the bar, the score and its level, then every figure."""
    shown = {k: v for k, v in row.items() if k not in ("bar", "level")}
    return f"[{row['bar']}] {row['confidence_score']} ({row['level']})\n" + "\n".join(f"{k}: {v}" for k, v in shown.items())


def with_level(found):
    from pyspark.sql import functions as F

    from traceloom.functions.scoring import bar, level

    score = F.col("confidence_score")
    return found.select("*", bar(score).alias("bar"), level(score).alias("level"))


def analyze(spark, o) -> int:
    from traceloom.operators.patterns import top_pairs
    from traceloom.operators.traces import log_stats, sequence, top_events
    from traceloom.plans.infer import infer
    from traceloom.sources.logs import read_logs, traced

    asked = bool(o.cause and o.effect)
    if o.streaming and o.list_pairs:
        return 11
    if o.streaming and not asked:
        return 6
    path, copied = spooled(o.file)
    try:
        if "://" not in path and not Path(path).exists():
            return 2
        log = read_logs(spark, path)
        if log.isEmpty():
            return 4
        own = traced(log)
        if own.isEmpty():
            return 5
        mode = "ext" if o.streaming else "mem"
        seq = sequence(own, mode)
        if o.verbose:
            say([r.asDict() for r in log_stats(seq, log).collect()] + [r.asDict() for r in top_events(own).collect()])
        if o.list_pairs:
            rows = top_pairs(seq, max(o.top_n, 0), o.min_support).select("cause", "effect", "score").collect()
            say([r.asDict() for r in rows]) if o.json else print("\n".join(f"{r['score']:6.1f}  {r['cause']} -> {r['effect']}" for r in rows))
            return 0
        if not asked:
            return 6
        row = with_level(infer(own, o.cause, o.effect, mode, o.min_support, o.max_pattern_len)).first().asDict()
        say({k: v for k, v in row.items() if k not in ("bar", "level")}) if o.json else print(report(row))
        return 0
    finally:
        if copied:
            Path(path).unlink()


def sort(spark, o) -> int:
    from traceloom.sources.logs import read_logs, write_sorted

    path, copied = spooled(o.file)
    try:
        if "://" not in path and not Path(path).exists():
            return 2
        write_sorted(read_logs(spark, path), o.output)
        return 0
    finally:
        if copied:
            Path(path).unlink()


class Remote:
    """A served engine, over HTTP."""

    def __init__(self, server: str):
        self.server = server.rstrip("/").replace("ws://", "http://").removesuffix("/ws/ingest").removesuffix("/ws/alerts")

    def call(self, method: str, url: str, body=None) -> dict:
        from urllib.request import Request, urlopen

        data = None if body is None else json.dumps(body).encode()
        with urlopen(Request(self.server + url, data=data, method=method, headers={"Content-Type": "application/json"}), timeout=600) as r:
            return json.loads(r.read())


class Local:
    """The same calls on a state folder, without a server."""

    def __init__(self, engine):
        from traceloom.streaming.server import Api

        self.api = Api(engine, f"{engine.folder}/unused-source")

    def call(self, method: str, url: str, body=None) -> dict:
        return self.api.call(method, url, "" if body is None else json.dumps(body))


def push(spark, o) -> int:
    """Send a generated log trace by trace, or a file's events by time in batches, paced; to ws:// through one socket."""
    from traceloom.sources.logs import batches, generate, parse_lines, json_lines, read_logs
    from pyspark.sql import functions as F

    from traceloom.streaming.server import drop
    from traceloom.streaming.storage import Files
    from traceloom.streaming.websocket import connect

    if o.mode == "replay" and not (o.file and ("://" in o.file or Path(o.file).exists())):
        return 2
    remote = Remote(o.server) if o.server else None
    socket = connect(f"ws://{remote.server.removeprefix('http://')}/ws/ingest") if remote and o.server.startswith("ws://") else None
    files = Files(spark, o.source) if o.source else None
    if o.mode == "replay":
        parts = batches(read_logs(spark, o.file))
    else:
        log = parse_lines(json_lines(generate(spark, o.num_traces, ratio=o.anomaly_ratio, start_at=o.anomaly_start)))
        parts = batches(log.withColumn("arrival", F.monotonically_increasing_id()))
    before = None
    for part in parts:
        if o.mode == "replay":
            pause = (part[0]["timestamp"] - before) / o.speed if before is not None and o.speed > 0 else 0.0
            before = part[0]["timestamp"]
        else:
            pause = len({e["trace_id"] for e in part}) * o.interval / 1000
        time.sleep(max(0.0, pause))
        if files:
            drop(files, json.dumps(part))
        if socket:
            socket.send(json.dumps(part))
        elif remote:
            remote.call("POST", "/api/ingest", part)
    if socket:
        socket.finish()
    return 0


def serve(spark, o) -> int:
    from traceloom.streaming.realtime import Engine
    from traceloom.streaming.server import serve as listen

    def keep(alert: dict) -> None:
        with Path(o.alert_file).open("a", encoding="utf-8") as f:
            f.write(json.dumps({k: v for k, v in alert.items() if k != "details"}, ensure_ascii=False) + "\n")

    engine = Engine(spark, o.state, o.window, o.min_support, on_alert=keep if o.alert_file else None, sample_s=o.sample_interval)
    query = engine.start(o.source, o.once, f"{engine.sample_s} seconds")
    server = None if o.once else listen(engine, o.source, o.host, o.port)
    try:
        query.awaitTermination()
    finally:
        if server:
            server.shutdown()
    return 0


def watch(at, o) -> int:
    pair = {"cause": o.cause, "effect": o.effect}
    if (o.add or o.remove) and not (o.cause and o.effect):
        return 6
    if o.add:
        say(at.call("POST", "/api/watch", pair))
    if o.remove:
        say(at.call("DELETE", "/api/watch", pair))
    if o.list:
        say(at.call("GET", "/api/watch"))
    since, known = 0.0, set()
    while o.alerts or o.follow:
        new = [a for a in at.call("GET", f"/api/alerts?limit={o.alerts or 500}&since={since}")["alerts"] if a["alert_id"] not in known]
        known |= {a["alert_id"] for a in new}
        if new:
            since = new[-1]["timestamp"]
            say(new)
        if o.output:
            with Path(o.output).open("a", encoding="utf-8") as f:
                f.writelines(json.dumps(a, ensure_ascii=False) + "\n" for a in new)
        if not o.follow:
            break
        time.sleep(2)
    return 0


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    try:
        if o.command in ("rt-query", "watch") and o.server:
            return asked(Remote(o.server), o)
        from traceloom.session import local_session

        spark = local_session()
        if o.command in ("rt-query", "watch"):
            from traceloom.streaming.realtime import Engine

            if not o.state:
                return 15
            return asked(Local(Engine(spark, o.state)), o)
        if o.command == "generate":
            from traceloom.sources.logs import generate, json_lines

            json_lines(generate(spark, o.num_traces, o.seed)).write.mode("overwrite").text(o.output)
            return 0
        return {"analyze": analyze, "sort": sort, "push": push, "serve": serve}[o.command](spark, o)
    except ConnectionError as e:
        print(f"no connection: {e}", file=sys.stderr)
        return 15
    except Exception as e:  # noqa: BLE001
        from urllib.error import HTTPError, URLError

        print(f"failed: {e}", file=sys.stderr)
        return 15 if isinstance(e, URLError) and not isinstance(e, HTTPError) else 3


def asked(at, o) -> int:
    if o.command == "watch":
        return watch(at, o)
    if not (o.cause and o.effect):
        return 6
    row = at.call("POST", "/api/query", {"cause": o.cause, "effect": o.effect})
    score = row["confidence_score"]
    level = "high" if score >= 80 else "medium" if score >= 50 else "low"
    full = min(40, max(0, int(40 * score / 100)))
    say(row) if o.json else print(report(row | {"bar": "#" * full + "-" * (40 - full), "level": level}))
    return 0


if __name__ == "__main__":
    sys.exit(main())

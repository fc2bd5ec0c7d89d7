"""The live engine on Structured Streaming: file-drop ingest, window scores, alerts.

Each micro-batch adds its events to the window's, samples the watched pairs at every tick of the sampling grid since the
last batch, feeds the samples to the detector, appends alerts to a JSON sink, and writes the events of the traces that are
still in the window as a new version of the store. Traces that expired before a batch's earliest event leave first, so a
later event of one begins it anew. State is one file, replaced last: a batch that runs again before that replaces its own output, one that
was finished is passed over. All files are written through Spark's filesystem, so the folder may be on any of them.
Callbacks get every alert once at least: what a lost driver did not deliver is delivered by the next batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from traceloom.operators.anomaly import ALERT, Monitor, Rule
from traceloom.operators.pairs import ordered_pairs
from traceloom.operators.traces import sequence
from traceloom.operators.window import pair_samples, snapshot
from traceloom.plans.infer import infer_pairs
from traceloom.sources.logs import parse_lines, traced
from traceloom.streaming.storage import Files

EVENT = "batch long, line long, trace_id string, span_id string, event_type string, message string, event_key string, us long, timestamp double"


class Engine:
    """folder holds the state; window, sampling interval and min support that are not given are those it was made with."""

    def __init__(self, spark: SparkSession, folder: str, window_s: float | None = None, min_support: int | None = None, rule: Rule | None = None, on_alert=None, sample_s: float | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        made = self.files.get_json("engine.json", {"window_s": 300.0, "min_support": 2, "sample_s": 5.0})
        given = {"window_s": window_s, "min_support": min_support, "sample_s": sample_s}
        made |= {k: v for k, v in given.items() if v is not None}
        self.window_s, self.min_support, self.sample_s = made["window_s"], made["min_support"], made["sample_s"]
        if made != self.files.get_json("engine.json", None):
            self.files.put_json("engine.json", made)
        self.rule, self.on_alert, self.began = rule or Rule(), on_alert, time.time()

    def state(self) -> dict:
        new = {"batch": -1, "now": None, "tick": None, "ingested": 0, "monitors": {}, "undelivered": []}
        return new | self.files.get_json("state.json", {})

    def watch(self, cause: str, effect: str) -> None:
        pairs = self.watched()
        if [cause, effect] not in pairs:
            self.files.put_json("watch.json", [*pairs, [cause, effect]])

    def unwatch(self, cause: str, effect: str) -> bool:
        """Stop sampling a pair; its monitor's state stays."""
        pairs = self.watched()
        self.files.put_json("watch.json", [p for p in pairs if p != [cause, effect]])
        return [cause, effect] in pairs

    def watched(self) -> list[list[str]]:
        return self.files.get_json("watch.json", [])

    def pair_state(self, cause: str, effect: str) -> dict | None:
        text = self.state()["monitors"].get(json.dumps([cause, effect]))
        watched = [cause, effect] in self.watched()
        if text is None and watched:
            text = Monitor(cause, effect).dump()
        return Monitor.load(text).state(watched) if text else None

    def events(self) -> DataFrame:
        """The stored events, in order of arrival: those of the traces in the window at the last batch's end."""
        batch = self.state()["batch"]
        if not self.files.exists(f"events/v={batch}"):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(f"{self.folder}/events/v={batch}")

    def window(self) -> DataFrame:
        """Events of the window at the newest event time, as a log in order of arrival."""
        return self.events().withColumn("arrival", F.struct("batch", "line"))

    def stats(self) -> dict:
        """Counts of the window. A pair counts if an event of the one is followed by one of the other, not earlier in time."""
        log = self.window()
        row = log.agg(F.countDistinct("trace_id"), F.count("*"), F.countDistinct("event_key")).first()
        pairs = ordered_pairs(sequence(log, "rt")).select("cause", "effect").distinct().count()
        return {"window_seconds": self.window_s, "total_traces": row[0], "total_events": row[1], "unique_event_types": row[2], "pair_count": pairs}

    def health(self) -> dict:
        """Counters since the folder was made, and the window's counts."""
        state = self.state()
        return {"status": "ok", "uptime_seconds": round(time.time() - self.began, 1), "ingest_events": state["ingested"], "batches": state["batch"] + 1, "engine": self.stats()}

    def query(self, cause: str, effect: str) -> dict:
        return infer_pairs(self.window(), "rt", self.min_support, cause=cause, effect=effect).first().asDict()

    def alerts(self) -> DataFrame:
        if not self.files.names("alerts"):
            return self.spark.createDataFrame([], ALERT)
        return self.spark.read.schema(ALERT + ", batch long").json(f"{self.folder}/alerts").drop("batch")

    def process(self, lines: DataFrame, batch: int) -> None:
        """One micro-batch; lines: a column value of JSON texts, each an event or an array of events."""
        state = self.state()
        if batch <= state["batch"]:
            return self._deliver(state)
        one = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
        parsed = traced(parse_lines(lines.select(F.explode(one).alias("value")).withColumn("line", F.monotonically_increasing_id())))
        names = [f.split()[0] for f in EVENT.split(", ")]
        new = parsed.withColumn("batch", F.lit(batch).cast("long")).select(names).cache()
        count, newest, oldest = new.agg(F.count("*"), F.max("us"), F.min("us")).first()
        stored = self.window()
        alive = stored
        if count and state["now"] is not None:
            own = snapshot(stored, max(state["now"], oldest), self.window_s).select("trace_id").distinct()
            alive = stored.join(own, "trace_id", "left_semi")
        every = alive.unionByName(new.withColumn("arrival", F.struct("batch", "line")))
        now = max(x for x in (state["now"], newest, -(1 << 62)) if x is not None)
        step = int(self.sample_s * 1e6)
        found = []
        if count or state["now"] is not None:
            first = state["tick"] + step if state["tick"] is not None else -(-oldest // step) * step
            last = now // step * step
            if first <= last:
                middle = min(max(first, -(-oldest // step) * step), last + step) if count else last + step
                found = self._sample([(stored, first, middle - step), (every, middle, last)], state)
                state["tick"] = last
            kept = snapshot(every, now, self.window_s).select("trace_id").distinct()
            every.join(kept, "trace_id", "left_semi").select(names).write.mode("overwrite").parquet(f"{self.folder}/events/v={batch}")
            state["now"] = now
        new.unpersist()
        if found:
            self.spark.createDataFrame(pd.DataFrame(found), ALERT).coalesce(1).write.mode("overwrite").json(f"{self.folder}/alerts/batch={batch}")
        before = state["batch"]
        state |= {"batch": batch, "ingested": state["ingested"] + count, "undelivered": state["undelivered"] + found}
        self.files.put_json("state.json", state)
        for name in self.files.names("events"):
            if name not in (f"v={batch}", f"v={before}"):
                self.files.delete(f"events/{name}")
        self._deliver(state)

    def _sample(self, parts: list[tuple[DataFrame, int, int]], state: dict) -> list[dict]:
        """Feed the watched pairs' samples to their monitors, all in one job; the alerts, in order of time. parts: a log and
        the first and last tick at which it is what was in the window."""
        pairs = [tuple(p) for p in self.watched()]
        if not pairs:
            return []
        known, rule = state["monitors"], self.rule

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            monitors: dict[str, Monitor] = {}
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    name = json.dumps([r.cause, r.effect])
                    if name not in monitors:
                        monitors[name] = Monitor.load(known[name]) if name in known else Monitor(r.cause, r.effect)
                    if alert := monitors[name].add(r.ts, r.score, int(r.co_occurrence), rule):
                        out.append(("", json.dumps(alert)))
                yield pd.DataFrame(out, columns=["name", "value"])
            yield pd.DataFrame([(k, m.dump()) for k, m in monitors.items()], columns=["name", "value"])

        sampled = [pair_samples(log, pairs, first, last, self.window_s, self.sample_s, self.min_support) for log, first, last in parts if first <= last]
        samples = reduce(DataFrame.union, sampled)
        rows = samples.repartition("cause", "effect").sortWithinPartitions("cause", "effect", "ts").mapInPandas(run, "name string, value string").collect()  # a row a pair, and alerts
        state["monitors"] = known | {r["name"]: r["value"] for r in rows if r["name"]}
        return sorted((json.loads(r["value"]) for r in rows if not r["name"]), key=lambda a: (a["timestamp"], a["alert_id"]))

    def _deliver(self, state: dict) -> None:
        for alert in state["undelivered"]:
            if self.on_alert:
                self.on_alert(alert)
        if state["undelivered"]:
            self.files.put_json("state.json", state | {"undelivered": []})

    def start(self, source: str, once: bool = False, every: str = "5 seconds"):
        """Run on text files dropped into `source`; once: take what is there and end."""
        Files(self.spark, source)
        lines = self.spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(source).select("value")
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def detect_stream(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Alerts of a stream of samples (ts, cause, effect, score, co_occurrence): the fold as keyed state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitor = Monitor.load(state.get[0]) if state.exists else Monitor(*key)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = [a for r in rows.itertuples(index=False) if (a := monitor.add(r.ts, r.score, int(r.co_occurrence), rule))]
        state.update((monitor.dump(),))
        if out:
            yield pd.DataFrame([a | {"details": json.dumps(a["details"])} for a in out])

    head, tail = ALERT.split("details ")
    flat = f"{head}details string, {tail.rpartition('>, ')[2]}"
    return samples.groupBy("cause", "effect").applyInPandasWithState(run, flat, "monitor string", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Watermarked counts of events a key and sliding window: (start, end, event_key, n). events: ts timestamp, event_key."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_key").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_key", "n")

"""Alerts on jumps and lasting rises of a pair's score.

Monitor is the rule as a fold over one pair's samples; batch and stream share it. Batch folds run over rows sorted by
pair and time, one at a time, so a pair's series may be of any length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALERT = "alert_id string, timestamp double, cause string, effect string, old_score double, new_score double, change_magnitude double, alert_type string, details struct<baseline_mean:double,baseline_std:double,cusum_pos:double,cusum_neg:double,consec_breaches:int,current_co_occurrence:long>, message string"


@dataclass(frozen=True)
class Rule:
    min_samples: int = 10
    threshold: float = 50.0  # of CUSUM and of a spike's change
    min_rising: float = 80.0
    cooldown: float = 60.0
    breaches: int = 3
    change: float = 30.0
    baseline: int = 60  # scores that a baseline holds
    kept: int = 120  # samples that introspection keeps


@dataclass
class Monitor:
    """One pair's state. It serialises to JSON for streaming state."""

    cause: str
    effect: str
    base: list[float] = field(default_factory=list)
    recent: list[list[float]] = field(default_factory=list)
    mean: float = 0.0
    std: float = 0.0
    up: float = 0.0
    down: float = 0.0
    count: int = 0
    last_alert: float = -1e18
    samples: int = 0

    def add(self, ts: float, score: float, co: int, rule: Rule) -> dict | None:
        """Take one sample; the alert that it raises, if any. The baseline is of earlier scores, and still zero when the
        first min_samples are full; the sample's own time counts for the cooldown, in which nothing is updated. Scores have
        one decimal, so mean and deviation are taken to nine: what is beyond is noise of the sums, and would decide ties."""
        self.samples += 1
        self.recent = [*self.recent, [ts, score]][-rule.kept :]
        if len(self.base) >= rule.min_samples:
            mean = math.fsum(self.base) / len(self.base)
            self.mean = round(mean, 9)
            self.std = round(math.sqrt(math.fsum((x - mean) ** 2 for x in self.base) / len(self.base)), 9)
        self.base = [*self.base, score][-rule.baseline :]
        if len(self.base) < rule.min_samples or ts - self.last_alert < rule.cooldown:
            return None
        delta, slack = score - self.mean, max(5.0, 1.5 * self.std)
        self.up, self.down = max(0.0, self.up + delta - slack), max(0.0, self.down - delta - slack)
        spike = self.mean < rule.min_rising - 10 and score >= rule.min_rising and abs(delta) >= rule.change
        lasting = self.up >= rule.threshold and score >= rule.min_rising
        self.count = self.count + 1 if spike or lasting else max(0, self.count - 1)
        if self.count < rule.breaches:
            return None
        kind = "spike" if spike else "cusum"
        said = f"rose from {self.mean:.1f} to {score:.1f}, by {abs(delta):.1f}" if spike else f"stayed high for {self.count} samples, now {score:.1f} over a baseline of {self.mean:.1f}"
        alert = {
            "alert_id": f"alert_{int(ts)}_{self.cause}_{self.effect}", "timestamp": ts, "cause": self.cause, "effect": self.effect,
            "old_score": round(self.mean, 1), "new_score": round(score, 1), "change_magnitude": round(abs(delta), 1), "alert_type": kind,
            "details": {"baseline_mean": round(self.mean, 1), "baseline_std": round(self.std, 1), "cusum_pos": round(self.up, 1), "cusum_neg": round(self.down, 1), "consec_breaches": self.count, "current_co_occurrence": co},
            "message": f"{self.cause} -> {self.effect}: score {said}",
        }
        self.last_alert, self.count, self.up, self.down = ts, 0, 0.0, 0.0
        return alert

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> Monitor:
        return Monitor(**json.loads(text))

    def state(self, watched: bool = True) -> dict:
        """What can be asked about a pair: counts, baseline, sums and the last ten samples."""
        last = self.recent[-10:]
        return {"cause": self.cause, "effect": self.effect, "watched": watched, "samples_collected": len(self.recent), "baseline_mean": round(self.mean, 1), "baseline_std": round(self.std, 1), "cusum_pos": round(self.up, 1), "cusum_neg": round(self.down, 1), "consec_breaches": self.count, "recent_scores": [s for _, s in last], "recent_timestamps": [t for t, _ in last]}


def detect(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Alerts of samples (ts double, cause, effect, score, co_occurrence)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        monitor = None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if monitor is None or (monitor.cause, monitor.effect) != (r.cause, r.effect):
                    monitor = Monitor(r.cause, r.effect)
                if alert := monitor.add(r.ts, r.score, int(r.co_occurrence), rule):
                    out.append(alert)
            if out:
                yield pd.DataFrame(out)

    rows = samples.select("cause", "effect", "ts", "score", "co_occurrence")
    return rows.repartition("cause", "effect").sortWithinPartitions("cause", "effect", "ts").mapInPandas(run, ALERT)


def baseline(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Adds n, baseline_mean and baseline_std of the scores before each sample; 0 until min_samples of them are there."""
    w = Window.partitionBy("cause", "effect").orderBy("ts")
    before = w.rowsBetween(-rule.baseline, -1)
    n = F.row_number().over(w)
    full = n > rule.min_samples
    return samples.select("cause", "effect", "ts", "score", n.alias("n"), F.when(full, F.avg("score").over(before)).otherwise(F.lit(0.0)).alias("baseline_mean"), F.when(full, F.stddev_pop("score").over(before)).otherwise(F.lit(0.0)).alias("baseline_std"))


def cusum(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Adds cusum_pos and cusum_neg without resets: running sums less their running minimum, 0 at most."""
    base = baseline(samples, rule).where(F.col("n") >= rule.min_samples)
    slack = F.greatest(F.lit(5.0), 1.5 * F.col("baseline_std"))
    rows = base.withColumn("p", F.col("score") - F.col("baseline_mean") - slack).withColumn("m", -(F.col("score") - F.col("baseline_mean")) - slack)
    w = Window.partitionBy("cause", "effect").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cp", F.sum("p").over(w)).withColumn("cm", F.sum("m").over(w))
    above = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(w))
    return rows.select("cause", "effect", "ts", "score", "n", above("cp").alias("cusum_pos"), above("cm").alias("cusum_neg"))


def recent_alerts(alerts: DataFrame, limit: int = 50, since: float = 0.0) -> DataFrame:
    """The last `limit` alerts at or after `since`, oldest first; limit is 1 to 500, since not negative."""
    if not 1 <= limit <= 500 or since < 0:
        raise ValueError("limit must be 1 to 500 and since not negative")
    last = alerts.where(F.col("timestamp") >= since).orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(limit)
    return last.orderBy("timestamp", "alert_id")


def watched(samples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Samples of the watched pairs."""
    table = samples.sparkSession.createDataFrame(pairs, "cause string, effect string").distinct()
    return samples.join(F.broadcast(table), ["cause", "effect"], "left_semi")

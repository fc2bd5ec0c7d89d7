"""Column arithmetic of the scores. All take and give columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of confidence, lift, pattern and interval; caps; and what a window without patterns counts.
W_CONFIDENCE, W_LIFT, W_INTERVAL, LIFT_CAP, PATTERN_CAP, LIVE_PATTERN = 0.45, 0.25, 0.10, 5.0, 0.4, 0.05


def d(x) -> Column:
    return x.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, d(a) / d(b)).otherwise(F.lit(0.0))


def lift(both: Column, cause: Column, effect: Column, total: Column) -> Column:
    t = F.greatest(total, F.lit(1))
    return F.when((cause > 0) & (effect > 0), (d(both) / d(t)) / ((d(cause) / d(t)) * (d(effect) / d(t)))).otherwise(F.lit(0.0))


def interval_score(n: Column, mean: Column, std: Column) -> Column:
    """1 for constant gaps, falling to 0 at a variation coefficient of 3; 0 with fewer than two gaps or no positive mean."""
    return F.when((n < 2) | (mean <= 0) | mean.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.least(std / mean, F.lit(3.0)) / 3))


def pattern_score(confidence: Column, lift_: Column) -> Column:
    return F.coalesce(F.least(confidence * 0.3 + F.least(lift_, F.lit(LIFT_CAP)) * 0.1, F.lit(PATTERN_CAP)), F.lit(0.0))


def total_score(confidence: Column, lift_: Column, pattern: Column, interval: Column, both: Column, cause: Column, effect: Column, min_support: int) -> Column:
    """0 to 100, one decimal. Under min_support the score shrinks with the support that there is; nothing is taken off
    where there is none."""
    base = confidence * W_CONFIDENCE + F.least(lift_, F.lit(LIFT_CAP)) / LIFT_CAP * W_LIFT + pattern + interval * W_INTERVAL
    short = F.greatest(F.lit(0.0), 1 - d(both) / max(1, min_support) * 0.5)
    base = F.when(both < min_support, base * short).otherwise(base)
    base = F.when((cause == 0) | (effect == 0), F.lit(0.0)).otherwise(base)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(base * 100, 1)))


def level(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def bar(score: Column, width: int = 40) -> Column:
    n = F.least(F.lit(width), F.greatest(F.lit(0), (score * width / 100).cast("int")))
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n))


def explanation(r: dict[str, Column], mode: str) -> Column:
    """Clauses that hold, in words: timing or small sample, conditional probability, lift, chain, low or high score."""
    c = r
    lead = F.format_string("%s -> %s: score %.1f. ", c["cause"], c["effect"], c["score"])
    none = F.format_string("No link found: '%s' (%d traces) and '%s' (%d traces) share none of %d traces.", c["cause"], c["cause_traces"], c["effect"], c["effect_traces"], c["total"])
    steady = F.when((c["std_ms"] > 0) & (c["std_ms"] / c["avg_ms"] < 0.5), F.format_string(", steady, sd %.0f ms", c["std_ms"])).when(c["std_ms"] > 0, F.format_string(", sd %.0f ms", c["std_ms"])).otherwise("")
    timing = F.when(c["avg_ms"] > 0, F.concat(F.format_string(", %.0f ms apart on average", c["avg_ms"]), steady)).otherwise("")
    support = F.when(c["both"] >= 5, F.concat(F.format_string("Both occur in %d traces", c["both"]), timing, F.lit(". "))).otherwise(F.format_string("A small sample: %d shared traces. ", c["both"]))
    chance = F.when(c["cause_traces"] > 0, F.format_string("P(effect|cause) = %.1f%%. ", ratio(c["both"], c["cause_traces"]) * 100)).otherwise("")
    strength = F.when(c["lift"] > 3, "strong").when(c["lift"] > 2, "medium").otherwise("weak")
    lifted = F.when(c["lift"] > 1, F.format_string("Lift %.2f, a %s association. ", c["lift"], strength)).when((c["lift"] > 0) & (c["lift"] < 1), F.format_string("Lift %.2f: the cause makes the effect rarer. ", c["lift"])).otherwise("")
    chain = F.lit("")
    if mode != "rt" and "pattern" in c:
        chain = F.when(F.size(c["pattern"]) > 2, F.format_string("Seen in the sequence %s (%d times, confidence %.1f%%). ", F.array_join(c["pattern"], " -> "), c["pattern_support"], c["pattern_confidence"] * 100)).otherwise("")
    close = F.when(c["score"] >= 80, "A strong signal: check the cause first.").when(c["score"] < 30, "A low score: few shared traces, uneven gaps or another cause.").otherwise("")
    text = F.concat(lead, support, chance, lifted, F.coalesce(chain, F.lit("")), close)
    prefix = F.lit("[live window] ") if mode == "rt" else F.lit("")
    return F.concat(prefix, F.trim(F.when(c["both"] == 0, none).otherwise(text)))

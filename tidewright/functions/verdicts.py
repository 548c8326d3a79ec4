"""Column functions that turn numbers into words. The words and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The word of the first limit that x is below; `last` from the last limit on. Null for null."""
    out = F.when(x.isNull(), None)
    for limit, word in steps:
        out = out.when(x < limit, word)
    return out.otherwise(last)


def over(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The word of the first limit that x exceeds."""
    out = F.when(x.isNull(), None)
    for limit, word in steps:
        out = out.when(x > limit, word)
    return out.otherwise(last)


def quality(best_r2: Column) -> Column:
    return over(best_r2, [(0.95, "Exact"), (0.85, "Strong"), (0.7, "Good"), (0.3, "Approx")], "Abstain")


def reliable(r2: Column) -> Column:
    return r2 > 0.7


def health(shift: Column) -> Column:
    """Verdict on a change of the exponent."""
    return bands(F.abs(shift), [(0.03, "Healthy"), (0.08, "Watch"), (0.15, "Warning")], "Critical")


def scaled_health(shift: Column, threshold: float) -> Column:
    """The verdict with limits in proportion to a threshold."""
    return bands(F.abs(shift), [(threshold * 0.375, "Healthy"), (threshold, "Watch"), (threshold * 1.875, "Warning")], "Critical")


def signal_class(alpha: Column, r2: Column) -> Column:
    named = bands(alpha, [(0.3, "ANTI-CORRELATED"), (0.6, "WHITE NOISE"), (0.85, "CORRELATED"), (1.15, "1/f NOISE"), (1.65, "BROWNIAN MOTION")], "PERSISTENT")
    return F.when(r2 < 0.3, "UNCLASSIFIABLE").otherwise(named)


def meaning(alpha: Column) -> Column:
    steps = [(0.4, "anti-correlated / mean-reverting"), (0.55, "uncorrelated / random"), (0.75, "weakly correlated"), (1.05, "strongly correlated (1/f)"), (1.4, "highly persistent")]
    return bands(alpha, steps, "unbounded walk")


def regime(alpha: Column) -> Column:
    return F.when(alpha > 0.6, "Trending").when(alpha < 0.45, "MeanReverting").otherwise("RandomWalk")


def rhythm(alpha: Column, r2: Column, n: Column) -> Column:
    named = over(alpha, [(0.7, "Bursty"), (0.55, "Natural"), (0.45, "Random")], "Metronomic")
    return F.when((r2 < 0.3) | (n < 64), "Random").otherwise(named)


def text_tag(alpha: Column, r2: Column, n: Column) -> Column:
    return F.when((n >= 64) & (r2 > 0.5), over(alpha, [(0.7, "strong"), (0.55, "moderate")], "uniform"))


def alarm_class(leg: Column, observed: Column, threshold: Column, hit_gap: Column) -> Column:
    """The fault class that an alarm points to. Legs: missing, parity, repeated, dfa, cusum, level_shift, residual."""
    large = observed > 2 * threshold
    return (
        F.when(leg == "missing", "packet_loss")
        .when(leg == "parity", F.when(large, "spike").otherwise("cross_channel_inconsistency"))
        .when(leg == "repeated", "stuck")
        .when(leg.isin("dfa", "cusum"), "drift")
        .when(leg == "level_shift", F.when(large, "spike").otherwise("regime_shift"))
        .when(leg == "residual", F.when(hit_gap >= 8, "spike").otherwise("correlation_change"))
    )

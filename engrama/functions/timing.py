"""Time column functions: relevance by age and deadline, urgency curves, interval algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86400.0, 3600.0
#: How long kinds of nodes stay relevant.
HALF_LIVES = {"conversation": 4 * HOUR, "task": 3 * DAY, "goal": 30 * DAY, "belief": 90 * DAY, "routine": 60 * DAY, "preference": 180 * DAY, "episode": 7 * DAY}
#: Two intervals meet if the gap is no longer than this.
MEETS = 0.5


def recency_relevance(age: Column, half_life: Column | float, floor: float = 0.01) -> Column:
    return F.greatest(F.pow(F.lit(2.0), -age / half_life), F.lit(floor))


def domain_half_life(domain: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in HALF_LIVES.items() for x in kv])[domain], F.lit(DAY))


def deadline_urgency(now: float, deadline: Column, ramp: float = 7 * DAY, floor: float = 0.1, at_deadline: float = 0.95, overdue: float = 1.0, steep: float = 6.0) -> Column:
    """floor before the ramp, a normalised sigmoid within it, `overdue` afterwards; null without a deadline."""
    left = deadline - now
    x = 1.0 - left / ramp
    s = lambda v: 1.0 / (1.0 + F.exp(-steep * (v - 0.5)))
    low, high = s(F.lit(0.0)), s(F.lit(1.0))
    return F.when(left < 0, overdue).when(left > ramp, floor).when(left.isNotNull(), floor + (at_deadline - floor) * (s(x) - low) / (high - low))


def relevance(now: float, updated: Column, due_again: Column, deadline: Column, half_life: float = DAY, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    """Recency, nearness of the next occurrence and urgency of the deadline, weighed; what is missing counts as 0."""
    recent = recency_relevance(F.lit(now) - updated, half_life)
    again = F.when(due_again.isNotNull(), 1.0 / (1.0 + F.greatest(due_again - now, F.lit(0.0)) / HOUR)).otherwise(0.0)
    due = F.coalesce(deadline_urgency(now, deadline), F.lit(0.0))
    a, b, d = weights
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a * recent + b * again + d * due) / (a + b + d)))


def urgency_curve(kind: Column, now: float, start: Column, deadline: Column, dismissals: Column) -> Column:
    """linear, sigmoid, step, decaying when ignored, or constant urgency, in [0, 1]."""
    value = (
        F.when(kind == "linear", 0.2 + 0.00001 * (now - start))
        .when(kind == "sigmoid", 1.0 / (1.0 + F.exp(0.00005 * (deadline - now - 3600.0))))
        .when(kind == "step", F.when(F.lit(now) >= deadline - 7200.0, 0.9).otherwise(0.2))
        .when(kind == "decay", 0.8 * F.pow(F.lit(0.7), dismissals))
        .otherwise(0.5)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two intervals overlap: unknown (null) without either begin; a missing end is open."""
    far = F.lit(1.7976931348623157e308)
    return F.when(a0.isNotNull() & b0.isNotNull(), (a0 < F.coalesce(b1, far)) & (b0 < F.coalesce(a1, far)))


def disjoint(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two intervals with open ends have nothing in common."""
    inf = float("inf")
    return (F.coalesce(a1, F.lit(inf)) < F.coalesce(b0, F.lit(-inf))) | (F.coalesce(b1, F.lit(inf)) < F.coalesce(a0, F.lit(-inf)))


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """One of the 13 relations of two intervals, with a tolerance for meeting."""
    return (
        F.when((a0 == b0) & (a1 == b1), "equals")
        .when(F.abs(a1 - b0) <= MEETS, "meets").when(F.abs(b1 - a0) <= MEETS, "met_by")
        .when(a1 < b0, "before").when(b1 < a0, "after")
        .when((a0 == b0) & (a1 < b1), "starts").when((a0 == b0) & (a1 > b1), "started_by")
        .when((a1 == b1) & (a0 > b0), "finishes").when((a1 == b1) & (a0 < b0), "finished_by")
        .when((a0 > b0) & (a1 < b1), "during").when((a0 < b0) & (a1 > b1), "contains")
        .when(a0 < b0, "overlaps").otherwise("overlapped_by")
    )

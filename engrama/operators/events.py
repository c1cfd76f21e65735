"""Event operators over (event_id, t, user_id, kind, value): rates, lags, motifs, periods, bursts, point processes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidate periods in seconds.
PERIODS = {"hour": 3600.0, "four_hours": 14400.0, "day": 86400.0, "week": 604800.0, "two_weeks": 1209600.0, "month": 2592000.0, "quarter": 7776000.0}


def in_order(*by: str):
    return Window.partitionBy(*by).orderBy("t", "event_id")


def gaps(events: DataFrame, *by: str) -> DataFrame:
    """events with `gap`, the seconds since the one before of the same key."""
    return events.withColumn("gap", F.col("t") - F.lag("t").over(in_order(*by)))


def lag_pairs(events: DataFrame, shortest: float, longest: float) -> DataFrame:
    """For each event and each other kind, its user's first event of that kind at a lag within the bounds.

    A forward as-of join without a join: each kind's next time is carried backwards over one window per kind, all on
    one partitioning by user.
    """
    kinds = [r[0] for r in events.select("kind").distinct().orderBy("kind").collect()]  # a row per kind of event
    # the first event at least `shortest` later: a range frame over time in microseconds
    us = (F.col("t") * 1e6).cast("long")
    rows = events.withColumn("_us", us)
    ahead = Window.partitionBy("user_id").orderBy("_us").rangeBetween(int(shortest * 1e6), int(longest * 1e6))
    for k in kinds:
        rows = rows.withColumn(f"_n_{k}", F.min(F.when(F.col("kind") == k, F.col("_us"))).over(ahead))
    effects = F.array(*[F.struct(F.lit(k).alias("effect"), F.col(f"_n_{k}").alias("at")) for k in kinds])
    out = rows.select("event_id", F.col("kind").alias("cause"), "_us", F.explode(effects).alias("e"))
    return out.where("e.at is not null and e.effect <> cause").select("event_id", "cause", "e.effect", ((F.col("e.at") - F.col("_us")) / 1e6).alias("lag"))


def motifs(events: DataFrame, size: int, longest_gap: float) -> DataFrame:
    """(motif, n, gap_mean, gap_cv): runs of `size` kinds of one user whose consecutive gaps stay within the bound."""
    w = in_order("user_id")
    rows = events
    for k in range(1, size):
        rows = rows.withColumn(f"_k{k}", F.lead("kind", k).over(w)).withColumn(f"_t{k}", F.lead("t", k).over(w))
    kinds = [F.col("kind")] + [F.col(f"_k{k}") for k in range(1, size)]
    times = [F.col("t")] + [F.col(f"_t{k}") for k in range(1, size)]
    fits = F.lit(True)
    for a, b in zip(times, times[1:], strict=False):
        fits &= (b - a) <= longest_gap
    rows = rows.where(fits).select(F.concat_ws(">", *kinds).alias("motif"), ((times[-1] - times[0]) / (size - 1)).alias("g"))
    return rows.groupBy("motif").agg(F.count("*").alias("n"), F.avg("g").alias("gap_mean"), (F.stddev_pop("g") / F.avg("g")).alias("gap_cv"))


def chains(events: DataFrame, longest_gap: float) -> DataFrame:
    """Maximal chains of a user's events by gap: (user_id, chain, start, stop, n)."""
    rows = gaps(events, "user_id").withColumn("_new", F.when(F.col("gap").isNull() | (F.col("gap") > longest_gap), 1).otherwise(0))
    rows = rows.withColumn("chain", F.sum("_new").over(in_order("user_id")))
    return rows.groupBy("user_id", "chain").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"))


def periodicity(events: DataFrame, *by: str) -> DataFrame:
    """Rayleigh strength of each candidate period per key, where the span has one and a half of them."""
    span = events.groupBy(*by).agg((F.max("t") - F.min("t")).alias("span"), F.count("*").alias("n"), *[f(F.col("t") * (2 * math.pi / p)) for p in PERIODS.values() for f in (lambda x: F.sum(F.cos(x)), lambda x: F.sum(F.sin(x)))])
    names = [*by, "span", "n", *[f"{f}_{k}" for k in PERIODS for f in ("c", "s")]]
    span = span.toDF(*names)
    parts = F.array(*[F.struct(F.lit(k).alias("period"), F.lit(p).alias("seconds"), (F.sqrt(F.pow(f"c_{k}", F.lit(2)) + F.pow(f"s_{k}", F.lit(2))) / F.col("n")).alias("strength")) for k, p in PERIODS.items()])
    return span.select(*by, "span", "n", F.explode(parts).alias("p")).where(F.col("span") >= 1.5 * F.col("p.seconds")).select(*by, "n", "p.period", "p.strength")


def ewma(values: Column, alpha: float = 0.2) -> Column:
    """Fold an ordered array of doubles into struct(mean, var, z): z of the last value before it is counted."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0).alias("n"), F.lit(0.0).alias("z"))

    def step(s: Column, x: Column) -> Column:
        diff = x - s["mean"]
        z = F.when((s["n"] < 3) | (F.sqrt(s["var"]) < 1e-10), 0.0).otherwise(diff / F.sqrt(s["var"]))
        mean = F.when(s["n"] == 0, x).otherwise(s["mean"] + alpha * diff)
        var = F.when(s["n"] == 0, 0.0).otherwise((1 - alpha) * (s["var"] + alpha * diff * diff))
        return F.struct(mean.alias("mean"), var.alias("var"), (s["n"] + 1).alias("n"), z.alias("z"))

    return F.aggregate(values, start, step)


def bins(events: DataFrame, width: float, *by: str) -> DataFrame:
    """Counts in fixed-width bins from each key's first event, empty bins included: (by, bin, n)."""
    first = Window.partitionBy(*by)
    rows = events.select(*by, F.floor((F.col("t") - F.min("t").over(first)) / width).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = rows.groupBy(*by).agg(F.max("bin").alias("last")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    return every.join(rows, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


#: A point process of one event an hour with mild excitation, where no gap tells more; what is kept.
DEFAULT_MU, DEFAULT_ALPHA, DEFAULT_BETA = 1 / 3600, 0.001, 1 / 300
KEPT_EVENTS, KEPT_DECAYS = 500, 4.6


def hawkes_fit(events: DataFrame, *by: str) -> DataFrame:
    """Moment fit per key over its gaps longer than 0: mu from their mean, branching from their CV squared, beta from the
    upper median. A key without such a gap gets the default process; n counts its gaps, total its events."""
    g = gaps(events, *by).where("gap > 0")
    s = g.groupBy(*by).agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.var_pop("gap").alias("v"))
    w = Window.partitionBy(*by).orderBy("gap", "event_id")
    mid = g.withColumn("_r", F.row_number().over(w) - 1).join(s.select(*by, "n"), list(by)).where(F.col("_r") == F.floor(F.col("n") / 2)).select(*by, F.col("gap").alias("median"))
    every = events.groupBy(*by).agg(F.count("*").alias("total"), F.max("t").alias("last"))
    out = every.join(s, list(by), "left").join(mid, list(by), "left")
    cv2 = F.col("v") / (F.col("m") * F.col("m"))
    branching = F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(0.85), cv2 / (1 + cv2))), F.lit(DEFAULT_ALPHA / DEFAULT_BETA))
    beta = F.coalesce(1 / F.col("median"), F.lit(DEFAULT_BETA))
    out = out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "total", "last", F.coalesce(1 / F.col("m"), F.lit(DEFAULT_MU)).alias("mu"), branching.alias("branching"), beta.alias("beta"))
    return out.withColumn("alpha", F.col("branching") * F.col("beta"))


def point_process(events: DataFrame, now: float, *by: str) -> DataFrame:
    """hawkes_fit of the events before `now` with `excited`, the excitation at now that the kept ones leave, `hours`, the
    24 circadian multipliers, and `stationary`, the long-run rate."""
    before = events.where(F.col("t") < now)
    fit = hawkes_fit(before, *by)
    late = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("event_id")))
    kept = before.select(*by, "t", late.alias("_r")).where(F.col("_r") <= KEPT_EVENTS).join(fit.select(*by, "last", "alpha", "beta"), list(by))
    kept = kept.where(F.col("t") >= F.col("last") - KEPT_DECAYS / F.col("beta"))
    excited = kept.groupBy(*by).agg(F.sum(F.col("alpha") * F.exp(-F.col("beta") * (now - F.col("t")))).alias("excited"))
    hour = F.floor(F.pmod(F.col("t"), F.lit(86400.0)) / 3600)
    hours = before.groupBy(*by).agg(F.array(*[24.0 * (F.count_if(hour == h) + 1) / (F.count("*") + 24) for h in range(24)]).alias("hours"))
    return fit.join(excited, list(by)).join(hours, list(by)).withColumn("stationary", F.col("mu") / (1 - F.col("branching")))


def intensity(now: float, ahead: Column) -> Column:
    """The rate of a point_process row `ahead` seconds after its now: base rate by the hour, and what excitation is left."""
    at = F.pmod(F.lit(now) + ahead, F.lit(86400.0)) / 3600
    low = F.floor(at).cast("int") % 24
    a, b = F.get("hours", low), F.get("hours", (low + 1) % 24)
    base = F.col("mu") * (a + (at - F.floor(at)) * (b - a))
    return F.greatest(F.lit(0.0), base + F.col("excited") * F.exp(-F.col("beta") * ahead))


def predict_next(model: DataFrame, now: float, horizon: float = 14400.0, step: float = 60.0, least: int = 3) -> DataFrame:
    """point_process rows of `least` events or more with `expected`: the first step at which the summed rate reaches one
    event, else the step of the highest rate; `peak`, the highest rate so far; and `confidence`."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("top"), F.lit(None).cast("int").alias("hit"))

    def one(s: Column, k: Column) -> Column:
        rate = intensity(now, k * step)
        total = s["sum"] + rate * step
        higher = rate > s["peak"]
        new = F.struct(total.alias("sum"), F.when(higher, rate).otherwise(s["peak"]).alias("peak"), F.when(higher, k).otherwise(s["top"]).alias("top"), F.when(total >= 1, k).alias("hit"))
        return F.when(s["hit"].isNotNull(), s).otherwise(new)

    steps = F.sequence(F.lit(0), F.lit(int(horizon // step)))
    out = model.where(F.col("total") >= least).withColumn("_p", F.aggregate(steps, start, one)).where("_p.peak > 0")
    share = F.col("_p.peak") / F.col("stationary")
    sure = F.when(F.col("_p.hit").isNotNull(), F.least(share, F.lit(1.0))).otherwise(F.least(0.3 * share, F.lit(0.5)))
    return out.withColumn("expected", now + step * F.coalesce("_p.hit", "_p.top")).withColumn("peak", F.col("_p.peak")).withColumn("confidence", sure).drop("_p")


def anticipate(events: DataFrame, now: float, *by: str, least: int = 5, surge: float = 1.5) -> DataFrame:
    """Predictions for the keys whose rate now is above `surge` times their long-run rate."""
    model = point_process(events, now, *by).withColumn("rate", intensity(now, F.lit(0.0)))
    return predict_next(model.where((F.col("total") >= least) & (F.col("rate") > surge * F.col("stationary"))), now)


def circadian(events: DataFrame, *by: str) -> DataFrame:
    """Smoothed 24-hour profile with mean 1 per key."""
    h = events.groupBy(*by, F.floor(F.pmod(F.col("t"), F.lit(86400.0)) / 3600).alias("hour")).agg(F.count("*").alias("n"))
    total = h.groupBy(*by).agg(F.sum("n").alias("total"))
    every = total.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return every.join(h, [*by, "hour"], "left").select(*by, "hour", (24 * (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + 24)).alias("weight"))


def granger(events: DataFrame, width: float, cause: str, effect: str) -> DataFrame:
    """Does a cause in one window foretell the effect in the next? Accuracy against always saying the likelier, per user."""
    b = events.withColumn("w", F.floor(F.col("t") / width)).groupBy("user_id", "w").agg(F.max(F.when(F.col("kind") == cause, 1).otherwise(0)).alias("c"), F.max(F.when(F.col("kind") == effect, 1).otherwise(0)).alias("e"))
    every = b.groupBy("user_id").agg(F.min("w").alias("a"), F.max("w").alias("z")).select("user_id", F.explode(F.sequence("a", "z")).alias("w"))
    b = every.join(b, ["user_id", "w"], "left").fillna(0, ["c", "e"])
    b = b.withColumn("after", F.lead("e").over(Window.partitionBy("user_id").orderBy("w"))).where("after is not null")
    s = b.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("after").alias("rate"), F.avg(F.when(F.col("c") == F.col("after"), 1.0).otherwise(0.0)).alias("accuracy")).where("n >= 3")
    return s.withColumn("lift", F.col("accuracy") - F.greatest("rate", 1 - F.col("rate")))

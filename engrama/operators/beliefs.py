"""Beliefs, causes and learning: ordered folds, propagation, calibration, choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How far evidence of each provenance is trusted.
RELIABILITY = {"told": 0.95, "observed": 0.90, "experimented": 0.85, "consolidated": 0.80, "extracted": 0.75, "inferred": 0.60}
DEFAULT_RELIABILITY = 0.50


def reliability(provenance: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RELIABILITY.items() for x in kv])[provenance], F.lit(DEFAULT_RELIABILITY))


def log_odds_fold(weights: Column, limit: float = 6.0) -> Column:
    """Fold an ordered array of signed weights into clamped log-odds: clamping makes the order matter."""
    return F.aggregate(weights, F.lit(0.0), lambda s, w: F.greatest(F.lit(-limit), F.least(F.lit(limit), s + w)))


def probability(log_odds: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-log_odds))


def ordered(rows: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """(key, xs): each key's values in order, for sequential folds."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_x"))))
    return rows.groupBy(*key).agg(F.transform(packed, lambda r: r["_x"]).alias("xs"))


def reinforced_confidence(hits: Column, start: float = 0.5) -> Column:
    """Fold booleans: up by 5 % of the room left when confirmed, down by 8 % when contradicted, each less with its own count."""
    first = F.struct(F.lit(start).alias("c"), F.lit(0).alias("up"), F.lit(0).alias("down"))

    def step(s: Column, ok: Column) -> Column:
        up, down = s["up"] + ok.cast("int"), s["down"] + (~ok).cast("int")
        higher = F.least(F.lit(0.99), s["c"] + (1 - s["c"]) * 0.05 / (1 + 0.01 * up))
        lower = F.greatest(F.lit(0.0), s["c"] - s["c"] * 0.08 / (1 + 0.01 * down))
        return F.struct(F.when(ok, higher).otherwise(lower).alias("c"), up.alias("up"), down.alias("down"))

    return F.aggregate(hits, first, step)["c"]


def staleness_decay(value: Column, days: Column) -> Column:
    return value * (1 - F.least(F.lit(0.95), F.greatest(F.lit(0.0), 0.02 * (days - 7))))


def propagate(edges: DataFrame, start: DataFrame, hops: int, decay: float, floor: float) -> DataFrame:
    """Signed effects downstream: strength x edge x decay per hop; weak ones end; (cause, node, hop, strength)."""
    wave = start.select("cause", "node", F.lit(0).alias("hop"), F.lit(1.0).alias("strength"))
    every = None
    for h in range(1, hops + 1):
        wave = wave.withColumnRenamed("node", "src").withColumnRenamed("strength", "s").join(edges.select("src", "dst", "strength"), "src")
        wave = wave.groupBy("cause", F.col("dst").alias("node")).agg(F.max_by(F.col("s") * F.col("strength") * decay, F.abs(F.col("s") * F.col("strength"))).alias("strength")).where(F.abs("strength") >= floor).select("cause", "node", F.lit(h).alias("hop"), "strength")
        every = wave if every is None else every.unionByName(wave)
    return every


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, actual) of rows (score, outcome)."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg(F.col("outcome").cast("double")).alias("actual"))


def pooled(bins: DataFrame) -> DataFrame:
    """Pool adjacent violators over a fixed number of bins, without count weights: adds `fitted`."""
    start = F.array().cast("array<struct<v:double,n:int>>")

    def merge(stack: Column, x: Column) -> Column:
        """Push x, then merge while the one before is not less; each merge is one bounded inner fold."""
        pushed = F.concat(stack, F.array(F.struct(x.alias("v"), F.lit(1).alias("n"))))

        def once(s: Column, _: Column) -> Column:
            m = F.size(s)
            a, b = F.get(s, m - 2), F.get(s, m - 1)
            both = F.struct(((a["v"] * a["n"] + b["v"] * b["n"]) / (a["n"] + b["n"])).alias("v"), (a["n"] + b["n"]).alias("n"))
            return F.when((m >= 2) & (a["v"] > b["v"]), F.concat(F.slice(s, 1, m - 2), F.array(both))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.size(pushed)), pushed, once)

    packed = F.array_sort(F.collect_list(F.struct("bin", "n", "predicted", "actual")))
    one = bins.agg(packed.alias("b"))  # as many entries as bins
    fit = one.withColumn("s", F.aggregate(F.transform("b", lambda r: r["actual"]), start, merge))
    flat = F.flatten(F.transform("s", lambda r: F.array_repeat(r["v"], r["n"])))
    return fit.select(F.explode(F.arrays_zip("b", flat.alias("f"))).alias("z")).select("z.b.bin", "z.b.n", "z.b.predicted", "z.b.actual", F.col("z.f").alias("fitted"))


def softmax(score: str, *by: str, temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    top = F.max(score).over(w)
    e = F.exp((F.col(score) - top) / temperature)
    return e / F.sum(e).over(w)


def ranking_loss(rows: DataFrame, margin: float = 0.05) -> DataFrame:
    """Per query, the mean squared hinge over (relevant, irrelevant) pairs of rows (query_id, relevant, score).

    Pairs are not made: sorted by score, a relevant row's loss against all irrelevant ones within the margin comes from
    running sums, in one window per query.
    """
    w = Window.partitionBy("query_id").orderBy("at")
    at = F.when(F.col("relevant"), F.col("score") - margin).otherwise(F.col("score"))
    bad = F.when(~F.col("relevant"), 1.0).otherwise(0.0)
    r = rows.select("query_id", "relevant", "score", at.alias("at"), bad.alias("b"))
    above = w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    n, s, q = (F.sum(x).over(above) for x in (F.col("b"), F.col("b") * F.col("score"), F.col("b") * F.col("score") * F.col("score")))
    x = F.col("at")  # sum over irrelevant s_j >= x of (s_j - x)^2
    part = F.when(F.col("relevant"), q - 2 * x * s + n * x * x).otherwise(0.0)
    g = r.withColumn("part", part).groupBy("query_id").agg(F.sum("part").alias("loss"), F.count_if("relevant").alias("good"), F.sum("b").alias("bad"))
    return g.where("good > 0 and bad > 0").select("query_id", (F.col("loss") / (F.col("good") * F.col("bad"))).alias("loss"))


#: The least urgency of each way to bring something up, of a conflict's alert, and of a nudge in a pause.
PREEMPT, ALERT, NUDGE, CONFLICT_ALERT, PAUSE_NUDGE = 0.95, 0.8, 0.5, 0.6, 0.4


def surface_mode(urgency: Column, reason: Column, pausing: Column, preempt: bool = True) -> Column:
    """How to bring something up: only an imminent deadline preempts; a pause lowers what it takes to nudge."""
    return (
        F.when(F.lit(preempt) & (urgency >= PREEMPT) & (reason == "deadline_imminent"), "preempt")
        .when((urgency >= ALERT) | ((reason == "conflict_needs_resolution") & (urgency >= CONFLICT_ALERT)), "alert")
        .when((urgency >= NUDGE) | (pausing & (urgency >= PAUSE_NUDGE)), "nudge")
        .otherwise("whisper")
    )

"""Pattern mining, triggers and consolidation over memories, edges and links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def hour_of_week_clusters(memories: DataFrame, least: int = 5) -> DataFrame:
    """Hours of the week with more than mean + 2 standard deviations (over all 168, empty ones included)."""
    rows = memories.where("status = 'active' and type = 'episodic'").groupBy(F.pmod(F.floor(F.col("created_at") / 3600), F.lit(168)).alias("hour")).agg(F.count("*").alias("n"), F.avg("valence").alias("valence"))
    hours = memories.sparkSession.range(168).withColumnRenamed("id", "hour").join(rows, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = hours.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))  # one row
    return hours.crossJoin(stats).where((F.col("n") > F.col("mean") + 2 * F.col("sd")) & (F.col("n") >= least)).withColumn("confidence", F.least(F.lit(1.0), (F.col("n") - F.col("mean")) / F.col("n")))


def valence_shift(memories: DataFrame, now: float, recent: float, past: float, least: int = 3, threshold: float = 0.3) -> DataFrame:
    """Average valence of the last `recent` days against days recent to past, where both have enough rows and differ."""
    age = (F.lit(now) - F.col("created_at")) / DAY
    new, old = F.when(age < recent, F.col("valence")), F.when((age >= recent) & (age < past), F.col("valence"))
    g = memories.where("status = 'active'").agg(F.avg(new).alias("recent"), F.avg(old).alias("baseline"), F.count(new).alias("n_recent"), F.count(old).alias("n_baseline"))
    return g.withColumn("delta", F.col("recent") - F.col("baseline")).where((F.col("n_recent") >= least) & (F.col("n_baseline") >= least) & (F.abs("delta") > threshold))


def bridges(links: DataFrame, memories: DataFrame, least: int = 2) -> DataFrame:
    """Entities of several domains of active memories, the general one apart: ln(domains) x entropy x IDF of all mentions."""
    inside = memories.where("status = 'active' and domain <> 'general'").select("rid", "domain")
    cell = links.join(inside, "rid").groupBy("entity", "domain").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = cell.groupBy("entity").agg(F.sum("n").alias("total"), F.count("*").alias("domains")).where("domains >= 2")
    mentions = links.groupBy("entity").agg(F.count("*").alias("mentions"))
    every = links.agg(F.countDistinct("entity").alias("every"))  # one row
    p = F.col("n") / F.col("total")
    g = cell.join(total, "entity").groupBy("entity").agg(F.first("domains").alias("domains"), F.sum(-p * F.log(p)).alias("entropy")).join(mentions, "entity").crossJoin(every)
    idf = F.greatest(F.log(F.col("every") / (1 + F.col("mentions"))), F.lit(0.1))
    return g.withColumn("score", F.log("domains") * F.col("entropy") * idf).withColumn("confidence", F.least(F.col("score") / 5, F.lit(1.0)))


def temporal_drift(memories: DataFrame, now: float, old: float = 90.0, unseen: float = 30.0, most: int = 10) -> DataFrame:
    """The oldest facts of `old` days or more that nobody looked at for `unseen` days: (rid, urgency)."""
    rows = memories.where("status = 'active' and type = 'semantic'").where((F.col("created_at") < now - old * DAY) & (F.col("last_access") < now - unseen * DAY))
    return rows.orderBy("created_at", "rid").limit(most).select("rid", F.least(F.lit(1.0), (now - F.col("created_at")) / DAY / 365).alias("urgency"))


def co_occurrence(edges: DataFrame, least: int = 3, block: int = 1024) -> DataFrame:
    """Pairs of sources by shared destinations; each destination's sources meet in blocks of about `block`."""
    e = edges.select("src", "dst").distinct()
    n = e.groupBy("dst").agg(F.count("*").alias("n")).where("n >= 2").select("dst", F.ceil(F.col("n") / block).cast("int").alias("n"))
    e = e.join(n, "dst").withColumn("own", F.pmod(F.xxhash64("src"), F.col("n")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a, b = e.select("dst", F.col("src").alias("a"), F.col("own").alias("i"), F.col("other").alias("j")), e.select("dst", F.col("src").alias("b"), F.col("other").alias("i"), F.col("own").alias("j"))
    return a.join(b, ["dst", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def greedy_clusters(rows: DataFrame, threshold: float, days: float, smallest: int, largest: int, group: str = "namespace", entities: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """Greedy single-seed clusters in time order within a group: (group, cluster, rid), cluster being the seed's rid.

    Rows are (group, rid, created_at, v), rids unique. Any two of a group within `days` may meet. With `entities`
    (rid, entity), two that both have some must share one. Rows are compared in blocks of about `block`, each with those of
    its own and the next slot of `days`; one task then holds a group's neighbours, not its vectors.
    """
    kind = rows.schema["rid"].dataType.simpleString()
    base = rows.select(F.col(group).alias("g"), "rid", "created_at", "v", F.floor(F.col("created_at") / (days * DAY)).alias("s"))
    sizes = base.groupBy("g", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = F.broadcast(sizes.toDF("og", "os", "n"))  # a row per group and slot
    base = base.join(own, F.col("g").eqNullSafe(F.col("og")) & (F.col("s") == F.col("os"))).withColumn("b", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int")).drop("og", "os", "n")
    if entities is not None:
        base = base.join(entities.groupBy("rid").agg(F.collect_set("entity").alias("e")), "rid", "left")
    else:
        base = base.withColumn("e", F.lit(None).cast("array<string>"))
    other = F.broadcast(sizes.toDF("og", "os", "n"))
    cells = base.withColumn("near", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))).join(other, F.col("g").eqNullSafe(F.col("og")) & (F.col("near") == F.col("os")))
    cells = cells.withColumn("nb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    mine, theirs = F.struct(F.col("s").alias("s"), F.col("b").alias("b")), F.struct(F.col("near").alias("s"), F.col("nb").alias("b"))
    cells = cells.select("g", F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), (mine > theirs).alias("upper"), (mine == theirs).alias("alone"), "rid", "created_at", "v", "e")

    def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "rid"]).reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        t, upper, alone = pdf["created_at"].to_numpy(), pdf["upper"].to_numpy(), bool(pdf["alone"].iloc[0])
        ok = np.zeros((len(t), len(t)), bool)
        for k in range(0, len(t), 512):
            ok[k : k + 512] = np.triu((x[k : k + 512] @ x.T >= threshold) & (np.abs(t[k : k + 512, None] - t) <= days * DAY), 1 + k)
        if not alone:
            ok &= upper[:, None] != upper
        named = np.array([e is not None and len(e) > 0 for e in pdf["e"]])
        some = np.flatnonzero((ok.any(0) | ok.any(1)) & named)
        if len(some):
            number: dict = {}
            has = np.zeros((len(some), len({k for i in some for k in pdf["e"].iloc[i]})), np.float32)
            for r, i in enumerate(some):
                has[r, [number.setdefault(k, len(number)) for k in pdf["e"].iloc[i]]] = 1
            ok[np.ix_(some, some)] &= has @ has.T > 0
        seeds = np.arange(len(pdf)) if alone and smallest <= 1 else np.flatnonzero(ok.any(1))
        out = [(pdf["g"].iloc[0], pdf["rid"].iloc[i], t[i], pdf["rid"][ok[i]].tolist(), t[ok[i]].tolist()) for i in seeds]
        return pd.DataFrame(out, columns=["g", "seed", "at", "rids", "ats"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for r in pdf.itertuples():
            near.setdefault((r.at, r.seed), []).extend(zip(r.ats, r.rids, strict=True))
        used, out = set(), []
        for at, seed in sorted(near):
            if seed in used:
                continue
            own = [rid for _, rid in sorted(near[at, seed]) if rid not in used][: largest - 1]
            used.update([seed, *own])
            if len(own) + 1 >= smallest:
                out += [(pdf["g"].iloc[0], seed, rid) for rid in [seed, *own]]
        return pd.DataFrame(out, columns=[group, "cluster", "rid"])

    found = cells.groupBy("g", "low", "high").applyInPandas(neighbours, f"g string, seed {kind}, at double, rids array<{kind}>, ats array<double>")
    return found.groupBy("g").applyInPandas(cluster, f"{group} string, cluster {kind}, rid {kind}")


def consolidated(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """One merged memory per cluster: importance min(1.1 max, 1), mean valence, 1.5 max half-life, the lead text."""
    g = clusters.select("cluster", "rid").join(memories, "rid").groupBy("cluster").agg(
        F.count("*").alias("members"), F.least(F.lit(1.0), 1.1 * F.max("importance")).alias("importance"), F.avg("valence").alias("valence"), (1.5 * F.max("half_life")).alias("half_life"),
        F.max_by("text", F.struct("importance", -F.col("rid"))).alias("lead"),
    )
    return g


def extractive_summary(memories: DataFrame, group: str) -> DataFrame:
    """(group, summary, n): the most important memory's text as it is, then the other texts trimmed, in that order.

    Texts that are empty once trimmed, or equal to the lead, are left out. A group's texts are one value.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "rid", F.col("text").alias("t"))))
    g = memories.groupBy(group).agg(F.transform(rows, lambda x: x["t"]).alias("r"), F.count("*").alias("n"))
    g = g.withColumn("r", F.array_compact("r")).withColumn("lead", F.get("r", F.lit(0)))
    rest = F.transform(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    rest = F.filter(rest, lambda t: (t != "") & (t != F.col("lead")))
    return g.select(group, F.array_join(F.concat(F.array("lead"), rest), " | ").alias("summary"), "n")

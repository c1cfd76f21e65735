"""Scans, filters, lifecycle views and profiles over memories. Every operator takes `now` and reads no clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions import scoring as S

DAY = 86400.0


def with_decay(memories: DataFrame, now: float) -> DataFrame:
    """Adds decay and recency, both by the last access."""
    elapsed = F.lit(now) - F.col("last_access")
    return memories.withColumn("decay", S.decay_score(F.col("importance"), F.col("half_life"), elapsed)).withColumn("recency", S.recency_score(F.lit(now) - F.col("created_at")))


def active(memories: DataFrame, consolidated: bool = False) -> DataFrame:
    return memories.where(F.col("status").isin("active", "consolidated") if consolidated else F.col("status") == "active")


def recall_filter(memories: DataFrame, *, type: str | None = None, since: float | None = None, until: float | None = None, namespace: str | None = None, domain: str | None = None, source: str | None = None, consolidated: bool = False) -> DataFrame:  # noqa: A002
    """The predicate set of recall; absent ones don't filter."""
    out = active(memories, consolidated)
    for name, value in (("type", type), ("namespace", namespace), ("domain", domain), ("source", source)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    if until is not None:
        out = out.where(F.col("created_at") <= until)
    return out


def page(memories: DataFrame, key: str, offset: int, limit: int, descending: bool = True) -> DataFrame:
    """One page of active memories by a whitelisted key, ties by rid."""
    if key not in ("created_at", "importance", "last_access", "valence", "access_count"):
        raise ValueError(f"can't sort by {key}")
    return active(memories).orderBy(F.desc(key) if descending else F.asc(key), "rid").offset(offset).limit(limit)


def decayed_below(memories: DataFrame, threshold: float, now: float) -> DataFrame:
    return with_decay(active(memories), now).where(F.col("decay") < threshold)


def stale(memories: DataFrame, days: float, now: float, limit: int) -> DataFrame:
    return active(memories).where((F.col("last_access") < now - days * DAY) & (F.col("importance") >= 0.3)).orderBy(F.desc("importance"), "rid").limit(limit)


def upcoming(memories: DataFrame, days: float, now: float, limit: int) -> DataFrame:
    return active(memories).where(F.col("due_at").between(now, now + days * DAY)).orderBy("due_at", "rid").limit(limit)


def eviction_rank(memories: DataFrame, keep: int, now: float) -> DataFrame:
    """The active hot memories beyond the best `keep`, worst first."""
    rows = with_decay(active(memories).where("storage_tier = 'hot'"), now).withColumn("score", S.eviction_score(F.col("decay"), F.col("recency")))
    return rows.orderBy(F.desc("score"), F.desc("rid")).offset(keep)


def reinforced(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Fold an access log (rid, at): last access, count, and a half-life that grows by a fifth each time, up to a year."""
    n = accesses.groupBy("rid").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    out = memories.join(n, "rid", "left")
    grown = F.least(F.col("half_life") * F.pow(F.lit(1.2), F.coalesce("n", F.lit(0))), F.lit(31536000.0))
    return out.withColumn("half_life", grown).withColumn("last_access", F.greatest("last_access", "at")).withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).drop("n", "at")


def latest(rows: DataFrame, key: list[str], clock: list[str]) -> DataFrame:
    """The latest-wins view of versioned rows, one pass with map-side combine."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*clock)).alias("_")).select(*key, "_.*")


def counts(memories: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    s = F.col("status")
    return memories.agg(count(s == "active").alias("active"), count(s == "consolidated").alias("consolidated"), count(s == "tombstoned").alias("tombstoned"), count(F.col("storage_tier") == "cold").alias("cold"))


def entity_profiles(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Per entity: mentions, sessions, average valence, its trend between the older and newer half, modal emotion."""
    rows = links.join(active(memories).select("rid", "session_id", "valence", "emotion", "domain", "created_at"), "rid")
    w = Window.partitionBy("entity").orderBy("created_at", "rid")
    n = F.count("*").over(Window.partitionBy("entity"))
    rows = rows.withColumn("newer", F.row_number().over(w) * 2 > n)
    modal = rows.where("emotion is not null").groupBy("entity", "emotion").count().groupBy("entity").agg(F.max_by("emotion", F.struct("count", "emotion")).alias("emotion"))
    out = rows.groupBy("entity").agg(
        F.count("*").alias("mentions"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("domain").alias("domains"), F.avg("valence").alias("valence"),
        (F.avg(F.when(F.col("newer"), F.col("valence"))) - F.avg(F.when(~F.col("newer"), F.col("valence")))).alias("trend"),
    )
    return out.join(modal, "entity", "left")


def relationship_depth(sessions: Column, memories: Column, domains: Column, connections: Column, relations: Column) -> Column:
    ln = lambda x, base: F.log1p(x) / F.log(F.lit(float(base)))
    raw = 0.25 * ln(sessions, 4) + 0.25 * ln(memories, 20) + 0.20 * F.least(domains / 3, F.lit(1.0)) + 0.15 * ln(connections, 10) + 0.15 * F.least(relations / 4, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Element-wise mean vector per key: exploded, averaged with map-side combine, put together again."""
    cells = vectors.select(key, F.posexplode("v").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))

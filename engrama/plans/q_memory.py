"""Queries of scans, filters, lifecycle and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.operators import memory as M
from engrama.plans.registry import query
from engrama.sources import adapters as A

NOW = A.NOW
c = F.col
DECAY = "importance * pow(2, -(1706745600.0 - last_access) / half_life)"
RECENCY = "exp(-(1706745600.0 - created_at) / 604800.0)"


def mem(spark, sf_dir):
    return A.memories(spark, sf_dir)


@query("memory_get", "SELECT rid, type, domain, importance, status FROM memories WHERE rid = 42", ("memories",))
def _(spark, sf_dir):
    return mem(spark, sf_dir).where("rid = 42").select("rid", "type", "domain", "importance", "status")


@query("memory_page", "SELECT rid, importance, created_at FROM memories WHERE status = 'active' AND namespace = 'en' ORDER BY importance DESC, rid LIMIT 50 OFFSET 100", ("memories",))
def _(spark, sf_dir):
    return M.page(mem(spark, sf_dir).where("namespace = 'en'"), "importance", 100, 50).select("rid", "importance", "created_at")


@query("memory_page_total", "SELECT namespace, type, count(*) AS total FROM memories WHERE status = 'active' GROUP BY namespace, type", ("memories",))
def _(spark, sf_dir):
    return M.active(mem(spark, sf_dir)).groupBy("namespace", "type").agg(F.count("*").alias("total"))


@query("scoring_cache", "SELECT rid, type, importance, valence, half_life, last_access, namespace, domain FROM memories WHERE status <> 'tombstoned'", ("memories",))
def _(spark, sf_dir):
    return mem(spark, sf_dir).where("status <> 'tombstoned'").select("rid", "type", "importance", "valence", "half_life", "last_access", "namespace", "domain")


@query(
    "store_stats",
    """SELECT (SELECT count(*) FROM memories WHERE status = 'active') AS active, (SELECT count(*) FROM memories WHERE status = 'consolidated') AS consolidated, (SELECT count(*) FROM memories WHERE status = 'tombstoned') AS tombstoned,
    (SELECT count(*) FROM memories WHERE storage_tier = 'cold') AS cold, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM events) AS ops""",
    ("memories", "edges"),
)
def _(spark, sf_dir):
    one = M.counts(mem(spark, sf_dir))
    edges = A.edges(spark, sf_dir).agg(F.count("*").alias("edges"))
    return one.crossJoin(edges).crossJoin(A.oplog(spark, sf_dir).agg(F.count("*").alias("ops")))  # one row each


@query("recall_predicates", "SELECT rid, created_at FROM memories WHERE status IN ('active', 'consolidated') AND type = 'semantic' AND namespace = 'en' AND created_at BETWEEN 1706745600.0 - 1209600.0 AND 1706745600.0 - 86400.0", ("memories",))
def _(spark, sf_dir):
    return M.recall_filter(mem(spark, sf_dir), type="semantic", namespace="en", since=NOW - 14 * M.DAY, until=NOW - M.DAY, consolidated=True).select("rid", "created_at")


@query("decay_below", f"SELECT rid, round({DECAY}, 6) AS decay FROM memories WHERE status = 'active' AND {DECAY} < 0.05", ("memories",))
def _(spark, sf_dir):
    return M.decayed_below(mem(spark, sf_dir), 0.05, NOW).select("rid", F.round("decay", 6).alias("decay"))


@query("stale_memories", "SELECT rid, importance, last_access FROM memories WHERE status = 'active' AND last_access < 1706745600.0 - 864000.0 AND importance >= 0.3 ORDER BY importance DESC, rid LIMIT 100", ("memories",))
def _(spark, sf_dir):
    return M.stale(mem(spark, sf_dir), 10, NOW, 100).select("rid", "importance", "last_access")


@query("upcoming_memories", "SELECT rid, due_at FROM memories WHERE status = 'active' AND due_at BETWEEN 1706745600.0 AND 1706745600.0 + 604800.0 ORDER BY due_at, rid LIMIT 100", ("memories",))
def _(spark, sf_dir):
    return M.upcoming(mem(spark, sf_dir), 7, NOW, 100).select("rid", "due_at")


@query("evict_rank", f"SELECT rid, round(s, 6) AS score FROM (SELECT rid, 0.6 * {DECAY} + 0.4 * {RECENCY} AS s FROM memories WHERE status = 'active' AND storage_tier = 'hot') ORDER BY s DESC, rid DESC OFFSET 300", ("memories",))
def _(spark, sf_dir):
    return M.eviction_rank(mem(spark, sf_dir), 300, NOW).select("rid", F.round("score", 6).alias("score"))


@query(
    "reinforce_fold",
    """SELECT rid, least(half_life * pow(1.2, coalesce(n, 0)), 31536000.0) AS half_life, greatest(last_access, coalesce(seen_at, 0)) AS last_access, access_count + coalesce(n, 0) AS access_count
    FROM memories LEFT JOIN (SELECT user_id AS rid, count(*) AS n, max(t) AS seen_at FROM ev WHERE kind = 'view' GROUP BY user_id) USING (rid)""",
    ("memories", "ev"),
)
def _(spark, sf_dir):
    log = A.events(spark, sf_dir).where("kind = 'view'").select(c("user_id").alias("rid"), c("t").alias("at"))
    return M.reinforced(mem(spark, sf_dir), log).select("rid", "half_life", "last_access", "access_count")


@query("tier_archive", f"SELECT rid, CASE WHEN {DECAY} < 0.01 THEN 'cold' WHEN storage_tier = 'cold' AND last_access > 1706745600.0 - 259200.0 THEN 'hot' ELSE storage_tier END AS tier FROM memories WHERE status = 'active'", ("memories",))
def _(spark, sf_dir):
    m = M.with_decay(M.active(mem(spark, sf_dir)), NOW)
    tier = F.when(c("decay") < 0.01, "cold").when((c("storage_tier") == "cold") & (c("last_access") > NOW - 3 * M.DAY), "hot").otherwise(c("storage_tier"))
    return m.select("rid", tier.alias("tier"))


@query(
    "forget_and_correct",
    """SELECT rid, CASE WHEN gone IS NOT NULL THEN 'tombstoned' ELSE status END AS status, CASE WHEN gone IS NOT NULL AND gone % 2 = 0 THEN rid + 10000000 END AS corrected_by
    FROM memories LEFT JOIN (SELECT target AS rid, max(op_id) AS gone FROM oplog WHERE op_type = 'forget' GROUP BY target) USING (rid)""",
    ("memories", "oplog"),
)
def _(spark, sf_dir):
    gone = A.oplog(spark, sf_dir).where("op_type = 'forget'").groupBy(c("target").alias("rid")).agg(F.max("op_id").alias("gone"))
    out = mem(spark, sf_dir).select("rid", "status").join(gone, "rid", "left")
    return out.select("rid", F.when(c("gone").isNotNull(), "tombstoned").otherwise(c("status")).alias("status"), F.when(c("gone") % 2 == 0, c("rid") + 10000000).alias("corrected_by"))


@query("procedural_stats", "SELECT domain, count(*) AS n, round(avg(importance), 6) AS effectiveness FROM memories WHERE type = 'procedural' AND status = 'active' GROUP BY domain", ("memories",))
def _(spark, sf_dir):
    return M.active(mem(spark, sf_dir)).where("type = 'procedural'").groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("effectiveness"))


@query("surface_procedural", f"SELECT rid, round(importance * {RECENCY}, 6) AS score FROM memories WHERE type = 'procedural' AND status = 'active' ORDER BY importance * {RECENCY} DESC, rid LIMIT 20", ("memories",))
def _(spark, sf_dir):
    m = M.with_decay(M.active(mem(spark, sf_dir)).where("type = 'procedural'"), NOW)
    return m.orderBy(F.desc(c("importance") * c("recency")), "rid").limit(20).select("rid", F.round(c("importance") * c("recency"), 6).alias("score"))


@query(
    "procedural_reinforce",
    "SELECT user_id AS rid, round(list_reduce(list(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY t, event_id), lambda a, x: a * 0.7 + x * 0.3, 0.5::DOUBLE), 6) AS effectiveness FROM ev WHERE kind = 'purchase' GROUP BY user_id",
    ("ev",),
)
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).where("kind = 'purchase'")
    rows = F.array_sort(F.collect_list(F.struct("t", "event_id", F.when(c("value") > 50, 1.0).otherwise(0.0).alias("x"))))
    return e.groupBy(c("user_id").alias("rid")).agg(rows.alias("r")).select("rid", F.round(F.aggregate("r", F.lit(0.5), lambda a, x: a * 0.7 + x["x"] * 0.3), 6).alias("effectiveness"))


@query("session_active", "SELECT client, max_by(session_id, struct_pack(a := started_at, b := session_id)) AS session_id, max(started_at) AS started_at FROM sessions WHERE status = 'active' GROUP BY client", ("sessions",))
def _(spark, sf_dir):
    s = A.sessions(spark, sf_dir).where("status = 'active'")
    return s.groupBy("client").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"), F.max("started_at").alias("started_at"))


@query("session_history", "SELECT session_id, client, started_at, turns FROM sessions ORDER BY started_at DESC, session_id LIMIT 20", ("sessions",))
def _(spark, sf_dir):
    return A.sessions(spark, sf_dir).orderBy(F.desc("started_at"), "session_id").limit(20).select("session_id", "client", "started_at", "turns")


@query("session_abandon_stale", "SELECT session_id, CASE WHEN status = 'active' AND started_at < 1706745600.0 - 604800.0 THEN 'abandoned' ELSE status END AS status FROM sessions", ("sessions",))
def _(spark, sf_dir):
    return A.sessions(spark, sf_dir).select("session_id", F.when((c("status") == "active") & (c("started_at") < NOW - 7 * M.DAY), "abandoned").otherwise(c("status")).alias("status"))


@query(
    "session_summary",
    """SELECT session_id, count(rid) AS memories, round(avg(valence), 6) + 0.0 AS valence, round(any_value(coalesce(ended_at, 1706745600.0) - started_at), 3) AS seconds, count(DISTINCT domain) AS topics
    FROM sessions LEFT JOIN memories USING (session_id) GROUP BY session_id""",
    ("sessions", "memories"),
)
def _(spark, sf_dir):
    m = mem(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("memories"), F.avg("valence").alias("valence"), F.countDistinct("domain").alias("topics"))
    s = A.sessions(spark, sf_dir).join(m, "session_id", "left")
    return s.select("session_id", F.coalesce("memories", F.lit(0)).alias("memories"), (F.round("valence", 6) + 0.0).alias("valence"), F.round(F.coalesce("ended_at", F.lit(NOW)) - c("started_at"), 3).alias("seconds"), F.coalesce("topics", F.lit(0)).alias("topics"))


@query(
    "session_topics",
    """SELECT session_id, entity FROM (SELECT session_id, entity, row_number() OVER (PARTITION BY session_id ORDER BY entity) AS k FROM (SELECT DISTINCT session_id, entity FROM links JOIN (SELECT rid, session_id FROM memories) USING (rid))) WHERE k <= 20""",
    ("links", "memories"),
)
def _(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = A.links(spark, sf_dir).join(mem(spark, sf_dir).select("rid", "session_id"), "rid").select("session_id", "entity").distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("entity"))).where("k <= 20").select("session_id", "entity")


@query(
    "entity_profile",
    """WITH r AS (SELECT entity, session_id, domain, valence, emotion, row_number() OVER (PARTITION BY entity ORDER BY created_at, rid) * 2 > count(*) OVER (PARTITION BY entity) AS newer FROM links JOIN memories USING (rid) WHERE status = 'active'),
    e AS (SELECT entity, max_by(emotion, struct_pack(n := n, x := emotion)) AS emotion FROM (SELECT entity, emotion, count(*) AS n FROM r WHERE emotion IS NOT NULL GROUP BY 1, 2) GROUP BY entity)
    SELECT entity, mentions, sessions, domains, round(valence, 6) + 0.0 AS valence, round(trend, 6) + 0.0 AS trend, emotion FROM (SELECT entity, count(*) AS mentions, count(DISTINCT session_id) AS sessions, count(DISTINCT domain) AS domains, avg(valence) AS valence,
    avg(CASE WHEN newer THEN valence END) - avg(CASE WHEN NOT newer THEN valence END) AS trend FROM r GROUP BY entity) LEFT JOIN e USING (entity)""",
    ("links", "memories"),
)
def _(spark, sf_dir):
    p = M.entity_profiles(A.links(spark, sf_dir), mem(spark, sf_dir))
    return p.select("entity", "mentions", "sessions", "domains", (F.round("valence", 6) + 0.0).alias("valence"), (F.round("trend", 6) + 0.0).alias("trend"), "emotion")


@query(
    "relationship_depth",
    """SELECT entity, round(greatest(0, least(1, 0.25 * ln(1 + s) / ln(4) + 0.25 * ln(1 + m) / ln(20) + 0.2 * least(d / 3, 1) + 0.15 * ln(1 + k) / ln(10) + 0.15 * least(r / 4, 1))), 6) AS depth
    FROM (SELECT entity, count(DISTINCT session_id)::DOUBLE AS s, count(*)::DOUBLE AS m, count(DISTINCT domain)::DOUBLE AS d, count(DISTINCT namespace)::DOUBLE AS k, count(DISTINCT type)::DOUBLE AS r FROM links JOIN memories USING (rid) GROUP BY entity)""",
    ("links", "memories"),
)
def _(spark, sf_dir):
    rows = A.links(spark, sf_dir).join(mem(spark, sf_dir).select("rid", "session_id", "domain", "namespace", "type"), "rid")
    g = rows.groupBy("entity").agg(F.countDistinct("session_id").alias("s"), F.count("*").alias("m"), F.countDistinct("domain").alias("d"), F.countDistinct("namespace").alias("k"), F.countDistinct("type").alias("r"))
    return g.select("entity", F.round(M.relationship_depth(c("s"), c("m"), c("d"), c("k"), c("r")), 6).alias("depth"))


@query(
    "mean_embedding",
    "SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM vectors) GROUP BY label, i",
    ("vectors",),
)
def _(spark, sf_dir):
    v = M.mean_vectors(A.vectors(spark, sf_dir), "label")
    return v.select("label", F.posexplode("v").alias("i", "x")).select("label", c("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("namespace_tenants", "SELECT namespace, count(*) AS memories, min(created_at) AS first_at, max(created_at) AS last_at FROM memories GROUP BY namespace", ("memories",))
def _(spark, sf_dir):
    return mem(spark, sf_dir).groupBy("namespace").agg(F.count("*").alias("memories"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(
    "personality_traits",
    """SELECT round(((SELECT avg(valence) FROM (SELECT valence FROM memories WHERE status = 'active' ORDER BY created_at DESC, rid DESC LIMIT 100)) + 1) / 2, 6) AS warmth,
    round(least(0.9, greatest(0.1, ((SELECT count(DISTINCT domain) FROM memories WHERE status = 'active') - 1) / 4.0 * 0.7 + 0.2)) + least((SELECT count(DISTINCT entity) FROM links) / 50.0 * 0.3, 0.3), 6) AS depth,
    round(least(0.9, greatest(0.1, (SELECT count(*) FROM memories WHERE created_at > 1706745600.0 - 604800.0) / 7.0 / 10 * 0.8 + 0.1)), 6) AS energy""",
    ("memories", "links"),
)
def _(spark, sf_dir):
    m = mem(spark, sf_dir)
    act = M.active(m)
    warm = act.orderBy(F.desc("created_at"), F.desc("rid")).limit(100).agg(F.avg("valence").alias("v"))
    wide = act.agg(F.countDistinct("domain").alias("d"))
    ents = A.links(spark, sf_dir).agg(F.countDistinct("entity").alias("e"))
    fresh = m.where(c("created_at") > NOW - 7 * M.DAY).agg(F.count("*").alias("n"))
    clamp = lambda x: F.least(F.lit(0.9), F.greatest(F.lit(0.1), x))
    one = warm.crossJoin(wide).crossJoin(ents).crossJoin(fresh)  # one row each
    return one.select(F.round((c("v") + 1) / 2, 6).alias("warmth"), F.round(clamp((c("d") - 1) / 4.0 * 0.7 + 0.2) + F.least(c("e") / 50.0 * 0.3, F.lit(0.3)), 6).alias("depth"), F.round(clamp(c("n") / 7.0 / 10 * 0.8 + 0.1), 6).alias("energy"))

"""Queries of pattern mining, triggers and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions import scoring as S
from engrama.operators import memory as M
from engrama.operators import patterns as P
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
NOW = A.NOW
DECAY = "importance * pow(2, -(1706745600.0 - last_access) / half_life)"


def mem(spark, sf_dir):
    return A.memories(spark, sf_dir)


@query(
    "hour_of_week_clusters",
    """WITH h AS (SELECT CAST(floor(created_at / 3600) AS BIGINT) % 168 AS hour, count(*) AS n FROM memories WHERE status = 'active' AND type = 'episodic' GROUP BY 1), e AS (SELECT hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(168)) AS hour) LEFT JOIN h USING (hour)), s AS (SELECT avg(n) AS m, stddev_pop(n) AS d FROM e)
    SELECT hour, n, round(least(1, (n - m) / n), 6) AS confidence FROM e, s WHERE n > m + 2 * d AND n >= 2""",
    ("memories",),
)
def _(spark, sf_dir):
    return P.hour_of_week_clusters(mem(spark, sf_dir), 2).select("hour", "n", F.round("confidence", 6).alias("confidence"))


def _shift_sql(a, b, t):
    return f"""WITH m AS (SELECT greatest(-1, least(1, valence + CASE WHEN created_at > 1706745600.0 - 10 * 86400 THEN 0.8 ELSE 0 END)) AS valence, created_at FROM memories WHERE status = 'active'),
    g AS (SELECT avg(CASE WHEN age < {a} THEN valence END) AS r, avg(CASE WHEN age >= {a} AND age < {b} THEN valence END) AS o, count(CASE WHEN age < {a} THEN 1 END) AS nr, count(CASE WHEN age >= {a} AND age < {b} THEN 1 END) AS no
    FROM (SELECT valence, (1706745600.0 - created_at) / 86400 AS age FROM m)) SELECT nr AS n_recent, no AS n_baseline, round(r - o, 6) AS delta FROM g WHERE nr >= 3 AND no >= 3 AND abs(r - o) > {t}"""


def brighter(spark, sf_dir):
    """Memories whose tone has gone up in the last ten days, to have a shift."""
    up = F.when(c("created_at") > NOW - 10 * M.DAY, 0.8).otherwise(0.0)
    return mem(spark, sf_dir).withColumn("valence", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("valence") + up)))


@query("valence_trend", _shift_sql(14, 35, 0.3), ("memories",))
def _(spark, sf_dir):
    return P.valence_shift(brighter(spark, sf_dir), NOW, 14, 35).select("n_recent", "n_baseline", F.round("delta", 6).alias("delta"))


@query("valence_trend_trigger", _shift_sql(7, 37, 0.3), ("memories",))
def _(spark, sf_dir):
    return P.valence_shift(brighter(spark, sf_dir), NOW, 7, 37).select("n_recent", "n_baseline", F.round("delta", 6).alias("delta"))


@query("entity_hubs", "SELECT src AS entity, count(*) AS degree FROM edges GROUP BY src HAVING count(*) >= 100", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy(c("src").alias("entity")).agg(F.count("*").alias("degree")).where("degree >= 100")


@query("relationship_insight", "SELECT src AS entity, count(*) AS degree, round(least(count(*) / 20.0, 1), 6) AS urgency FROM edges GROUP BY src HAVING count(*) >= 5", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy(c("src").alias("entity")).agg(F.count("*").alias("degree"), F.round(F.least(F.count("*") / 20.0, F.lit(1.0)), 6).alias("urgency")).where("degree >= 5")


@query(
    "entity_bridges",
    """WITH m AS (SELECT rid, CASE WHEN domain LIKE '%1' THEN 'general' ELSE domain END AS domain FROM memories WHERE status = 'active'), c AS (SELECT entity, domain, count(*) AS n FROM links JOIN m USING (rid) WHERE domain <> 'general' GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT entity, sum(n) AS total, count(*) AS domains FROM c GROUP BY 1 HAVING count(*) >= 2),
    e AS (SELECT count(DISTINCT entity) AS every FROM links), a AS (SELECT entity, count(*) AS mentions FROM links GROUP BY 1)
    SELECT entity, domains, round(ln(domains) * entropy * greatest(ln(every / (1 + mentions)::DOUBLE), 0.1), 6) AS score FROM (SELECT entity, any_value(domains) AS domains, sum(-n / total::DOUBLE * ln(n / total::DOUBLE)) AS entropy FROM c JOIN t USING (entity) GROUP BY entity) JOIN a USING (entity), e""",
    ("links", "memories"),
)
def _(spark, sf_dir):
    m = mem(spark, sf_dir).withColumn("domain", F.when(c("domain").endswith("1"), "general").otherwise(c("domain")))
    return P.bridges(A.links(spark, sf_dir), m).select("entity", "domains", F.round("score", 6).alias("score"))


@query(
    "co_occurrence",
    "WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'supplies'), k AS (SELECT dst FROM e GROUP BY dst HAVING count(*) >= 2), f AS (SELECT * FROM e WHERE dst IN (SELECT dst FROM k)) SELECT a.src AS a, b.src AS b, count(*) AS shared FROM f a JOIN f b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 3",
    ("edges",),
)
def _(spark, sf_dir):
    return P.co_occurrence(A.edges(spark, sf_dir).where("rel = 'supplies'"))


@query("entity_anomaly", "SELECT src, rel, count(DISTINCT dst) AS objects FROM edges GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 3", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy("src", "rel").agg(F.countDistinct("dst").alias("objects")).where("objects >= 3")


@query("consolidation_trigger", "SELECT namespace, count(*) AS n, round(least(count(*) / 50.0, 1), 6) AS urgency FROM memories WHERE type = 'episodic' AND status = 'active' GROUP BY namespace HAVING count(*) >= 10", ("memories",))
def _(spark, sf_dir):
    g = M.active(mem(spark, sf_dir)).where("type = 'episodic'").groupBy("namespace").agg(F.count("*").alias("n"))
    return g.where("n >= 10").select("namespace", "n", F.round(F.least(c("n") / 50.0, F.lit(1.0)), 6).alias("urgency"))


@query("decay_triggers", f"SELECT rid, round(importance * (1 - {DECAY} / importance), 6) AS urgency FROM memories WHERE status = 'active' AND importance >= 0.6 AND {DECAY} < 0.2", ("memories",))
def _(spark, sf_dir):
    m = M.with_decay(M.active(mem(spark, sf_dir)), NOW).where("importance >= 0.6 and decay < 0.2")
    return m.select("rid", F.round(c("importance") * (1 - c("decay") / c("importance")), 6).alias("urgency"))


@query("temporal_drift", "SELECT rid, round(least(1, (1713225600.0 - created_at) / 86400 / 365), 6) AS urgency FROM memories WHERE status = 'active' AND type = 'semantic' AND created_at < 1713225600.0 - 90 * 86400 AND last_access < 1713225600.0 - 30 * 86400 ORDER BY created_at, rid LIMIT 10", ("memories",))
def _(spark, sf_dir):
    later = NOW + 75 * M.DAY  # memories are a month old at most
    return P.temporal_drift(mem(spark, sf_dir), later).select("rid", F.round("urgency", 6).alias("urgency"))


@query("conflict_escalation", "SELECT namespace, count(*) AS open, bool_or(valid_from < 9.2e8) AS old_critical FROM claims WHERE polarity = -1 GROUP BY namespace HAVING count(*) > 5", ("claims",))
def _(spark, sf_dir):
    return A.claims(spark, sf_dir).where("polarity = -1").groupBy("namespace").agg(F.count("*").alias("open"), F.bool_or(c("valid_from") < 9.2e8).alias("old_critical")).where("open > 5")


TRIGGERS = f"""t AS (SELECT 'decay' AS kind, rid, importance AS urgency FROM memories WHERE status = 'active' AND importance >= 0.8 AND {DECAY} < 0.1
    UNION ALL SELECT 'due', rid, 0.9 FROM memories WHERE status = 'active' AND due_at < 1706745600.0 + 86400 UNION ALL SELECT 'drift', rid, 0.3 FROM memories WHERE status = 'active' AND last_access < 1706745600.0 - 25 * 86400)"""


def triggers(spark, sf_dir):
    m = M.with_decay(M.active(mem(spark, sf_dir)), NOW)
    part = lambda kind, cond, u: m.where(cond).select(F.lit(kind).alias("kind"), "rid", u.alias("urgency"))
    return part("decay", (c("importance") >= 0.8) & (c("decay") < 0.1), c("importance")).unionByName(part("due", c("due_at") < NOW + M.DAY, F.lit(0.9))).unionByName(part("drift", c("last_access") < NOW - 25 * M.DAY, F.lit(0.3)))


@query("all_triggers", f"WITH {TRIGGERS} SELECT kind, rid, round(urgency, 6) AS urgency FROM t", ("memories",))
def _(spark, sf_dir):
    return triggers(spark, sf_dir).select("kind", "rid", F.round("urgency", 6).alias("urgency"))


@query("pending_triggers", f"WITH {TRIGGERS} SELECT kind, rid, round(urgency, 6) AS urgency FROM t ORDER BY urgency DESC, kind, rid LIMIT 50", ("memories",))
def _(spark, sf_dir):
    return triggers(spark, sf_dir).orderBy(F.desc("urgency"), "kind", "rid").limit(50).select("kind", "rid", F.round("urgency", 6).alias("urgency"))


@query("persist_triggers", f"WITH {TRIGGERS}, r AS (SELECT DISTINCT CASE WHEN kind = 'click' THEN 'decay' WHEN kind = 'view' THEN 'due' ELSE 'drift' END AS kind, user_id AS rid FROM ev WHERE t > 1706745600.0 - 259200) SELECT kind, rid FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.kind = t.kind AND r.rid = t.rid)", ("memories", "ev"))
def _(spark, sf_dir):
    e = A.events(spark, sf_dir).where(c("t") > NOW - 3 * M.DAY)
    recent = e.select(F.when(c("kind") == "click", "decay").when(c("kind") == "view", "due").otherwise("drift").alias("kind"), c("user_id").alias("rid")).distinct()
    return triggers(spark, sf_dir).join(recent, ["kind", "rid"], "left_anti").select("kind", "rid")


@query("expire_triggers", f"WITH {TRIGGERS} SELECT kind, rid, CASE WHEN created_at + CASE kind WHEN 'decay' THEN 7 WHEN 'due' THEN 3 ELSE 14 END * 86400 < 1706745600.0 THEN 'expired' ELSE 'pending' END AS status FROM t JOIN (SELECT rid, created_at FROM memories) USING (rid)", ("memories",))
def _(spark, sf_dir):
    days = F.when(c("kind") == "decay", 7).when(c("kind") == "due", 3).otherwise(14)
    t = triggers(spark, sf_dir).join(mem(spark, sf_dir).select("rid", "created_at"), "rid")
    return t.select("kind", "rid", F.when(c("created_at") + days * M.DAY < NOW, "expired").otherwise("pending").alias("status"))


@query("upsert_patterns", "SELECT kind AS pattern, k AS dedup_key, round(max(value), 6) AS confidence, count(*) AS occurrences, max(t) AS last_seen FROM ev GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return A.events(spark, sf_dir).groupBy(c("kind").alias("pattern"), c("k").alias("dedup_key")).agg(F.round(F.max("value"), 6).alias("confidence"), F.count("*").alias("occurrences"), F.max("t").alias("last_seen"))


@query("expire_patterns", "SELECT kind AS pattern, k AS dedup_key, CASE WHEN max(t) < 1706745600.0 - 5 * 86400 THEN 'stale' ELSE 'active' END AS status FROM ev GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return A.events(spark, sf_dir).groupBy(c("kind").alias("pattern"), c("k").alias("dedup_key")).agg(F.when(F.max("t") < NOW - 5 * M.DAY, "stale").otherwise("active").alias("status"))


@query("gossip_triggers", "SELECT p_brand AS category, count(*) AS members, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY 1 HAVING count(*) >= 3")
def _(spark, sf_dir):
    return A.table(spark, sf_dir, "part").groupBy(c("p_brand").alias("category")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds")).where("members >= 3")


@query(
    "redundancy_pairs",
    """WITH n AS (SELECT rid, v FROM memories JOIN tight USING (rid) WHERE status = 'active' ORDER BY created_at DESC, rid LIMIT 30)
    SELECT rid_a, rid_b, round(sim, 5) AS sim, CASE WHEN sim > 0.85 THEN 'redundant' ELSE 'similar' END AS kind FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS sim FROM n a JOIN n b ON a.rid < b.rid) WHERE sim > 0.65""",
    ("memories", "tight"),
)
def _(spark, sf_dir):
    from engrama.functions import vectors as V

    # dates that lie close for neighbouring ids, as those of one day do
    n = M.active(mem(spark, sf_dir)).select("rid", "created_at").join(A.tight_vectors(spark, sf_dir), "rid").orderBy(F.desc("created_at"), "rid").limit(30).select("rid", "v")
    a, b = n.toDF("rid_a", "va"), n.toDF("rid_b", "vb")
    pairs = a.join(b, F.col("rid_a") < F.col("rid_b"))  # thirty rows
    s = pairs.withColumn("sim", V.cosine_similarity(c("va"), c("vb"))).where("sim > 0.65")
    return s.select("rid_a", "rid_b", F.round("sim", 5).alias("sim"), F.when(c("sim") > 0.85, "redundant").otherwise("similar").alias("kind"))


def alike(spark, sf_dir, *names):
    """Active memories with vectors that have neighbours, in four namespaces of neighbouring ids."""
    m = M.active(mem(spark, sf_dir)).withColumn("namespace", F.concat(F.lit("g"), F.floor(c("rid") / 4) % 4))
    return m.select("rid", "namespace", "created_at", *names).join(A.tight_vectors(spark, sf_dir), "rid")


@query("topic_clusters")
def _(spark, sf_dir):
    return P.greedy_clusters(alike(spark, sf_dir), 0.8, 30.0, 3, 20)


@query("consolidate")
def _(spark, sf_dir):
    m = alike(spark, sf_dir, "type", "storage_tier", "importance", "valence", "half_life", "text").where("type in ('episodic', 'semantic') and storage_tier = 'hot'")
    cl = P.greedy_clusters(m.select("rid", "namespace", "created_at", "v"), 0.8, 30.0, 2, 20, entities=A.links(spark, sf_dir))
    out = P.consolidated(cl, m)
    return out.select("cluster", "members", F.round("importance", 6).alias("importance"), F.round("valence", 6).alias("valence"), "half_life", F.length("lead").alias("lead_chars"))


@query("consolidation_candidates", "SELECT namespace, count(*) AS n FROM memories WHERE status = 'active' AND storage_tier = 'hot' AND type IN ('episodic', 'semantic') GROUP BY namespace", ("memories",))
def _(spark, sf_dir):
    return M.active(mem(spark, sf_dir)).where("storage_tier = 'hot' and type in ('episodic', 'semantic')").groupBy("namespace").agg(F.count("*").alias("n"))


@query(
    "extractive_summary",
    r"""WITH g AS (SELECT session_id, list(text ORDER BY importance DESC, rid) FILTER (text IS NOT NULL) AS l, count(*) AS n FROM memories WHERE status = 'active' GROUP BY session_id)
    SELECT session_id, array_to_string([l[1]] || list_filter(list_transform(l[2:], lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '' AND t <> l[1]), ' | ') AS summary, n FROM g""",
    ("memories",),
)
def _(spark, sf_dir):
    return P.extractive_summary(M.active(mem(spark, sf_dir)), "session_id")


@query(
    "cross_domain_pairs",
    """WITH s AS (SELECT q.rid AS query_id, a.rid, list_dot_product(a.v, q.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(q.v, q.v)) AS sim FROM vectors a, vectors q WHERE q.rid % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, rid) AS near FROM s),
    d AS (SELECT n.query_id, n.rid, sim, a.domain AS domain_a, b.domain AS domain_b FROM n JOIN memories a ON a.rid = n.query_id JOIN memories b ON b.rid = n.rid WHERE near <= 10 AND a.domain <> b.domain)
    SELECT query_id, rid, domain_a, domain_b, round(sim, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY domain_a, domain_b ORDER BY round(sim, 9) DESC, query_id, rid) AS k FROM d) WHERE k <= 3""",
    ("memories", "vectors"),
)
def _(spark, sf_dir):
    from engrama.operators import retrieval as R

    v = A.vectors(spark, sf_dir)
    near = R.nearest(v, v.where("rid % 20 = 0").select(c("rid").alias("query_id"), "v"), 10)  # the stated query set of a search
    d = mem(spark, sf_dir).select("rid", "domain")
    rows = near.join(d.withColumnRenamed("domain", "domain_b"), "rid").join(d.select(c("rid").alias("query_id"), c("domain").alias("domain_a")), "query_id").where("domain_a <> domain_b")
    w = Window.partitionBy("domain_a", "domain_b").orderBy(F.desc(F.round("similarity", 9)), "query_id", "rid")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 3").select("query_id", "rid", "domain_a", "domain_b", F.round("similarity", 5).alias("similarity"))


@query("attention_gate", "SELECT rid, round(1 / (1 + exp(-12 * (importance - 0.25))), 6) AS gate FROM memories", ("memories",))
def _(spark, sf_dir):
    return mem(spark, sf_dir).select("rid", F.round(S.importance_gate(c("importance")), 6).alias("gate"))

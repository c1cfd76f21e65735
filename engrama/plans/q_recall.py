"""The recall queries: vector top-k, fused ranking, diversity, refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.functions import scoring as S
from engrama.functions import vectors as V
from engrama.operators import memory as M
from engrama.operators import retrieval as R
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
NOW = A.NOW
COS = "list_dot_product(a.v, q.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(q.v, q.v))"
FUSED = f"""c AS (SELECT q.rid AS query_id, m.rid, {COS} AS cos, greatest(0, {COS}) AS sim, importance * pow(2, -(1706745600.0 - last_access) / half_life) AS decay, exp(-(1706745600.0 - created_at) / 604800.0) AS rec, importance, valence
    FROM vectors a JOIN memories m USING (rid), vectors q WHERE q.rid % 20 = 0 AND m.status = 'active'),
    s AS (SELECT *, (0.5 * sim + 0.2 * decay + 0.3 * rec) * (1 + 1 / (1 + exp(-12 * (sim - 0.25))) * 0.8 * least(importance, 1)) * (1 + 0.3 * abs(valence)) AS score FROM c)"""


def query_set(spark, sf_dir):
    """The stated query set of searches: every row whose id is divisible by 20."""
    return A.vectors(spark, sf_dir).where("rid % 20 = 0").select(c("rid").alias("query_id"), "v")


def scored(spark, sf_dir, pool: int = 500):
    """Recall candidates: the nearest `pool` active memories per query with their fused score."""
    m = M.with_decay(M.active(A.memories(spark, sf_dir)).drop("text"), NOW)
    rows = A.vectors(spark, sf_dir).join(m, "rid")
    near = R.nearest(rows.select("rid", "v"), query_set(spark, sf_dir), pool)
    out = near.join(m, "rid").withColumn("sim", F.greatest(F.lit(0.0), c("similarity")))
    return out.withColumn("score", S.composite_score(c("sim"), c("decay"), c("recency"), c("importance"), c("valence")))


@query("vector_topk", f"SELECT query_id, rid, round(sim, 5) AS similarity FROM (SELECT q.rid AS query_id, a.rid, {COS} AS sim, row_number() OVER (PARTITION BY q.rid ORDER BY round({COS}, 9) DESC, a.rid) AS k FROM vectors a, vectors q WHERE q.rid % 20 = 0) WHERE k <= 10", ("vectors",))
def _(spark, sf_dir):
    return R.nearest(A.vectors(spark, sf_dir), query_set(spark, sf_dir), 10).select("query_id", "rid", F.round("similarity", 5).alias("similarity"))


@query("recall_flagship", f"WITH {FUSED} SELECT query_id, rid, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rid) AS k FROM s) WHERE k <= 10", ("memories", "vectors"))
def _(spark, sf_dir):
    # every active memory is scored where it lies; a batch hands on its best ten per query alone
    m = M.with_decay(M.active(A.memories(spark, sf_dir)).drop("text"), NOW)
    rows = A.vectors(spark, sf_dir).join(m.select("rid", "decay", "recency", "importance", "valence"), "rid")
    return R.best_scored(rows, query_set(spark, sf_dir), 10).select("query_id", "rid", F.round("score", 5).alias("score"))


POOLED = FUSED + """, p AS (SELECT s.*, m.domain, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, s.rid) AS near FROM s JOIN memories m USING (rid)), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rid) AS k FROM p WHERE near <= 50)"""


@query("recall_pool", f"WITH {POOLED} SELECT query_id, rid, round(score, 5) AS score FROM b WHERE k <= 10", ("memories", "vectors"))
def _(spark, sf_dir):
    s = scored(spark, sf_dir, 50)
    return R.top_per(s, "query_id", F.round("score", 9), "rid", 10).select("query_id", "rid", F.round("score", 5).alias("score"))


@query("recall_diverse")
def _(spark, sf_dir):
    pool = R.top_per(scored(spark, sf_dir, 100), "query_id", F.round("score", 9), "rid", 60)
    pool = pool.select("query_id", "rid", "score").join(A.vectors(spark, sf_dir).select("rid", "v"), "rid")
    return R.diversify(pool, 10)


_UNIT = "list_transform(x, lambda e: e / sqrt(list_dot_product(x, x)))"


@query(
    "recall_refine",
    f"""WITH mixed AS (SELECT rid, {_UNIT} AS v FROM (SELECT a.rid, list_transform(list_zip(a.v, b.v), lambda p: 0.4::DOUBLE * p[1] + 0.6::DOUBLE * p[2]) AS x FROM vectors a JOIN vectors b ON b.rid = a.rid + 1 WHERE a.rid % 20 = 0)),
    seen AS (SELECT q.rid AS query_id, a.rid, row_number() OVER (PARTITION BY q.rid ORDER BY round({COS}, 9) DESC, a.rid) AS k FROM vectors a, vectors q WHERE q.rid % 20 = 0),
    again AS (SELECT q.rid AS query_id, a.rid, {COS} AS sim, row_number() OVER (PARTITION BY q.rid ORDER BY round({COS}, 9) DESC, a.rid) AS k FROM vectors a, mixed q)
    SELECT query_id, rid, round(sim, 5) AS similarity FROM again WHERE k <= 10 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.query_id = again.query_id AND s.rid = again.rid AND s.k <= 5)""",
    ("vectors",),
)
def _(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("rid", "v")
    q = query_set(spark, sf_dir)
    refine = v.where("rid % 20 = 1").select((c("rid") - 1).alias("query_id"), c("v").alias("r"))
    mixed = q.join(refine, "query_id").select("query_id", V.blend(c("v"), c("r"), 0.6).alias("v"))
    seen = R.nearest(v, q, 5).select("query_id", "rid")
    return R.nearest(v, mixed, 10).join(seen, ["query_id", "rid"], "left_anti").select("query_id", "rid", F.round("similarity", 5).alias("similarity"))


@query(
    "recall_confidence",
    f"""WITH {POOLED}, g AS (SELECT query_id, max(sim) AS top, max(score) - min(score) AS gap, count(DISTINCT domain) AS kinds, count(*) AS n FROM b WHERE k <= 10 GROUP BY 1), h AS (SELECT query_id, 0.35 * top + 0.25 * least(1, gap) + 0.2 * least(1, kinds / 4.0) + 0.2 * n / 10.0 AS v FROM g)
    SELECT query_id, round(v, 5) AS confidence, v < 0.6 AS hint FROM h""",
    ("memories", "vectors"),
)
def _(spark, sf_dir):
    s = R.top_per(scored(spark, sf_dir, 50), "query_id", F.round("score", 9), "rid", 10)
    g = s.groupBy("query_id").agg(F.max("sim").alias("top"), (F.max("score") - F.min("score")).alias("gap"), F.countDistinct("domain").alias("sources"), F.count("*").alias("n"))
    conf = 0.35 * c("top") + 0.25 * F.least(c("gap"), F.lit(1.0)) + 0.2 * F.least(c("sources") / 4, F.lit(1.0)) + 0.2 * c("n") / 10
    return g.select("query_id", F.round(conf, 5).alias("confidence"), (conf < 0.6).alias("hint"))


@query(
    "importance_fallback",
    f"WITH {FUSED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, rid) AS k FROM c) SELECT query_id, rid, round(sim, 5) AS similarity FROM p WHERE k > 10 AND importance >= 0.7 AND sim >= 0.2",
    ("memories", "vectors"),
)
def _(spark, sf_dir):
    from engrama.operators import recall as L

    m = M.active(A.memories(spark, sf_dir)).select("rid", "importance")
    rows = A.vectors(spark, sf_dir).select("rid", "v").join(m, "rid")
    return L.candidates(rows, query_set(spark, sf_dir), 10, 0.7, 0.2).where("via = 'important'").select("query_id", "rid", F.round("similarity", 5).alias("similarity"))


@query("valence_scan", "SELECT rid, round(0.2 * abs(valence) * importance, 6) AS boost FROM memories WHERE status = 'active' AND valence <= -0.4 AND importance >= 0.5 ORDER BY round(abs(valence) * importance, 9) DESC, rid LIMIT 30", ("memories",))
def _(spark, sf_dir):
    m = M.active(A.memories(spark, sf_dir)).where("valence <= -0.4 and importance >= 0.5")
    return m.orderBy(F.desc(F.round(F.abs("valence") * c("importance"), 9)), "rid").limit(30).select("rid", F.round(0.2 * F.abs("valence") * c("importance"), 6).alias("boost"))


@query("cold_fallback", "SELECT rid, round(0.15 * importance, 6) AS boost FROM memories WHERE status = 'active' AND access_count = 0 AND contains(lower(text), 'the') ORDER BY importance DESC, rid LIMIT 30", ("memories",))
def _(spark, sf_dir):
    m = M.active(A.memories(spark, sf_dir)).where((c("access_count") == 0) & F.contains(F.lower("text"), F.lit("the")))
    return m.orderBy(F.desc("importance"), "rid").limit(30).select("rid", F.round(0.15 * c("importance"), 6).alias("boost"))


@query("candidate_union", "SELECT rid, min(phase) AS phase FROM (SELECT rid, 1 AS phase FROM memories WHERE importance >= 0.9 UNION ALL SELECT rid, 2 FROM memories WHERE access_count = 0 UNION ALL SELECT rid, 3 FROM memories WHERE abs(valence) >= 0.8) GROUP BY rid", ("memories",))
def _(spark, sf_dir):
    m = A.memories(spark, sf_dir)
    part = lambda cond, k: m.where(cond).select("rid", F.lit(k).alias("phase"))
    return part("importance >= 0.9", 1).unionByName(part("access_count = 0", 2)).unionByName(part("abs(valence) >= 0.8", 3)).groupBy("rid").agg(F.min("phase").alias("phase"))


def texts(spark, sf_dir):
    """Queries with words: the stated query set, asking with the start of its own memory's text."""
    d = A.table(spark, sf_dir, "documents").select(c("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", "[ \\n]+"), 1, 12), " ").alias("text"))
    return query_set(spark, sf_dir).join(d, "query_id").select("query_id", "text", "v")


@query("recall_full")
def _(spark, sf_dir):
    from engrama.operators.recall import recall

    hits = recall(A.memories(spark, sf_dir), A.vectors(spark, sf_dir), A.links(spark, sf_dir), A.word_edges(spark, sf_dir), texts(spark, sf_dir), NOW)
    return hits.select("query_id", "rid", F.round("score", 5).alias("score"), F.array_join("why", ",").alias("why"), "rank")


@query("recall_response")
def _(spark, sf_dir):
    from engrama.operators.recall import recall, respond

    hits = recall(A.memories(spark, sf_dir), A.vectors(spark, sf_dir), A.links(spark, sf_dir), A.word_edges(spark, sf_dir), texts(spark, sf_dir), NOW, diverse=False)
    return respond(hits).select("query_id", F.round("confidence", 5).alias("confidence"), "hint")


@query("reason_pipeline")
def _(spark, sf_dir):
    from engrama.plans.reason import Reason

    seeds = spark.createDataFrame([("The", 1.0), ("Les", 0.5)], "entity string, activation double")
    words = A.links(spark, sf_dir)
    edges = words.where("entity in ('The', 'Les')").select(c("entity").alias("src"), F.lit("in").alias("rel"), F.concat(F.lit("m"), "rid").alias("dst"), F.lit(1.0).alias("weight"))
    r = Reason(NOW, A.memories(spark, sf_dir).drop("text"), edges=edges, links=words, events=A.events(spark, sf_dir))
    return r.attend(seeds).constrain("certainty >= 0.2").recall(50).assess().compare("0.1 * valence").execute().select("rid", "namespace", F.round("score", 6).alias("score"), "rank", F.round("assessed", 6).alias("assessed"))

"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.operators import graph as G
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
UND = "u AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
HOP1 = "h1 AS (SELECT seed, dst AS entity, max(weight) AS weight FROM (SELECT entity AS seed, dst, u.weight FROM seeds JOIN u ON u.src = entity) WHERE dst <> seed GROUP BY 1, 2)"
HOP2 = "h2 AS (SELECT seed, dst AS entity, max(h1.weight * u.weight) AS weight FROM h1 JOIN u ON u.src = h1.entity WHERE dst <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.entity = u.dst) GROUP BY 1, 2)"
SEEDS = "seeds AS (SELECT unnest(['s1', 's2', 'c7']) AS entity)"


def seeds(spark):
    return spark.createDataFrame([("s1",), ("s2",), ("c7",)], "entity string")


@query("graph_adjacency", "SELECT src, count(*) AS degree, round(sum(weight), 6) AS weight FROM edges GROUP BY src", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 6).alias("weight"))


@query("get_edges", "SELECT src, rel, dst, weight FROM edges WHERE src = 's1' OR dst = 'p5'", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).where("src = 's1' or dst = 'p5'").select("src", "rel", "dst", "weight")


@query("search_entities", "SELECT DISTINCT dst AS entity FROM edges WHERE dst LIKE 'p10%' ORDER BY entity LIMIT 50", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).where(c("dst").like("p10%")).select(c("dst").alias("entity")).distinct().orderBy("entity").limit(50)


@query("expand_bfs", f"WITH {UND}, {SEEDS}, {HOP1}, {HOP2} SELECT entity AS seed, entity, 0 AS hops, 1.0::DOUBLE AS weight FROM seeds UNION ALL SELECT seed, entity, 1, round(weight, 6) FROM h1 UNION ALL SELECT seed, entity, 2, round(weight, 6) FROM h2", ("edges",))
def _(spark, sf_dir):
    return G.expand(A.edges(spark, sf_dir), seeds(spark), 2).select("seed", "entity", "hops", F.round("weight", 6).alias("weight"))


def _near(base):
    return f"""WITH {UND}, {SEEDS}, {HOP1}, r AS (SELECT entity AS seed, entity, 0 AS hops, 1.0::DOUBLE AS weight FROM seeds UNION ALL SELECT seed, entity, 1, weight FROM h1),
    l AS (SELECT o_orderkey AS rid, 'c' || o_custkey AS entity FROM orders) SELECT seed, rid, round(max(weight / pow({base}, hops)), 6) AS proximity FROM r JOIN l USING (entity) GROUP BY 1, 2"""


def _proximity(spark, sf_dir, base):
    links = A.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("rid"), F.concat(F.lit("c"), c("o_custkey")).alias("entity"))
    return G.proximity(G.expand(A.edges(spark, sf_dir), seeds(spark), 1), links, base).select("seed", "rid", F.round("proximity", 6).alias("proximity"))


@query("graph_proximity", _near(4), ("edges",))
def _(spark, sf_dir):
    return _proximity(spark, sf_dir, 4.0)


@query("graph_proximity_legacy", _near(2), ("edges",))
def _(spark, sf_dir):
    return _proximity(spark, sf_dir, 2.0)


@query("entities_for_memories", "SELECT DISTINCT entity FROM links WHERE rid IN (SELECT rid FROM memories WHERE status = 'active' AND importance >= 0.9)", ("links", "memories"))
def _(spark, sf_dir):
    m = A.memories(spark, sf_dir).where("status = 'active' and importance >= 0.9").select("rid")
    return A.links(spark, sf_dir).join(m, "rid", "left_semi").select("entity").distinct()


@query("memories_for_entities", "SELECT DISTINCT rid FROM links WHERE entity IN (SELECT entity FROM links WHERE rid = 3)", ("links",))
def _(spark, sf_dir):
    links = A.links(spark, sf_dir)
    return links.join(links.where("rid = 3").select("entity"), "entity", "left_semi").select("rid").distinct()


@query("entity_matches_query", "SELECT DISTINCT entity FROM links WHERE lower(entity) IN ('the', 'of', 'and', 'les', 'der')", ("links",))
def _(spark, sf_dir):
    return A.links(spark, sf_dir).where(F.lower("entity").isin("the", "of", "and", "les", "der")).select("entity").distinct()


@query("shared_entity_counts", "SELECT p.rid AS rid_a, p.rid + d AS rid_b, count(*) AS shared FROM memories p, (SELECT unnest([1, 2, 7]) AS d) JOIN links a ON a.rid = p.rid JOIN links b ON b.rid = p.rid + d AND b.entity = a.entity GROUP BY 1, 2", ("memories", "links"))
def _(spark, sf_dir):
    # asked of stated pairs: each memory and three others
    pairs = A.memories(spark, sf_dir).select(c("rid").alias("rid_a"), F.explode(F.array(c("rid") + 1, c("rid") + 2, c("rid") + 7)).alias("rid_b"))
    return G.shared_entities(pairs, A.links(spark, sf_dir))


@query("unlinked_memories", "SELECT rid FROM memories WHERE status = 'active' AND rid NOT IN (SELECT rid FROM links)", ("memories", "links"))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).where("status = 'active'").select("rid").join(A.links(spark, sf_dir), "rid", "left_anti")


@query("lww_edges", "SELECT src, dst, max_by(weight, struct_pack(a := created_at, b := rel)) AS weight, max(created_at) AS created_at FROM edges GROUP BY src, dst", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy("src", "dst").agg(F.max_by("weight", F.struct("created_at", "rel")).alias("weight"), F.max("created_at").alias("created_at"))


@query(
    "resolve_alias",
    """WITH a AS (SELECT 's' || s_suppkey AS alias, CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE 'ns' || (s_suppkey % 3) END AS namespace, s_name AS entity FROM supplier WHERE s_suppkey % 4 <> 3)
    SELECT src, namespace, coalesce((SELECT entity FROM a WHERE a.alias = src AND a.namespace = c.namespace), (SELECT entity FROM a WHERE a.alias = src AND a.namespace = '*'), src) AS canonical FROM (SELECT DISTINCT src, namespace FROM claims) c""",
    ("claims",),
)
def _(spark, sf_dir):
    k = c("s_suppkey")
    aliases = A.table(spark, sf_dir, "supplier").where(k % 4 != 3).select(F.concat(F.lit("s"), k).alias("alias"), F.when(k % 2 == 0, "*").otherwise(F.concat(F.lit("ns"), k % 3)).alias("namespace"), c("s_name").alias("entity"))
    rows = A.claims(spark, sf_dir).select("src", "namespace").distinct()
    return G.resolve_alias(rows, aliases, "src", c("namespace")).select("src", "namespace", "canonical")


@query("proposition_ids", "SELECT DISTINCT sha256(src || '|' || rel || '|' || dst || '|' || namespace) AS proposition, src, rel, dst, namespace FROM claims", ("claims",))
def _(spark, sf_dir):
    return A.claims(spark, sf_dir).select(F.sha2(F.concat_ws("|", "src", "rel", "dst", "namespace"), 256).alias("proposition"), "src", "rel", "dst", "namespace").distinct()


@query(
    "spread_activation",
    f"""WITH {UND}, fan AS (SELECT src, sum(weight) AS fan FROM u GROUP BY src), fl AS (SELECT u.src, dst, weight / fan AS share FROM u JOIN fan ON fan.src = u.src),
    w0 AS (SELECT 's1' AS entity, 1.0::DOUBLE AS a UNION ALL SELECT 'c7', 0.8::DOUBLE), w1 AS (SELECT dst AS entity, sum(a * share) * 0.5 AS a FROM w0 JOIN fl ON src = entity GROUP BY dst HAVING sum(a * share) * 0.5 >= 0.0001),
    w2 AS (SELECT dst AS entity, sum(a * share) * 0.5 AS a FROM w1 JOIN fl ON src = entity GROUP BY dst HAVING sum(a * share) * 0.5 >= 0.0001)
    SELECT entity, round(sum(a), 7) AS activation FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY entity""",
    ("edges",),
)
def _(spark, sf_dir):
    start = spark.createDataFrame([("s1", 1.0), ("c7", 0.8)], "entity string, activation double")
    return G.spread(A.edges(spark, sf_dir), start, threshold=0.0001).select("entity", F.round("activation", 7).alias("activation"))


@query("in_edges_by_kind", "SELECT dst, count(*) FILTER (rel = 'supplies') AS supporters, count(*) FILTER (rel = 'buys') AS buyers FROM edges GROUP BY dst", ("edges",))
def _(spark, sf_dir):
    return A.edges(spark, sf_dir).groupBy("dst").agg(F.count_if(c("rel") == "supplies").alias("supporters"), F.count_if(c("rel") == "buys").alias("buyers"))


@query("topological_layers", "SELECT 'r' || r_regionkey AS node, 0 AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer")
def _(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    edges = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(t("customer").select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    return G.layers(edges)[0]

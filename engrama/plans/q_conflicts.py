"""Queries of conflict scans, resolution and substitution categories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
KEY = ["src", "rel", "dst", "namespace"]
#: Conflicts: propositions with claims of both polarities, typed by the part and prioritised by type.
CONFLICTS = """k AS (SELECT src, rel, dst, namespace, min(source_rid) FILTER (polarity = 1) AS rid_a, min(source_rid) FILTER (polarity = -1) AS rid_b, min(created_at) AS detected_at, ['identity_fact', 'preference', 'temporal', 'minor'][1 + CAST(substr(dst, 2) AS BIGINT) % 4] AS type
    FROM claims GROUP BY src, rel, dst, namespace HAVING min(polarity) = -1 AND max(polarity) = 1)"""
RANK = "CASE type WHEN 'identity_fact' THEN 0 WHEN 'preference' THEN 1 WHEN 'temporal' THEN 1 ELSE 3 END"


def conflicts(spark, sf_dir):
    side = lambda p: F.min(F.when(c("polarity") == p, c("source_rid")))
    g = A.claims(spark, sf_dir).groupBy(*KEY).agg(side(1).alias("rid_a"), side(-1).alias("rid_b"), F.min("created_at").alias("detected_at"))
    kind = F.element_at(F.array(*map(F.lit, ("identity_fact", "preference", "temporal", "minor"))), (F.substring("dst", 2, 20).cast("long") % 4 + 1).cast("int"))
    return g.where("rid_a is not null and rid_b is not null").withColumn("type", kind)


@query("scan_conflicts", f"WITH {CONFLICTS} SELECT * FROM k", ("claims",))
def _(spark, sf_dir):
    return conflicts(spark, sf_dir)


@query("get_conflicts", f"WITH {CONFLICTS} SELECT src, dst, type, detected_at FROM k WHERE namespace = 'ns1' ORDER BY {RANK}, detected_at DESC, src, dst LIMIT 50", ("claims",))
def _(spark, sf_dir):
    rank = F.when(c("type") == "identity_fact", 0).when(c("type").isin("preference", "temporal"), 1).otherwise(3)
    return conflicts(spark, sf_dir).where("namespace = 'ns1'").orderBy(rank, F.desc("detected_at"), "src", "dst").limit(50).select("src", "dst", "type", "detected_at")


@query("conflict_counts", f"WITH {CONFLICTS} SELECT type, namespace, count(*) AS n FROM k GROUP BY 1, 2", ("claims",))
def _(spark, sf_dir):
    return conflicts(spark, sf_dir).groupBy("type", "namespace").agg(F.count("*").alias("n"))


@query("conflict_sides", f"WITH {CONFLICTS} SELECT rid_a AS rid FROM k UNION SELECT rid_b FROM k", ("claims",))
def _(spark, sf_dir):
    k = conflicts(spark, sf_dir)
    return k.select(c("rid_a").alias("rid")).union(k.select("rid_b")).distinct()


@query("conflicted_claims", f"WITH {CONFLICTS} SELECT src, dst, extractor, polarity FROM claims WHERE source_rid IN (SELECT rid_a FROM k UNION SELECT rid_b FROM k)", ("claims",))
def _(spark, sf_dir):
    k = conflicts(spark, sf_dir)
    sides = k.select(c("rid_a").alias("source_rid")).union(k.select("rid_b")).distinct()
    return A.claims(spark, sf_dir).join(sides, "source_rid", "left_semi").select("src", "dst", "extractor", "polarity")


@query(
    "conflict_semi_join",
    f"WITH {CONFLICTS} SELECT src, dst FROM k WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey IN (rid_a, rid_b) AND o_orderstatus = 'F')",
    ("claims",),
)
def _(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    k = conflicts(spark, sf_dir)
    a = k.join(o, k["rid_a"] == o["o_orderkey"], "left_semi").select("src", "dst", "namespace")
    b = k.join(o, k["rid_b"] == o["o_orderkey"], "left_semi").select("src", "dst", "namespace")
    return a.union(b).distinct().select("src", "dst")  # an OR of two sides as two hash joins


@query("resolve_conflicts", f"WITH {CONFLICTS} SELECT src, dst, CASE WHEN rid_a % 4 = 0 THEN 'keep_a' WHEN rid_a % 4 = 1 THEN 'keep_b' WHEN rid_a % 4 = 2 THEN 'keep_both' ELSE 'dismissed' END AS resolution, CASE WHEN rid_a % 4 = 0 THEN rid_b WHEN rid_a % 4 = 1 THEN rid_a ELSE -1 END AS tombstoned FROM k", ("claims",))
def _(spark, sf_dir):
    r = c("rid_a") % 4
    return conflicts(spark, sf_dir).select("src", "dst", F.when(r == 0, "keep_a").when(r == 1, "keep_b").when(r == 2, "keep_both").otherwise("dismissed").alias("resolution"), F.when(r == 0, c("rid_b")).when(r == 1, c("rid_a")).otherwise(F.lit(-1).cast("long")).alias("tombstoned"))


@query("succession", "SELECT src, dst, extractor, polarity, valid_from, lead(valid_from) OVER (PARTITION BY src, rel, namespace, extractor, polarity ORDER BY valid_from, dst) AS superseded_at FROM claims", ("claims",))
def _(spark, sf_dir):
    w = Window.partitionBy("src", "rel", "namespace", "extractor", "polarity").orderBy("valid_from", "dst")
    return A.claims(spark, sf_dir).select("src", "dst", "extractor", "polarity", "valid_from", F.lead("valid_from").over(w).alias("superseded_at"))


@query("categories", "SELECT p_type AS category, count(*) AS members, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def _(spark, sf_dir):
    return A.table(spark, sf_dir, "part").groupBy(c("p_type").alias("category")).agg(F.count("*").alias("members"), F.countDistinct("p_brand").alias("brands"))


@query("category_members", "SELECT p_type AS category, p_partkey AS member, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_type), 6) AS confidence FROM part")
def _(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(c("p_type").alias("category"), c("p_partkey").alias("member"), F.round(c("p_retailprice") / F.max("p_retailprice").over(Window.partitionBy("p_type")), 6).alias("confidence"))


@query("category_substitution", "SELECT l_orderkey, p_type AS category, count(DISTINCT p_partkey) AS members FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 1")
def _(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    return rows.groupBy("l_orderkey", c("p_type").alias("category")).agg(F.countDistinct("p_partkey").alias("members")).where("members > 1")


@query(
    "entity_substitution",
    r"""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, array_to_string(list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))), ' ') AS only_a, array_to_string(list_sort(list_filter(b.w, lambda x: NOT list_contains(a.w, x))), ' ') AS only_b FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""",
)
def _(spark, sf_dir):
    t = A.table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    a, b = t.toDF("a", "wa"), t.toDF("b", "wb")
    only = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return a.join(b, c("b") == c("a") + 1).select("a", "b", only(c("wa"), c("wb")).alias("only_a"), only(c("wb"), c("wa")).alias("only_b"))


@query("reset_categories", "SELECT p_type AS category, p_partkey AS member FROM part WHERE p_size <= 25")
def _(spark, sf_dir):
    return A.table(spark, sf_dir, "part").where("p_size <= 25").select(c("p_type").alias("category"), c("p_partkey").alias("member"))

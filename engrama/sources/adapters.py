"""Model tables over the raw tables: memories, vectors, edges, claims, links, sessions, events, op-log, feedback.

Every rule uses integer arithmetic on keys, so each model table has one meaning in Spark and in SQL; CTES holds the SQL.
`NOW` is the reference time of all queries: nothing reads a wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600.0
DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per document; without its text unless a query selects it, so that scans stay narrow."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    created = F.lit(NOW) - 3600.0 * (i * 7 % 720)
    return d.select(
        i.alias("rid"), F.element_at(F.array(F.lit("episodic"), F.lit("semantic"), F.lit("procedural")), (i % 3 + 1).cast("int")).alias("type"), "text",
        F.col("source").alias("domain"), F.col("lang").alias("namespace"), ((i * 37 % 100) / 100.0).alias("importance"), ((i * 53 % 201 - 100) / 100.0).alias("valence"),
        (DAY * (1 + i % 14)).alias("half_life"), created.alias("created_at"), (created + 1800.0 * (i % 24)).alias("last_access"), (i % 7).alias("access_count"),
        ((i * 11 % 100) / 100.0).alias("certainty"), F.when(i % 17 == 0, "consolidated").when(i % 19 == 0, "tombstoned").otherwise("active").alias("status"),
        F.when(i % 5 == 0, F.lit(NOW) + DAY * (i % 30)).alias("due_at"), F.when(i % 23 == 0, "cold").otherwise("hot").alias("storage_tier"), (i * 13 % 100).alias("session_id"),
        F.when(i % 4 == 0, F.element_at(F.array(F.lit("joy"), F.lit("calm"), F.lit("fear")), (i % 3 + 1).cast("int"))).alias("emotion"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def tight_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn towards that of the first of each four ids, so that memories of one kind exist."""
    v = vectors(spark, sf_dir).select("rid", "v")
    lead = v.select(F.col("rid").alias("lead"), F.col("v").alias("g"))
    rows = v.join(lead, F.col("rid") - F.col("rid") % 4 == F.col("lead"))
    return rows.select("rid", F.zip_with("v", "g", lambda x, y: 0.3 * x + 0.7 * y).alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplies and buys edges, one per pair, weighted by how often they occur."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = F.concat(F.lit("p"), F.col("l_partkey"))
    supplies = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.lit("supplies").alias("rel"), part.alias("dst"), F.col("l_shipdate").alias("at"))
    buys = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.lit("buys").alias("rel"), part.alias("dst"), F.col("l_shipdate").alias("at"))
    rows = supplies.unionByName(buys).groupBy("src", "rel", "dst").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return rows.select("src", "rel", "dst", F.least(F.lit(1.0), F.col("n") / 10.0).alias("weight"), F.unix_seconds(F.col("at").cast("timestamp")).cast("double").alias("created_at"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims 'supplier supplies part' by extractor, polarity and batch, with validity, lineage and modality."""
    li = table(spark, sf_dir, "lineitem")
    part, batch = (F.col("l_partkey") % 60).alias("part"), (F.col("l_orderkey") % 3).alias("batch")
    rows = li.groupBy("l_suppkey", part, batch, F.col("l_linestatus").alias("extractor"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("polarity")).agg(
        F.min("l_shipdate").alias("f"), F.max("l_shipdate").alias("t"), F.array_sort(F.collect_set((F.col("l_orderkey") % 7).cast("string"))).alias("lineage"), F.min("l_linenumber").alias("line"), F.min("l_quantity").alias("q"), F.min("l_orderkey").alias("source"), F.max("l_discount").alias("d")
    )
    return rows.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.lit("supplies").alias("rel"), F.concat(F.lit("p"), F.col("part")).alias("dst"), "extractor", "polarity", F.concat(F.lit("ns"), F.col("part") % 3).alias("namespace"),
        F.concat_ws("/", "l_suppkey", "part", "batch", "extractor", "polarity").alias("claim_id"),
        F.unix_seconds(F.col("f").cast("timestamp")).cast("double").alias("valid_from"), F.when(F.col("t") > F.col("f"), F.unix_seconds(F.col("t").cast("timestamp")).cast("double")).alias("valid_to"), "lineage", (F.col("line") % 6).alias("modality"), (F.col("q") < 10).alias("self_generated"),
        (F.col("source") % 40 + 1).alias("source_rid"), (0.5 + 5 * F.col("d")).alias("weight"), F.unix_seconds(F.col("f").cast("timestamp")).cast("double").alias("created_at"),
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reasoning move per order: its type by priority, its outcome by status and key, open ones with a horizon."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("decomposition", "aggregate_back", "source_audit", "compression", "hypothesis_generation", "negate_and_test", "analogy")))
    outcome = F.when(F.col("o_orderstatus") == "F", F.element_at(F.array(*map(F.lit, ("corroborated", "retracted", "harmful_side_effect", "corroborated"))), (i % 4 + 1).cast("int")))
    return o.select(i.alias("move_id"), F.element_at(kinds, (i % 7 + 1).cast("int")).alias("move_type"), F.concat(F.lit("v"), i % 2).alias("version"), F.lit("default").alias("regime"), outcome.alias("outcome"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_at"), F.when(i % 3 == 0, 86400.0 * (i % 3000)).alias("horizon"))


def move_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims an order's moves take and make: its lines name claims, every third line an output."""
    li = table(spark, sf_dir, "lineitem")
    polarity = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    claim = F.concat_ws("/", "l_suppkey", F.col("l_partkey") % 60, F.col("l_orderkey") % 3, "l_linestatus", polarity)
    return li.select((F.col("l_orderkey") - F.col("l_orderkey") % 2).alias("move_id"), claim.alias("claim_id"), F.when(F.col("l_linenumber") % 3 == 0, "output").otherwise("input").alias("role")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, entity): a memory's capitalised words, of two letters or more."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rid"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[ \n])([A-Z][a-z]+)")))).alias("entity"))


def word_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between capitalised words that follow one another in a text, weighted by how often they do."""
    d = table(spark, sf_dir, "documents")
    w = d.select(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[ \n])([A-Z][a-z]+)"))).alias("w")).where(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("src"), F.slice("w", F.lit(2), F.size("w") - 1).alias("dst"))).alias("p")).select("p.src", "p.dst")
    return pairs.groupBy("src", "dst").agg(F.least(F.lit(1.0), F.count("*") / 10.0).alias("weight")).select("src", F.lit("before").alias("rel"), "dst", "weight")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "user_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sessions: one per conversation, each with a client, a start, and an end unless it is open."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("turns"))
    i = F.col("session_id")
    start = F.lit(NOW) - 7200.0 * (i % 360)
    return c.select("session_id", (i % 4).alias("client"), start.alias("started_at"), F.when(i % 6 != 0, start + 60.0 * F.col("turns")).alias("ended_at"), "turns", F.when(i % 6 == 0, "active").otherwise("ended").alias("status"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations: kind by event type, target by user, clock (ms, counter, node)."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in (("click", "relate"), ("error", "forget"), ("purchase", "record"), ("signup", "consolidate"), ("view", "pattern")) for x in pair])
    return e.select(F.col("event_id").alias("op_id"), kind[F.col("event_type")].alias("op_type"), F.col("user_id").alias("target"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_id") % 4).alias("counter"), (F.col("user_id") % 3).alias("node"), F.col("value").alias("payload"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance labels per query group with the scores that were shown."""
    x = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return x.select(i.alias("rid"), (i % 20).alias("query_id"), (F.col("quality") == 1).alias("relevant"), ((i * 29 % 1000) / 1000.0).alias("score"))


CTES = {
    "memories": """memories AS (SELECT doc_id AS rid, ['episodic', 'semantic', 'procedural'][1 + doc_id % 3] AS type, text, source AS domain, lang AS namespace,
        (doc_id * 37 % 100) / 100.0::DOUBLE AS importance, (doc_id * 53 % 201 - 100) / 100.0::DOUBLE AS valence, 86400.0::DOUBLE * (1 + doc_id % 14) AS half_life,
        1706745600.0::DOUBLE - 3600.0::DOUBLE * (doc_id * 7 % 720) AS created_at, 1706745600.0::DOUBLE - 3600.0::DOUBLE * (doc_id * 7 % 720) + 1800.0::DOUBLE * (doc_id % 24) AS last_access,
        doc_id % 7 AS access_count, (doc_id * 11 % 100) / 100.0::DOUBLE AS certainty,
        CASE WHEN doc_id % 17 = 0 THEN 'consolidated' WHEN doc_id % 19 = 0 THEN 'tombstoned' ELSE 'active' END AS status,
        CASE WHEN doc_id % 5 = 0 THEN 1706745600.0::DOUBLE + 86400.0::DOUBLE * (doc_id % 30) END AS due_at,
        CASE WHEN doc_id % 23 = 0 THEN 'cold' ELSE 'hot' END AS storage_tier, doc_id * 13 % 100 AS session_id,
        CASE WHEN doc_id % 4 = 0 THEN ['joy', 'calm', 'fear'][1 + doc_id % 3] END AS emotion FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS rid, embedding::DOUBLE[] AS v, label FROM embeddings)",
    "tight": "tight AS (SELECT a.vec_id AS rid, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: 0.3::DOUBLE * p[1] + 0.7::DOUBLE * p[2]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 4)",
    "edges": """edges AS (SELECT src, rel, dst, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS weight, epoch(max(seen_at))::DOUBLE AS created_at FROM (
        SELECT 's' || l_suppkey AS src, 'supplies' AS rel, 'p' || l_partkey AS dst, l_shipdate AS seen_at FROM lineitem
        UNION ALL SELECT 'c' || o_custkey, 'buys', 'p' || l_partkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY src, rel, dst)""",
    "claims": """claims AS (SELECT 's' || l_suppkey AS src, 'supplies' AS rel, 'p' || part AS dst, extractor, polarity, 'ns' || (part % 3) AS namespace,
        l_suppkey || '/' || part || '/' || batch || '/' || extractor || '/' || polarity AS claim_id,
        epoch(f)::DOUBLE AS valid_from, CASE WHEN t > f THEN epoch(t)::DOUBLE END AS valid_to, lineage, line % 6 AS modality, q < 10 AS self_generated, source % 40 + 1 AS source_rid, 0.5::DOUBLE + 5 * d AS weight, epoch(f)::DOUBLE AS created_at
        FROM (SELECT l_suppkey, l_partkey % 60 AS part, l_orderkey % 3 AS batch, l_linestatus AS extractor, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS polarity, min(l_shipdate) AS f, max(l_shipdate) AS t,
        list_sort(list_distinct(list((l_orderkey % 7)::VARCHAR))) AS lineage, min(l_linenumber) AS line, min(l_quantity) AS q, min(l_orderkey) AS source, max(l_discount) AS d FROM lineitem GROUP BY 1, 2, 3, 4, 5))""",
    "moves": """moves AS (SELECT o_orderkey AS move_id, ['decomposition', 'aggregate_back', 'source_audit', 'compression', 'hypothesis_generation', 'negate_and_test', 'analogy'][1 + o_orderkey % 7] AS move_type, 'v' || (o_orderkey % 2) AS version, 'default' AS regime,
        CASE WHEN o_orderstatus = 'F' THEN ['corroborated', 'retracted', 'harmful_side_effect', 'corroborated'][1 + o_orderkey % 4] END AS outcome, epoch(o_orderdate)::DOUBLE AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 86400.0::DOUBLE * (o_orderkey % 3000) END AS horizon FROM orders)""",
    "move_io": """move_io AS (SELECT DISTINCT l_orderkey - l_orderkey % 2 AS move_id, l_suppkey || '/' || (l_partkey % 60) || '/' || (l_orderkey % 3) || '/' || l_linestatus || '/' || CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS claim_id, CASE WHEN l_linenumber % 3 = 0 THEN 'output' ELSE 'input' END AS role FROM lineitem)""",
    "links": """links AS (SELECT DISTINCT rid, entity FROM (SELECT doc_id AS rid, unnest(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]+)', 1)) AS entity FROM documents))""",
    "ev": "ev AS (SELECT event_id, ts, epoch_us(ts) / 1e6::DOUBLE AS t, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "sessions": """sessions AS (SELECT session_id, session_id % 4 AS client, 1706745600.0::DOUBLE - 7200.0::DOUBLE * (session_id % 360) AS started_at,
        CASE WHEN session_id % 6 <> 0 THEN 1706745600.0::DOUBLE - 7200.0::DOUBLE * (session_id % 360) + 60.0::DOUBLE * turns END AS ended_at, turns, CASE WHEN session_id % 6 = 0 THEN 'active' ELSE 'ended' END AS status
        FROM (SELECT conv_id AS session_id, count(*) AS turns FROM conversations GROUP BY conv_id))""",
    "oplog": """oplog AS (SELECT event_id AS op_id, CASE event_type WHEN 'click' THEN 'relate' WHEN 'error' THEN 'forget' WHEN 'purchase' THEN 'record' WHEN 'signup' THEN 'consolidate' WHEN 'view' THEN 'pattern' END AS op_type,
        user_id AS target, epoch_us(ts) // 1000 AS ms, event_id % 4 AS counter, user_id % 3 AS node, value AS payload FROM events)""",
    "feedback": "feedback AS (SELECT doc_id AS rid, doc_id % 20 AS query_id, quality = 1 AS relevant, (doc_id * 29 % 1000) / 1000.0::DOUBLE AS score FROM labels)",
}


def with_ctes(uses: tuple[str, ...], sql: str) -> str:
    if not uses:
        return sql
    head = ",\n".join(CTES[u] for u in uses)
    body = sql.strip()
    return f"WITH {head}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}"

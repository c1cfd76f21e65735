"""Queries of replication: incremental extraction and order-independent folds of the op-log."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.operators import memory as M
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
CLOCK = "struct_pack(a := ms, b := counter, c := node, d := op_id)"


def hlc():
    return F.struct("ms", "counter", "node", "op_id")



def log(spark, sf_dir):
    return A.oplog(spark, sf_dir)


@query("ops_since", "SELECT op_id, op_type, ms FROM oplog WHERE (ms > 1705500000000 OR (ms = 1705500000000 AND op_id > 100)) AND node <> 1 ORDER BY ms, counter, node, op_id LIMIT 500", ("oplog",))
def _(spark, sf_dir):
    new = (c("ms") > 1705500000000) | ((c("ms") == 1705500000000) & (c("op_id") > 100))
    return log(spark, sf_dir).where(new & (c("node") != 1)).orderBy("ms", "counter", "node", "op_id").limit(500).select("op_id", "op_type", "ms")


@query("log_hashes", "SELECT op_id, sha256(op_type || ':' || target || ':' || ms) AS hash FROM oplog", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).select("op_id", F.sha2(F.concat_ws(":", "op_type", "target", "ms"), 256).alias("hash"))


@query("clock_merge", "SELECT node, max(ms) AS ms, max(CASE WHEN ms = m THEN counter END) AS counter FROM (SELECT *, max(ms) OVER (PARTITION BY node) AS m FROM oplog) GROUP BY node", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).groupBy("node").agg(F.max(F.struct("ms", "counter")).alias("h")).select("node", "h.ms", "h.counter")


@query("apply_idempotent", "SELECT op_id, op_type FROM oplog WHERE op_id NOT IN (SELECT l_orderkey FROM lineitem)", ("oplog",))
def _(spark, sf_dir):
    seen = A.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("op_id"))
    return log(spark, sf_dir).join(seen, "op_id", "left_anti").select("op_id", "op_type")


@query("dispatch_counts", "SELECT op_type, node, count(*) AS n, max(ms) AS last_ms FROM oplog GROUP BY 1, 2", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).groupBy("op_type", "node").agg(F.count("*").alias("n"), F.max("ms").alias("last_ms"))


@query("addwins_records", f"SELECT target, min_by(payload, {CLOCK}) AS payload, min(ms) AS ms FROM oplog WHERE op_type = 'record' GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).where("op_type = 'record'").groupBy("target").agg(F.min_by("payload", hlc()).alias("payload"), F.min("ms").alias("ms"))


@query("lww_relate", f"SELECT target, max_by(payload, {CLOCK}) AS payload, max(ms) AS ms FROM oplog WHERE op_type = 'relate' GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    return M.latest(log(spark, sf_dir).where("op_type = 'relate'"), ["target"], ["ms", "counter", "node", "op_id"]).select("target", "payload", "ms")


@query("tombstones", "SELECT target, bool_or(op_type = 'forget') AS forgotten, count(*) AS ops FROM oplog GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).groupBy("target").agg(F.bool_or(c("op_type") == "forget").alias("forgotten"), F.count("*").alias("ops"))


@query("consolidation_union", "SELECT DISTINCT target, counter AS source FROM oplog WHERE op_type = 'consolidate'", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).where("op_type = 'consolidate'").select("target", c("counter").alias("source")).dropDuplicates(["target", "source"])


@query("concurrent_consolidation", "WITH m AS (SELECT DISTINCT target, counter AS source FROM oplog WHERE op_type = 'consolidate') SELECT source, count(*) AS targets, count(*) * (count(*) - 1) // 2 AS pairs FROM m GROUP BY source HAVING count(*) > 1", ("oplog",))
def _(spark, sf_dir):
    m = log(spark, sf_dir).where("op_type = 'consolidate'").select("target", c("counter").alias("source")).distinct()
    return m.groupBy("source").agg(F.count("*").alias("targets")).where("targets > 1").select("source", "targets", F.expr("targets * (targets - 1) div 2").alias("pairs"))


@query("merge_patterns", "SELECT target, max(payload) AS confidence, max(ms) AS last_seen, max(counter) AS occurrences FROM oplog WHERE op_type = 'pattern' GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).where("op_type = 'pattern'").groupBy("target").agg(F.max("payload").alias("confidence"), F.max("ms").alias("last_seen"), F.max("counter").alias("occurrences"))


@query("first_resolution", f"SELECT target, min_by(node, {CLOCK}) AS winner FROM oplog WHERE op_type IN ('relate', 'consolidate') GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).where("op_type in ('relate', 'consolidate')").groupBy("target").agg(F.min_by("node", hlc()).alias("winner"))


@query("peer_watermarks", f"SELECT node AS peer, max_by(op_id, {CLOCK}) AS op_id, max(ms) AS ms FROM oplog GROUP BY node", ("oplog",))
def _(spark, sf_dir):
    return log(spark, sf_dir).groupBy(c("node").alias("peer")).agg(F.max_by("op_id", hlc()).alias("op_id"), F.max("ms").alias("ms"))


@query("sync_missing", "SELECT a.op_id, 'b' AS peer FROM oplog a WHERE a.node = 0 AND NOT EXISTS (SELECT 1 FROM oplog b WHERE b.node = 1 AND b.ms // 60000 = a.ms // 60000)", ("oplog",))
def _(spark, sf_dir):
    minute = F.expr("ms div 60000").alias("minute")
    a = log(spark, sf_dir).where("node = 0").select("op_id", minute)
    b = log(spark, sf_dir).where("node = 1").select(minute).distinct()
    return a.join(b, "minute", "left_anti").select("op_id", F.lit("b").alias("peer"))


@query("state_after_fold", f"SELECT target, CASE WHEN bool_or(op_type = 'forget') THEN 'tombstoned' WHEN bool_or(op_type = 'consolidate') THEN 'consolidated' WHEN bool_or(op_type = 'record') THEN 'active' ELSE 'unknown' END AS status, max_by(op_type, {CLOCK}) AS last_op FROM oplog GROUP BY target", ("oplog",))
def _(spark, sf_dir):
    has = lambda k: F.bool_or(c("op_type") == k)
    return log(spark, sf_dir).groupBy("target").agg(F.when(has("forget"), "tombstoned").when(has("consolidate"), "consolidated").when(has("record"), "active").otherwise("unknown").alias("status"), F.max_by("op_type", hlc()).alias("last_op"))

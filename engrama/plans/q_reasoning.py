"""Queries of beliefs, causes, choice, coherence and narrative."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.operators import beliefs as B
from engrama.operators import events as E
from engrama.operators import network as N
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
NOW = A.NOW
PROV = "['told', 'observed', 'extracted', 'inferred', 'rumour'][1 + k % 5]"
REL = "CASE k % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 ELSE 0.5 END"
FOLD = f"list_reduce(list((CASE WHEN kind IN ('error', 'view') THEN -1.0 ELSE 1.0 END * value / 100 * {REL})::DOUBLE ORDER BY t, event_id), lambda s, w: greatest(-6.0, least(6.0, s + w)), 0.0::DOUBLE)"


def evidence(spark, sf_dir):
    prov = F.element_at(F.array(*map(F.lit, ("told", "observed", "extracted", "inferred", "rumour"))), (c("k") % 5 + 1).cast("int"))
    sign = F.when(c("kind").isin("error", "view"), -1.0).otherwise(1.0)
    return A.events(spark, sf_dir).withColumn("provenance", prov).withColumn("w", sign * c("value") / 100 * B.reliability(prov))


def beliefs(spark, sf_dir):
    x = B.ordered(evidence(spark, sf_dir), ["user_id"], ["t", "event_id"], c("w"))
    return x.select("user_id", B.log_odds_fold(c("xs")).alias("log_odds"))


@query("assert_evidence", f"SELECT user_id, round({FOLD}, 6) + 0.0 AS log_odds FROM ev GROUP BY user_id", ("ev",))
def _(spark, sf_dir):
    return beliefs(spark, sf_dir).select("user_id", (F.round("log_odds", 6) + 0.0).alias("log_odds"))


@query("belief_bands", f"WITH b AS (SELECT user_id, {FOLD} AS lo FROM ev GROUP BY user_id) SELECT CASE WHEN 1 / (1 + exp(-lo)) >= 0.75 THEN 'held' WHEN 1 / (1 + exp(-lo)) <= 0.25 THEN 'rejected' ELSE 'open' END AS band, user_id % 5 AS domain, count(*) AS n FROM b GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    p = B.probability(c("log_odds"))
    band = F.when(p >= 0.75, "held").when(p <= 0.25, "rejected").otherwise("open")
    return beliefs(spark, sf_dir).groupBy(band.alias("band"), (c("user_id") % 5).alias("domain")).agg(F.count("*").alias("n"))


@query("query_beliefs", f"WITH b AS (SELECT user_id, {FOLD} AS lo, count(*) AS n FROM ev GROUP BY user_id) SELECT user_id FROM b WHERE 1 / (1 + exp(-lo)) BETWEEN 0.6 AND 0.999 AND n >= 20", ("ev",))
def _(spark, sf_dir):
    n = A.events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 20")
    return beliefs(spark, sf_dir).join(n, "user_id").where(B.probability(c("log_odds")).between(0.6, 0.999)).select("user_id")


@query("explain_belief", f"SELECT user_id, {PROV} AS provenance, count(*) AS n, round(sum(value), 6) AS weight FROM ev GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("user_id", "provenance").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("weight"))


@query("staleness_decay", "SELECT rid, round(valence * (1 - least(0.95, greatest(0, 0.02 * ((1706745600.0 - last_access) / 86400 - 7)))), 6) + 0.0 AS value FROM memories", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).select("rid", (F.round(B.staleness_decay(c("valence"), (NOW - c("last_access")) / 86400), 6) + 0.0).alias("value"))


@query(
    "domain_conflicts",
    f"WITH b AS (SELECT user_id, user_id % 5 AS domain, {FOLD} AS lo FROM ev GROUP BY user_id) SELECT domain, count(*) FILTER (lo > 0.4) AS positive, count(*) FILTER (lo < -0.4) AS negative, count(*) FILTER (lo > 0.4) * count(*) FILTER (lo < -0.4) AS pairs FROM b GROUP BY 1",
    ("ev",),
)
def _(spark, sf_dir):
    g = beliefs(spark, sf_dir).groupBy((c("user_id") % 5).alias("domain")).agg(F.count_if(c("log_odds") > 0.4).alias("positive"), F.count_if(c("log_odds") < -0.4).alias("negative"))
    return g.withColumn("pairs", c("positive") * c("negative"))


@query(
    "form_beliefs",
    "SELECT user_id, kind, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM ev GROUP BY 1, 2",
    ("ev",),
)
def _(spark, sf_dir):
    g = A.events(spark, sf_dir).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))


@query(
    "confidence_fold",
    """SELECT user_id, round(list_reduce(list(struct_pack(c := CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, u := 0.0::DOUBLE, d := 0.0::DOUBLE) ORDER BY t, event_id), lambda s, x: struct_pack(c := CASE WHEN x.c > 0 THEN least(0.99, s.c + (1 - s.c) * 0.05 / (1 + 0.01 * (s.u + 1))) ELSE greatest(0, s.c - s.c * 0.08 / (1 + 0.01 * (s.d + 1))) END,
    u := s.u + CASE WHEN x.c > 0 THEN 1 ELSE 0 END, d := s.d + CASE WHEN x.c > 0 THEN 0 ELSE 1 END), struct_pack(c := 0.5::DOUBLE, u := 0.0::DOUBLE, d := 0.0::DOUBLE)).c, 6) AS confidence FROM ev GROUP BY user_id""",
    ("ev",),
)
def _(spark, sf_dir):
    x = B.ordered(A.events(spark, sf_dir), ["user_id"], ["t", "event_id"], c("value") > 40)
    return x.select("user_id", F.round(B.reinforced_confidence(c("xs")), 6).alias("confidence"))


CAUSAL = """p AS (SELECT a.kind AS src, b.kind AS dst, count(*) AS n, avg(lag) AS m, stddev_pop(lag) AS sd FROM (SELECT a.event_id, a.kind, b.kind AS k2, min(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS lag FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.kind <> b.kind AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 500000 AND 3600000000 GROUP BY 1, 2, 3) a,
    LATERAL (SELECT a.k2 AS kind) b GROUP BY 1, 2)""".replace(",\n    LATERAL (SELECT a.k2 AS kind) b", "").replace("b.kind AS dst", "k2 AS dst")


def causes(spark, sf_dir):
    lags = E.lag_pairs(A.events(spark, sf_dir), 0.5, 3600.0)
    g = lags.groupBy(c("cause").alias("src"), c("effect").alias("dst")).agg(F.count("*").alias("n"), F.avg("lag").alias("m"), F.stddev_pop("lag").alias("sd"))
    return g.withColumn("strength", 0.3 * F.greatest(1 - c("sd") / c("m"), F.lit(0.0)) + 0.7 * F.least(c("n") / 20.0, F.lit(1.0)))


@query("causal_edges", f"WITH {CAUSAL} SELECT src, dst, n, round(0.3 * greatest(1 - sd / m, 0) + 0.7 * least(n / 20.0, 1), 5) AS strength FROM p", ("ev",))
def _(spark, sf_dir):
    return causes(spark, sf_dir).select("src", "dst", "n", F.round("strength", 5).alias("strength"))


@query("causal_decay", f"WITH {CAUSAL} SELECT src, dst, round((0.3 * greatest(1 - sd / m, 0) + 0.7 * least(n / 20.0, 1)) * pow(0.98, 30), 5) AS strength FROM p", ("ev",))
def _(spark, sf_dir):
    return causes(spark, sf_dir).select("src", "dst", F.round(c("strength") * F.pow(F.lit(0.98), F.lit(30)), 5).alias("strength"))


def _hop(k, before):
    return f"h{k} AS (SELECT cause, dst AS node, max_by(s * strength * 0.8, abs(s * strength)) AS s FROM {before} JOIN e ON e.src = {before}.node GROUP BY 1, 2 HAVING abs(max_by(s * strength * 0.8, abs(s * strength))) >= 0.05)"


@query(
    "predict_effects",
    f"""WITH {CAUSAL}, e AS (SELECT src, dst, 0.3 * greatest(1 - sd / m, 0) + 0.7 * least(n / 20.0, 1) AS strength FROM p), h0 AS (SELECT DISTINCT src AS cause, src AS node, 1.0::DOUBLE AS s FROM e), {_hop(1, "h0")}, {_hop(2, "h1")}, {_hop(3, "h2")}
    SELECT cause, node, hop, round(s, 5) AS strength FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)""",
    ("ev",),
)
def _(spark, sf_dir):
    edges = causes(spark, sf_dir).select("src", "dst", "strength")
    start = edges.select(c("src").alias("cause"), c("src").alias("node")).distinct()
    return B.propagate(edges, start, 3, 0.8, 0.05).select("cause", "node", "hop", F.round("strength", 5).alias("strength"))


@query("counterfactual")
def _(spark, sf_dir):
    edges = causes(spark, sf_dir).select("src", "dst", "strength")
    start = edges.where("src = 'error'").select(c("src").alias("cause"), c("src").alias("node")).distinct()
    world = lambda e: B.propagate(e, start, 3, 0.8, 0.05).groupBy("node").agg(F.max("strength").alias("s"))
    actual, cut = world(edges), world(edges.where("dst <> 'purchase'")).withColumnRenamed("s", "without")
    return actual.join(cut, "node", "left").select("node", F.round("s", 5).alias("actual"), F.round(F.coalesce("without", F.lit(0.0)), 5).alias("counterfactual"), F.round(F.coalesce("without", F.lit(0.0)) - c("s"), 5).alias("regret"))


@query("intervention_counts", "SELECT user_id % 10 AS arm, count(*) FILTER (value > 50) AS successes, count(*) AS trials, round((count(*) FILTER (value > 50) + 1) / (count(*) + 2)::DOUBLE, 6) AS rate FROM ev WHERE kind = 'purchase' GROUP BY 1", ("ev",))
def _(spark, sf_dir):
    g = A.events(spark, sf_dir).where("kind = 'purchase'").groupBy((c("user_id") % 10).alias("arm")).agg(F.count_if(c("value") > 50).alias("successes"), F.count("*").alias("trials"))
    return g.withColumn("rate", F.round((c("successes") + 1) / (c("trials") + 2), 6))


UTIL = "0.35 * importance - 1.0 * certainty * 0.4 - 0.5 * least(0.5, access_count / 10.0) + 0.25 * (rid % 10) / 10.0 + 0.15 * valence"


def utility():
    return 0.35 * c("importance") - 1.0 * c("certainty") * 0.4 - 0.5 * F.least(F.lit(0.5), c("access_count") / 10.0) + 0.25 * (c("rid") % 10) / 10.0 + 0.15 * c("valence")


@query("evaluate_candidates", f"SELECT rid, round({UTIL}, 6) + 0.0 AS utility FROM memories WHERE {UTIL} >= -0.1", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).withColumn("u", utility()).where("u >= -0.1").select("rid", (F.round("u", 6) + 0.0).alias("utility"))


@query("select_action", f"SELECT namespace, max_by(rid, struct_pack(a := round({UTIL}, 9), b := -rid)) AS rid FROM memories WHERE status = 'active' AND certainty >= 0.35 GROUP BY namespace", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).where("status = 'active' and certainty >= 0.35").groupBy("namespace").agg(F.max_by("rid", F.struct(F.round(utility(), 9), -c("rid"))).alias("rid"))


@query("intent_softmax", "WITH s AS (SELECT session_id, rid, 0.25 * importance + 0.2 * certainty + 0.05 * (valence + 1) / 2 AS s FROM memories), e AS (SELECT session_id, rid, exp(s - max(s) OVER (PARTITION BY session_id)) AS e FROM s) SELECT session_id, rid, round(e / sum(e) OVER (PARTITION BY session_id), 6) AS posterior FROM e", ("memories",))
def _(spark, sf_dir):
    s = A.memories(spark, sf_dir).select("session_id", "rid", (0.25 * c("importance") + 0.2 * c("certainty") + 0.05 * (c("valence") + 1) / 2).alias("s"))
    return s.select("session_id", "rid", F.round(B.softmax("s", "session_id"), 6).alias("posterior"))


NET = "greatest(0, least(1, 0.4 * importance + 0.25 * certainty + 0.2 * (valence + 1) / 2 - 0.15 * access_count / 7.0))"


def net():
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * c("importance") + 0.25 * c("certainty") + 0.2 * (c("valence") + 1) / 2 - 0.15 * c("access_count") / 7.0))


@query(
    "surface_modes",
    f"""WITH r AS (SELECT rid, {NET} AS net, CASE WHEN due_at <= 1706745600.0 + 300 THEN 'deadline_imminent' WHEN valence < -0.5 THEN 'conflict_needs_resolution' ELSE 'goal_at_risk' END AS reason, access_count = 0 AS idle FROM memories WHERE status = 'active'),
    u AS (SELECT *, CASE WHEN reason = 'deadline_imminent' THEN greatest(net, 0.95) ELSE net END AS urgency FROM r)
    SELECT rid, reason, round(urgency, 6) AS urgency, CASE WHEN urgency >= 0.95 AND reason = 'deadline_imminent' THEN 'preempt' WHEN urgency >= 0.8 THEN 'alert' WHEN urgency >= 0.6 AND reason = 'conflict_needs_resolution' THEN 'alert' WHEN urgency >= 0.5 THEN 'nudge' WHEN idle AND urgency >= 0.4 THEN 'nudge' ELSE 'whisper' END AS mode FROM u""",
    ("memories",),
)
def _(spark, sf_dir):
    reason = F.when(c("due_at") <= NOW + 300, "deadline_imminent").when(c("valence") < -0.5, "conflict_needs_resolution").otherwise("goal_at_risk")
    m = A.memories(spark, sf_dir).where("status = 'active'").withColumn("reason", reason).withColumn("n", net())
    urgency = F.when(c("reason") == "deadline_imminent", F.greatest(c("n"), F.lit(0.95))).otherwise(c("n"))
    return m.withColumn("u", urgency).select("rid", "reason", F.round("u", 6).alias("urgency"), B.surface_mode(c("u"), c("reason"), c("access_count") == 0).alias("mode"))


@query("surfacing_rate_cap", f"SELECT session_id, rid FROM (SELECT session_id, rid, row_number() OVER (PARTITION BY session_id ORDER BY round({NET}, 9) DESC, rid) AS k FROM memories WHERE status = 'active') WHERE k <= 10", ("memories",))
def _(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy(F.desc(F.round("n", 9)), "rid")
    return A.memories(spark, sf_dir).where("status = 'active'").withColumn("n", net()).withColumn("k", F.row_number().over(w)).where("k <= 10").select("session_id", "rid")


@query("replay_priority", "SELECT rid, round(pow(abs(valence), 0.6) * 1 / (1 + (1706745600.0 - created_at) / 3600 / 24) * 1 / (1 + access_count), 6) AS priority FROM memories", ("memories",))
def _(spark, sf_dir):
    p = F.pow(F.abs(c("valence")), F.lit(0.6)) / (1 + (NOW - c("created_at")) / 3600 / 24) / (1 + c("access_count"))
    return A.memories(spark, sf_dir).select("rid", F.round(p, 6).alias("priority"))


@query("salience", "SELECT rid, round(greatest(0, least(10, importance * CASE WHEN type = 'semantic' THEN 1.5 ELSE 1 END * CASE WHEN due_at IS NOT NULL THEN 2 ELSE 1 END * CASE WHEN status <> 'active' THEN 0.1 ELSE 1 END)), 6) AS salience FROM memories", ("memories",))
def _(spark, sf_dir):
    f = c("importance") * F.when(c("type") == "semantic", 1.5).otherwise(1.0) * F.when(c("due_at").isNotNull(), 2.0).otherwise(1.0) * F.when(c("status") != "active", 0.1).otherwise(1.0)
    return A.memories(spark, sf_dir).select("rid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), f)), 6).alias("salience"))


@query("coherence_report", "SELECT namespace, round(1 - 0.15 * avg((status = 'tombstoned')::INT) - 0.1 * avg((valence < -0.5)::INT) - 0.1 * avg((last_access < 1706745600.0 - 1209600)::INT), 6) AS coherence FROM memories GROUP BY 1", ("memories",))
def _(spark, sf_dir):
    share = lambda cond: F.avg(cond.cast("int"))
    value = 1 - 0.15 * share(c("status") == "tombstoned") - 0.1 * share(c("valence") < -0.5) - 0.1 * share(c("last_access") < NOW - 1209600)
    return A.memories(spark, sf_dir).groupBy("namespace").agg(F.round(value, 6).alias("coherence"))


@query("metacognition", "SELECT domain, count(*) AS n, round(0.4 / (1 + count(*) / 500.0) + 0.3 * (1 - count(DISTINCT type) / 3.0) + 0.3 * (1 - avg((certainty >= 0.5)::INT)), 6) AS sparsity FROM memories GROUP BY 1", ("memories",))
def _(spark, sf_dir):
    s = 0.4 / (1 + F.count("*") / 500.0) + 0.3 * (1 - F.countDistinct("type") / 3.0) + 0.3 * (1 - F.avg((c("certainty") >= 0.5).cast("int")))
    return A.memories(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.round(s, 6).alias("sparsity"))


@query("node_decay", "SELECT rid, round(importance * pow(2, -(1706745600.0 - last_access) / (300 + 3300 * certainty * 1000)), 9) AS activation FROM memories WHERE importance * pow(2, -(1706745600.0 - last_access) / (300 + 3300 * certainty * 1000)) >= 1e-6", ("memories",))
def _(spark, sf_dir):
    a = c("importance") * F.pow(F.lit(2.0), -(NOW - c("last_access")) / (300 + 3300 * c("certainty") * 1000))
    return A.memories(spark, sf_dir).withColumn("a", a).where("a >= 1e-6").select("rid", F.round("a", 9).alias("activation"))


@query("arc_chapters", "SELECT session_id, rid, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, rid) AS BIGINT) AS chapter FROM (SELECT session_id, rid, created_at, CASE WHEN created_at - lag(created_at) OVER w > 259200 OR abs(valence - lag(valence) OVER w) > 0.6 THEN 1 ELSE 0 END AS fresh FROM memories WINDOW w AS (PARTITION BY session_id ORDER BY created_at, rid))", ("memories",))
def _(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("created_at", "rid")
    fresh = F.when((c("created_at") - F.lag("created_at").over(w) > 259200) | (F.abs(c("valence") - F.lag("valence").over(w)) > 0.6), 1).otherwise(0)
    return A.memories(spark, sf_dir).select("session_id", "rid", "created_at", fresh.alias("fresh")).select("session_id", "rid", F.sum("fresh").over(w).alias("chapter"))


@query("timeline", "SELECT session_id, count(*) AS episodes, min(created_at) AS first_at, max(created_at) AS last_at, count(*) >= 3 AS active FROM memories GROUP BY 1", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("episodes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), (F.count("*") >= 3).alias("active"))


@query("skill_chains", "WITH l AS (SELECT user_id, kind, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(t, 2) OVER w - t AS span FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT kind || '>' || k1 || '>' || k2 AS skill, count(*) AS n, count(DISTINCT user_id) AS users, round(least(1, count(*) / 10.0), 6) AS confidence FROM l WHERE span <= 86400 GROUP BY 1 HAVING count(*) >= 3", ("ev",))
def _(spark, sf_dir):
    w = E.in_order("user_id")
    l_ = A.events(spark, sf_dir).select("user_id", F.concat_ws(">", "kind", F.lead("kind", 1).over(w), F.lead("kind", 2).over(w)).alias("skill"), (F.lead("t", 2).over(w) - c("t")).alias("span")).where("span <= 86400")
    return l_.groupBy("skill").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.least(F.lit(1.0), F.count("*") / 10.0), 6).alias("confidence")).where("n >= 3")


@query("belief_network")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    v = e.groupBy(c("user_id").cast("string").alias("grp"), c("kind").alias("node")).agg(F.avg(F.when(c("value") > 40, 0.9).otherwise(0.2)).alias("prior"), F.lit(2.0).alias("weight"))
    k = causes(spark, sf_dir).select("src", "dst", "strength")
    users = e.select(c("user_id").cast("string").alias("grp")).distinct()
    f = users.crossJoin(F.broadcast(k)).select("grp", c("src").alias("a"), c("dst").alias("b"), F.when(c("src") == "error", "oppose").otherwise("agree").alias("kind"), "strength", F.lit(0.8).alias("confidence"))  # k has a row per pair of kinds
    return N.belief_propagation(v, f).select("grp", "node", F.round("mean", 5).alias("mean"))


@query("plan_search")
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    a = e.groupBy(c("user_id").cast("string").alias("grp"), c("kind").alias("action")).agg(F.avg(F.when(c("value") > 30, 0.9).otherwise(0.5)).alias("chance"), (F.avg("value") / 100).alias("utility"))
    needs = F.when(c("action") == "purchase", F.array(F.lit("seen"))).when(c("action") == "view", F.array(F.lit("member"))).otherwise(F.array().cast("array<string>"))
    gives = F.when(c("action") == "purchase", F.array(F.lit("owned"))).when(c("action") == "view", F.array(F.lit("seen"))).when(c("action") == "signup", F.array(F.lit("member"))).otherwise(F.array(F.lit("noise")))
    g = a.select("grp").distinct().select("grp", F.lit("owned").alias("goal"), F.array().cast("array<string>").alias("have"))
    return N.plans(a.select("grp", "action", needs.alias("needs"), gives.alias("gives"), "chance", "utility"), g).select("grp", "goal", F.array_join("plan", ">").alias("plan"), F.round("score", 6).alias("score"))


@query("induce_schemas", "SELECT kind AS action, array_to_string(list_sort(list_filter(['high', 'odd', 'any'], lambda x: (x = 'high' AND lo > 20) OR x = 'any' OR (x = 'odd' AND od = 1))), ',') AS conditions, support, round(support / n::DOUBLE, 6) AS confidence FROM (SELECT kind, min(CASE WHEN value > 50 THEN value END) AS lo, min(CASE WHEN value > 50 THEN k % 2 END) AS od, count(*) FILTER (value > 50) AS support, count(*) AS n FROM ev GROUP BY kind) WHERE support >= 3", ("ev",))
def _(spark, sf_dir):
    e = A.events(spark, sf_dir)
    cond = F.array_compact(F.array(F.when(c("value") > 20, "high"), F.when(c("k") % 2 == 1, "odd"), F.lit("any")))
    s = N.schemas(e.select(c("kind").alias("action"), cond.alias("conditions"), (c("value") > 50).alias("success")))
    return s.select("action", F.array_join("conditions", ",").alias("conditions"), "support", F.round("confidence", 6).alias("confidence"))


@query("analogies")
def _(spark, sf_dir):
    o = A.edges(spark, sf_dir).where("rel = 'supplies'").select("src", "rel", "dst")
    number = F.substring("src", 2, 20).cast("long")
    pairs = o.withColumn("pair", F.concat(F.lit("q"), F.floor(number / 2))).withColumn("side", (number % 2).cast("int"))
    return N.analogies(pairs.select("pair", "side", "src", "rel", "dst")).select("pair", F.size("mapping").alias("mapped"), F.round("similarity", 6).alias("similarity"))

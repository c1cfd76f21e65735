"""Queries of cognitive nodes: propagation, contradictions, blocked goals, causes, skills, arcs, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.functions import text as T
from engrama.operators import cognition as C
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col
NOW = A.NOW
KINDS = list(C.TRANSFER)
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
#: Nodes and edges made of memories: every second one a belief, goals and facts between; edges go to a fixed other id.
NODES = """nodes AS (SELECT rid AS id, CASE WHEN rid % 2 = 0 THEN 'belief' WHEN rid % 3 = 0 THEN 'goal' ELSE 'fact' END AS kind, domain, 3 * valence AS log_odds, 0.3 + 0.7 * certainty AS confidence, importance AS salience, access_count AS evidence, last_access AS last_evidence, rid % 11 = 0 AS confirmed FROM memories)"""
EDGES = f"""mind AS (SELECT src, dst, kind, weight, confidence, observations FROM (SELECT m.rid AS src, (m.rid * 7 + 4) % t.n AS dst, {_KINDS}[1 + m.rid % 18] AS kind, importance AS weight, 0.3 + 0.7 * certainty AS confidence, access_count * 4 AS observations FROM memories m, (SELECT count(*) AS n FROM memories) t
    UNION ALL SELECT m.rid, (m.rid * 5 + 2) % t.n, CASE WHEN m.rid % 4 < 2 THEN 'contradicts' ELSE 'supports' END, importance, certainty, access_count FROM memories m, (SELECT count(*) AS n FROM memories) t) WHERE dst IN (SELECT rid FROM memories))"""
PREFERENCES = "prefs AS (SELECT rid AS id, namespace AS domain, 'x' || (rid % 9) AS preferred, CASE WHEN rid % 3 > 0 THEN 'x' || (rid * 5 % 9) END AS dispreferred, importance AS strength FROM memories WHERE rid % 2 = 1)"


def nodes(spark, sf_dir):
    m = A.memories(spark, sf_dir)
    i = c("rid")
    kind = F.when(i % 2 == 0, "belief").when(i % 3 == 0, "goal").otherwise("fact")
    return m.select(i.alias("id"), kind.alias("kind"), "domain", (3 * c("valence")).alias("log_odds"), (0.3 + 0.7 * c("certainty")).alias("confidence"), c("importance").alias("salience"), c("access_count").alias("evidence"), c("last_access").alias("last_evidence"), (i % 11 == 0).alias("confirmed"))


def mind(spark, sf_dir):
    m = A.memories(spark, sf_dir).select("rid", "importance", "certainty", "access_count")
    n = m.count()
    i = c("rid")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % 18 + 1).cast("int"))
    one = m.select(i.alias("src"), ((i * 7 + 4) % n).alias("dst"), kind.alias("kind"), c("importance").alias("weight"), (0.3 + 0.7 * c("certainty")).alias("confidence"), (c("access_count") * 4).alias("observations"))
    two = m.select(i.alias("src"), ((i * 5 + 2) % n).alias("dst"), F.when(i % 4 < 2, "contradicts").otherwise("supports").alias("kind"), c("importance").alias("weight"), c("certainty").alias("confidence"), c("access_count").alias("observations"))
    return one.unionByName(two).join(m.select(i.alias("dst")), "dst", "left_semi")


def preferences(spark, sf_dir):
    i = c("rid")
    return A.memories(spark, sf_dir).where(i % 2 == 1).select(i.alias("id"), c("namespace").alias("domain"), F.concat(F.lit("x"), i % 9).alias("preferred"), F.when(i % 3 > 0, F.concat(F.lit("x"), i * 5 % 9)).alias("dispreferred"), c("importance").alias("strength"))


@query("activation_transfer", f"SELECT kind, count(*) AS n, {'CASE kind ' + ' '.join(f'WHEN {k!r} THEN {v}' for k, v in C.TRANSFER.items()) + ' END'} AS transfer, max(abs(weight)) AS weight FROM mind GROUP BY kind".replace("SELECT", f"WITH {EDGES} SELECT", 1), ("memories",))
def _(spark, sf_dir):
    return mind(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.max(F.abs("weight")).alias("weight")).withColumn("transfer", C.activation_transfer(c("kind")))


@query(
    "propagate_evidence",
    f"""WITH {NODES}, {EDGES}, w AS (SELECT e.dst AS id, 2 * s.valence * CASE e.kind WHEN 'supports' THEN 1 ELSE -1 END * abs(e.weight) * e.confidence * 0.5 AS w FROM mind e JOIN memories s ON s.rid = e.src WHERE e.kind IN ('supports', 'contradicts')),
    t AS (SELECT id, sum(w) AS shift FROM w WHERE abs(w) >= 0.1 GROUP BY id) SELECT id, round(shift, 6) AS shift, round(greatest(-6, least(6, log_odds + shift)), 6) AS log_odds FROM nodes JOIN t USING (id) WHERE kind = 'belief'""",
    ("memories",),
)
def _(spark, sf_dir):
    told = A.memories(spark, sf_dir).select(c("rid").alias("id"), (2 * c("valence")).alias("effective"))
    out = C.propagate_evidence(told, mind(spark, sf_dir), nodes(spark, sf_dir).where("kind = 'belief'").select("id", "log_odds"))
    return out.select("id", F.round("shift", 6).alias("shift"), F.round("log_odds", 6).alias("log_odds"))


_RES = "CASE WHEN a.confirmed <> b.confirmed THEN 'prefer_user_confirmed' WHEN a.evidence > 2 * b.evidence OR b.evidence > 2 * a.evidence THEN 'prefer_stronger_evidence' WHEN abs(a.last_evidence - b.last_evidence) > 604800 THEN 'prefer_more_recent' ELSE 'ask_user' END"
_SEV = "least(1, greatest(0, sqrt(a.confidence * b.confidence) * greatest(a.salience, b.salience) * {}))"
EPISTEMIC = f"""ep AS (SELECT * FROM (SELECT a.id AS belief_a, b.id AS belief_b, 'epistemic_edge' AS method, {_SEV.format("(0.5 + 0.5 * abs(e.weight))")} AS severity, {_RES} AS resolution FROM mind e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
    WHERE e.kind = 'contradicts' AND a.kind = 'belief' AND b.kind = 'belief' AND a.confidence >= 0.6 AND b.confidence >= 0.6) WHERE severity >= 0.2)"""
DOMAIN = f"""dc AS (SELECT * FROM (SELECT a.id AS belief_a, b.id AS belief_b, 'domain_opposition' AS method, round({_SEV.format("0.75")}, 12) AS severity, {_RES} AS resolution FROM nodes a JOIN nodes b ON a.domain = b.domain AND a.id < b.id
    WHERE a.kind = 'belief' AND b.kind = 'belief' AND sign(a.log_odds) <> sign(b.log_odds) AND greatest(a.confidence, b.confidence) >= 0.6 AND least(a.confidence, b.confidence) >= 0.4) WHERE severity >= 0.2 ORDER BY severity DESC, belief_a, belief_b LIMIT 20)"""
WANTED = """pc AS (SELECT a.id AS belief_a, b.id AS belief_b, 'preference_conflict' AS method, round((a.strength + b.strength) / 2, 12) AS severity, 'ask_user' AS resolution FROM prefs a JOIN prefs b ON a.domain = b.domain AND a.id < b.id
    WHERE (a.dispreferred = b.preferred OR b.dispreferred = a.preferred) AND (a.strength + b.strength) / 2 >= 0.2 ORDER BY severity DESC, belief_a, belief_b LIMIT 20)"""
_SHOWN = "belief_a, belief_b, method, round(severity, 6) AS severity, resolution"


def shown(rows):
    return rows.select("belief_a", "belief_b", "method", F.round("severity", 6).alias("severity"), "resolution")


@query("epistemic_conflicts", f"WITH {NODES}, {EDGES}, {EPISTEMIC} SELECT {_SHOWN} FROM ep", ("memories",))
def _(spark, sf_dir):
    return shown(C.epistemic_conflicts(nodes(spark, sf_dir), mind(spark, sf_dir)))


@query("domain_opposition", f"WITH {NODES}, {DOMAIN} SELECT {_SHOWN} FROM dc", ("memories",))
def _(spark, sf_dir):
    return shown(C.domain_conflicts(nodes(spark, sf_dir)))


@query("preference_conflicts", f"WITH {PREFERENCES}, {WANTED} SELECT {_SHOWN} FROM pc", ("memories",))
def _(spark, sf_dir):
    return shown(C.preference_conflicts(preferences(spark, sf_dir)))


@query("scan_contradictions", f"WITH {NODES}, {EDGES}, {PREFERENCES}, {EPISTEMIC}, {DOMAIN}, {WANTED} SELECT {_SHOWN} FROM (SELECT * FROM ep UNION ALL SELECT * FROM dc UNION ALL SELECT * FROM pc) ORDER BY round(severity, 9) DESC, method, belief_a, belief_b LIMIT 20", ("memories",))
def _(spark, sf_dir):
    return shown(C.scan_contradictions(nodes(spark, sf_dir), mind(spark, sf_dir), preferences(spark, sf_dir)))


@query("blocked_goals", f"WITH {NODES}, {EDGES} SELECT DISTINCT dst AS goal, src AS blocker FROM mind WHERE kind = 'blocks_goal' AND dst IN (SELECT id FROM nodes WHERE kind = 'goal') AND src IN (SELECT id FROM nodes)", ("memories",))
def _(spark, sf_dir):
    return C.blocked_goals(nodes(spark, sf_dir), mind(spark, sf_dir))


@query(
    "graph_causal_edges",
    f"""WITH {EDGES} SELECT src AS cause, dst AS effect, round(weight * CASE kind WHEN 'causes' THEN 1 WHEN 'predicts' THEN 0.7 ELSE -1 END, 6) AS strength, observations, CASE WHEN confidence >= 0.6 AND observations >= 15 THEN 'established' WHEN observations >= 5 THEN 'candidate' ELSE 'hypothesized' END AS stage FROM mind WHERE kind IN ('causes', 'predicts', 'prevents')""",
    ("memories",),
)
def _(spark, sf_dir):
    return C.graph_causal_edges(mind(spark, sf_dir)).select("cause", "effect", F.round("strength", 6).alias("strength"), "observations", "stage")


MOMENT = {"hour": 9, "day": 2, "app": 3, "transition": "1>3", "seconds": 1200.0, "idle": True}


@query(
    "matching_skills",
    """WITH s AS (SELECT rid AS skill, CASE WHEN rid % 2 = 0 THEN [rid % 24, 9] ELSE [] END AS hours, CASE WHEN rid % 3 = 0 THEN rid % 5 END AS app, CASE WHEN rid % 5 = 0 THEN '1>' || (rid % 4) END AS transition, CASE WHEN rid % 7 < 3 THEN [rid % 7, 2] END AS days, CASE WHEN rid % 4 = 1 THEN 60.0 * (rid % 40) END AS secs, CASE WHEN rid % 6 = 0 THEN rid % 12 = 0 END AS idle,
    0.5 + 0.5 * certainty AS confidence, CASE WHEN rid % 3 = 1 THEN 'candidate' WHEN rid % 2 = 0 THEN 'promoted' ELSE 'reliable' END AS stage, rid % 13 = 0 AS deprecated FROM memories),
    m AS (SELECT *, (len(hours) > 0)::INT + (app IS NOT NULL)::INT + (transition IS NOT NULL)::INT + (days IS NOT NULL)::INT + (secs IS NOT NULL)::INT + (idle IS NOT NULL)::INT AS total,
    (len(hours) > 0 AND list_contains(hours, 9))::INT + coalesce(app = 3, false)::INT + coalesce(transition = '1>3', false)::INT + coalesce(list_contains(days, 2), false)::INT + coalesce(1200 >= secs, false)::INT + coalesce(idle, false)::INT AS hits FROM s),
    r AS (SELECT skill, CASE WHEN total = 0 THEN 1 ELSE hits / total::DOUBLE END AS score, confidence FROM m WHERE stage IN ('reliable', 'promoted') AND NOT deprecated AND confidence >= 0.7)
    SELECT skill, round(score, 6) AS trigger_score, round(score * confidence, 6) AS relevance FROM r WHERE score >= 0.5 ORDER BY round(score * confidence, 12) DESC, skill LIMIT 10""",
    ("memories",),
)
def _(spark, sf_dir):
    i = c("rid")
    none = F.array().cast("array<bigint>")
    skills = A.memories(spark, sf_dir).select(
        i.alias("skill"), F.when(i % 2 == 0, F.array(i % 24, F.lit(9).cast("long"))).otherwise(none).alias("hours"), F.when(i % 3 == 0, i % 5).alias("app"), F.when(i % 5 == 0, F.concat(F.lit("1>"), i % 4)).alias("transition"),
        F.when(i % 7 < 3, F.array(i % 7, F.lit(2).cast("long"))).alias("days"), F.when(i % 4 == 1, 60.0 * (i % 40)).alias("least_seconds"), F.when(i % 6 == 0, i % 12 == 0).alias("after_idle"),
        (0.5 + 0.5 * c("certainty")).alias("confidence"), F.when(i % 3 == 1, "candidate").when(i % 2 == 0, "promoted").otherwise("reliable").alias("stage"), (i % 13 == 0).alias("deprecated"),
    )
    return C.matching_skills(skills, MOMENT).select("skill", F.round("trigger_score", 6).alias("trigger_score"), F.round("relevance", 6).alias("relevance"))


@query(
    "arc_match_scores",
    """WITH a AS (SELECT session_id, list_distinct(list(namespace)) AS people, list_distinct(list(domain)) AS domains, max(created_at) AS newest, avg(valence) AS mood FROM memories WHERE status = 'consolidated' GROUP BY 1), m AS (SELECT rid, session_id, [namespace, 'me'] AS people, [domain] AS domains, created_at, valence FROM memories WHERE status = 'active')
    SELECT rid, round(0.4 * len(list_filter(m.people, lambda x: list_contains(a.people, x))) / 2.0 + 0.3 * list_contains(a.domains, m.domains[1])::INT + 0.15 * exp(-greatest(0, created_at - newest) / 86400 / 14) + 0.15 * (1 - abs(valence - mood) / 2), 6) AS score FROM m JOIN a USING (session_id)""",
    ("memories",),
)
def _(spark, sf_dir):
    m = A.memories(spark, sf_dir)
    arcs = m.where("status = 'consolidated'").groupBy("session_id").agg(F.collect_set("namespace").alias("ap"), F.collect_set("domain").alias("ad"), F.max("created_at").alias("aa"), F.avg("valence").alias("av"))
    rows = m.where("status = 'active'").join(arcs, "session_id")
    score = C.arc_match(F.array("namespace", F.lit("me")), F.array("domain"), c("created_at"), c("valence"), c("ap"), c("ad"), c("aa"), c("av"))
    return rows.select("rid", F.round(score, 6).alias("score"))


@query(
    "match_schemas",
    """SELECT rid AS schema, round(s, 6) AS satisfied, round(s * certainty * (0.5 + 0.3 * importance + 0.2 * exp(-greatest(0, 1706745600.0 - last_access) / 86400 / 30)), 6) AS score FROM (SELECT *, (access_count % 5) / 4.0::DOUBLE AS s FROM memories WHERE type = 'procedural') WHERE s >= 0.5""",
    ("memories",),
)
def _(spark, sf_dir):
    m = A.memories(spark, sf_dir).where("type = 'procedural'").select(c("rid").alias("schema"), c("certainty").alias("confidence"), c("importance").alias("generality"), c("last_access").alias("refined_at"), "access_count")
    return C.match_schemas(m, (c("access_count") % 5) / 4.0, NOW).select("schema", F.round("satisfied", 6).alias("satisfied"), F.round("score", 6).alias("score"))


@query("entities_by_type", f"SELECT entity, count(*) AS mentions FROM links WHERE length(entity) > 1 AND upper(entity) = entity OR lower(entity) IN ({', '.join(repr(t) for t in T.TECH)}) GROUP BY entity", ("links",))
def _(spark, sf_dir):
    mentions = A.links(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("mentions"))
    return mentions.where(T.entity_type(c("entity")) == "tech")

"""Beliefs, goals, preferences, skills, arcs and schemas as graph nodes: propagation, contradictions, matching, learning.

Nodes have id, kind, domain, log_odds, confidence, salience, evidence, last_evidence, confirmed; edges src, dst, kind,
weight, confidence, observations.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions import scoring as S

DAY = 86400.0
#: How much activation an edge of each kind hands on; below 0 it inhibits.
TRANSFER = {
    "supports": 0.7, "causes": 0.8, "advances_goal": 0.6, "triggers": 0.7, "requires": 0.5, "subtask_of": 0.4,
    "predicts": 0.4, "associated_with": 0.3, "similar_to": 0.3, "instance_of": 0.3, "part_of": 0.3, "prefers": 0.3, "precedes_temporally": 0.2,
    "contradicts": -0.5, "prevents": -0.6, "blocks_goal": -0.5, "avoids": -0.3, "constrains": -0.2,
}
#: How an edge of a causal kind counts as a cause.
CAUSAL = {"causes": 1.0, "predicts": 0.7, "prevents": -1.0}
LOG_ODDS, PROPAGATION, LEAST_WEIGHT = 6.0, 0.5, 0.1
SURE, LIKELY, SEVERE, MOST = 0.6, 0.4, 0.2, 20


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def activation_transfer(kind: Column) -> Column:
    return _lookup(kind, TRANSFER)


def propagate_evidence(sources: DataFrame, edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """beliefs (id, log_odds) with `shift`, what evidence (id, effective) on others adds over supports and contradicts
    edges, and the log-odds after it; shares too weak are dropped, the sum is clamped once."""
    sign = F.when(F.col("kind") == "supports", 1.0).when(F.col("kind") == "contradicts", -1.0)
    told = edges.join(sources.select(F.col("id").alias("src"), "effective"), "src")
    told = told.select(F.col("dst").alias("id"), (F.col("effective") * sign * F.abs("weight") * F.col("confidence") * PROPAGATION).alias("w"))
    shift = told.where(F.abs("w") >= LEAST_WEIGHT).groupBy("id").agg(F.sum("w").alias("shift"))
    out = beliefs.join(shift, "id")
    return out.withColumn("log_odds", F.greatest(F.lit(-LOG_ODDS), F.least(F.lit(LOG_ODDS), F.col("log_odds") + F.col("shift"))))


def severity(a: str, b: str, weight: Column) -> Column:
    value = F.sqrt(F.col(f"{a}confidence") * F.col(f"{b}confidence")) * F.greatest(f"{a}salience", f"{b}salience") * (0.5 + 0.5 * weight)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def resolution(a: str, b: str) -> Column:
    """How two beliefs at odds should be settled: by who confirmed, by evidence, by recency, else by asking."""
    x, y = F.col(f"{a}evidence"), F.col(f"{b}evidence")
    return (
        F.when(F.col(f"{a}confirmed") != F.col(f"{b}confirmed"), "prefer_user_confirmed")
        .when((x > 2 * y) | (y > 2 * x), "prefer_stronger_evidence")
        .when(F.abs(F.col(f"{a}last_evidence") - F.col(f"{b}last_evidence")) > 7 * DAY, "prefer_more_recent")
        .otherwise("ask_user")
    )


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(x).alias(prefix + x) for x in ("id", "domain", "log_odds", "confidence", "salience", "evidence", "last_evidence", "confirmed")])


def _conflict(rows: DataFrame, method: str) -> DataFrame:
    return rows.where(F.col("severity") >= SEVERE).select(F.col("a_id").alias("belief_a"), F.col("b_id").alias("belief_b"), F.lit(method).alias("method"), "severity", resolution("a_", "b_").alias("resolution"))


def epistemic_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contradicts edges between two beliefs that are both held."""
    held = nodes.where((F.col("kind") == "belief") & (F.col("confidence") >= SURE))
    rows = edges.where("kind = 'contradicts'").select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"), "weight")
    rows = rows.join(_side(held, "a_"), "a_id").join(_side(held, "b_"), "b_id")
    return _conflict(rows.withColumn("severity", severity("a_", "b_", F.abs("weight"))), "epistemic_edge")


def domain_conflicts(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` severest pairs of beliefs of one domain with opposite signs, one of them held and neither unlikely.

    A pair's severity is one belief's root of confidence times salience, times the other's root of confidence. So the
    severest pairs lie among the best few of either side by those two measures, and only these meet.
    """
    beliefs = nodes.where((F.col("kind") == "belief") & (F.col("confidence") >= LIKELY)).withColumn("up", F.signum("log_odds"))
    own, other = F.sqrt("confidence") * F.col("salience"), F.sqrt("confidence")

    def best(rows: DataFrame, by: Column) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy("domain", "up", F.col("confidence") >= SURE).orderBy(F.round(by, 12).desc(), "id"))).where(F.col("_k") <= most).drop("_k")

    a, b = _side(best(beliefs, own), "a_"), _side(best(beliefs, other), "b_")
    rows = a.join(b, F.col("a_domain") == F.col("b_domain")).where((F.signum("a_log_odds") != F.signum("b_log_odds")) & (F.greatest("a_confidence", "b_confidence") >= SURE))
    rows = rows.withColumn("severity", F.round(severity("a_", "b_", F.lit(0.5)), 12))
    found = _conflict(rows, "domain_opposition")
    pair = [F.least("belief_a", "belief_b").alias("belief_a"), F.greatest("belief_a", "belief_b").alias("belief_b")]
    return found.select(*pair, "method", "severity", "resolution").distinct().orderBy(F.desc("severity"), "belief_a", "belief_b").limit(most)


def preference_conflicts(preferences: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` severest pairs of preferences (id, domain, preferred, dispreferred, strength) of which one rejects what the
    other wants; per domain and thing only the strongest few of either side meet."""

    def best(rows: DataFrame, thing: str) -> DataFrame:
        w = Window.partitionBy("domain", thing).orderBy(F.desc("strength"), "id")
        return rows.where(F.col(thing).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most + 1)

    against = best(preferences, "dispreferred").select("domain", F.col("dispreferred").alias("thing"), F.col("id").alias("x"), F.col("strength").alias("sx"))
    wanted = best(preferences, "preferred").select("domain", F.col("preferred").alias("thing"), F.col("id").alias("y"), F.col("strength").alias("sy"))
    rows = against.join(wanted, ["domain", "thing"]).where("x <> y").withColumn("severity", F.round((F.col("sx") + F.col("sy")) / 2, 12)).where(F.col("severity") >= SEVERE)
    rows = rows.select(F.least("x", "y").alias("belief_a"), F.greatest("x", "y").alias("belief_b"), F.lit("preference_conflict").alias("method"), "severity", F.lit("ask_user").alias("resolution"))
    return rows.distinct().orderBy(F.desc("severity"), "belief_a", "belief_b").limit(most)


def scan_contradictions(nodes: DataFrame, edges: DataFrame, preferences: DataFrame, most: int = MOST) -> DataFrame:
    """The severest of all three kinds."""
    every = epistemic_conflicts(nodes, edges).unionByName(domain_conflicts(nodes, most)).unionByName(preference_conflicts(preferences, most))
    return every.orderBy(F.desc(F.round("severity", 9)), "method", "belief_a", "belief_b").limit(most)


def blocked_goals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(goal, blocker): goals and the nodes with a blocks_goal edge to them."""
    goals = nodes.where("kind = 'goal'").select(F.col("id").alias("dst"))
    rows = edges.where("kind = 'blocks_goal'").join(goals, "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return rows.select(F.col("dst").alias("goal"), F.col("src").alias("blocker")).distinct()


def graph_causal_edges(edges: DataFrame) -> DataFrame:
    """(cause, effect, strength, confidence, observations, stage) of edges of causal kinds."""
    sign = _lookup(F.col("kind"), CAUSAL)
    stage = F.when((F.col("confidence") >= 0.6) & (F.col("observations") >= 15), "established").when(F.col("observations") >= 5, "candidate").otherwise("hypothesized")
    return edges.where(F.col("kind").isin(*CAUSAL)).select(F.col("src").alias("cause"), F.col("dst").alias("effect"), (F.col("weight") * sign).alias("strength"), "confidence", "observations", stage.alias("stage"))


def trigger_score(hours: Column, app: Column, transition: Column, days: Column, least_seconds: Column, after_idle: Column, now: dict) -> Column:
    """The share of a skill's stated conditions that hold now (hour, day, app, transition, seconds, idle); 1 without any."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    same = lambda x, v: F.coalesce(x == F.lit(v), F.lit(False)) if v is not None else F.lit(False)
    conditions = [
        (size(hours), F.array_contains(hours, now["hour"])),
        (app.isNotNull(), same(app, now.get("app"))),
        (transition.isNotNull(), same(transition, now.get("transition"))),
        (size(days), F.array_contains(days, now["day"])),
        (least_seconds.isNotNull(), F.lit(float(now["seconds"])) >= least_seconds),
        (after_idle.isNotNull(), same(after_idle, now["idle"])),
    ]
    total = sum((stated.cast("int") for stated, _ in conditions), F.lit(0))
    hits = sum((F.when(stated & holds, 1).otherwise(0) for stated, holds in conditions), F.lit(0))
    return F.when(total == 0, 1.0).otherwise(hits / total)


def matching_skills(skills: DataFrame, now: dict, least: float = 0.5, most: int = 10) -> DataFrame:
    """Skills that may be offered, by how well their trigger fits now times their confidence."""
    score = trigger_score(*[F.col(x) for x in ("hours", "app", "transition", "days", "least_seconds", "after_idle")], now)
    rows = skills.where(F.col("stage").isin("reliable", "promoted") & ~F.col("deprecated") & (F.col("confidence") >= 0.7)).withColumn("trigger_score", score).where(F.col("trigger_score") >= least)
    return rows.withColumn("relevance", F.round(F.col("trigger_score") * F.col("confidence"), 12)).orderBy(F.desc("relevance"), "skill").limit(most).select("skill", "trigger_score", "relevance")


def arc_match(people: Column, domains: Column, at: Column, sentiment: Column, arc_people: Column, arc_domains: Column, arc_at: Column, arc_valence: Column) -> Column:
    """How well an episode continues an arc: shared people and domains, recency over two weeks, evenness of mood."""

    def shared(own: Column, others: Column) -> Column:
        some = (F.size(own) > 0) & (F.size(others) > 0)
        return F.when(some, F.size(F.filter(own, lambda x: F.array_contains(others, x))) / F.size(own)).otherwise(0.0)

    recency = F.exp(-F.greatest(at - arc_at, F.lit(0.0)) / DAY / 14)
    return 0.40 * shared(people, arc_people) + 0.30 * shared(domains, arc_domains) + 0.15 * recency + 0.15 * (1 - F.abs(sentiment - arc_valence) / 2)


def match_schemas(schemas: DataFrame, satisfied: Column, now: float) -> DataFrame:
    """Schemas at least half of whose conditions hold, by satisfaction, confidence, generality and recency of refinement."""
    recency = F.exp(-F.greatest(F.lit(now) - F.col("refined_at"), F.lit(0.0)) / DAY / 30)
    score = satisfied * F.col("confidence") * (0.5 + 0.3 * F.col("generality") + 0.2 * recency)
    return schemas.withColumn("satisfied", satisfied).where("satisfied >= 0.5").withColumn("score", score).select("schema", "satisfied", "score")


def utility_weights(interactions: DataFrame, weights: list[float], rate: float = 0.05, margin: float = 0.1, features: int = 4) -> list[float]:
    """Weights after one pairwise hinge step over interactions (rank, f0, f1, ...), on better and worse outcomes.

    The gradient of a pair is there if the better one's lead is below the margin. Interactions become counts and sums by
    rank and score to six digits, a bounded table for the sums that a pair needs; no pair is made.
    """
    score = F.round(sum((F.col(f"f{k}") * weights[k] for k in range(features)), F.lit(0.0)), 6)
    rows = interactions.withColumn("score", score).groupBy("rank", "score").agg(F.count("*").alias("n"), *[F.sum(f"f{k}").alias(f"s{k}") for k in range(features)])
    ranks = [r[0] for r in rows.select("rank").distinct().orderBy("rank").collect()]  # kinds of outcomes
    gradient, pairs = np.zeros(features), 0
    for better in ranks:
        # walk along the scores: a better row at s counts against all worse rows above s - margin
        at = F.when(F.col("rank") == better, F.col("score") - margin).otherwise(F.col("score"))
        side = rows.where(F.col("rank") <= better).withColumn("good", F.col("rank") == better).withColumn("at", at)
        bad = [F.when(~F.col("good"), x).otherwise(0) for x in [F.col("n"), *[F.col(f"s{k}") for k in range(features)]]]
        above = Window.orderBy(F.desc("at"), F.col("good").cast("int").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        side = side.select("good", "n", *[f"s{k}" for k in range(features)], *[F.sum(x).over(above).alias(f"w{k}") for k, x in enumerate(bad)], F.sum(bad[0]).over(Window.partitionBy(F.lit(1))).alias("all"))
        sums = side.where("good").agg(F.sum(F.col("n") * F.col("all")), *[F.sum(F.col(f"s{k}") * F.col("w0") - F.col("n") * F.col(f"w{k + 1}")) for k in range(features)]).first()
        if sums[0]:
            pairs += sums[0]
            gradient += np.array(sums[1:], float)
    if not pairs:
        return weights
    moved = np.clip(np.array(weights) + gradient * rate / pairs, 0.01, 1.0)
    return (moved / moved.sum()).tolist()


def assign_variant(variants: list[tuple[float, float]], jitter: float) -> int:
    """The variant, as (alpha, beta) of its posterior, with the greatest mode plus a small jitter by its place."""

    def value(i: int) -> float:
        a, b = variants[i]
        mode = (a - 1) / (a + b - 2) if a > 1 and b > 1 else a / (a + b)
        return max(0.0, min(1.0, mode + jitter * (1 + i * 0.1) % 0.05))

    return max(range(len(variants)), key=lambda i: (value(i), i))


#: Labels that learning needs, the newest it reads, and its step, margin and greatest change.
LEAST_LABELS, NEWEST, STEP, MARGIN, CHANGE = 20, 500, 0.05, 0.05, 0.05


def learn_weights(feedback: DataFrame, memories: DataFrame, w: S.Weights, now: float) -> S.Weights | None:
    """Weights after one round of coordinate descent on the newest labels (query_text, rid, relevant, score, at), or None
    where there are too few labels or nothing is gained. Reads at most NEWEST rows, whatever there is."""
    if feedback.count() < LEAST_LABELS:
        return None
    newest = feedback.orderBy(F.desc("at"), "query_text", "rid").limit(NEWEST)
    decay = S.decay_score(F.col("importance"), F.col("half_life"), now - F.col("last_access")).alias("decay")
    rows = newest.join(memories, "rid").select("query_text", "relevant", "score", "importance", "valence", decay, S.recency_score(now - F.col("created_at")).alias("recency")).toPandas()
    if rows.empty:
        return None
    decay, recency, importance, valence = (rows[x].to_numpy(float) for x in ("decay", "recency", "importance", "valence"))
    base = rows["score"].to_numpy(float) / (1 + w.alpha * importance)
    sim = np.clip((base - w.decay * decay - w.recency * recency) / w.sim, -1, 1) if w.sim > 0 else np.full(len(rows), 0.5)
    sim = np.where(rows["score"].isna(), 0.5, sim)
    groups = [(g.index[g["relevant"]].to_numpy(), g.index[~g["relevant"].astype(bool)].to_numpy()) for _, g in rows.assign(relevant=rows["relevant"].astype(bool)).groupby(rows["query_text"].fillna(""))]

    def loss(v: S.Weights) -> float:
        gate = 1 / (1 + np.exp(-12 * (sim - v.tau)))
        score = (v.sim * sim + v.decay * decay + v.recency * recency) * (1 + gate * v.alpha * np.minimum(importance, 1)) * (1 + 0.3 * np.abs(valence))
        total, n = 0.0, 0
        for good, bad in groups:
            gap = np.maximum(0, MARGIN - (score[good][:, None] - score[bad][None, :]))
            total, n = total + float((gap**2).sum()), n + gap.size
        return total / n if n else 0.0

    def even(v: S.Weights) -> S.Weights:
        total = v.sim + v.decay + v.recency
        return dataclasses.replace(v, sim=v.sim / total, decay=v.decay / total, recency=v.recency / total) if total > 0 else v

    best, least = w, loss(w)
    for name, low, high in (("sim", 0.05, 0.90), ("decay", 0.05, 0.90), ("recency", 0.05, 0.90), ("tau", 0.10, 0.50), ("alpha", 0.10, 1.50)):
        for step in (STEP, -STEP):
            value = getattr(best, name)
            value = value + step * 0.1 if name == "tau" else value * (1 + step)
            tried = even(dataclasses.replace(best, **{name: min(high, max(low, value))}))
            if (found := loss(tried)) < least:
                best, least = tried, found
    if least >= loss(w):
        return None
    near = {n: min(getattr(w, n) + CHANGE, max(getattr(w, n) - CHANGE, getattr(best, n))) for n in ("sim", "decay", "recency", "tau", "alpha")}
    return even(dataclasses.replace(best, **near))

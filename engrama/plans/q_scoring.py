"""Queries of the scoring functions, each over all memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrama.functions import scoring as S
from engrama.functions import timing as T
from engrama.functions import vectors as V
from engrama.operators import memory as M
from engrama.plans.registry import query
from engrama.sources import adapters as A

NOW = A.NOW
#: SQL of the signals that the scores combine; similarity is a function of the key here, to score without vectors.
SIGNALS = """s AS (SELECT rid, importance, valence, half_life, status, type, domain, namespace, created_at, last_access, access_count, storage_tier, importance * pow(2, -(1706745600.0 - last_access) / half_life) AS decay,
    exp(-(1706745600.0 - created_at) / 604800.0) AS recency, (rid * 31 % 100) / 100.0::DOUBLE AS sim, (rid * 7 % 10) / 10.0::DOUBLE AS prox FROM memories)"""
GATE = "(1 / (1 + exp(-12 * (sim - 0.25))))"


def signals(spark, sf_dir):
    m = M.with_decay(A.memories(spark, sf_dir), NOW)
    return m.withColumn("sim", (F.col("rid") * 31 % 100) / 100.0).withColumn("prox", (F.col("rid") * 7 % 10) / 10.0)


c = F.col


def args():
    return [c("sim"), c("decay"), c("recency"), c("importance")]



@query("score_decay_recency", f"WITH {SIGNALS} SELECT rid, round(decay, 6) AS decay, round(recency, 6) AS recency, round(1 + 0.3 * abs(valence), 6) AS boost FROM s", ("memories",))
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round("decay", 6).alias("decay"), F.round("recency", 6).alias("recency"), F.round(S.valence_boost(c("valence")), 6).alias("boost"))


@query("score_composite", f"WITH {SIGNALS} SELECT rid, round((0.5 * sim + 0.2 * decay + 0.3 * recency) * (1 + {GATE} * 0.8 * least(importance, 1)) * (1 + 0.3 * abs(valence)), 6) AS score, round({GATE}, 6) AS gate FROM s", ("memories",))
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.composite_score(*args(), c("valence")), 6).alias("score"), F.round(S.importance_gate(c("sim")), 6).alias("gate"))


@query("score_composite_sentiment", f"WITH {SIGNALS} SELECT rid, round((0.5 * sim + 0.2 * decay + 0.3 * recency) * (1 + {GATE} * 0.8 * least(importance, 1)) * (1 + 0.3 * abs(valence)) * (1 + 0.2 * CASE WHEN abs(valence) < 1e-10 THEN 0 ELSE -sign(valence) END), 6) AS score FROM s", ("memories",))
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.composite_score(*args(), c("valence"), S.query_sentiment("the worst day")), 6).alias("score"))


@query(
    "score_graph_composite",
    f"""WITH {SIGNALS} SELECT rid, round(CASE WHEN prox > 0 THEN (0.35 * sim + 0.15 * decay + 0.2 * recency + 0.3 * prox) * (1 + {GATE} * 0.6 * least(importance, 1))
    ELSE (0.5 * sim + 0.2 * decay + 0.3 * recency) * (1 + {GATE} * 0.8 * least(importance, 1)) END * (1 + 0.3 * abs(valence)), 6) AS score FROM s""",
    ("memories",),
)
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.graph_composite_score(*args(), c("valence"), c("prox")), 6).alias("score"))


LEARNED = S.Weights(sim=0.45, decay=0.25, recency=0.30, tau=0.3, alpha=0.7)
LGATE = "(1 / (1 + exp(-12 * (sim - 0.3))))"


@query("score_adaptive", f"WITH {SIGNALS} SELECT rid, round((0.45 * sim + 0.25 * decay + 0.3 * recency) * (1 + {LGATE} * 0.7 * least(importance, 1)) * (1 + 0.3 * abs(valence)), 6) AS score FROM s", ("memories",))
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.composite_score(*args(), c("valence"), w=LEARNED), 6).alias("score"))


@query(
    "score_adaptive_graph",
    f"""WITH {SIGNALS} SELECT rid, round(CASE WHEN prox > 0 THEN (0.315 * sim + 0.175 * decay + 0.21 * recency + 0.3 * prox) * (1 + {LGATE} * 0.525 * least(importance, 1))
    ELSE (0.45 * sim + 0.25 * decay + 0.3 * recency) * (1 + {LGATE} * 0.7 * least(importance, 1)) END * (1 + 0.3 * abs(valence)), 6) AS score FROM s""",
    ("memories",),
)
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.graph_composite_score(*args(), c("valence"), c("prox"), w=LEARNED), 6).alias("score"))


def _parts(df, struct):
    return df.withColumn("_p", struct).select("rid", *[F.round(f"_p.{k}", 6).alias(f"c_{k}") for k in ("similarity", "decay", "recency", "importance", "graph")])


@query("score_contributions", f"WITH {SIGNALS} SELECT rid, round(0.5 * sim, 6) AS c_similarity, round(0.2 * decay, 6) AS c_decay, round(0.3 * recency, 6) AS c_recency, round({GATE} * 0.8 * least(importance, 1), 6) AS c_importance, 0.0::DOUBLE AS c_graph FROM s", ("memories",))
def _(spark, sf_dir):
    return _parts(signals(spark, sf_dir), S.contributions(*args()))


@query(
    "score_graph_contributions",
    f"""WITH {SIGNALS} SELECT rid, round(CASE WHEN prox > 0 THEN 0.35 ELSE 0.5 END * sim, 6) AS c_similarity, round(CASE WHEN prox > 0 THEN 0.15 ELSE 0.2 END * decay, 6) AS c_decay, round(CASE WHEN prox > 0 THEN 0.2 ELSE 0.3 END * recency, 6) AS c_recency,
    round({GATE} * CASE WHEN prox > 0 THEN 0.6 ELSE 0.8 END * least(importance, 1), 6) AS c_importance, round(0.3 * prox, 6) AS c_graph FROM s""",
    ("memories",),
)
def _(spark, sf_dir):
    return _parts(signals(spark, sf_dir), S.contributions(*args(), c("prox")))


@query("score_adaptive_contributions", f"WITH {SIGNALS} SELECT rid, round(0.45 * sim, 6) AS c_similarity, round(0.25 * decay, 6) AS c_decay, round(0.3 * recency, 6) AS c_recency, round({LGATE} * 0.7 * least(importance, 1), 6) AS c_importance, 0.0::DOUBLE AS c_graph FROM s", ("memories",))
def _(spark, sf_dir):
    return _parts(signals(spark, sf_dir), S.contributions(*args(), w=LEARNED))


@query(
    "score_adaptive_graph_contributions",
    f"""WITH {SIGNALS} SELECT rid, round(CASE WHEN prox > 0 THEN 0.315 ELSE 0.45 END * sim, 6) AS c_similarity, round(CASE WHEN prox > 0 THEN 0.175 ELSE 0.25 END * decay, 6) AS c_decay, round(CASE WHEN prox > 0 THEN 0.21 ELSE 0.3 END * recency, 6) AS c_recency,
    round({LGATE} * CASE WHEN prox > 0 THEN 0.525 ELSE 0.7 END * least(importance, 1), 6) AS c_importance, round(0.3 * prox, 6) AS c_graph FROM s""",
    ("memories",),
)
def _(spark, sf_dir):
    return _parts(signals(spark, sf_dir), S.contributions(*args(), c("prox"), LEARNED))


@query(
    "score_why",
    f"""WITH {SIGNALS} SELECT rid, CASE WHEN r = '' THEN 'matched query' ELSE r END AS reasons FROM (SELECT rid, concat_ws('; ', CASE WHEN sim > 0.5 THEN 'semantically similar (' || printf('%.2f', sim) || ')' END, CASE WHEN recency > 0.5 THEN 'recent' END,
    CASE WHEN decay > 0.3 THEN 'important' END, CASE WHEN abs(valence) > 0.5 THEN 'emotionally weighted' END) AS r FROM s)""",
    ("memories",),
)
def _(spark, sf_dir):
    why = S.why_retrieved(c("sim"), c("recency"), c("decay"), c("valence"))
    # the second decimal of decay and valence may round either way between engines, so those reasons go without figures
    plain = F.transform(why, lambda w: F.regexp_replace(w, r"^(important|emotionally weighted) \(.*\)$", "$1"))
    return signals(spark, sf_dir).select("rid", F.array_join(plain, "; ").alias("reasons"))


@query("score_eviction", f"WITH {SIGNALS} SELECT rid, round(0.6 * decay + 0.4 * recency, 6) AS score FROM s", ("memories",))
def _(spark, sf_dir):
    return signals(spark, sf_dir).select("rid", F.round(S.eviction_score(c("decay"), c("recency")), 6).alias("score"))


@query("score_recency_relevance", f"WITH {SIGNALS} SELECT rid, round(greatest(pow(2, -(1706745600.0 - created_at) / 86400.0), 0.01), 6) AS relevance FROM s", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).select("rid", F.round(T.recency_relevance(F.lit(NOW) - c("created_at"), T.DAY), 6).alias("relevance"))


@query(
    "score_recency_relevance_domain",
    """SELECT rid, kind, round(greatest(pow(2, -(1706745600.0 - created_at) / CASE kind WHEN 'conversation' THEN 14400.0 WHEN 'task' THEN 259200.0 WHEN 'goal' THEN 2592000.0 ELSE 86400.0 END), 0.01), 6) AS relevance
    FROM (SELECT *, ['conversation', 'task', 'goal', 'other'][1 + rid % 4] AS kind FROM memories)""",
    ("memories",),
)
def _(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("conversation", "task", "goal", "other"))), (c("rid") % 4 + 1).cast("int"))
    m = A.memories(spark, sf_dir).withColumn("kind", kind)
    return m.select("rid", "kind", F.round(T.recency_relevance(F.lit(NOW) - c("created_at"), T.domain_half_life(c("kind"))), 6).alias("relevance"))


_SIG = "1 / (1 + exp(-6 * ({} - 0.5)))"


@query(
    "deadline_urgency",
    f"""SELECT rid, round(CASE WHEN due_at - 1706745600.0 < 0 THEN 1.0 WHEN due_at - 1706745600.0 > 604800.0 THEN 0.1 WHEN due_at IS NOT NULL THEN
    0.1 + 0.85 * ({_SIG.format("(1 - (due_at - 1706745600.0) / 604800.0)")} - {_SIG.format("0")}) / ({_SIG.format("1")} - {_SIG.format("0")}) END, 6) AS urgency FROM memories""",
    ("memories",),
)
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).select("rid", F.round(T.deadline_urgency(NOW, c("due_at")), 6).alias("urgency"))


@query(
    "deadline_urgency_by_priority",
    f"""SELECT rid, round(CASE WHEN due_at - 1706745600.0 < 0 THEN 1.0 WHEN due_at - 1706745600.0 > w THEN 0.1 WHEN due_at IS NOT NULL THEN
    0.1 + 0.85 * ({_SIG.format("(1 - (due_at - 1706745600.0) / w)")} - {_SIG.format("0")}) / ({_SIG.format("1")} - {_SIG.format("0")}) END, 6) AS urgency FROM (SELECT *, 604800.0 * (0.5 + 1.5 * importance) AS w FROM memories)""",
    ("memories",),
)
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).select("rid", F.round(T.deadline_urgency(NOW, c("due_at"), 7 * T.DAY * (0.5 + 1.5 * c("importance"))), 6).alias("urgency"))


@query(
    "urgency_curves",
    """SELECT rid, kind, round(greatest(0, least(1, CASE kind WHEN 'linear' THEN 0.2 + 0.00001 * (1706745600.0 - created_at) WHEN 'sigmoid' THEN 1 / (1 + exp(0.00005 * (due - 1706745600.0 - 3600.0)))
    WHEN 'step' THEN CASE WHEN 1706745600.0 >= due - 7200.0 THEN 0.9 ELSE 0.2 END WHEN 'decay' THEN 0.8 * pow(0.7, access_count) ELSE 0.5 END)), 6) AS urgency
    FROM (SELECT *, ['linear', 'sigmoid', 'step', 'decay', 'constant'][1 + rid % 5] AS kind, coalesce(due_at, 1706745600.0 + 3600.0 * (rid % 50)) AS due FROM memories)""",
    ("memories",),
)
def _(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("linear", "sigmoid", "step", "decay", "constant"))), (c("rid") % 5 + 1).cast("int"))
    m = A.memories(spark, sf_dir).withColumn("kind", kind).withColumn("due", F.coalesce("due_at", F.lit(NOW) + 3600.0 * (c("rid") % 50)))
    return m.select("rid", "kind", F.round(T.urgency_curve(c("kind"), NOW, c("created_at"), c("due"), c("access_count")), 6).alias("urgency"))


@query(
    "temporal_relevance_composite",
    f"""WITH p AS (SELECT rid, greatest(0.01, pow(2, -(1706745600.0 - last_access) / 86400.0)) AS recent, CASE WHEN rid % 3 = 0 THEN 1 / (1 + greatest(0, 3600.0 * (rid % 40) - 7200) / 3600.0) ELSE 0 END AS again,
    CASE WHEN due_at IS NULL THEN 0 WHEN due_at - 1706745600.0 < 0 THEN 1.0 WHEN due_at - 1706745600.0 > 604800.0 THEN 0.1 ELSE 0.1 + 0.85 * ({_SIG.format("(1 - (due_at - 1706745600.0) / 604800.0)")} - {_SIG.format("0")}) / ({_SIG.format("1")} - {_SIG.format("0")}) END AS due FROM memories)
    SELECT rid, round(least(1, greatest(0, 0.4 * recent + 0.3 * again + 0.3 * due)), 6) AS relevance FROM p""",
    ("memories",),
)
def _(spark, sf_dir):
    again = F.when(c("rid") % 3 == 0, NOW + 3600.0 * (c("rid") % 40) - 7200)  # some come again, a few of them overdue
    return A.memories(spark, sf_dir).select("rid", F.round(T.relevance(NOW, c("last_access"), again, c("due_at")), 6).alias("relevance"))


@query(
    "node_relevance",
    f"WITH {SIGNALS} SELECT rid, round((0.35 * sim + 0.25 * importance + 0.15 * prox + 0.15 * decay + 0.1 * exp(-(1706745600.0 - last_access) / 86400.0)) * (1 + 0.2 * recency), 6) AS relevance FROM s",
    ("memories",),
)
def _(spark, sf_dir):
    age = F.exp(-(F.lit(NOW) - c("last_access")) / T.DAY)
    return signals(spark, sf_dir).select("rid", F.round((0.35 * c("sim") + 0.25 * c("importance") + 0.15 * c("prox") + 0.15 * c("decay") + 0.1 * age) * (1 + 0.2 * c("recency")), 6).alias("relevance"))


@query(
    "vector_norm_distance",
    """SELECT a.rid, round(sqrt(list_sum(list_transform(a.v, lambda x: x * x))), 5) AS norm,
    round(CASE WHEN list_sum(list_transform(a.v, lambda x: x * x)) = 0 THEN 1 ELSE greatest(0, least(2, 1 - list_dot_product(a.v, b.v) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))))) END, 5) AS distance
    FROM vectors a, (SELECT v FROM vectors WHERE rid = 0) b""",
    ("vectors",),
)
def _(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    first = v.where("rid = 0").select(c("v").alias("q"))  # one row
    return v.crossJoin(F.broadcast(first)).select("rid", F.round(V.norm(c("v")), 5).alias("norm"), F.round(V.cosine_distance(c("v"), c("q")), 5).alias("distance"))

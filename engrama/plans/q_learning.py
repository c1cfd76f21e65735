"""Queries of learning: relevance feedback, ranking loss, calibration, outcome models, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.operators import beliefs as B
from engrama.plans.registry import query
from engrama.sources import adapters as A

c = F.col


def fb(spark, sf_dir):
    return A.feedback(spark, sf_dir)


@query(
    "ranking_loss",
    "SELECT a.query_id, round(avg(pow(greatest(0, 0.05 - (a.score - b.score)), 2)), 6) AS loss FROM feedback a JOIN feedback b ON a.query_id = b.query_id WHERE a.relevant AND NOT b.relevant GROUP BY 1",
    ("feedback",),
)
def _(spark, sf_dir):
    return B.ranking_loss(fb(spark, sf_dir)).select("query_id", F.round("loss", 6).alias("loss"))


@query("feedback_counts", "SELECT query_id, count(*) AS n, count(*) FILTER (relevant) AS relevant, round(avg(score), 6) AS score FROM feedback GROUP BY 1", ("feedback",))
def _(spark, sf_dir):
    return fb(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("relevant").alias("relevant"), F.round(F.avg("score"), 6).alias("score"))


@query(
    "retrieval_metrics",
    """WITH r AS (SELECT query_id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rid) AS k FROM feedback)
    SELECT query_id, round(count(*) FILTER (relevant AND k <= 10) / 10.0, 6) AS precision_10, round(count(*) FILTER (relevant AND k <= 10) / count(*) FILTER (relevant)::DOUBLE, 6) AS recall_10, round(1.0 / min(CASE WHEN relevant THEN k END), 6) AS mrr FROM r GROUP BY 1 HAVING count(*) FILTER (relevant) > 0""",
    ("feedback",),
)
def _(spark, sf_dir):
    r = fb(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rid")))
    top = F.count_if(c("relevant") & (c("k") <= 10))
    g = r.groupBy("query_id").agg(top.alias("h"), F.count_if("relevant").alias("n"), F.min(F.when(c("relevant"), c("k"))).alias("first")).where("n > 0")
    return g.select("query_id", F.round(c("h") / 10.0, 6).alias("precision_10"), F.round(c("h") / c("n"), 6).alias("recall_10"), F.round(1.0 / c("first"), 6).alias("mrr"))


CAL = "b AS (SELECT least(9, CAST(floor(score * 10) AS INTEGER)) AS bin, count(*) AS n, avg(score) AS predicted, avg(relevant::INT) AS actual FROM feedback GROUP BY 1)"


@query("calibration_bins", f"WITH {CAL} SELECT bin, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM b", ("feedback",))
def _(spark, sf_dir):
    b = B.calibration_bins(fb(spark, sf_dir).withColumn("outcome", c("relevant").cast("int")))
    return b.select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


@query("calibration_error", f"WITH {CAL} SELECT round(sum(n * abs(actual - predicted)) / sum(n), 6) AS error FROM b", ("feedback",))
def _(spark, sf_dir):
    b = B.calibration_bins(fb(spark, sf_dir).withColumn("outcome", c("relevant").cast("int")))
    return b.agg(F.round(F.sum(c("n") * F.abs(c("actual") - c("predicted"))) / F.sum("n"), 6).alias("error"))


@query("calibration_refit")
def _(spark, sf_dir):
    b = B.calibration_bins(fb(spark, sf_dir).withColumn("outcome", c("relevant").cast("int")))
    return B.pooled(b).select("bin", "n", F.round("actual", 6).alias("actual"), F.round("fitted", 6).alias("fitted"))


OUT = "o AS (SELECT user_id % 10 AS state, kind AS action, CASE WHEN value > 50 THEN 'good' ELSE 'bad' END AS outcome FROM ev)"


def outcomes(spark, sf_dir):
    return A.events(spark, sf_dir).select((c("user_id") % 10).alias("state"), c("kind").alias("action"), F.when(c("value") > 50, "good").otherwise("bad").alias("outcome"))


@query("outcome_counts", f"WITH {OUT} SELECT state, action, count(*) FILTER (outcome = 'good') AS good, count(*) FILTER (outcome = 'bad') AS bad FROM o GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("state", "action").agg(F.count_if(c("outcome") == "good").alias("good"), F.count_if(c("outcome") == "bad").alias("bad"))


@query("outcome_posteriors", f"WITH {OUT} SELECT state, action, round((count(*) FILTER (outcome = 'good') + 1) / (count(*) + 2)::DOUBLE, 6) AS p FROM o GROUP BY 1, 2", ("ev",))
def _(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("state", "action").agg(F.round((F.count_if(c("outcome") == "good") + 1) / (F.count("*") + 2), 6).alias("p"))


@query(
    "outcome_backoff",
    f"WITH {OUT}, l AS (SELECT state, action, count(*) AS n, avg((outcome = 'good')::INT) AS p FROM o GROUP BY 1, 2), g AS (SELECT action, avg((outcome = 'good')::INT) AS q FROM o GROUP BY 1) SELECT state, action, round(greatest(0.001, least(1, n / 100.0) * p + (1 - least(1, n / 100.0)) * q), 6) AS p FROM l JOIN g USING (action)",
    ("ev",),
)
def _(spark, sf_dir):
    good = F.avg((c("outcome") == "good").cast("int"))
    o = outcomes(spark, sf_dir)
    l_, g = o.groupBy("state", "action").agg(F.count("*").alias("n"), good.alias("p")), o.groupBy("action").agg(good.alias("q"))
    w = F.least(F.lit(1.0), c("n") / 100.0)
    return l_.join(g, "action").select("state", "action", F.round(F.greatest(F.lit(0.001), w * c("p") + (1 - w) * c("q")), 6).alias("p"))


@query("outcome_entropy", f"WITH {OUT}, p AS (SELECT state, action, (count(*) FILTER (outcome = 'good') + 1) / (count(*) + 2)::DOUBLE AS p FROM o GROUP BY 1, 2) SELECT state, action, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM p", ("ev",))
def _(spark, sf_dir):
    p = outcomes(spark, sf_dir).groupBy("state", "action").agg(((F.count_if(c("outcome") == "good") + 1) / (F.count("*") + 2)).alias("p"))
    return p.select("state", "action", F.round(-(c("p") * F.log("p") + (1 - c("p")) * F.log(1 - c("p"))), 6).alias("entropy"))


@query("best_action", f"WITH {OUT}, p AS (SELECT state, action, (count(*) FILTER (outcome = 'good') + 1) / (count(*) + 2)::DOUBLE AS p FROM o GROUP BY 1, 2) SELECT state, max_by(action, struct_pack(a := round(p, 9), b := action)) AS action FROM p GROUP BY state", ("ev",))
def _(spark, sf_dir):
    p = outcomes(spark, sf_dir).groupBy("state", "action").agg(((F.count_if(c("outcome") == "good") + 1) / (F.count("*") + 2)).alias("p"))
    return p.groupBy("state").agg(F.max_by("action", F.struct(F.round("p", 9), "action")).alias("action"))


@query(
    "experiment_superiority",
    f"""WITH {OUT}, t AS (SELECT action, (1 + count(*) FILTER (outcome = 'good'))::DOUBLE AS a, (1 + count(*) FILTER (outcome = 'bad'))::DOUBLE AS b FROM o GROUP BY 1), m AS (SELECT action, a / (a + b) AS m, a * b / ((a + b) * (a + b) * (a + b + 1)) AS v FROM t)
    SELECT x.action AS a, y.action AS b, round(1 / (1 + exp(-1.7 * (x.m - y.m) / sqrt(x.v + y.v))), 6) AS p FROM m x JOIN m y ON x.action < y.action""",
    ("ev",),
)
def _(spark, sf_dir):
    t = outcomes(spark, sf_dir).groupBy("action").agg((F.count_if(c("outcome") == "good") + 1.0).alias("a"), (F.count_if(c("outcome") == "bad") + 1.0).alias("b"))
    s = c("a") + c("b")
    m = t.select("action", (c("a") / s).alias("m"), (c("a") * c("b") / (s * s * (s + 1))).alias("v"))
    x, y = m.toDF("xa", "xm", "xv"), m.toDF("ya", "ym", "yv")  # a handful of variants
    return x.join(y, c("xa") < c("ya")).select(c("xa").alias("a"), c("ya").alias("b"), F.round(1 / (1 + F.exp(-1.7 * (c("xm") - c("ym")) / F.sqrt(c("xv") + c("yv")))), 6).alias("p"))


@query("logistic_score", "SELECT event_id, round(1 / (1 + exp(-(0.02 * value - 0.01 * k + CASE kind WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.5 ELSE 0 END + 0.5))), 6) AS p FROM ev", ("ev",))
def _(spark, sf_dir):
    z = 0.02 * c("value") - 0.01 * c("k") + F.when(c("kind") == "error", -1.0).when(c("kind") == "purchase", 1.5).otherwise(0.0) + 0.5
    return A.events(spark, sf_dir).select("event_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@query("bias_scores", "SELECT rid, round((0.6 - 0.5) * valence * 1.0 + (0.7 - 0.5) * importance * 0.8 + (0.4 - 0.5) * certainty * 0.5, 6) + 0.0 AS bias FROM memories", ("memories",))
def _(spark, sf_dir):
    return A.memories(spark, sf_dir).select("rid", (F.round((0.6 - 0.5) * c("valence") * 1.0 + (0.7 - 0.5) * c("importance") * 0.8 + (0.4 - 0.5) * c("certainty") * 0.5, 6) + 0.0).alias("bias"))

"""The reasoning pipeline: steps chained into one plan, run when executed, each step a frame transformation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.functions import scoring as S
from engrama.operators import beliefs as B
from engrama.operators import events as E
from engrama.operators import graph as G
from engrama.operators import memory as M


class Reason:
    """reason(memories=..., edges=..., links=..., events=...).attend(seeds).recall(20).constrain("...").execute()

    The current frame has rid and score. Catalyst plans all steps together; nothing runs before execute().
    """

    def __init__(self, now: float, memories: DataFrame, edges: DataFrame | None = None, links: DataFrame | None = None, events: DataFrame | None = None):
        self.now, self.memories, self.edges, self.links, self.events = now, memories, edges, links, events
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def _then(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Reason:
        self.steps.append((name, f))
        return self

    def attend(self, seeds: DataFrame, hops: int = 2, decay: float = 0.5) -> Reason:
        """Add spreading activation from seed entities (entity, activation) to the scores of linked memories."""

        def step(now: DataFrame) -> DataFrame:
            heat = G.spread(self.edges, seeds, hops, decay).join(self.links, "entity").groupBy("rid").agg(F.max("activation").alias("heat"))
            return now.join(heat, "rid", "left").withColumn("score", F.col("score") + F.coalesce("heat", F.lit(0.0))).drop("heat")

        return self._then("attend", step)

    def recall(self, k: int = 20) -> Reason:
        return self._then("recall", lambda now: now.orderBy(F.desc(F.round("score", 9)), "rid").limit(k))

    def believe(self, evidence: DataFrame) -> Reason:
        """Weigh scores by the probability of each memory's claims; evidence is (rid, weight, at)."""

        def step(now: DataFrame) -> DataFrame:
            odds = B.ordered(evidence, ["rid"], ["at"], F.col("weight")).select("rid", B.probability(B.log_odds_fold(F.col("xs"))).alias("p"))
            return now.join(odds, "rid", "left").withColumn("score", F.col("score") * F.coalesce("p", F.lit(0.5)) * 2).drop("p")

        return self._then("believe", step)

    def constrain(self, condition: str) -> Reason:
        return self._then("constrain", lambda now: now.where(condition))

    def compare(self, bias: str = "0") -> Reason:
        """Add a bias expression to the score and rank the candidates, a bounded list by then."""

        def step(now: DataFrame) -> DataFrame:
            from pyspark.sql.window import Window

            out = now.withColumn("score", F.col("score") + F.expr(bias))
            return out.withColumn("rank", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc(F.round("score", 9)), "rid")))

        return self._then("compare", step)

    def anticipate(self, horizon: float, column: str, key: str = "user_id") -> Reason:
        """Keep memories whose `column` names a key of the events from which one is expected within the horizon: at the
        first step at which the rate, summed from now on, comes to one event."""

        def step(now: DataFrame) -> DataFrame:
            model = E.point_process(self.events, self.now, key)
            soon = E.predict_next(model, self.now, horizon=horizon, step=horizon / 240).where(F.col("expected") <= self.now + horizon).select(F.col(key).alias(column)).distinct()
            return now.join(soon, column, "left_semi")

        return self._then("anticipate", step)

    def project(self, ahead: float) -> Reason:
        """Scores as they will be `ahead` seconds from now, if nothing is looked at until then."""

        def step(now: DataFrame) -> DataFrame:
            later = M.with_decay(now.drop("decay", "recency"), self.now + ahead)
            return later.withColumn("score", S.eviction_score(F.col("decay"), F.col("recency")) * (1 + F.col("importance")))

        return self._then("project", step)

    def plan(self, steps: int = 3) -> Reason:
        return self._then("plan", lambda now: now.where(F.col("type") == "procedural").orderBy(F.desc(F.round("score", 9)), "rid").limit(steps))

    def assess(self) -> Reason:
        return self._then("assess", lambda now: now.withColumn("assessed", F.col("certainty") * F.least(F.col("score"), F.lit(1.0))))

    def coherence_check(self, least: float = 0.0) -> Reason:
        return self._then("coherence", lambda now: now.withColumn("coherent", (F.col("status") == "active") & (F.col("certainty") >= least)))

    def explain(self) -> list[str]:
        return [name for name, _ in self.steps]

    def execute(self) -> DataFrame:
        rows = M.with_decay(M.active(self.memories), self.now)
        out = rows.withColumn("score", S.eviction_score(F.col("decay"), F.col("recency")) * (1 + F.col("importance")))
        for _, f in self.steps:
            out = out.transform(f)
        return out

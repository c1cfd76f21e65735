"""Reasoning moves over claims: canonical events, profiles, load, ancestry, axioms, preconditions, adversarial candidates.

Moves have move_id, move_type, version, regime, outcome (null while open), created_at, horizon (seconds, may be null);
io has move_id, claim_id, role (input, output, side_effect); corrections move_id, at and the fields they set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.operators.claims import KEY

#: Pairs of moves with a law of their own, what a move needs of its proposition, how a candidate may be found.
PAIRS = [("decompose_aggregate_identity", "decomposition", "aggregate_back"), ("negate_analogize_non_commutative", "negate_and_test", "analogy")]
NEEDS = [("source_audit_requires_external_ancestry", "source_audit"), ("compression_requires_support", "compression"), ("hypothesis_generation_skips_present_tense_conflict", "hypothesis_generation")]
FOUND_BY = ["contradiction", "retraction", "calibration_signal", "human_audit"]
HARM = ["retracted", "harmful_side_effect"]


def canonical(moves: DataFrame, corrections: DataFrame) -> DataFrame:
    """Moves as corrected: of each field the newest correction that sets it, else what was recorded."""
    fields = ["move_type", "version", "regime"]
    newest = corrections.groupBy("move_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("at", f))).alias(f"_{f}") for f in fields])
    out = moves.join(newest, "move_id", "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def profiles(moves: DataFrame, now: float) -> DataFrame:
    """By type, version and regime: uses, resolved ones (with an outcome or past their horizon), outcomes, and the share of
    the resolved that brought in a contradiction (null without any)."""
    resolved = F.col("outcome").isNotNull() | (F.col("created_at") + F.col("horizon") < now)
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    g = moves.groupBy("move_type", "version", "regime").agg(F.count("*").alias("uses"), F.count_if(resolved).alias("resolved"), count("corroborated"), *[count(x) for x in HARM])
    return g.withColumn("contradiction_rate", F.when(F.col("resolved") > 0, sum((F.col(x) for x in HARM), F.lit(0)) / F.col("resolved")))


def consuming(io: DataFrame) -> DataFrame:
    """(claim_id, moves): how many moves take a claim as input."""
    return io.where("role = 'input'").groupBy("claim_id").agg(F.countDistinct("move_id").alias("moves"))


def load(io: DataFrame, claims: DataFrame) -> DataFrame:
    """By proposition the moves that take any of its claims as input, 0 without any."""
    used = io.where("role = 'input'").select("move_id", "claim_id").distinct()
    return claims.select(*KEY, "claim_id").join(used, "claim_id", "left").groupBy(*KEY).agg(F.countDistinct("move_id").alias("load"))


def ancestry(io: DataFrame, claims: DataFrame, depth: int = 2) -> DataFrame:
    """By proposition the self-generated share of the claims it was made from, up to `depth` moves back; 0 without any."""
    back = io.where("role = 'output'").select("move_id", F.col("claim_id").alias("made")).join(io.where("role = 'input'").select("move_id", "claim_id"), "move_id").select("made", "claim_id").distinct()
    edge = claims.select(*KEY, F.col("claim_id").alias("made"))
    seen = None
    for _ in range(depth):
        step = edge.join(back, "made").select(*KEY, "claim_id").distinct()
        if seen is not None:
            step = step.join(seen, [*KEY, "claim_id"], "left_anti")
        seen = step if seen is None else seen.unionByName(step)
        edge = step.withColumnRenamed("claim_id", "made")
    own = claims.select("claim_id", F.col("self_generated").cast("int").alias("own"))
    share = seen.join(own, "claim_id", "left").groupBy(*KEY).agg(F.avg(F.coalesce("own", F.lit(0))).alias("ancestral"))
    return claims.select(*KEY).distinct().join(share, KEY, "left").fillna(0.0, ["ancestral"])


def composition_axioms(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """(left, right, axiom) for pairs of canonical moves whose types have a law of their own."""
    kind = moves.select("move_id", "move_type")
    rows = pairs.join(kind.toDF("left", "_l"), "left").join(kind.toDF("right", "_r"), "right")
    law = F.when(F.lit(False), "")
    for name, a, b in PAIRS:
        law = law.when((F.col("_l") == a) & (F.col("_r") == b), name)
    return rows.withColumn("axiom", law).where("axiom is not null").select("left", "right", "axiom")


def violations(asked: DataFrame) -> DataFrame:
    """asked (move_type, ancestral, support, flags, ...) with `axiom`, the need that isn't met, where one isn't; an unknown
    ancestry or support doesn't meet a need."""
    external = F.coalesce(F.col("ancestral") < 1.0, F.lit(False))
    supported = F.coalesce(F.col("support") > 0.0, F.lit(False))
    calm = F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(16)) == 0
    unmet = F.when(F.lit(False), "")
    for (name, kind), met in zip(NEEDS, (external, supported, calm), strict=True):
        unmet = unmet.when((F.col("move_type") == kind) & ~met, name)
    return asked.withColumn("axiom", unmet).where("axiom is not null")


def auto_file(before: DataFrame, after: DataFrame, claims: DataFrame, io: DataFrame, filed: DataFrame, found_by: str = "contradiction") -> DataFrame:
    """(move_id, found_by, status): a candidate for each move that made a claim of a proposition whose flags (KEY, flags)
    gained a bit, unless one found the same way is filed."""
    if found_by not in FOUND_BY:
        raise ValueError(f"a candidate is found by one of {', '.join(FOUND_BY)}")
    old = before.select(*KEY, F.col("flags").alias("_f"))
    gained = after.join(old, KEY, "left").where(F.col("flags").bitwiseAND(F.bitwise_not(F.coalesce("_f", F.lit(0).cast("long")))) != 0)
    made = claims.join(gained.select(*KEY), KEY, "left_semi").select("claim_id")
    moves = io.where("role = 'output'").join(made, "claim_id", "left_semi").select("move_id").distinct()
    known = filed.where(F.col("found_by") == found_by).select("move_id")
    return moves.join(known, "move_id", "left_anti").select("move_id", F.lit(found_by).alias("found_by"), F.lit("candidate").alias("status"))


def promote(candidates: DataFrame, move_id, lesson: str, actor: str) -> DataFrame:
    """Candidates with one confirmed by a named curator and its lesson; the rest as they are."""
    if not lesson.strip() or not actor.strip():
        raise ValueError("a lesson and who drew it must be given")
    mine = (F.col("move_id") == move_id) & (F.col("status") == "candidate")
    return candidates.withColumn("lesson", F.when(mine, lesson)).withColumn("curator", F.when(mine, actor)).withColumn("status", F.when(mine, "confirmed").otherwise(F.col("status")))

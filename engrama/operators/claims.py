"""Evidence over claims: discounts, mass, coherence, contest state. A proposition is (src, rel, dst, namespace).

Claims have claim_id, the proposition, polarity (1 or -1), extractor, lineage (sources), weight, self_generated, modality,
source_rid, valid_from, valid_to, created_at. Nothing here makes pairs of claims: pairs are counted by aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions.timing import disjoint

KEY = ["src", "rel", "dst", "namespace"]
SIDE = [*KEY, "polarity"]
#: What shared sources, shared extractors and shared self-generation weigh.
SOURCE, PIPELINE, SELF_GENERATED = 0.5, 0.3, 0.7
#: Modalities that count, and the bits of a contest's flags.
MODALITIES = 6.0
DUPLICATION_RISK, SAME_SOURCE, HETEROGENEOUS, SAME_ARTIFACT, PRESENT_TENSE = 1, 2, 4, 8, 16


def leave_one_out(claims: DataFrame) -> DataFrame:
    """claims with `jaccard`: the sources of a claim that others of its side name too, over all sources of the side."""
    named = claims.select(*SIDE, "claim_id", F.explode(F.array_distinct("lineage")).alias("x"))
    by_source, side = Window.partitionBy(*SIDE, "x"), Window.partitionBy(*SIDE)
    named = named.withColumn("n", F.count("*").over(by_source)).withColumn("first", F.when(F.row_number().over(by_source.orderBy("claim_id")) == 1, 1).otherwise(0))
    named = named.withColumn("every", F.sum("first").over(side)).groupBy(*SIDE, "claim_id").agg(F.count_if(F.col("n") > 1).alias("shared"), F.first("every").alias("every"))
    return claims.join(named, [*SIDE, "claim_id"], "left").withColumn("jaccard", F.coalesce(F.col("shared") / F.col("every"), F.lit(0.0))).drop("shared", "every")


def omegas(claims: DataFrame) -> DataFrame:
    """claims with `jaccard` and `omega`, the share of a claim's weight that counts beside the others of its side."""
    side = Window.partitionBy(*SIDE)
    others = F.count("*").over(side) - 1
    same = F.count("*").over(Window.partitionBy(*SIDE, "extractor")) - 1
    generated = F.count_if("self_generated").over(side)
    pipeline = F.when(others > 0, same / others).otherwise(0.0)
    echo = F.when(F.col("self_generated") & (generated > 1), 1.0).otherwise(0.0)
    return leave_one_out(claims).withColumn("omega", 1 / (1 + SOURCE * F.col("jaccard") + PIPELINE * pipeline + SELF_GENERATED * echo))


def mass(claims: DataFrame) -> DataFrame:
    """By proposition the mass and the effective independence (sum of omegas) of either side."""
    on = lambda p, v: F.sum(F.when(F.col("polarity") == p, v).otherwise(0.0))
    weighed, omega = F.col("weight") * F.col("omega"), F.col("omega")
    return omegas(claims).groupBy(*KEY).agg(on(1, weighed).alias("support"), on(-1, weighed).alias("attack"), on(1, omega).alias("support_independence"), on(-1, omega).alias("attack_independence"), F.count("*").alias("claims"))


def write_tier(claims: DataFrame) -> DataFrame:
    """By proposition, over its supporting claims: distinct modalities over all, and the self-generated share."""
    up = F.col("polarity") == 1
    consilience = F.least(F.lit(1.0), F.countDistinct(F.when(up, F.col("modality"))) / MODALITIES)
    return claims.groupBy(*KEY).agg(consilience.alias("consilience"), F.coalesce(F.avg(F.when(up, F.col("self_generated").cast("int"))), F.lit(0.0)).alias("self_generated"))


def temporal_coherence(claims: DataFrame) -> DataFrame:
    """1 - polarity flips per step in order of creation; tombstoned claims count on purpose."""
    before = F.lag("polarity").over(Window.partitionBy(*KEY).orderBy("created_at", "claim_id"))
    rows = claims.select(*KEY, F.when(before != F.col("polarity"), 1).otherwise(0).alias("flip"))
    return rows.groupBy(*KEY).agg(F.when(F.count("*") > 1, 1 - F.sum("flip") / (F.count("*") - 1)).otherwise(1.0).alias("coherence"))


def same_source_opposites(claims: DataFrame) -> DataFrame:
    """By proposition the pairs of opposite claims with identical lineage; claims without a source have none."""
    named = claims.where(F.size("lineage") > 0).withColumn("lineage", F.array_sort(F.array_distinct("lineage")))
    both = named.groupBy(*KEY, "lineage").agg(F.count_if(F.col("polarity") == 1).alias("a"), F.count_if(F.col("polarity") == -1).alias("b"))
    return both.groupBy(*KEY).agg(F.sum(F.col("a") * F.col("b")).alias("same_source"))


def same_artifact_extractors(claims: DataFrame) -> DataFrame:
    """By proposition the pairs of opposite claims from one artifact by different extractors: all such pairs less those by one."""
    each = claims.where("source_rid is not null").groupBy(*KEY, "source_rid", "extractor").agg(F.count_if(F.col("polarity") == 1).alias("a"), F.count_if(F.col("polarity") == -1).alias("b"))
    by = each.groupBy(*KEY, "source_rid").agg((F.sum("a") * F.sum("b") - F.sum(F.col("a") * F.col("b"))).alias("n"))
    return by.groupBy(*KEY).agg(F.sum("n").alias("same_artifact"))


def temporal_conflicts(claims: DataFrame) -> DataFrame:
    """By proposition the pairs of opposite claims whose validity overlaps, and those apart; open ends are endless.

    A pair is apart if one claim ends before the other begins. Per claim, the opposite ends that came before its begin
    are counted by a running sum along the proposition's begins and ends; at one time begins come first.
    """
    inf = float("inf")
    begin, end = F.coalesce("valid_from", F.lit(-inf)), F.coalesce("valid_to", F.lit(inf))
    marks = claims.select(*SIDE, F.inline(F.array(F.struct(begin.alias("at"), F.lit(0).alias("ends")), F.struct(end.alias("at"), F.lit(1).alias("ends")))))
    so_far = Window.partitionBy(*KEY).orderBy("at", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = lambda p: F.count_if((F.col("ends") == 1) & (F.col("polarity") == p)).over(so_far)
    opposite = F.when(F.col("polarity") == 1, ended(-1)).otherwise(ended(1))
    rows = marks.withColumn("apart", F.when(F.col("ends") == 0, opposite).otherwise(0)).groupBy(*KEY).agg(
        (F.count_if((F.col("ends") == 0) & (F.col("polarity") == 1)) * F.count_if((F.col("ends") == 0) & (F.col("polarity") == -1))).alias("pairs"), F.sum("apart").alias("separable")
    )
    return rows.select(*KEY, (F.col("pairs") - F.col("separable")).alias("overlapping"), "separable")


def contest_state(claims: DataFrame) -> DataFrame:
    """By proposition: masses, independence, counts of what is contested and how, and `flags`, their mask."""
    distinct = F.countDistinct("namespace").alias("namespaces")
    out = mass(claims)
    # src, rel and dst alone: whether one statement stands in several namespaces
    out = out.join(claims.groupBy("src", "rel", "dst").agg(distinct), ["src", "rel", "dst"])
    for part in (same_source_opposites(claims), same_artifact_extractors(claims), temporal_conflicts(claims)):
        out = out.join(part, KEY, "left")
    out = out.fillna(0, ["same_source", "same_artifact", "overlapping", "separable"])
    bit = lambda cond, v: F.when(F.expr(cond), v).otherwise(0)
    flags = bit("support > 2 and support_independence < 2", DUPLICATION_RISK) + bit("same_source > 0", SAME_SOURCE) + bit("namespaces > 1", HETEROGENEOUS) + bit("same_artifact > 0", SAME_ARTIFACT) + bit("overlapping > 0", PRESENT_TENSE)
    return out.withColumn("flags", flags.cast("long"))


def flagged(claims: DataFrame, mask: int) -> DataFrame:
    """The propositions whose contest has any bit of the mask."""
    return contest_state(claims).where(F.col("flags").bitwiseAND(F.lit(mask)) != 0)


def contest_pairs(claims: DataFrame) -> DataFrame:
    """All opposite pairs of the propositions given, and what each pair has in common: for a look at a few of them."""
    side = lambda p, x: claims.where(F.col("polarity") == p).select(*KEY, *[F.col(k).alias(x + k) for k in ("claim_id", "lineage", "source_rid", "extractor", "valid_from", "valid_to")])
    rows = side(1, "a_").join(side(-1, "b_"), KEY)
    source = (F.col("a_lineage") == F.col("b_lineage")) & (F.size("a_lineage") > 0)
    artifact = (F.col("a_source_rid") == F.col("b_source_rid")) & (F.col("a_extractor") != F.col("b_extractor"))
    apart = disjoint(F.col("a_valid_from"), F.col("a_valid_to"), F.col("b_valid_from"), F.col("b_valid_to"))
    return rows.select(F.col("a_claim_id").alias("support_claim"), F.col("b_claim_id").alias("attack_claim"), source.alias("same_source"), artifact.alias("same_artifact"), (~apart).alias("overlapping"))

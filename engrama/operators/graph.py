"""Graph operators over edge frames (src, rel, dst, weight): bounded expansion, proximity, spreading, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.operators.frames import settled


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, entity, hops, weight): what each seed reaches, at its least hop count, with the best product of weights there.

    Each hop is one join and one aggregation; entities seen at fewer hops are left out by an anti join.
    """
    both = undirected(edges)
    seen = seeds.select(F.col("entity").alias("seed"), "entity", F.lit(0).alias("hops"), F.lit(1.0).alias("weight"))
    edge = seen
    for h in range(1, hops + 1):
        step = edge.select("seed", F.col("entity").alias("src"), F.col("weight").alias("w")).join(both, "src")
        step = step.groupBy("seed", F.col("dst").alias("entity")).agg(F.max(F.col("w") * F.col("weight")).alias("weight")).withColumn("hops", F.lit(h))
        edge = step.join(seen.select("seed", "entity"), ["seed", "entity"], "left_anti").select("seed", "entity", "hops", "weight")
        seen = seen.unionByName(edge)
    return seen


def proximity(reached: DataFrame, links: DataFrame, base: float = 4.0) -> DataFrame:
    """(seed, rid, proximity): the best weight / base^hops over a memory's entities."""
    return reached.join(links, "entity").groupBy("seed", "rid").agg(F.max(F.col("weight") / F.pow(F.lit(base), F.col("hops"))).alias("proximity"))


def shared_entities(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(rid_a, rid_b, shared) of the stated pairs that share an entity, however many memories an entity has."""
    a = pairs.distinct().join(links.select(F.col("rid").alias("rid_a"), "entity"), "rid_a")
    return a.join(links.select(F.col("rid").alias("rid_b"), "entity"), ["rid_b", "entity"]).groupBy("rid_a", "rid_b").agg(F.count("*").alias("shared"))


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5, threshold: float = 0.01) -> DataFrame:
    """Spreading activation: each hop adds activation x weight x decay, split over out-edges; weak activation is dropped."""
    out = undirected(edges)
    fan = out.groupBy("src").agg(F.sum("weight").alias("fan"))
    flow = out.join(fan, "src").select("src", "dst", (F.col("weight") / F.col("fan")).alias("share"))
    total = wave = seeds.select("entity", F.col("activation").cast("double").alias("activation"))
    for _ in range(hops):
        wave = wave.withColumnRenamed("entity", "src").join(flow, "src").groupBy(F.col("dst").alias("entity")).agg((F.sum(F.col("activation") * F.col("share")) * decay).alias("activation")).where(F.col("activation") >= threshold)
        total = total.unionByName(wave)
    return total.groupBy("entity").agg(F.sum("activation").alias("activation"))


def resolve_alias(frame: DataFrame, aliases: DataFrame, name: str, namespace: Column) -> DataFrame:
    """frame with `canonical`: the namespace's alias, else the default namespace's, else the name itself."""
    own = aliases.select(F.col("alias").alias(name), F.col("namespace").alias("_n"), F.col("entity").alias("_own"))
    common = aliases.where("namespace = '*'").select(F.col("alias").alias(name), F.col("entity").alias("_any"))
    out = frame.withColumn("_n", namespace).join(own, [name, "_n"], "left").join(common, name, "left")
    return out.withColumn("canonical", F.coalesce("_own", "_any", name)).drop("_n", "_own", "_any")


def layers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topological layers (node, layer) of a directed graph, and the nodes that lie on or behind cycles.

    Kahn's rounds as anti joins until no node is free, one round a layer; each round's frames are written and read back.
    """
    keep = settled
    left, done, k = keep(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()), None, 0
    while True:
        live = edges.join(left.select(F.col("node").alias("src")), "src", "left_semi")
        free = keep(left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(k)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left, k = keep(left.join(free.select("node"), "node", "left_anti")), k + 1
    return (done if done is not None else left.where("false").withColumn("layer", F.lit(0))), left

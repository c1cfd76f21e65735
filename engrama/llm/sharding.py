"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes, in DataFrame code only.

Rows fall into blocks by a hash of the whole row. How many rows of each block go to each cell of each shard is drawn
on the driver from the multivariate hypergeometric law, whose row and column sums are the exact block and cell sizes;
the matrix grows with the number of blocks, not of rows. Each block is permuted, its rows go out by the matrix, and
each cell is permuted again. A cell is a slice of a shard of about `block_rows` rows, so that no task ever holds a
whole shard; its first slot is known beforehand, which makes slots gapless.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, without

#: Blocks at most, and cells of a shard at most: what keeps the matrix small however many rows there are.
BLOCKS, SLICES = 2048, 50
HASHES = 65_536


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good, by the hypergeometric law exactly, for any numbers of rows.

    Where there are too many rows for one draw, each is taken by itself with the same chance, which takes about n; those
    over or missing are then drawn from the rows taken or left, by the same law and of far smaller number.
    """
    if not (good and bad and n and n < good + bad):
        return good if n and n == good + bad else 0 if bad else n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > good + bad:
        return good - _draw(rng, good, bad, good + bad - n)
    if n < 64:
        taken = 0
        for k in range(n):
            taken += int(rng.integers(good + bad - k)) < good - taken
        return taken
    x, y = int(rng.binomial(good, n / (good + bad))), int(rng.binomial(bad, n / (good + bad)))
    if x + y >= n:
        return x - _draw(rng, x, y, x + y - n)
    return x + _draw(rng, good - x, bad - y, n - x - y)


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Random counts with row sums `blocks` and column sums `cells`, with the law of a uniform shuffle."""
    rng, left = np.random.default_rng(seed), np.array(cells, np.int64)
    out = np.zeros((len(blocks), len(cells)), np.int64)
    for p, n in enumerate(blocks):
        rest = int(left.sum())
        for t in range(len(cells)):
            if n == 0:
                break
            rest -= int(left[t])
            out[p, t] = _draw(rng, int(left[t]), rest, n)
            n -= int(out[p, t])
        left -= out[p]
    return out


def shard(df: DataFrame, n_shards: int = 40, seed: int = 17, block_rows: int = 4_000) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most; every arrangement is equally likely. Nulls in any column and empty texts are
    ordinary values. Repeated rows get slots of their own. An empty table gives an empty result. Input columns named
    shard or slot are replaced. Rows equal in every column share a block.
    """
    df = without(df, "shard", "slot")
    spark, names = df.sparkSession, [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    cell = F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(HASHES)).cast("int")
    counts = {r[0]: r[1] for r in df.groupBy(cell.alias("c")).count().collect()}
    total = sum(counts.values())
    n_blocks = max(1, min(BLOCKS, -(-total // block_rows)))
    blocks = [0] * n_blocks
    for c, n in counts.items():
        blocks[c % n_blocks] += n
    base, extra = divmod(total, n_shards)
    parts = max(1, min(SLICES, -(-base // block_rows)))
    sizes = [base + (s < extra) for s in range(n_shards)]
    cells = [m * (k + 1) // parts - m * k // parts for m in sizes for k in range(parts)]
    ends = communication_matrix(blocks, cells, seed).cumsum(axis=1).reshape(n_blocks, n_shards, parts)
    if ends.size <= 200_000:  # under 2 MB
        table = json.dumps([{"_sh_b": b, "_sh_e": e.tolist()} for b, e in enumerate(ends)])
        cuts = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<_sh_b:int,_sh_e:array<array<bigint>>>>"))))
    else:
        cuts = None
        for at in range(0, n_blocks, max(1, 200_000 * n_blocks // ends.size)):  # written in parts, not carried by the plan
            part = [(b, ends[b].tolist()) for b in range(at, min(n_blocks, at + max(1, 200_000 * n_blocks // ends.size)))]
            part = materialize(spark.createDataFrame(part, "_sh_b int, _sh_e array<array<bigint>>"), "shard-matrix")
            cuts = part if cuts is None else cuts.unionByName(part)

    rows = df.withColumn("_sh_b", F.pmod(cell, F.lit(n_blocks)).cast("int"))
    rows = rows.withColumn("_sh_p", F.row_number().over(Window.partitionBy("_sh_b").orderBy(F.xxhash64(F.lit(seed + 1), *names))))
    # equal rows are neighbours so far; a second local permutation parts them
    rows = rows.withColumn("_sh_p", F.row_number().over(Window.partitionBy("_sh_b").orderBy(F.xxhash64(F.lit(seed + 2), "_sh_b", "_sh_p"), "_sh_p")) - 1)
    rows = rows.join(cuts, "_sh_b")
    rows = rows.withColumn("shard", F.size(F.filter("_sh_e", lambda e: F.element_at(e, parts) <= F.col("_sh_p"))))
    rows = rows.withColumn("_sh_k", F.size(F.filter(F.element_at("_sh_e", F.col("shard") + 1), lambda e: e <= F.col("_sh_p")))).drop("_sh_e")
    first = F.expr(f"(({base}L + cast(shard < {extra} as bigint)) * _sh_k) div {parts}")
    rank = F.row_number().over(Window.partitionBy("shard", "_sh_k").orderBy(F.xxhash64(F.lit(seed + 3), "_sh_b", "_sh_p"), "_sh_b", "_sh_p"))
    rows = rows.withColumn("slot", first + rank - 1)
    return rows.drop("_sh_b", "_sh_p", "_sh_k")

"""Helpers shared by the training-data operators: shared scratch tables, word hashing, connected components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a local folder serves, but only under a local master, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local_scratch:
            _local_scratch.append(f"file://{tempfile.mkdtemp(prefix='engrama-')}")
        found = _local_scratch[0]
    return f"{found.rstrip('/')}/engrama-{spark.conf.get('spark.app.id', 'app')}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) the operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def same(left: DataFrame, right: DataFrame, *names: str):
    """Null-safe equality on the named columns, for rows whose id may be null."""
    return functools.reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) over an array."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Words are runs of ASCII letters, digits and underscores and of any other than ASCII characters, in lower case.
WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = True
_BASE = 0x5851F42D4C957F2D
_PIECE, _LONG = 1 << 20, 256
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + _PIECE // 8, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of these bytes: differences of one polynomial prefix sum, finalized.

    Long spans can be made to collide modulo 2^64 whatever the base, so those are hashed one by one.
    """
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    out = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in np.flatnonzero(stops - starts >= _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : stops[k]].tobytes())
    return out


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of these bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, span_hashes(data, starts, stops)


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and where each text's begin (with the end, one more than texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and _IN_WORD[data[stop]]:
            stop += 1
        s, h = _hash_piece(data[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def text_slices(column, size: int = 1 << 20):
    """Consecutive (first row, texts) of an Arrow string column, of about `size` characters each."""
    held: list[str | None] = []
    first = total = 0
    for k, value in enumerate(column):
        text = value.as_py()
        held.append(text)
        total += len(text or "")
        if total >= size:
            yield first, held
            held, first, total = [], k + 1, 0
    if held:
        yield first, held


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b) as (node, root), root being the least node of the component.

    Runs until a round changes nothing, after about as many as the logarithm of the longest path squared. Alternating large-star and small-star steps, each one aggregation with map-side combine and one join; lineage is
    cut with a written table after each pair of steps. Nodes may be of any orderable type. No neighbour list is built.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(now, name), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that each join has two plain shuffles and those of hubs can be split
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"{name}-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

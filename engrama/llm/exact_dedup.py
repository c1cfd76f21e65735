"""Exact dedup of a new batch against an immutable snapshot, screened by static binary fuse filters.

The snapshot's digests are dealt into cells, and each cell gets one static filter. The batch's own duplicates are
grouped first, with map-side combine, so a digest is probed once however many rows carry it. Digests that a filter
lets pass join the snapshot's exact groups; the others are new. Rows that share a digest have their normalized texts
compared byte by byte with those of the row that stays; should texts differ under one digest, they are regrouped by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import materialize, without

CELL_KEYS = 500_000
#: A hot group's texts are compared in so many parts first.
SALTS = 32


def _digests(batches: Iterator[pa.RecordBatch], bits: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Digest of each normalized text, the digest it is grouped by, and if asked the normalized text itself."""
    for batch in batches:
        plain = [(t.as_buffer().to_pybytes() if t.is_valid else b"").lower() for t in batch.column("_ed_x").cast(pa.large_string())]
        sums = [hashlib.sha256(t).digest() for t in plain]
        short = sums if bits >= 256 else [bytes([d[0] & ((1 << bits) - 1)]) for d in sums]
        out = {"_ed_i": batch.column("_ed_i"), "_ed_s": batch.column("_ed_s"), "_ed_sha": pa.array(sums, pa.binary())}
        if bits < 256 or texts:
            out["_ed_g"] = pa.array(short, pa.binary())
        if texts:
            out["_ed_x"] = pa.array(plain, pa.binary())
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _key(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), np.uint64)


def _build_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "filter": [fuse.build(_key(pdf["_ed_g"]))]})


def _screen_cell(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    passed = fuse.probe(filters["filter"].iloc[0], _key(batch["_ed_g"])) if len(filters) and len(batch) else np.zeros(len(batch), bool)
    return batch.drop(columns="cell").assign(passed=passed)


def exact_dedup(df: DataFrame, in_snapshot: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """df with keep_id, group_size (long), kept (boolean) and text_sha256 (lowercase hex of the normalized text).

    `in_snapshot` is a boolean SQL condition: rows where it holds form the immutable snapshot, the rest (nulls too) the
    new batch. Texts are equal when identical after lowering A-Z; null counts as empty. The largest id of equal texts
    stays, so rows repeated with that id all count as kept; a null id is smaller than any other. digest_bits under 8
    weakens the group digest, for tests of the byte comparison. Columns named as the added ones are replaced.
    """
    df = without(df, "keep_id", "group_size", "kept", "text_sha256")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_ed_i"), F.coalesce(F.expr(in_snapshot), F.lit(False)).alias("_ed_s"), F.col(text_col).alias("_ed_x"))
    shape = f"_ed_i {kind}, _ed_s boolean, _ed_sha binary"
    weak = digest_bits < 256  # else the group digest is the whole sum, stored once
    digests = materialize(rows.mapInArrow(lambda it: _digests(it, digest_bits, False), shape + ", _ed_g binary" * weak), "digests")
    if not weak:
        digests = digests.withColumn("_ed_g", F.col("_ed_sha"))

    def grouped(part: DataFrame) -> DataFrame:
        return part.groupBy("_ed_g").agg(F.max("_ed_i").alias("top"), F.count("*").alias("n"))

    old, new = grouped(digests.where("_ed_s")), grouped(digests.where("not _ed_s"))
    cells = max(1, -(-digests.count() // CELL_KEYS))
    cell = F.pmod(F.xxhash64("_ed_g"), F.lit(cells)).cast("int").alias("cell")
    filters = old.select("_ed_g", cell).groupBy("cell").applyInPandas(_build_cell, "cell int, filter binary")
    screened = new.select("*", cell).groupBy("cell").cogroup(filters.groupBy("cell")).applyInPandas(_screen_cell, f"_ed_g binary, top {kind}, n long, passed boolean")
    screened = materialize(screened, "screened")
    # positives meet their exact group in the snapshot; negatives are known to have none
    both = old.join(screened.where("passed").select("_ed_g", F.col("top").alias("top2"), F.col("n").alias("n2")), "_ed_g", "full")
    both = both.select("_ed_g", F.greatest("top", "top2").alias("top"), (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))
    groups = both.unionByName(screened.where("not passed").drop("passed"))
    groups = materialize(groups, "groups")

    out = digests.join(groups, "_ed_g")
    texts = rows.mapInArrow(lambda it: _digests(it, digest_bits, True), shape + ", _ed_g binary, _ed_x binary").withColumn("_ed_r", F.pmod(F.xxhash64("_ed_i"), F.lit(SALTS)))
    many = groups.where("n > 1").select("_ed_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_ed_r"))
    # all texts of a group are equal bytes exactly if their least and greatest are
    ends = texts.join(many, ["_ed_g", "_ed_r"]).groupBy("_ed_g", "_ed_r").agg(F.min("_ed_x").alias("low"), F.max("_ed_x").alias("high"))
    ends = ends.groupBy("_ed_g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    differ = materialize(ends.where("low <> high").select("_ed_g"), "differ")
    if not differ.isEmpty():  # texts that share a digest: group those digests by the text itself
        again = texts.join(differ, "_ed_g", "left_semi").groupBy("_ed_g", "_ed_x").agg(F.max("_ed_i").alias("top"), F.count("*").alias("n"), F.first("_ed_sha").alias("_ed_sha"))
        again = again.select("_ed_g", "_ed_sha", "top", "n")
        out = out.join(differ, "_ed_g", "left_anti").unionByName(digests.join(again, ["_ed_g", "_ed_sha"]))
    return out.select(F.col("_ed_i").alias(id_col), F.col("top").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("_ed_i").eqNullSafe(F.col("top")).alias("kept"), F.lower(F.hex("_ed_sha")).alias("text_sha256"))

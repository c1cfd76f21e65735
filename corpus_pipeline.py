"""Corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns documents; the last returns
packed pieces. Stages are written to the shared scratch folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.common import materialize, read_table
from engrama.llm.decontaminate import decontaminate
from engrama.llm.line_dedup import dedup_passages
from engrama.llm.near_dup import near_duplicates
from engrama.llm.packing import pack
from engrama.llm.quality import filter_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    return filter_quality(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated runs of two lines or more; n_chars follows the text."""
    out = dedup_passages(docs)
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least by (id, text hash), rows without an id last."""
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))
    keyed = docs.withColumn("_cp_k", key)
    found = near_duplicates(keyed, id_col="_cp_k").where(F.col("_cp_k").eqNullSafe(F.col("class_id")))
    kept = materialize(found.select(F.col("_cp_k").alias("_cp_n")).groupBy("_cp_n").agg(F.count("*").alias("n")), "unique-kept")
    out = keyed.join(kept.hint("merge"), F.col("_cp_k.i").eqNullSafe(F.col("_cp_n.i")) & (F.col("_cp_k.t") == F.col("_cp_n.t")))
    if kept.where("n > 1").isEmpty():
        return out.select(*docs.columns)
    once = out.where("n > 1").dropDuplicates(["_cp_n"])  # rows that repeat an id and its text
    return out.where("n = 1").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_dups), ("decontamination", decontamination), ("packing", packing)]

#: A trained score, hashed chunks and tokenizer ids: SQL can't express the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of the training-data operators: thin, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TOKENIZER = "word_bpe_49k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(read_table(spark, sf_dir, "documents"), n_shards=40)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, end_id=0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = read_table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    # the older half of the id range is the snapshot, the newer half the incoming batch; both are answered in full
    return exact_dedup(docs, f"doc_id <= {(low + high) // 2}L" if low is not None else "false")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import dedup_spans

    # sentences of these documents may have one word; two such in a row are no passage
    out = dedup_spans(read_table(spark, sf_dir, "documents"), min_words=20)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "sentences_removed", "removed_spans", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_passages

    out = dedup_passages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    "op6_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Frames written once between the steps of a long operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names and read back: computed once, with a plan of its own.

    Under a local master without that setting a temporary folder serves; on a cluster without it, df is kept in memory.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            return df.cache()
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='engrama-')}")
        folder = _local[0]
    path = f"{folder.rstrip('/')}/engrama-{spark.conf.get('spark.app.id', 'app')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

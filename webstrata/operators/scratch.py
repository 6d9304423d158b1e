"""Intermediate tables where driver and executors share them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in spark.checkpoint.dir, read back: made once, however many read it. Without that setting, in a folder of this machine if all executors are on it; else df as it is."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            return df
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='webstrata-')}")
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

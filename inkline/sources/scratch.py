"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a folder of its own; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="inkline-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/inkline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, readable after executors are lost."""
    path = shared(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``df`` written and bucketed by ``key``: joins on it with as many partitions don't shuffle it. The table's name is its own.

    Rows are dealt by bucket first (unless ``dealt`` says that they are), so that a bucket is one file: else each task writes a file for each bucket, and the driver lists and commits their product.
    """
    spark = df.sparkSession
    path = shared(spark, name)
    table = f"{re.sub(r'[^a-z]', '_', name)}_{path[-32:]}"
    (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)

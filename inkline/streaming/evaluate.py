"""An extension: error rates of prediction files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics

PAIRS = "ts timestamp, gt string, predict string"


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines with ``ts``, ``gt``, ``predict`` as they are put into ``folder``."""
    return spark.readStream.schema(PAIRS).json(folder)


def windowed_rates(pairs: DataFrame, length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Mean rates by window; rows later than ``late`` are dropped and a window's state with them."""
    rated = pairs.withColumn("cer", metrics.cer(F.col("gt"), F.col("predict"))).withColumn("wer", metrics.wer(F.col("gt"), F.col("predict")))
    return rated.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.count("*").alias("n"))

"""Labels and images brought together by name, with the stem as fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def resolve_images(labels: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("writer",)) -> DataFrame:
    """Each label (``keys``, ``name``, ``text``) with the ``path`` of its image; labels without one are dropped.

    The exact file name wins; else the first path, in order, whose stem is the name's. Two equi joins on
    keys and name, no comparison of all with all.
    """
    shown = images.select(*keys, F.col("path"), text.basename("path").alias("name"), text.stem("path").alias("stem"))
    exact = labels.join(shown.drop("stem"), [*keys, "name"]).withColumn("how", F.lit(0))
    by_stem = labels.withColumn("stem", text.stem("name")).join(shown.drop("name"), [*keys, "stem"]).drop("stem").withColumn("how", F.lit(1))
    first = Window.partitionBy(*keys, "name").orderBy("how", "path")
    return exact.unionByName(by_stem).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "how")


def unmatched(labels: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("writer",)) -> DataFrame:
    """Labels without an image."""
    return labels.join(resolve_images(labels, images, keys).select(*keys, "name"), [*keys, "name"], "left_anti")


def matched(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``n``: how many images (``path``) have a label of their very name."""
    return images.select(text.basename("path").alias("name")).join(labels.select("name"), "name", "left_semi").agg(F.count("*").alias("n"))


def label_of_image(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``path`` and ``gt``: the label of the exact name, else that of the first label (by name) with the same stem, else null."""
    named = images.select("path", text.basename("path").alias("name"), text.stem("path").alias("stem"))
    by_stem = labels.groupBy(text.stem("name").alias("stem")).agg(F.min_by("text", "name").alias("by_stem"))
    exact = labels.groupBy("name").agg(F.min("text").alias("exact"))
    return named.join(exact, "name", "left").join(by_stem, "stem", "left").select("path", F.coalesce("exact", "by_stem").alias("gt"))

"""Reading dataset trees, label files, charsets, lexicons and artifact folders with Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels as joined

#: Image suffixes, label file names in order of preference, the comment mark and the blank token.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
LABEL_FILES = ("label.json", "labels.json")
COMMENT, BLANK = "##", "<BLANK>"
SPLITS = {"train": "train_data", "val": "val_data", "test": "test_data"}


def split_folder(split: str, folders: dict[str, str] | None = None) -> str:
    """The folder of a split; an unknown name is an error."""
    try:
        return {**SPLITS, **(folders or {})}[split]
    except KeyError:
        raise ValueError(f"unknown split: {split}") from None


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length`` of the image files that ``folder``/``pattern`` names, in order; their contents are not read."""
    found = spark.read.format("binaryFile").load(f"{folder}/{pattern}").select("path", "length")
    return found.where(text.suffix("path").isin(*SUFFIXES)).orderBy("path")


def label_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``writer``, ``name``, ``text`` of the label files under ``folder``/``pattern``.

    Of a folder's label files only the first in order of preference is read, even if it is broken; what is
    not a JSON object gives no labels.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(LABEL_FILES) + "}").load(f"{folder}/{pattern}")
    named = files.select("path", "content", text.basename("path").alias("file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("writer"), F.regexp_replace("path", r"/[^/]+$", "").alias("dir"))
    order = Window.partitionBy("dir").orderBy(F.array_position(F.array(*(F.lit(x) for x in LABEL_FILES)), F.col("file")))
    first = named.withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return first.select("writer", F.explode(F.from_json(F.col("content").cast("string"), "map<string,string>")).alias("name", "text"))


def folder_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` and ``text`` of the labels in ``folder`` itself: keys without their folders, composed texts; of equal names the greatest text stays."""
    found = label_files(spark, folder, "").select(text.basename("name").alias("name"), "text")
    return text.compose(found.groupBy("name").agg(F.max("text").alias("text")), "text")


def discover(spark: SparkSession, root: str, split: str, folders: dict[str, str] | None = None) -> DataFrame:
    """``image`` (relative to ``root``), ``text``, ``writer`` of every label of the split that has an image."""
    folder = f"{root}/{split_folder(split, folders)}"
    shown = images(spark, folder, "*/*").select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("writer"))
    found = joined.resolve_images(label_files(spark, folder), shown)
    relative = F.concat(F.lit(split_folder(split, folders)), F.lit("/"), F.col("writer"), F.lit("/"), text.basename("path"))
    return found.select(relative.alias("image"), "text", "writer").orderBy("writer", "image")


def load_split(spark: SparkSession, root: str, split: str, charset: list[str] | None = None, folders: dict[str, str] | None = None) -> DataFrame:
    """``discover`` with composed texts; with a charset, rows with characters outside it are dropped."""
    from ..functions import ctc

    found = text.compose(discover(spark, root, split, folders), "text")
    return found if charset is None else found.where(ctc.has_only(F.col("text"), charset))


def token_file(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """``pos``, ``token`` of a file with one token a line; comments and empty lines are skipped, order is kept."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "token"))
    lines = lines.withColumn("token", text.strip("token")) if strip else lines
    return lines.where((F.col("token") != "") & ~F.col("token").startswith(COMMENT))


def load_charset(spark: SparkSession, path: str) -> list[str]:
    """Tokens in order; it must begin with the blank and hold nothing twice. A lone # or blank is a token."""
    found = [r.token for r in token_file(spark, path, strip=False).orderBy("pos").collect()]  # a charset is some hundred tokens
    if not found or found[0] != BLANK or len(set(found)) != len(found):
        raise ValueError(f"{path}: a charset begins with {BLANK} and holds nothing twice")
    return found


def missing_files(spark: SparkSession, folder: str, required: tuple[str, ...]) -> list[str]:
    """Which of the files required are not in the folder."""
    there = spark.read.format("binaryFile").load(f"{folder}/*").select(text.basename("path").alias("name"))
    wanted = spark.createDataFrame([(x,) for x in required], "name string")
    return sorted(r.name for r in wanted.join(there, "name", "left_anti").collect())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(f"{folder}/*").select("path", F.sha2("content", 256).alias("sha256"))

"""Pieces that several operators share: written intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast at most.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a folder of its own; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="inkline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, its lineage cut, readable after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that go to Python together: whole texts can be long, and the usual 10,000 rows are held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drawn(share: float, seed: int, *columns: str) -> Column:
    """Whether a row is in a sample of ``share`` of all rows, by a hash of ``columns``; exact to 2^-63, so that no table is too large for it."""
    hashed = F.xxhash64(F.lit(seed), *columns)
    return F.lit(True) if share >= 1 else hashed < drawn_below(share)


def drawn_below(share: float) -> int:
    """The bound on signed 64-bit hashes that leaves ``share`` of them below it."""
    return max(-(1 << 63) + 1, min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))


def join_each(rows: DataFrame, told: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``told`` that has their ``key`` (a column of both, never null in ``told``).

    ``weight`` of ``told`` says for how many rows it stands. A small ``told`` is broadcast. Of a large one, keys
    that stand for many rows are: there are ``BROADCAST_ROWS`` of them at most; the others are dealt by key.
    """
    size = told.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(told), key, how)
    many = F.col(weight) > max(1000, size[1] // BROADCAST_ROWS)
    hot, cold = told.where(many), told.where(~many)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Least node reachable from each node that has an edge.

    ``edges`` has two columns of one orderable type; direction, repeats and loops don't matter,
    rows with a null end are ignored. Returns ``node`` and ``root`` (the roots themselves included).
    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars;
    no step needs more than one row a node in memory, and minima are combined before the shuffle.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"), F.col(a).isNotNull().alias("p"), F.col(b).isNotNull().alias("q")).where("p and q and x > y").select("x", "y").distinct()
    now = written(now, name)
    marks = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x > y").distinct()
        now = written(small, name)
        was, marks = marks, now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.count_distinct("x")).first()
        if marks[0] == marks[2] and was == marks:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionAll(now.select("y", "y").toDF("node", "root").distinct())


def keyed(docs: DataFrame, name: str = "keyed-rows") -> DataFrame:
    """``docs`` as a written table with a number of its own for each row (``_row``), whatever its ids are."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), name)


def one_row_each(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``rows`` (see ``keyed``) that stand for their component: the least id, null ids last, then the least ``_row``.

    ``classes``: ``class`` and ``first``, the least (id is null, id, row) of the class; ``roots``: ``node`` and
    ``root`` of the classes that have links.
    """
    ends = classes.join(roots, F.col("class") == F.col("node"), "left")
    kept = ends.groupBy(F.coalesce("root", "class").alias("_group")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").drop("_row")


def first_row(id_col: str):
    """The aggregate for ``first`` in ``one_row_each``."""
    return F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("first")

"""Whitening of vectors: MLlib's singular values of the centred rows, rescaled to the covariance's eigenvalues.

Vectors become whole numbers, so that sums, means and deviations are exact: a row is centred as
(n x - S) / n, with n x - S in whole numbers, before anything is multiplied. The squared singular values of the
centred rows over n are the eigenvalues of the covariance with divisor n, its right singular vectors the
components. The total variance comes from the exact deviations, not from the singular values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Share of the largest singular value that a component needs; below it there is nothing but rounding to rescale.
LEAST_SHARE = 1e-6
SCALE, SHIFT = 64, 1_000_000


def usable(vector: str) -> Column:
    """Not null, without null or non-finite entries."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id_col``, ``n``, ``deviation`` (decimal), ``whitened`` (an array, a value a component) of every usable row; ``explained`` and ``identity_error`` are the same for all rows.

    Rows whose vector is null or holds null or non-finite entries are left out. Entries become floor(``scale`` x) +
    ``shift``. ``deviation``: the sum over dimensions of (n x - S)^2, exact. There are up to ``most`` components, by
    falling eigenvalue; those whose singular value is below ``LEAST_SHARE`` of the largest are not counted, so that
    equal rows, or one row, have none and an empty array. ``explained`` is each eigenvalue's share of the total variance. Vectors of
    different widths are whitened apart, a width after the other. Ids may be null or repeat; empty vectors have
    no component; other columns are ignored; an empty table gives an empty result.
    """
    whole = F.transform(vector_col, lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long"))
    rows = written(vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), whole.alias("x")), "whole-vectors")
    each = [whiten_width(rows.where(F.size("x") == r.width), r.width, r["count"], most) for r in rows.groupBy(F.size("x").alias("width")).count().orderBy("width").collect()]
    if not each:
        each = [rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *(F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")), F.lit(0.0).alias("identity_error"))]
    out = each[0]
    for other in each[1:]:
        out = out.unionAll(other)
    return out.withColumnRenamed("id", id_col)


def whiten_width(rows: DataFrame, width: int, n: int, most: int) -> DataFrame:
    spark = rows.sparkSession
    # width numbers a row of the table of sums, one row in all
    sums = rows.agg(*(F.sum(F.get("x", F.lit(k))).alias(f"s{k}") for k in range(width))).first() if width else ()
    total = F.array(*(F.lit(int(s)) for s in sums)).cast("array<long>")
    apart = F.zip_with("x", total, lambda x, s: F.lit(n).cast("long") * x - s)
    squares = F.aggregate("apart", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)"))
    told = rows.select("id", apart.alias("apart")).withColumn("deviation", squares)
    centred = written(told.select("id", "deviation", F.transform("apart", lambda d: d.cast("double") / float(n)).alias("c")), "centred-vectors")
    spread = centred.agg(F.sum("deviation")).first()[0] or 0  # exact: n^3 times the total variance
    values, components = np.zeros(0), np.zeros((width, 0))
    if spread:
        found = matrix(centred, "c").computeSVD(min(most, width), computeU=False, rCond=LEAST_SHARE)
        values, components = found.s.toArray() ** 2 / n, found.V.toArray()
    variance = float(spread) / float(n) ** 3
    projection = components / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            w = c @ projection
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    white = written(centred.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened-vectors")
    error = 0.0
    if len(values):
        middle = white.agg(*(F.avg(F.get("whitened", F.lit(k))).alias(f"m{k}") for k in range(len(values)))).first()
        apart = white.select(F.zip_with("whitened", F.array(*(F.lit(m) for m in middle)), lambda x, m: x - m).alias("w"))
        gram = np.array(products(apart, "w", len(values)))
        error = float(np.abs(gram / n - np.eye(len(values))).max())
    shares = F.array(*(F.lit(float(v / variance)) for v in values)).cast("array<double>")
    return white.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def products(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """The sums of products of all pairs of entries: from the singular values and vectors of the rows."""
    found = matrix(rows, column).computeSVD(width, computeU=False, rCond=1e-15)
    v = found.V.toArray()
    return (v * found.s.toArray() ** 2) @ v.T

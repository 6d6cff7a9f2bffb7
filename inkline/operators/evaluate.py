"""Evaluation as DataFrame operators: pairing, error rates, failures, sampling, grids and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..sources.scratch import written


#: Points of a tuning grid and rows of a calibration set at most.
MOST_POINTS, CALIBRATION = 10_000, 300


def with_rates(pairs: DataFrame, ref: str = "gt", hyp: str = "predict") -> DataFrame:
    """``edits`` (of characters), ``cer`` and ``wer`` beside each pair; distances are worked out once."""
    r, h = F.col(ref), F.col(hyp)
    return pairs.withColumn("edits", metrics.char_edits(r, h)).withColumn("cer", metrics.cer(r, h, F.col("edits"))).withColumn("wer", metrics.wer(r, h))


def corpus_rates(pairs: DataFrame, ref: str = "gt", hyp: str = "predict", by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Macro means of the pairs' rates, the micro CER beside them; an empty corpus has zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return with_rates(pairs, ref, hyp).groupBy(*by).agg(zero(F.avg("cer")).alias("cer"), zero(F.avg("wer")).alias("wer"), zero(F.sum("edits") / F.nullif(F.sum(F.length(ref)), F.lit(0))).alias("micro_cer"), F.count("*").alias("n"), *more)


def failures(pairs: DataFrame, ref: str = "gt", hyp: str = "predict") -> DataFrame:
    return pairs.where(F.col(ref) != F.col(hyp))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same for the same seed: those with the least digest of seed and key. A top-n, not a full sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order`` (equal rows in any order, but each with a place of its own).

    Ranges of the order are dealt to tasks, equal values too; a task numbers its own rows, and the sizes of the ranges, a row each, say where it begins.
    """
    marked = df.withColumn("_o", F.struct(*(c.alias(f"c{k}") for k, c in enumerate(order)), F.monotonically_increasing_id().alias("row")))
    dealt = written(marked.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_o").withColumn("_part", F.spark_partition_id()), "numbered-rows")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    begins = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_o")) - 1 + F.col("_begin")
    return dealt.join(F.broadcast(begins), "_part").select(*df.columns, place.alias(name))


def shuffled(df: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """All rows with their place (``pos``, from 0) in an order that seed and epoch fix: by the digest of them and the key."""
    return numbered(df, F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string"))), F.col(key))


def evaluate_split(samples: DataFrame, hypothesis: Column, n: int | None = None, key: str = "path", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rates of a split (``samples``: ``path``, ``gt`` and what ``hypothesis`` is made from) with the number of failures, and the failures.

    ``n`` samples are drawn by the seed if it is given.
    """
    drawn = samples if n is None else sample_n(samples, n, key, seed)
    pairs = drawn.select("path", "gt", hypothesis.alias("predict"))
    failed = F.count_if(F.col("gt") != F.col("predict")).alias("n_failures")
    return corpus_rates(pairs, more=(failed,)), failures(pairs).select("path", "gt", "predict")


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def score_grid(outputs: DataFrame, grid: DataFrame, hypothesis: Column, ref: str = "gt") -> DataFrame:
    """``hypothesis`` of every output at every grid point (``alpha``, ``beta``), and its mean rates. A grid of more than ``MOST_POINTS`` points is an error."""
    points = grid.select("alpha", "beta").limit(MOST_POINTS + 1).collect()
    if len(points) > MOST_POINTS:
        raise ValueError(f"a grid has {MOST_POINTS} points at most")
    each = F.array(*(F.struct(F.lit(p.alpha).cast("double").alias("alpha"), F.lit(p.beta).cast("double").alias("beta")) for p in points)) if points else F.array().cast("array<struct<alpha:double,beta:double>>")
    tried = outputs.withColumn("_p", F.explode(each)).select(*outputs.columns, "_p.*").withColumn("predict", hypothesis)
    return corpus_rates(tried, ref, "predict", ("alpha", "beta")).drop("micro_cer")


def best_point(grid: DataFrame) -> DataFrame:
    """The lowest CER; of equals the first, alpha varying slowest."""
    return grid.orderBy("cer", "alpha", "beta").limit(1)


def quantiles(values: DataFrame, by: tuple[str, ...], value: str, **shares: float) -> DataFrame:
    """``by`` and, named by the keywords, the quantiles of ``value`` in each group, linear between two values; nulls are left out.

    Rows are numbered by group and value; a group asks for the two places about each quantile, and only those are looked up. No task holds a group.
    """
    placed = written(numbered(values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), *map(F.col, by), F.col("_v")), "placed-values")
    groups = placed.groupBy(*by).agg(F.min("pos").alias("first"), F.count("*").alias("n"))

    def spot(share: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(share))

    asked = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("first") + end(spot(share))).cast("long").alias("pos"), (F.lit(1.0) - F.abs(spot(share) - end(spot(share)))).alias("w")) for name, share in shares.items() for end in (F.floor, lambda x: F.floor(x) + 1)))
    each = groups.select(*by, F.explode(asked).alias("a")).select(*by, "a.*").where("w > 0")
    found = each.join(placed.select("pos", "_v"), "pos")
    return found.groupBy(*by).agg(*(F.sum(F.when(F.col("name") == name, F.col("_v") * F.col("w"))).alias(name) for name in shares))


def latency_summary(times: DataFrame, by: tuple[str, ...], ms: str = "ms", batch: int | Column = 1) -> DataFrame:
    """Linear-interpolated p50 and p95, and images a second at the median."""
    found = quantiles(times, by, ms, half=0.5, most=0.95)
    half = F.col("half")
    return found.select(*by, F.round(half, 3).alias("latency_ms_p50"), F.round("most", 3).alias("latency_ms_p95"), F.when(half > 0, F.round(batch * 1000 / half, 2)).otherwise(0.0).alias("images_per_s"))


def accuracy_deltas(rates: DataFrame, baselines: tuple[str, ...], model: str = "model") -> DataFrame:
    """Rates less those of the first of ``baselines`` that is there, rounded to four places; null without any."""
    order = F.array_position(F.array(*(F.lit(b) for b in baselines)), F.col(model))
    base = rates.where(order > 0).agg(F.min_by("cer", order).alias("base_cer"), F.min_by("wer", order).alias("base_wer"))
    return rates.crossJoin(F.broadcast(base)).select(*rates.columns, F.round(F.col("cer") - F.col("base_cer"), 4).alias("cer_delta"), F.round(F.col("wer") - F.col("base_wer"), 4).alias("wer_delta"))


def precision_drop(rates: DataFrame, limit: float = 0.01) -> DataFrame:
    """How far the CER of int8 lies above that of fp16, and whether beyond ``limit``."""
    of = lambda p: F.avg(F.when(F.col("precision") == p, F.col("cer")))
    return rates.agg((of("int8") - of("fp16")).alias("cer_drop")).withColumn("warn", F.coalesce(F.col("cer_drop") > limit, F.lit(False)))


def pick_variant(variants: DataFrame, preferred: tuple[tuple[str, int], ...] = (("int8", 1), ("fp16", 1), ("int8", 16), ("fp16", 16)), by: tuple[str, ...] = ()) -> DataFrame:
    """Of each group the first preferred (``precision``, ``batch``) that is there; else int8 first, then by batch and name."""
    rank = F.lit(len(preferred))
    for k, (precision, batch) in reversed(list(enumerate(preferred))):
        rank = F.when((F.col("precision") == precision) & (F.col("batch") == batch), k).otherwise(rank)
    best = F.min(F.struct(rank.alias("rank"), (F.col("precision") != "int8").alias("other"), "batch", "precision")).alias("b")
    return variants.groupBy(*by).agg(best).where("b IS NOT NULL").select(*by, "b.precision", "b.batch")


def variant_grid(precisions: tuple[str, ...], batches: tuple[int, ...], present: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``precision``, ``batch`` and ``place`` (in the grid, batch by batch) of each group's variants of the grid that are ``present``; missing ones are left out."""
    places = {(p, b): k for k, (b, p) in enumerate((b, p) for b in batches for p in precisions)}
    place = F.lit(None).cast("int")
    for (precision, batch), k in places.items():
        place = F.when((F.col("precision") == precision) & (F.col("batch") == batch), k).otherwise(place)
    return present.select(*by, "precision", "batch", place.alias("place")).where("place IS NOT NULL").distinct()


def calibration_batches(samples: DataFrame, batch: int, order: str, most: int = CALIBRATION) -> DataFrame:
    """Full batches of the first ``most`` samples in order, the tail dropped; fewer samples than one batch are repeated to fill one.

    ``most`` is the calibration set's own size, so that the windows below see no more rows.
    """
    placed = samples.orderBy(order).limit(most).withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    times = F.when(F.col("n") < batch, F.ceil(F.lit(batch) / F.col("n"))).otherwise(1)
    tiled = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).withColumn("slot", F.col("copy") * F.col("n") + F.col("pos"))
    full = F.greatest(F.floor(F.col("n") / batch), F.lit(1)) * batch
    return tiled.where(F.col("slot") < full).select(*samples.columns, F.floor(F.col("slot") / batch).cast("int").alias("batch_id"), (F.col("slot") % batch).cast("int").alias("slot"))


def masked_mean(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean loss with non-finite values as zeros that still count."""
    return losses.agg(F.avg(F.when(F.abs(loss) < float("inf"), F.col(loss)).otherwise(0.0)).alias("mean_loss"))


def best_so_far(history: DataFrame, step: str, loss: str, by: str) -> DataFrame:
    """The running minimum of a run's loss, and whether a step improves on all before."""
    before = F.min(loss).over(Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("best", F.least(F.coalesce(before, F.col(loss)), F.col(loss))).withColumn("improved", F.coalesce(F.col(loss) < before, F.lit(True)))


def paragraph(lines: DataFrame, by: str, line_no: str = "line_no", text: str = "text", ms: str = "ms") -> DataFrame:
    """Line texts joined in order, and their total time."""
    rows = F.array_sort(F.collect_list(F.struct(line_no, text)))
    return lines.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias("text"), F.sum(ms).alias("ms"))

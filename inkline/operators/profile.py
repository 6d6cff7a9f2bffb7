"""Row-projection profiles of pages (``page``, ``y``, ``p``): smoothing, text lines, thresholds, resolution, seams.

Everything is windows over a page's rows and HOFs over short arrays; pages are independent, so each
shuffle deals whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let

#: Millimetres between lines and of a stroke that resolution is judged by, and the resolution pages are brought to.
LINE_MM, STROKE_MM, TARGET_DPI = 10.0, 0.4, 150.0


def row_projection(image: Column | str) -> Column:
    """Ink of each row of a binary image (array of rows)."""
    return F.transform(image, lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda a, x: a + x))


def smooth(profile: DataFrame) -> DataFrame:
    """``page``, ``y``, ``p``, ``h`` and ``s``: the centred mean over max(3, height / 100 made odd) rows, zeros beyond the ends.

    Row numbers are 0 to height - 1. Pages are dealt once: rows that a page's reach counts as one step away are within one of its own.
    """
    sized = profile.withColumn("h", F.count("*").over(Window.partitionBy("page"))).withColumn("k", F.greatest(F.lit(3), F.floor(F.col("h") * 0.01).cast("int").bitwiseOR(F.lit(1))))
    near = sized.withColumn("_at", F.col("y") / F.floor(F.col("k") / 2))
    around = F.expr("sum(p) OVER (PARTITION BY page ORDER BY _at RANGE BETWEEN 1.000001D PRECEDING AND 1.000001D FOLLOWING)")
    return near.select("page", "y", "p", "h", (around / F.col("k")).alias("s"))


def lines_at(smoothed: DataFrame, ratio: Column | float, by: tuple[str, ...] = ("page",), min_height: float = 0.3) -> DataFrame:
    """Half-open row ranges (``y0``, ``y1``) above ``ratio`` of the page's highest value; of two or more, those at least ``min_height`` of the median height."""
    page = Window.partitionBy(*by)
    ink = F.col("s") > F.max("s").over(page) * (F.lit(ratio) if isinstance(ratio, float) else ratio)
    marked = smoothed.withColumn("ink", ink)
    rises = marked.withColumn("rise", (F.col("ink") & ~F.lag("ink", 1, False).over(page.orderBy("y"))).cast("int"))
    runs = rises.withColumn("run", F.sum("rise").over(page.orderBy("y"))).where("ink")
    lines = runs.groupBy(*by, "run").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    judged = lines.withColumn("m", F.median(F.col("y1") - F.col("y0")).over(page)).withColumn("n", F.count("*").over(page))
    return judged.where((F.col("n") < 2) | (F.col("y1") - F.col("y0") >= F.col("m") * min_height)).select(*by, "y0", "y1")


def lines_above(values: Column, ratio: Column, min_height: float) -> Column:
    """How many lines ``lines_at`` finds in a whole page's values at one threshold."""
    ink = F.transform(values, lambda v: v > F.array_max(values) * ratio)

    def heights(ink: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ink) - 1)
        edge = lambda step: F.filter(at, lambda y: F.get(ink, y) & ~F.coalesce(F.get(ink, y + step), F.lit(False)))
        return F.array_sort(F.zip_with(edge(1), edge(-1), lambda last, first: last - first + 1))

    def lines(h: Column) -> Column:
        middle = (F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor(F.size(h) / 2).cast("int"))) / 2
        return F.when(F.size(h) < 2, F.size(h)).otherwise(let(middle, lambda m: F.size(F.filter(h, lambda x: x >= m * min_height))))

    return let(ink, lambda i: let(heights(i), lines))


def stable_threshold(smoothed: DataFrame, low: float = 0.01, high: float = 0.5, steps: int = 50, min_height: float = 0.3) -> DataFrame:
    """``page``, ``threshold_ratio``, ``n_lines``: the middle of the first longest run of thresholds with one line count.

    A page's values go together as one array, and all thresholds are tried on it.
    """
    ratio = lambda k: F.lit(low) + k * F.lit((high - low) / (steps - 1))
    pages = smoothed.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "s"))), lambda r: r["s"]).alias("v"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: lines_above(F.col("v"), ratio(k), min_height))

    def runs(c: Column) -> Column:
        """Of each threshold that begins a run: minus the run's length, its start and count; the first longest is least."""
        at = F.sequence(F.lit(0), F.lit(steps - 1))
        begins = F.filter(at, lambda k: ~F.coalesce(F.get(c, k - 1) == F.get(c, k), F.lit(False)))
        return let(begins, lambda b: F.array_min(F.transform(b, lambda k, i: F.struct((k - F.coalesce(F.get(b, i + 1), F.lit(steps))).alias("less"), k.alias("start"), F.get(c, k).alias("n")))))

    best = pages.select("page", let(counts, runs).alias("best"))
    at = F.col("best.start") + F.floor(-F.col("best.less") / 2)
    return best.select("page", ratio(at).alias("threshold_ratio"), F.col("best.n").cast("long").alias("n_lines"))


def line_pitch(smoothed: DataFrame, ratio: float = 0.2) -> DataFrame:
    """``page``, ``pitch``: the median distance of neighbouring line centres, null for fewer than two lines."""
    lines = lines_at(smoothed, ratio, min_height=0.0).withColumn("centre", (F.col("y0") + F.col("y1")) / 2)
    steps = lines.withColumn("step", F.col("centre") - F.lag("centre").over(Window.partitionBy("page").orderBy("centre")))
    return steps.groupBy("page").agg(F.median("step").alias("pitch"))


def dpi(pitch: Column, stroke: Column) -> Column:
    """Resolution from the line pitch if it is at least 10 rows, else from the stroke width."""
    return F.when(pitch >= 10, pitch / (LINE_MM / 25.4)).otherwise(stroke / (STROKE_MM / 25.4))


def scale_to(dpi_: Column, target: float = TARGET_DPI, tolerance: float = 0.05) -> Column:
    scale = F.lit(target) / dpi_
    return F.when(F.abs(scale - 1) < tolerance, 1.0).otherwise(scale)


def scaled(size: Column, scale: Column) -> Column:
    """A dimension in whole pixels, halves to the even one, one at least."""
    return F.greatest(F.lit(1), F.bround(size * scale)).cast("int")


def limited(height: Column, width: Column, most: int = 2048) -> Column:
    """``height`` and ``width`` with the larger one at most ``most``."""
    scale = F.when(F.greatest(height, width) <= most, 1.0).otherwise(F.lit(float(most)) / F.greatest(height, width))
    return F.struct(scaled(height, scale).alias("height"), scaled(width, scale).alias("width"))


def multiline(profile: DataFrame, min_rows: int = 100, ratio: float = 0.15) -> DataFrame:
    """``page``, ``multiline``: at least ``min_rows`` rows, and two or more runs above ``ratio`` of the highest."""
    page = Window.partitionBy("page")
    ink = F.col("p") > F.max("p").over(page) * ratio
    rise = (F.col("ink") & ~F.lag("ink", 1, False).over(page.orderBy("y"))).cast("int")
    return profile.withColumn("ink", ink).withColumn("rise", rise).groupBy("page").agg(((F.count("*") >= min_rows) & (F.sum("rise") >= 2)).alias("multiline"))


def seam_costs(energy: Column) -> Column:
    """Least cost of reaching each cell from the left (columns of ``energy``: array of rows of doubles), as columns from left to right."""
    width = F.size(F.get(energy, F.lit(0)))
    column = lambda x: F.transform(energy, lambda row: F.get(row, x))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.transform(column(x), lambda e, i: e + F.array_min(F.array(F.get(last, i - 1), F.get(last, i), F.get(last, i + 1))))
        return F.concat(acc, F.array(grown))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), F.array(column(F.lit(0))), lambda acc, x: F.when(x < width, step(acc, x)).otherwise(acc))


def seam(costs: Column) -> Column:
    """The cheapest row of each column, walked from the right; of equals the smallest row."""

    def cheapest(column: Column, low: Column, high: Column) -> Column:
        part = F.slice(column, low + 1, high - low + 1)
        return (low + F.array_position(part, F.array_min(part)) - 1).cast("int")

    def step(acc: Column, column: Column) -> Column:
        row = F.get(acc, F.size(acc) - 1)
        near = cheapest(column, F.greatest(row - 1, F.lit(0)), F.least(row + 1, F.size(column) - 1))
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, cheapest(column, F.lit(0), F.size(column) - 1)).otherwise(near)))

    return F.reverse(F.aggregate(F.reverse(costs), F.array().cast("array<int>"), step))

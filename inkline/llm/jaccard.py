"""Near duplicates by the Jaccard similarity of word shingles: SimHash links and MinHash propose pairs, exact sets decide.

Texts with equal shingle sets are one class. Classes whose SimHash fingerprints vantage-point trees link (see
``simhash``) share a bucket; but sets of similarity 0.8 differ in some nine bits of 64, where triangle bounds
prune nothing, so that trees alone would miss them. A class also goes to a bucket for each of ``BANDS`` bands of
``ROWS`` least hashes; a pair of similarity 0.8 misses all its buckets with probability
(1 - 0.8 ** ROWS) ** BANDS, below 1 in 10,000. Pairs of a bucket are confirmed in rounds: all members with the
bucket's least class, then with a hub that differs between buckets, at last all members of buckets that still
lie in several components. A pair whose ends are joined already can change no component and needs no look.
The last round would be every pair of a crowded bucket; but two sets of n shingles or more with similarity t
share one of their n - ceil(t n) + 1 rarest, whatever the order of equally rare ones, and the first that they share must
have enough behind it in both sets, so only such pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, first_row, join_each, keyed, one_row_each, written
from .simhash import majority_bits
from .words import few

BANDS, ROWS = 24, 5
_RNG = np.random.default_rng(17)
FLIPS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct word shingles of a text, as sorted XXH64 values; a shorter text is one shingle, one without words none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))


def bands(grams: np.ndarray) -> np.ndarray:
    """A number for each band of the least hashes; none without shingles."""
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(grams), 512):
        x = (grams[k : k + 512, None] ^ FLIPS) * FACTORS
        x ^= x >> np.uint64(32)
        x *= FACTORS
        np.minimum(least, x.min(axis=0), out=least)
    found = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        found = (found ^ row) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found.view(np.int64)


def signatures(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """``_row``, ``digest`` (of the shingle set), ``n`` (its size), ``fp`` (its SimHash) and ``bands`` of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            sets = [shingles(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array(np.array([majority_bits(s) for s in sets], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, pa.array([len(s) for s in sets], pa.int64()), fps, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["_row", "digest", "n", "fp", "bands"])

    return rows.select("_row", text_col).mapInArrow(run, "_row long, digest binary, n long, fp long, bands array<long>")


def by_fingerprint(classes: DataFrame, reach: int) -> DataFrame:
    """``class``, ``n`` and ``bucket``: those whose fingerprints links of ``reach`` bits join share one."""
    prints = written(classes.groupBy("fp").agg(F.count("*").alias("weight")), "fingerprint-classes")
    roots = connected_components(simhash.near_links(prints, reach), "fingerprint-components").withColumnRenamed("node", "fp")
    told = prints.join(roots, "fp", "left").select("fp", "weight", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    return join_each(classes.select("class", "n", "fp"), written(told, "fingerprint-told"), "fp", "weight").select("class", "n", "bucket")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have a Jaccard similarity of ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 128):
            held: dict[int, np.ndarray] = {}

            def grams(number: int, text: bytes | None, held: dict[int, np.ndarray] = held) -> np.ndarray:
                if number not in held:
                    held[number] = shingles(text, size)
                return held[number]

            a, b, text_a, text_b = (batch.column(k) for k in range(4))
            near = []
            for p, q, s, t in zip(a.to_pylist(), b.to_pylist(), text_a.cast(pa.binary()).to_pylist(), text_b.cast(pa.binary()).to_pylist(), strict=True):
                x, y = grams(p, s), grams(q, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rarest(some: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """``class``, ``n``, ``part``, ``gram``, ``place`` of the rarest shingles of each class of ``some``, as many as a pair of ``threshold`` can't do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 128):
            sets = [shingles(t, size).view(np.int64) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["class", "n", "part", "grams"])

    sets = some.join(texts, "class").select("class", "n", "part", "text").mapInArrow(run, "class long, n long, part long, grams array<long>")
    each = written(sets.select("class", "n", "part", F.explode("grams").alias("gram")), "shingle-open")
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("often", "gram"))
    first = each.join(often, "gram").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    return written(first.where("often > 1").select("class", "n", "part", "gram", "place"), "shingle-rarest")


def near_links(classes: DataFrame, texts: DataFrame, threshold: float, size: int, reach: int = 3) -> DataFrame:
    """``node`` and ``root`` of the classes that confirmed links join; ``classes``: ``class``, ``n``, ``fp`` and ``bands``."""
    each = classes.select("class", "n", F.explode("bands").alias("bucket")).unionByName(by_fingerprint(classes.where("n > 0"), reach))
    full = each.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = written(each.join(full, "bucket"), "shingle-buckets")
    links = tested = roots = None

    def differ(p: str, q: str):
        """Sizes that allow the threshold."""
        return F.least(p, q) >= threshold * F.greatest(p, q) - 1e-9

    for hub in ("class", "varied", None):
        now = members if roots is None else members.join(roots.withColumnRenamed("node", "class"), "class", "left")
        now = now.withColumn("part", F.col("class") if roots is None else F.coalesce("root", "class"))
        order = F.struct(F.xxhash64("bucket", "class"), "class") if hub == "varied" else F.struct("class")
        heads = now.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by(F.struct("class", "n", "part"), order).alias("hub")).where("low < high")
        if hub:
            meet = now.join(heads.select("bucket", F.col("hub.class").alias("other"), F.col("hub.n").alias("m"), F.col("hub.part").alias("apart")), "bucket")
        else:
            rare = rarest(now.join(heads.select("bucket"), "bucket").select("class", "n", "part").distinct(), texts, threshold, size)
            others = rare.select("gram", F.col("class").alias("other"), F.col("n").alias("m"), F.col("part").alias("apart"), F.col("place").alias("there"))
            # the first shingle that both have leaves no more for both to have than stand behind it in either
            shared = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("there")) + 1
            enough = shared >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
            meet = rare.join(others, "gram").where((F.col("class") < F.col("other")) & (F.col("part") != F.col("apart")) & differ("n", "m") & enough)
        pairs = meet.where((F.col("part") != F.col("apart")) & differ("n", "m")).select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "shingle-pairs")
        found = written(confirmed(pairs, texts, threshold, size), "shingle-links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = found if links is None else links.unionAll(found)
        roots = connected_components(links, "shingle-components")
    return roots


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each group joined by links of Jaccard similarity ``threshold`` or more: the least id, null ids last.

    Texts without words (null ones too) have equal sets, so that one of them stays. A text of fewer words
    than ``shingle`` is one shingle of its own.
    """
    rows = keyed(docs)
    told = written(signatures(rows, text_col, shingle).join(rows.select("_row", id_col), "_row"), "shingle-signatures")
    classes = told.groupBy("digest").agg(first_row(id_col), *(F.first(c).alias(c) for c in ("n", "fp", "bands")))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")
    texts = classes.select("class", F.col("first.row").alias("_row")).join(rows.select("_row", F.col(text_col).alias("text")), "_row").select("class", "text")
    return one_row_each(rows, classes, near_links(classes, texts, threshold, shingle))

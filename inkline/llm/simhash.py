"""SimHash fingerprints and their near duplicates, found with vantage-point trees.

Two fingerprints within ``reach`` differing bits agree to ``reach // 2`` bits in one of their two
32-bit halves. So there are two trees, one a half. A node splits fingerprints at Hamming distance
``mu`` from a vantage point, measured on the tree's half (bound ``reach // 2``) or, where that half
no longer tells fingerprints apart, on all bits (bound ``reach``). By the triangle inequality only
fingerprints whose distance lies within the bound of ``mu`` can have neighbours across: those of the
inner side go to the outer side too, as queries; queries follow every side that they overlap.
The upper levels, built from a bounded sample, deal fingerprints into shards; each shard goes on
with a tree of its own and compares the leaves exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drawn, first_row, join_each, keyed, one_row_each, shuffle_width, written
from .words import few

HALVES = (np.uint64(0x00000000FFFFFFFF), np.uint64(0xFFFFFFFF00000000))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints that the driver sees at most, to place the upper levels of the trees, and for each shard aimed at.
SAMPLE, SAMPLE_EACH = 65_536, 8
#: Fingerprints aimed at in a shard, and in a leaf that is compared block by block.
SHARD, LEAF = 4_000, 384


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the 64-bit hashes. Bytes of a word count eight bits at a time, 255 rows a sum."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.uint64(0x0101010101010101)
    starts = np.arange(0, n, 255)
    counts = np.zeros((8, 8), dtype=np.int64)  # [bit in byte, byte]
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones, starts)
        counts[bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts.T > n).astype(np.uint8)  # little-endian bytes, bit 0 first
    return int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole UTF-8 text, over word shingles hashed with XXH64."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return majority_bits(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row; a null text has no words, which gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


class VantageTree:
    """Nodes as parallel lists; a child below zero is leaf ``~child``."""

    def __init__(self, half: int, reach: int):
        self.half, self.reach = half, reach
        self.vantage: list[int] = []
        self.mask: list[int] = []
        self.mu: list[int] = []
        self.bound: list[int] = []
        self.child: list[list[int]] = []
        self.leaves = 0

    def best_split(self, points: np.ndarray, rng: np.random.Generator):
        """The vantage point, mask and distance that leave the least on the larger side, overlap counted; None if none divides."""
        best, n = None, len(points)
        for vantage in points[rng.choice(n, min(n, 6), replace=False)]:
            for mask, bound in ((HALVES[self.half], self.reach // 2), (ALL, self.reach)):
                d = np.bitwise_count((points ^ vantage) & mask)
                upto = np.cumsum(np.bincount(d, minlength=65))
                for mu in range(64):
                    inner, outer = upto[mu], n - upto[mu]
                    if not inner or not outer:
                        continue
                    over = upto[mu] - (upto[mu - bound] if mu >= bound else 0)
                    cost = max(inner, outer + over)
                    if cost < 0.93 * n and (best is None or cost < best[0]):
                        best = (cost, vantage, mask, mu, bound)
        return best

    def grow(self, points: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        """Adds the subtree over ``points``; gives its child number. Works off a stack, so depth is no limit."""
        root = [0]
        todo = [(points, root, 0)]
        while todo:
            now, holder, at = todo.pop()
            split = self.best_split(now if len(now) <= 4096 else rng.choice(now, 4096, replace=False), rng) if len(now) > leaf else None
            if split is None:
                holder[at] = ~self.leaves
                self.leaves += 1
                continue
            _, vantage, mask, mu, bound = split
            holder[at] = len(self.mu)
            self.vantage.append(int(vantage))
            self.mask.append(int(mask))
            self.mu.append(mu)
            self.bound.append(bound)
            self.child.append([0, 0])
            inner = np.bitwise_count((now ^ vantage) & mask) <= mu
            todo += [(now[inner], self.child[-1], 0), (now[~inner], self.child[-1], 1)]
        self.root = root[0]
        return root[0]

    def route(self, points: np.ndarray, home: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaf, rows of ``points`` that live there, rows that query it."""
        todo = [(self.root, home, asks)]
        while todo:
            node, home, asks = todo.pop()
            if not len(home) and not len(asks):
                continue
            if node < 0:
                yield ~node, home, asks
                continue
            vantage, mask, mu, bound = np.uint64(self.vantage[node]), np.uint64(self.mask[node]), self.mu[node], self.bound[node]
            d = np.bitwise_count((points[home] ^ vantage) & mask).astype(np.int16)
            e = np.bitwise_count((points[asks] ^ vantage) & mask).astype(np.int16)
            inner, over = d <= mu, (d <= mu) & (d > mu - bound)
            todo.append((self.child[node][0], home[inner], asks[e <= mu + bound]))
            todo.append((self.child[node][1], home[~inner], np.concatenate([home[over], asks[e > mu - bound]])))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each group) once the rows ``a`` and ``b`` are joined."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row joined to each of ``n`` rows by the links (a, b)."""
    return merge(np.arange(n), a, b)


def shard_links(points: np.ndarray, home: np.ndarray, half: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the fingerprints of one shard: every pair (one of them at home) within ``reach`` is joined by them."""
    rng = np.random.default_rng(7)
    tree = VantageTree(half, reach)
    rows = np.arange(len(points))
    tree.grow(points[home] if home.any() else points[:0], LEAF, rng)
    ends_a, ends_b = [], []
    for _, here, asks in tree.route(points, rows[home], rows[~home]):
        if not len(here):
            continue
        both = np.concatenate([here, asks])
        label = np.arange(len(both))
        for k in range(0, len(both), 1024):
            for m in range(0, len(here), 4096):  # a leaf that nothing divides can be large
                near = np.bitwise_count(points[both[k : k + 1024], None] ^ points[None, here[m : m + 4096]]) <= reach
                i, j = np.nonzero(near & (label[k : k + 1024, None] != label[None, m : m + 4096][:, : near.shape[1]]))
                label = merge(label, i + k, j + m)
        joined = label != np.arange(len(both))
        ends_a.append(both[joined])
        ends_b.append(both[label[joined]])
    if not ends_a:
        return rows[:0], rows[:0]
    label = stars(len(points), np.concatenate(ends_a), np.concatenate(ends_b))
    joined = label != rows
    return rows[joined], label[joined]


def sample_share(n: int) -> float:
    """Of ``n`` fingerprints, those that the upper levels are placed by: more with more shards, an eighth and ``SAMPLE`` at most."""
    return min(0.125, min(SAMPLE, max(2048, SAMPLE_EACH * n // SHARD)) / max(n, 1))


def near_links(classes: DataFrame, reach: int = 3) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of ``classes`` whose components are those of all pairs within ``reach`` bits."""
    spark = classes.sparkSession
    n = classes.count()
    sample = np.array([r.fp for r in classes.where(drawn(sample_share(n), 11, "fp")).select("fp").limit(2 * SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    trees = []
    for half in (0, 1):
        tree = VantageTree(half, reach)
        tree.grow(sample, max(6.0, SHARD * len(sample) / max(n, 1)), np.random.default_rng(3))
        trees.append(tree)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for frame in chain(frames, [None]):
            if frame is not None:
                held.append(frame["fp"].to_numpy(np.int64))
            if not held or frame is not None and sum(map(len, held)) < 100_000:
                continue  # the trees are walked with many fingerprints at once
            points = np.concatenate(held).view(np.uint64)
            held, rows = [], np.arange(len(points))
            for half, tree in enumerate(trees):
                for leaf, home, asks in tree.route(points, rows, rows[:0]):
                    at = np.concatenate([home, asks])
                    yield pd.DataFrame({"shard": np.int32(2 * leaf + half), "fp": points[at].view(np.int64), "home": np.arange(len(at)) < len(home)})

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = shard_links(points, frame["home"].to_numpy(bool), int(key[0]) % 2, reach)
        return pd.DataFrame({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    shards = sum(t.leaves for t in trees)
    dealt = classes.select("fp").repartition(max(shuffle_width(spark), n // 500_000)).mapInPandas(deal, "shard int, fp long, home boolean")
    return dealt.repartition(max(shards, shuffle_width(spark)), "shard").groupBy("shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 3, seed: int = 42) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id``: the least id that links of ``reach`` or fewer bits reach.

    One row per input row. Null, empty and word-free texts have fingerprint zero and are linked like any
    other. Null ids never serve as a component's id unless it has no other (then null). Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("weight")), "fingerprint-classes")
    roots = connected_components(near_links(classes, reach), "fingerprint-components")
    linked = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    found = join_each(linked.select("node", "root"), least, "root", "fps").select(F.col("node").alias("fp"), "component_id")
    per_class = classes.join(found, "fp", "left").select("fp", "weight", F.coalesce("component_id", "least").alias("component_id"))
    return join_each(fps, written(per_class, "fingerprint-told"), "fp", "weight").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 3, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each component: the one with the least id, null ids last; of rows with equal ids one stays."""
    rows = keyed(docs)
    fps = fingerprints(rows, "_row", text_col, shingle, seed)
    told = written(fps.join(rows.select("_row", id_col), "_row"), "fingerprints")
    classes = written(told.groupBy(F.col("fp").alias("class")).agg(first_row(id_col)), "fingerprint-classes")
    roots = connected_components(near_links(classes.select(F.col("class").alias("fp")), reach), "fingerprint-components")
    return one_row_each(rows, classes, roots)

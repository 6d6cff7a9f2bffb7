"""Embedding near duplicates: spherical k-means cells, blocked cosine products within and between them, one vector of each group kept.

Equal vectors are one class with a weight. A class lives in the cell of its nearest centre. Above ``FAN`` cells
the centres are two levels, so that their number grows with the vectors and few of them are looked at. Classes are sorted by
cell and packed into blocks of bounded size, which are written once; pairs of blocks are read from there and
multiplied where a bound that follows from the threshold leaves anything to find (see ``Cells.ask`` for pairs of blocks,
``links_of_block`` for rows), so that no link is lost and a vector is never copied to the cells that it is near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, drawn, join_each, shuffle_width, written
from .simhash import merge

#: Bytes of vectors that the centres of a width are fitted on at most, vectors aimed at in a cell, cells of a level.
SAMPLE_BYTES, CELL, FAN = 64 << 20, 800, 256
#: Vectors and bytes of vectors in a block at most, vectors of it multiplied at once, widths that get centres of their own (the rest have one cell each).
BLOCK, BLOCK_BYTES, FRAGMENT, WIDTHS = 16_000, 4 << 20, 128, 64
#: Numbers in a partition of blocks: below the first there are no more partitions than the session shuffles to, none has more than the second.
FEW_NUMBERS, MOST_NUMBERS = 1 << 17, 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centres that gather the unit rows of ``x`` by cosine; a cell that runs empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


class Cells:
    """Centres of one or two levels; cells are numbered through."""

    def __init__(self, x: np.ndarray, k: int):
        fan = k if k <= FAN else int(np.ceil(np.sqrt(k)))
        self.top = spherical_kmeans(x, max(1, fan))
        self.sub = [self.top[c : c + 1] for c in range(len(self.top))]
        if k > FAN:
            near = np.concatenate([(x[a : a + 4096] @ self.top.T).argmax(axis=1) for a in range(0, len(x), 4096)])
            for c in range(len(self.top)):
                mine = x[near == c]
                if len(mine):
                    self.sub[c] = spherical_kmeans(mine, max(1, min(len(mine) // 4, -(-k // fan))))
        self.first = np.cumsum([0, *map(len, self.sub)])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest centre under the nearest top."""
        top, home = (x @ self.top.T).argmax(axis=1), np.zeros(len(x), dtype=np.int64)
        for c in np.unique(top):
            home[top == c] = self.first[c] + (x[top == c] @ self.sub[c].T).argmax(axis=1)
        return home

    def ask(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row; and rows and the cells that they live in or ask, in order of rows.

        Linked x and y are at most d = sqrt(2 - 2 ``threshold``) apart. With homes c and c' (nearest centres), (x.c - x.c') + (y.c' - y.c) =
        (x - y).(c - c') <= d |c - c'|, and neither summand is below zero. So one of them is at most half of that: where x asks
        every c' with x.c - x.c' <= d |c - c'| / 2, one of the two asks the other's home. On two levels a home is the
        nearest centre under the nearest top: tops are asked like this, and under another top than its own x asks every cell
        that a linked vector can live in, where the whole bound holds.
        """
        d = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        row, cell = [], []
        top, tops = asked(x, self.top, d, 0.5)
        home = np.zeros(len(x), dtype=np.int64)
        for c, sub in enumerate(self.sub):
            here = np.flatnonzero(tops[:, c])
            if not len(here):
                continue
            own = top[here] == c
            for some, share in ((here[own], 0.5), (here[~own], 1.0)):
                for k in range(0, len(some), 4096):
                    part = some[k : k + 4096]
                    near, asks = asked(x[part], sub, d, share)
                    if share < 1:
                        home[part] = self.first[c] + near
                    r, j = np.nonzero(asks)
                    row.append(part[r])
                    cell.append(self.first[c] + j)
        row, cell = np.concatenate([*row, np.zeros(0, dtype=np.int64)]), np.concatenate([*cell, np.zeros(0, dtype=np.int64)])
        order = np.lexsort((cell, row))
        return home, row[order], cell[order]


def asked(x: np.ndarray, centres: np.ndarray, d: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and whether each centre is as near but for ``share`` of ``d`` times its distance to that one."""
    near = x @ centres.T
    best = near.argmax(axis=1)
    norm = (centres**2).sum(axis=1)
    apart = np.sqrt(np.maximum(0.0, norm[:, None] + norm[None] - 2 * centres @ centres.T) + 1e-12)
    return best, near[np.arange(len(x)), best][:, None] - near <= share * d * apart[best]


def usable(vector: str):
    """Neither null nor zero, without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def to_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(classes: DataFrame) -> dict[int, Cells]:
    """Centres for the widths that more than one cell's vectors have, from a sample of bounded size."""
    found = {}
    for r in classes.groupBy(F.size("vector").alias("width")).count().where(F.col("count") > CELL).orderBy(F.desc("count"), "width").limit(WIDTHS).collect():
        most = max(1000, SAMPLE_BYTES // (4 * r.width))
        wanted = min(most, max(20_000, 4 * r["count"] // CELL))
        sample = classes.where((F.size("vector") == r.width) & drawn(min(0.5, wanted / r["count"]), 3, "class")).select("vector").limit(2 * wanted).toArrow()
        if sample.num_rows:
            x = unit(to_matrix(sample.column("vector").combine_chunks(), r.width).astype(np.float64))
            found[r.width] = Cells(x, max(1, min(r["count"] // CELL, len(x) // 4)))
    return found


BLOCKS = "width int, n int, class binary, weight binary, vector binary, home binary, lived array<int>, asked array<int>"


def in_blocks(classes: DataFrame, cells: dict[int, Cells], threshold: float) -> DataFrame:
    """Packed rows of ``BLOCK`` classes at most, in order of their cells, with the cells that they live in and that they ask."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, dtype=int)
            cell = np.zeros(len(width), dtype="<i4")
            for w in np.unique(width).tolist():
                if w in cells:
                    cell[width == w] = cells[w].home(unit(to_matrix(batch.filter(pa.array(width == w)).column(2), w).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width.astype("<i4")), pa.array(cell)], names=["class", "weight", "vector", "width", "cell"])

    def pack(w: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, weight, raw = whole.column(0).to_numpy(), whole.column(1).to_numpy(), to_matrix(whole.column(2), w)
        home, cell = np.zeros(len(ids), dtype=int), np.zeros(1, dtype=int)
        if w in cells:
            home, _, cell = cells[w].ask(unit(raw.astype(np.float64)), threshold)
        order = np.argsort(home, kind="stable")
        row = (w, len(ids), ids[order].tobytes(), weight[order].tobytes(), raw[order].tobytes(), home[order].astype("<i4").tobytes(), np.unique(home), np.unique(cell))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int32())] * 2)
        return pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            width = batch.column(3).to_numpy()
            for part in np.split(np.arange(len(width)), np.flatnonzero(np.diff(width)) + 1) if len(width) else []:
                w, at, end = int(width[part[0]]), int(part[0]), int(part[-1]) + 1
                if held and w != now:
                    yield pack(now, held)
                    held = []
                now, most = w, max(1, min(BLOCK, BLOCK_BYTES // 4 // max(1, w)))
                while at < end:
                    some = batch.slice(at, min(end - at, most - sum(b.num_rows for b in held)))
                    held.append(some)
                    at += some.num_rows
                    if sum(b.num_rows for b in held) == most:
                        yield pack(now, held)
                        held = []
        if held:
            yield pack(now, held)

    kind = classes.schema["vector"].dataType.simpleString()
    settled = classes.select("class", "weight", "vector").mapInArrow(settle, f"class long, weight long, vector {kind}, width int, cell int")
    numbers = classes.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    parts = max(1, min(shuffle_width(classes.sparkSession), numbers // FEW_NUMBERS), -(-numbers // MOST_NUMBERS))
    # the class is a key too, so that a crowded cell is spread
    return settled.repartitionByRange(parts, "width", "cell", "class").sortWithinPartitions("width", "cell").mapInArrow(run, BLOCKS)


def pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """Each two blocks of one width (``l_``, ``r_``; a block also with itself) of which one asks a cell of the other, read from where they are written: nothing is shuffled."""
    sides = [blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in blocks.columns)) for s in "lr"]
    met = F.arrays_overlap("l_lived", "r_asked") | F.arrays_overlap("l_asked", "r_lived")
    return sides[0].join(sides[1].hint("shuffle_replicate_nl"), (F.col("l_width") == F.col("r_width")) & (F.col("l_block") <= F.col("r_block")) & met)


def links_of_block(frame: pd.DataFrame, threshold: float, kind: str, cells: dict[int, Cells]) -> pd.DataFrame:
    """Of two blocks (or one with itself): each class's linked weight, and stars over the linked.

    Linked x and y are at most d = sqrt(2 - 2 ``threshold``) apart, so for the centres c and c' of their cells (x.c - x.c') + (y.c' - y.c) = (x - y).(c - c')
    <= d |c - c'|. Rows of two cells are put in order of these summands, and only those whose sum is small enough are multiplied.
    """
    many = lambda name, kind: np.frombuffer(b"".join(frame[name]), dtype=kind)
    ids, weight, home, width, sizes = many("class", "<i8"), many("weight", "<i8").astype(float), many("home", "<i4"), int(frame["width"].iloc[0]), frame["n"].to_numpy()
    x = unit(many("vector", kind).reshape(-1, width).astype(np.float64))
    centres = np.concatenate(cells[width].sub) if width in cells else np.zeros((1, width))
    alone = len(sizes) == 1
    l_rows, r_rows = slice(0, int(sizes[0])), slice(0 if alone else int(sizes[0]), len(ids))
    (l_cells, l_at), (r_cells, r_at) = (np.unique(home[rows], return_index=True) for rows in (l_rows, r_rows))
    a, b = centres[l_cells], centres[r_cells]
    own = np.einsum("ij,ij->i", x, centres[home])
    l_away, r_away = own[l_rows, None] - x[l_rows] @ b.T, own[r_rows, None] - x[r_rows] @ a.T
    d = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    most = d * np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T) + 1e-12) + 1e-9
    met = np.minimum.reduceat(l_away, l_at, axis=0) + np.minimum.reduceat(r_away, r_at, axis=0).T <= most
    l_ends, r_ends = np.append(l_at[1:], len(l_away)), np.append(r_at[1:], len(r_away))
    gained, label = np.zeros(len(ids)), np.arange(len(ids))
    for m, k in np.argwhere(np.triu(met) if alone else met):
        p, q, bound = l_away[l_at[m] : l_ends[m], k], r_away[r_at[k] : r_ends[k], m], most[m, k]
        left, right = np.flatnonzero(p <= bound - q.min()), np.flatnonzero(q <= bound - p.min())
        left, right = left[np.argsort(p[left])], right[np.argsort(q[right])]
        p, q, left, right = p[left], q[right], left + l_at[m], right + r_rows.start + r_at[k]
        y = x[right]
        for s in range(0, len(left), FRAGMENT):
            rows = left[s : s + FRAGMENT]
            cols = right[: np.searchsorted(q, bound - p[s], side="right")]
            near = x[rows] @ y[: len(cols)].T >= threshold
            if alone and m == k:
                near &= rows[:, None] < cols[None, :]  # each pair once
            if not near.any():
                continue
            gained[rows] += near @ weight[cols]
            gained[cols] += weight[rows] @ near
            live = near & (label[rows][:, None] != label[cols][None, :])
            if live.any():
                i, j = np.nonzero(live)
                label = merge(label, rows[i], cols[j])
    told = pd.DataFrame({"a": ids, "b": ids, "n": gained.astype(np.int64)})[gained > 0]
    joined = label != np.arange(len(ids))
    return pd.concat([told, pd.DataFrame({"a": ids[joined], "b": ids[label[joined]], "n": 0})])


def links(blocks: DataFrame, cells: dict[int, Cells], threshold: float, kind: str) -> DataFrame:
    """``a``, ``b``, ``n``: the weight linked to class ``a`` = ``b`` in two blocks, or 0 where classes ``a`` and ``b`` are linked directly or by others."""
    fields = ("width", "n", "class", "weight", "vector", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                sides = "l" if row["l_block"] == row["r_block"] else "lr"
                found = links_of_block(pd.DataFrame([{f: row[f"{s}_{f}"] for f in fields} for s in sides]), threshold, kind, cells)
                if len(found):
                    yield pa.RecordBatch.from_pandas(found.astype("int64"), preserve_index=False)

    pairs = pairs_of_blocks(blocks).select("l_block", "r_block", *(f"{s}_{f}" for s in "lr" for f in fields))
    return pairs.mapInArrow(run, "a long, b long, n long")


def same_vector(vector: str) -> Column:
    """128 bits that tell vectors apart, zeros of either sign alike."""
    plain = F.transform(vector, lambda x: x + F.lit(0.0).cast("float"))
    return F.struct(F.xxhash64(plain).alias("x"), F.xxhash64(F.lit(7), plain).alias("y"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` of every row.

    ``n_links``: other rows with cosine >= ``threshold``, equal vectors included; vectors of different widths
    are never linked. Vectors that are null, zero, or hold null or non-finite components link with nothing and
    are kept. A null id counts for others' links but stands for a component only if there is no other id.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = rows.where(usable("vector")).withColumn("same", same_vector("vector"))
    classes = good.groupBy("same").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    cells = fit(classes)
    kind = "<f4" if classes.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    blocks = written(in_blocks(classes, cells, threshold).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    found = written(links(blocks, cells, threshold, kind), "vector-links")
    linked = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    roots = connected_components(found.where("n = 0").select("a", "b"), "vector-components").withColumnRenamed("node", "class")
    per_class = classes.drop("vector").join(linked, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    per_class = written(per_class, "vector-classes-linked")
    least = written(per_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "vector-least")
    told = join_each(per_class, least, "root", "size").select("same", "weight", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    joined = join_each(good.select("id", "same"), written(told, "vector-told"), "same", "weight").select("id", "n_links", "component_id")
    alone = rows.where(~usable("vector")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return joined.unionAll(alone).select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

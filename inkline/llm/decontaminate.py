"""Benchmark passages in documents, found with an FM-index over each shard of documents.

Words outside the benchmark's vocabulary all count as one separator, and stretches of vocabulary words
shorter than the shortest phrase hold no occurrence, so that the index of a shard covers the stretches
that remain. Their suffixes are sorted, the Burrows-Wheeler sequence goes into a wavelet matrix, all
phrases are searched backwards together by its ranks, and occurrences are located by walking to sampled
suffix positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import written
from .words import WORD, as_bytes, few, in_chunks, split_words

#: Bytes of text in a shard, bytes of benchmark text searched for in one pass, bytes of a piece of an item and those that its row counts besides, and the distance between suffix samples.
SHARD_BYTES, PART_BYTES, PIECE_BYTES, ROW_BYTES, SAMPLED = 4 << 20, 1 << 20, 64 << 10, 16, 16


class FMIndex:
    """Over symbols above 0, with 0 as a separator that ends every stretch and is never searched."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        stops = symbols == 0
        rank = np.where(stops, np.cumsum(stops) - 1, symbols.astype(np.int64) + int(stops.sum()))
        step = 1
        order = np.argsort(rank, kind="stable")
        while n:
            ordered = rank[order]
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if fresh[order[-1]] == n - 1:
                break
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - step, 0)] = fresh[step:] + 1
            rank = fresh * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            step *= 2
        before = symbols[order - 1]  # of the first suffix: the last symbol, a separator
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])  # symbols below each
        marked = (order % SAMPLED == 0) | (before == 0)
        self.marked = marked
        self.sample = np.where(marked, order, -1)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        now = before
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append((np.concatenate([[0], np.cumsum(bit)]).astype(np.int32), n - int(bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each end."""
        zero, ends = np.zeros(len(symbol), dtype=np.int64), list(ends)
        for k, (ones, zeros) in enumerate(self.levels):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            zero, *ends = (np.where(bit, zeros + ones[e], e - ones[e]) for e in (zero, *ends))
        return [e - zero for e in ends]

    def symbol_at(self, row: np.ndarray) -> np.ndarray:
        found = np.zeros(len(row), dtype=np.int64)
        for ones, zeros in self.levels:
            bit = ones[row + 1] - ones[row]
            found = 2 * found + bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return found

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of ``phrases``, set to the right) that occur, and the first and last+1 of their suffixes."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for back in range(1, phrases.shape[1] + 1):
            over = lengths[alive] < back
            done.append((alive[over], low[over], high[over]))
            alive, low, high = alive[~over], low[~over], high[~over]
            symbol = phrases[alive, -back]
            known = symbol < len(self.start) - 1
            alive, low, high, symbol = alive[known], low[known], high[known], symbol[known]
            first = self.start[symbol]
            low, high = (first + r for r in self.rank(symbol, low, high))
            hit = low < high
            alive, low, high = alive[hit], low[hit], high[hit]
        done.append((alive, low, high))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, row: np.ndarray) -> np.ndarray:
        place, steps = np.full(len(row), -1, dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        open_ = np.arange(len(row))
        while len(open_):
            here = self.marked[row[open_]]
            place[open_[here]] = self.sample[row[open_[here]]] + steps[open_[here]]
            open_ = open_[~here]
            symbol = self.symbol_at(row[open_])
            (before,) = self.rank(symbol, row[open_])
            row[open_] = self.start[symbol] + before
            steps[open_] += 1
        return place


class Phrases:
    """Windows of benchmark items as rows of word numbers, each with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(tuple(ids[k : k + window]), set()).add(item)
        rows = list(held)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.rows = np.array([(0,) * (window - len(r)) + r for r in rows], dtype=np.int64).reshape(len(rows), window)
        self.items = [sorted(i for i in held[r] if i is not None) for r in rows]
        self.shortest = int(self.lengths.min(initial=window))


def find(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its words, the merged word spans [start, end) under occurrences, the items that occur."""
    get, per_text = phrases.vocabulary.get, []
    for text in texts:
        words = split_words(text)
        per_text.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
    n_words = np.array([len(x) for x in per_text], dtype=np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    starts = np.concatenate([[0], np.cumsum(n_words + 1)])
    flat = np.zeros(starts[-1], dtype=np.int64)  # each text is followed by a separator
    for s, x in zip(starts, per_text, strict=False):
        flat[s : s + len(x)] = x
    stops = np.flatnonzero(flat == 0)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    long = stops - begins >= max(phrases.shortest, 1)
    keep = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(keep, begins[long], 1)
    np.add.at(keep, stops[long] + 1, -1)
    at = np.flatnonzero(np.cumsum(keep[:-1]))
    if not len(at) or not len(phrases.rows):
        return n_words, spans, items
    index = FMIndex(flat[at])
    phrase, low, high = index.search(phrases.rows, phrases.lengths)
    times = high - low
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    phrase = np.repeat(phrase, times)
    place = at[index.locate(rows)]
    cover = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + phrases.lengths[phrase], -1)
    hit = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0]])
    edge = np.diff(hit)
    owner = np.searchsorted(starts, np.flatnonzero(edge == 1), side="right") - 1
    for doc, a, b in zip(owner.tolist(), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    pairs = np.unique(np.stack([np.searchsorted(starts, place, side="right") - 1, phrase]), axis=1) if len(place) else np.zeros((2, 0), dtype=np.int64)
    found: dict[int, set[str]] = {}
    for doc, p in pairs.T.tolist():
        found.setdefault(doc, set()).update(phrases.items[p])
    for doc, x in found.items():
        items[doc] = sorted(x)
    return n_words, spans, items


def merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word spans, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def in_parts(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """The benchmark's items as a table of pieces (``item``, ``text``, ``part``) and the number of parts, each small enough to go to every task.

    A long item is cut into pieces that overlap by ``window`` - 1 words, so that each of its windows lies in one. Items
    without words have no piece and repeated ones the pieces of one, so that a hash deals the pieces evenly; each counts as
    its bytes and ``ROW_BYTES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 64):
            at, texts = [], []
            for k, text in enumerate(as_bytes(batch.column(1))):
                words = split_words(text)
                start = 0
                while True:
                    end, held = start, 0
                    while end < len(words) and (held < PIECE_BYTES or end < start + window):
                        held += len(words[end]) + 1
                        end += 1
                    if end:
                        at.append(k)
                        texts.append(b" ".join(words[start:end]))
                    if end == len(words):
                        break
                    start = end - window + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(texts, type=pa.binary()).cast(pa.string())], names=["item", "text"])

    pieces = benchmark.select(F.col(item_col).cast("string"), text_col).mapInArrow(run, "item string, text string")
    pieces = written(pieces.distinct(), "benchmark-pieces")
    held = F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + ROW_BYTES
    n = -(-pieces.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] // PART_BYTES) or 1
    return pieces.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), n


def phrases_of(pieces: DataFrame, part: int, window: int) -> Phrases:
    """The windows of one part; about ``PART_BYTES`` reach the driver."""
    rows = pieces.where(F.col("part") == part).select("item", F.col("text").cast("binary")).collect()
    return Phrases([(r[0], bytes(r[1])) for r in rows], window)


def shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows whose texts (column ``at``) make a shard together, and those texts."""
    for batch in few(batches, 4096):
        texts = as_bytes(batch.column(at))
        for part in in_chunks(texts, SHARD_BYTES):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def spans_of(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(x["start"], x["end"]) for x in old or ()] for old in column.to_pylist()]


def search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """``docs`` (id, text and, from parts before, n_words, spans, items) with what one part of the benchmark adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for here, texts in shards(batches, 1):
            n_words, spans, items = find(texts, phrases)
            if here.num_columns > 2:
                spans = [merge(old, new) for old, new in zip(spans_of(here.column("spans")), spans, strict=True)]
                items = [sorted({*old, *new}) for old, new in zip(here.column("items").to_pylist(), items, strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], type=SPANS)
            yield pa.RecordBatch.from_arrays([*here.columns[:2], pa.array(n_words), spans, pa.array(items, type=pa.list_(pa.string()))], names=["id", "text", "n_words", "spans", "items"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``id_col``, ``text_col`` and, of every row, ``n_words``, ``spans`` (word ranges to remove, merged) and ``items`` (ids of items found, as strings).

    A phrase is any ``window`` consecutive words of an item, or a whole shorter item. Null and empty texts
    have no words; items without words are never found; a null item id is left out of ``items``. Rows are
    never joined or shuffled, so repeated rows and ids stay as they are; other columns are ignored. A
    large benchmark is searched for in parts: one pass each, a written table between them, that adds to the
    spans found before; one part at a time is held.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces, n = in_parts(benchmark, item_col, item_text_col, window)
    for k in range(n):
        out = search(out, phrases_of(pieces, k, window))
        if k < n - 1:
            out = written(out, "benchmark-spans")
    return out.toDF(id_col, text_col, "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None, item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with all occurrences of benchmark phrases cut from ``text_col``, as ``contaminated_spans`` finds them; the rows and the other columns stay.

    ``length_col``: a column that counts the characters of the text anew where it is cut. All parts of a large
    benchmark search the text as it came; it is cut once, in the last pass.
    """
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None
    pieces, n = in_parts(benchmark, item_col, item_text_col, window)

    def find_more(phrases: Phrases, last: bool, carried: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for here, own in shards(batches, at):
                spans, columns = find(own, phrases)[1], list(here.columns)
                if carried:
                    spans = [merge(a, b) for a, b in zip(spans_of(columns.pop()), spans, strict=True)]
                names = here.schema.names[: len(columns)]
                if last and any(spans):
                    cuts = [cut(t, s) if s else t for t, s in zip(own, spans, strict=True)]
                    columns[at] = pa.array(cuts, type=pa.binary()).cast(pa.string())
                    if size is not None:
                        columns[size] = pa.array([len(t.decode()) if s else x for t, s, x in zip(cuts, spans, columns[size].to_pylist(), strict=True)], type=columns[size].type)
                if not last:
                    columns.append(pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], type=SPANS))
                    names = [*names, carry]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    kept, carry = StructType(docs.schema.fields), "_spans"
    while carry in docs.columns:
        carry += "_"
    carries = StructType([*kept.fields, StructField(carry, ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])
    out = docs
    for k in range(n - 1):
        out = written(out.mapInArrow(find_more(phrases_of(pieces, k, window), False, k > 0), carries), "benchmark-spans")
    return out.mapInArrow(find_more(phrases_of(pieces, n - 1, window), True, n > 1), kept)

"""Modified Kneser-Ney over packed n-grams: a block of texts sends a bucket one row, words once and n-grams as their numbers.

A window is a word with the ``order`` - 1 before it; what stands before a text's beginning is the empty word. A window goes to the bucket of its word before
the last, where all n-grams of two words and more with that word there meet: so their counts, the totals of their contexts and the probabilities of their
shorter ends are worked out in place. Two things are known elsewhere and sent: how many kinds of words stand before a word (buckets ask for it), and the
totals of a context, which make the backoff of an n-gram that has its row where its own word before the last is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import bucketed, written

#: Stands before a text's beginning; no word is empty. The marks' numbers in a block follow.
NONE, START, END = "", "<s>", "</s>"
#: Tokens in a block at least (but the last), and bytes of text to a bucket.
BLOCK_TOKENS, BUCKET_BYTES = 1 << 21, 8 << 20
#: What windows are sent for: n-grams that are there, n-grams asked for.
GRAMS, ASKED = 0, 1
ROWS = 1 << 16
PIECE = "bucket int, what int, words binary, grams binary, counts binary"
MERGED = "bucket int, words binary, windows array<struct<grams:binary,counts:binary>>, seen array<bigint>, asks array<struct<part:int,words:binary,before:binary>>, contexts array<struct<home:int,sizes:array<int>,words:binary,grams:binary,sums:binary>>"
ANSWER = "bucket int, part int, before binary, seen array<bigint>"
MODEL = "length int, context string, token string, p double, backoff double"


def shrink(x: np.ndarray) -> bytes:
    """Whole numbers, their bytes by place: the upper places are mostly zero."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def expand(x: bytes, kind: str) -> np.ndarray:
    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(held.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shrink_words(words: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode())


def expand_words(x: bytes) -> pa.Array:
    return pa.array(zstandard.ZstdDecompressor().decompress(x).decode().split("\n"), pa.string())


def homes(words: np.ndarray, parts: int) -> np.ndarray:
    return (pd.util.hash_array(words, categorize=False) % np.uint64(parts)).astype(np.int64)


def in_order(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``columns`` of numbers below 2^``bits``, and which rows then differ from the one before."""
    keys, room = [], 0
    for c in columns:
        if room < bits:
            keys.append(c.astype(np.int64))
            room = 63 - bits
        else:
            keys[-1] = keys[-1] << bits | c
            room -= bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def distinct(grams: np.ndarray, counts: np.ndarray, columns: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of ``grams`` in the order of its rows ``columns``, their counts added up."""
    order, new = in_order([grams[c] for c in columns], bits)
    at = np.flatnonzero(new)
    return grams[:, order[at]], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def from_last(order: int) -> list[int]:
    """Places of a window, the bucket's word and the one after it first: a shorter end is a run of equal beginnings."""
    return [order - 2, order - 1, *range(order - 3, -1, -1)]


def alphabetical(words: np.ndarray) -> np.ndarray:
    return pc.sort_indices(pa.array(words, pa.string())).to_numpy()


def renumbered(grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that are there, frequent ones first, equally frequent ones by ``rank``, and ``grams`` by their places."""
    used, inverse, often = np.unique(grams, return_inverse=True, return_counts=True)
    frequent = np.lexsort((rank[used], -often))
    place = np.empty(len(used), np.int32)
    place[frequent] = np.arange(len(used))
    return used[frequent], place[inverse.reshape(grams.shape)]


def windows_of(lists: pa.ListArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block, and its windows as numbers of words (a row a place); two without a last word name the marks."""
    lists = lists.filter(lists.is_valid())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pa.concat_arrays([pa.array([NONE, START, END], pa.string()), lists.flatten().cast(pa.string())]).dictionary_encode()
    ids = coded.indices.to_numpy()[3:]
    starts, first = np.cumsum(sizes + order) - sizes - order, np.cumsum(sizes) - sizes
    stream = np.zeros(int((sizes + order).sum()), np.int32)
    stream[np.repeat(starts + order - 1 - first, sizes) + np.arange(len(ids))] = ids
    stream[starts + order - 2], stream[starts + sizes + order - 1] = 1, 2
    ends = np.repeat(starts + order - 1 - first - np.arange(len(sizes)), sizes + 1) + np.arange(len(ids) + len(sizes))
    grams = np.zeros((order, len(ends) + 2), np.int32)
    for k in range(order):
        grams[k, :-2] = stream[ends - (order - 1 - k)]
    grams[order - 2, -2:] = 1, 2
    return coded.dictionary.to_numpy(zero_copy_only=False), grams


def pieces(lists: pa.ListArray, order: int, what: int, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that a block has windows for."""
    words, grams = windows_of(lists, order)
    home = homes(words, len(labels))
    by_home = alphabetical(words)
    by_home = by_home[np.argsort(home[by_home], kind="stable")]  # words of a bucket get neighbouring numbers
    number = np.empty(len(by_home), np.int32)
    number[by_home] = np.arange(len(by_home))
    none, words, home, grams = number[0], words[by_home], home[by_home], number[grams]
    grams, counts = distinct(grams, (grams[-1] != none).astype(np.int64), from_last(order), len(words).bit_length())
    at = home[grams[order - 2]]
    edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
    schema = pa.schema([("bucket", pa.int32()), ("what", pa.int32()), ("words", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary())])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        used, own = renumbered(grams[:, a:b], np.arange(len(words)))
        again, _ = in_order([own[c] for c in from_last(order)], len(used).bit_length())  # like beside like, for the packing
        yield one(schema, bucket=int(labels[at[a]]), what=what, words=shrink_words(words[used]), grams=shrink(own[:, again].ravel()), counts=shrink(counts[a:b][again]))


def levels(grams: np.ndarray, counts: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
    """N-grams of each length from the longest down to two, of windows in the order of ``from_last``.

    ``at``: a window that ends with it; ``n``: its count, for shorter ones how many different words stand before it, or of texts that it begins if none does.
    ``parent``: its end without the first word, in the next shorter length.
    """
    order, out, runs, longer = len(grams), {}, {}, None
    total = np.concatenate([[0], np.cumsum(counts)])
    new = np.zeros(grams.shape[1], bool)
    new[:1] = True
    bounds = {}
    for k, c in enumerate(from_last(order), 1):
        new[1:] |= grams[c, 1:] != grams[c, :-1]
        bounds[k] = np.flatnonzero(new).astype(np.int32)
    for k in range(order, 1, -1):
        at = bounds[k]
        if k == order:
            n = counts
        else:
            # runs of the length above, within each run of this one
            lefts = grams[order - k - 1, longer] != 0
            own = np.searchsorted(at, longer, side="right") - 1
            kinds = np.bincount(own[lefts], minlength=len(at))
            ends = np.append(longer, grams.shape[1])[1:]
            first = np.bincount(own[~lefts], weights=(total[ends] - total[longer])[~lefts], minlength=len(at))
            n = np.where(kinds > 0, kinds, first.astype(np.int64))
        proper = grams[order - k, at] != 0
        out[k] = {"at": at[proper], "n": n[proper].astype(np.int32)}
        runs[k] = at, np.where(proper, np.cumsum(proper, dtype=np.int32) - 1, -1)
        longer = at
    for k in range(3, order + 1):
        at, number = runs[k - 1]
        out[k]["parent"] = number[np.searchsorted(at, out[k]["at"], side="right") - 1]
    return out


def seen(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in range(1, 5)]


def asked_words(words: np.ndarray, grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that a bucket asks for, by part, and their parts."""
    there = np.unique(grams[-2:])
    there = there[there != 0]
    part = homes(words[there], parts)
    order = np.argsort(part, kind="stable")
    return there[order], part[order]


def merge(rows: list[dict], order: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """All words of a bucket's rows (the empty one first) and the windows of each kind."""
    sets = [expand_words(r["words"]) for r in rows]
    coded = pa.concat_arrays([pa.array([NONE], pa.string()), *sets]).dictionary_encode()
    numbers, at = coded.indices.to_numpy(), 1
    grams, counts = defaultdict(list), defaultdict(list)
    for r, held in zip(rows, sets, strict=True):
        own = numbers[at : at + len(held)]
        at += len(held)
        grams[r["what"]].append(own[expand(r["grams"], "<i4")].reshape(order, -1))
        counts[r["what"]].append(expand(r["counts"], "<i8"))
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    bits = len(words).bit_length()
    found = {}
    for what in (GRAMS, ASKED):
        held = np.concatenate(grams.pop(what, [np.zeros((order, 0), np.int32)]), axis=1)
        found[what] = distinct(held, np.concatenate(counts.pop(what, [np.zeros(0, np.int64)])), from_last(order), bits) if held.size else (held, np.zeros(0, np.int64))
    return words, found


def by_bucket(batches: Iterator[pa.RecordBatch], key: str) -> Iterable[tuple[int, list[dict]]]:
    held = defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            held[r[key]].append(r)
    while held:
        yield held.popitem()


def one(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema=schema)


def contexts_of(held: dict[int, dict[str, np.ndarray]], grams: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The lengths from two on, the number of each n-gram's context, and a window that each context stands in."""
    context, order = None, len(grams)
    for k in sorted(held):
        at = held[k]["at"]
        own = grams[order - 2, at].astype(np.int64) if k == 2 else context[held[k]["parent"]].astype(np.int64) * size + grams[order - k, at]
        _, first, context = np.unique(own, return_index=True, return_inverse=True)
        context = context.astype(np.int32)
        yield k, context, at[first]


def merged_rows(batches: Iterator[pa.RecordBatch], order: int, labels: np.ndarray, only_asked: bool) -> Iterator[pa.RecordBatch]:
    window = pa.struct([("grams", pa.binary()), ("counts", pa.binary())])
    ask = pa.struct([("part", pa.int32()), ("words", pa.binary()), ("before", pa.binary())])
    context = pa.struct([("home", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("grams", pa.binary()), ("sums", pa.binary())])
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("windows", pa.list_(window)), ("seen", pa.list_(pa.int64())), ("asks", pa.list_(ask)), ("contexts", pa.list_(context))])
    for bucket, rows in by_bucket(batches, "bucket"):
        words, found = merge(rows, order)
        rows.clear()
        windows = [{"grams": shrink(g.ravel()), "counts": shrink(c)} for g, c in found.values()]
        grams, counts = found.pop(GRAMS)
        wanted = found.pop(ASKED)[0] if only_asked else None
        found.clear()
        there, part = asked_words(words, grams, len(labels))
        real = grams[-1] != 0
        grams, counts = grams[:, real], counts[real]
        held = levels(grams, counts)
        before = np.bincount(grams[-1, held[2]["at"]], minlength=len(words))
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        asks = [{"part": int(part[a]), "words": shrink_words(words[there[a:b]]), "before": shrink(before[there[a:b]])} for a, b in zip(edges[:-1], edges[1:], strict=True)]
        numbers = [x for k in range(2, order + 1) for x in seen(held[k]["n"])]
        yield one(schema, bucket=bucket, words=shrink_words(words), windows=windows, seen=numbers, asks=asks, contexts=list(sent_contexts(words, grams, held, labels, wanted)))


def among(some: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """Which columns of ``some`` are columns of ``others``."""
    order, new = in_order(list(np.concatenate([some, others], axis=1)), bits)
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new)
    return np.isin(run[: some.shape[1]], run[some.shape[1] :])


def sent_contexts(words: np.ndarray, grams: np.ndarray, held: dict[int, dict[str, np.ndarray]], labels: np.ndarray, wanted: np.ndarray | None) -> Iterator[dict]:
    """Contexts of two words and more, to where they have their rows as n-grams: the total, and how many n-grams count one, two and more.

    Of contexts asked for (all are by windows but those that end texts) only, if ``wanted`` has the windows.
    """
    order = len(grams)
    sent, rank = defaultdict(list), np.empty(len(words), np.int32)
    rank[alphabetical(words)] = np.arange(len(words))
    for k, context, first in contexts_of(held, grams, len(words)):
        if k == 2:
            continue
        n = held[k]["n"]
        sums = np.stack([np.bincount(context, weights=w, minlength=len(first)).astype(np.int32) for w in (n, n == 1, n == 2, n > 2)])
        own = grams[order - k : order - 1, first]
        if wanted is not None:
            some = np.flatnonzero(among(own, wanted[order - k : -1], len(words).bit_length()) | (words[own[-1]] == END))
            own, sums = own[:, some], sums[:, some]
        known, at = np.unique(own[-2], return_inverse=True)
        home = homes(words[known], len(labels))[at]
        by_home = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[by_home], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = by_home[a:b]
            sent[int(home[some[0]])].append((k - 3, own[:, some], sums[:, some]))
    for home, parts in sent.items():
        sizes = [0] * (order - 2)
        for k, own, _ in parts:
            sizes[k] = own.shape[1]
        used, flat = renumbered(np.concatenate([own.ravel() for _, own, _ in parts]), rank)
        yield {"home": int(labels[home]), "sizes": sizes, "words": shrink_words(words[used]), "grams": shrink(flat), "sums": shrink(np.concatenate([sums.ravel() for *_, sums in parts]))}


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all buckets bring for a word is added up, and goes back in the order asked; the beginning is no word."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("before", pa.binary()), ("seen", pa.list_(pa.int64()))])
    for part, rows in by_bucket(batches, "part"):
        sets = [expand_words(r["words"]) for r in rows]
        coded = pa.concat_arrays([pa.array([START], pa.string()), *sets]).dictionary_encode()
        numbers = coded.indices.to_numpy()[1:]
        n = np.bincount(numbers, weights=np.concatenate([expand(r["before"], "<i8") for r in rows]), minlength=len(coded.dictionary)).astype(np.int64)
        n[0] = 0
        yield one(schema, bucket=None, part=part, before=None, seen=[*seen(n), int(n.sum()), int((n > 0).sum())])
        at = 0
        for r, held in zip(rows, sets, strict=True):
            yield one(schema, bucket=r["bucket"], part=part, before=shrink(n[numbers[at : at + len(held)]]), seen=None)
            at += len(held)


def discounts_of(n: list[int], fallback: float = 0.75) -> list[float]:
    """The three discounts, from the numbers of n-grams seen once to four times (as ``ngram.discounts``)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
    d = [k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else None for k in (1, 2, 3)]
    return [x if x is not None and 0 <= x <= k else fallback * min(k, 1.5) for k, x in enumerate(d, 1)]


def model_rows(r: dict, order: int, parts: int, prune: int, cuts: dict[int, list[float]], total: int, kinds: int, only_asked: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket; ``cuts[0]``: how many words count one, two and more."""
    spelled = expand_words(r["words"])
    (grams, counts), (wanted, _) = ((expand(w["grams"], "<i4").reshape(order, -1), expand(w["counts"], "<i8")) for w in r["windows"])
    size = len(spelled)
    there, _ = asked_words(spelled.to_numpy(zero_copy_only=False), grams, parts)
    before = np.zeros(size, np.int64)
    before[there] = np.concatenate([expand(a["before"], "<i8") for a in sorted(r["answers"], key=lambda a: a["part"])])
    named = np.unique(grams[-2])  # each word is the last but one of windows in one bucket, and has its row there
    real = grams[-1] != 0
    grams, counts = grams[:, real], counts[real]
    held = levels(grams, counts)
    cut = np.array([0.0, *cuts[1]])
    rest = kinds and sum(n * d for n, d in zip(cuts[0], cuts[1], strict=True)) / total / kinds
    p = np.where(before > 0, (before - cut[np.minimum(before, 3)]) / max(total, 1) + rest, 0.0)
    kept = before > prune
    for k, context, first in contexts_of(held, grams, size):
        level = held[k]
        n, parent = level["n"], grams[-1, level["at"]] if k == 2 else level["parent"]
        cut = np.array([0.0, *cuts[k]])[np.minimum(n, 3)]
        whole, given = (np.bincount(context, weights=w, minlength=len(first)) for w in (n, cut))
        if k == 2:
            backoff = np.full(size, np.nan)
            backoff[grams[-2, first]] = given / whole
            here = named[kept[named] | (named == spelled.index(START).as_py())]
            if only_asked:
                here = here[np.isin(here, wanted[-2])]
            yield from spelled_rows(1, spelled, here[None], p[here], backoff[here])
        p, kept = (n - cut) / whole[context] + given[context] / whole[context] * p[parent], (n > prune) & kept[parent]
        level["p"], level["kept"] = p, kept
        level["key"] = (grams[-2, level["at"]].astype(np.int64) if k == 2 else parent.astype(np.int64)) * size + grams[order - k if k > 2 else -1, level["at"]]  # ascends

    def numbers(some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The lengths from two on, and the numbers of the ends of so many words of n-grams (columns of ``some``); -1: there is none."""
        at = np.zeros(some.shape[1], np.int64)
        for k in range(2, len(some) + 1):
            keys, key = held[k]["key"], (some[-2].astype(np.int64) * size + some[-1]) if k == 2 else at * size + some[-k]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at = np.where((at >= 0) & (keys[spot] == key), spot, -1) if len(keys) else np.full(len(key), -1)
            yield k, at

    for k, level in held.items():
        level["backoff"] = np.full(len(level["p"]), np.nan)
    if only_asked:
        for k, at in numbers(wanted):
            asked = np.zeros(len(held[k]["kept"]), bool)
            asked[at[at >= 0]] = True
            held[k]["kept"] &= asked
    for c in r["contexts"] or ():
        names = pc.index_in(expand_words(c["words"]), spelled).to_numpy()
        flat, sums = names[expand(c["grams"], "<i4")], expand(c["sums"], "<i4")
        for k, m in enumerate(c["sizes"], 2):
            *_, (_, at) = numbers(flat[: k * m].reshape(k, m))
            own = sums[: 4 * m].reshape(4, m)
            held[k]["backoff"][at] = np.array(cuts[k + 1]) @ own[1:] / own[0]
            flat, sums = flat[k * m :], sums[4 * m :]
    for k, level in held.items():
        out = np.flatnonzero(level["kept"])
        yield from spelled_rows(k, spelled, grams[order - k :, level["at"][out]], level["p"][out], level["backoff"][out])


def spelled_rows(length: int, words: pa.Array, places: np.ndarray, p: np.ndarray, backoff: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(p), ROWS):
        taken = [words.take(pa.array(row[a : a + ROWS])) for row in places]
        n = len(taken[-1])
        joined = pc.binary_join_element_wise(*taken[:-1], " ") if length > 1 else pa.repeat(pa.scalar("", pa.string()), n)
        weight = pa.array(backoff[a : a + ROWS], pa.float64(), from_pandas=True)  # not a number is null
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(length, pa.int32()), n), joined, taken[-1], pa.array(p[a : a + ROWS]), weight], names=["length", "context", "token", "p", "backoff"])


def labels_of(texts: DataFrame, text: str) -> np.ndarray:
    """Numbers of buckets that Spark deals to as many partitions, one to each; as many as the session shuffles to at least."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    found = spark.range(0, 40 * n, 1, 1).select(F.col("id").cast("int").alias("label"))
    dealt = found.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("at")).agg(F.min("label").alias("label")).collect()
    return np.array([r.label for r in sorted(dealt, key=lambda r: r.at)])


def counted(texts: DataFrame, order: int, buckets: Sequence[int], text: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """A row a bucket: its words, windows and their counts (see the module); of the texts of ``asked`` only which there are."""
    spark, labels, only_asked = texts.sparkSession, np.asarray(buckets), asked is not None
    none = spark.range(1).select(F.lit(None).cast("array<string>").alias("words"))  # names the marks where there are no texts

    def cut(what: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(batch.column(0))
                size += len(held[-1].flatten())
                if size >= BLOCK_TOKENS:
                    yield from pieces(pa.concat_arrays(held), order, what, labels)
                    held, size = [], 0
            if held:
                yield from pieces(pa.concat_arrays(held), order, what, labels)

        return run

    sent = texts.select(tokens(text).alias("words")).unionAll(none).mapInArrow(cut(GRAMS), PIECE)
    if asked is not None:
        sent = sent.unionAll(asked.select(tokens(F.coalesce("text", F.lit(""))).alias("words")).mapInArrow(cut(ASKED), PIECE))
    dealt = sent.repartition(len(labels), "bucket").mapInArrow(lambda batches: merged_rows(batches, order, labels, only_asked), MERGED)
    return bucketed(dealt, "packed-grams", "bucket", len(labels), dealt=True)


def model(grams: DataFrame, order: int, buckets: int, prune: int = 0, only_asked: bool = False) -> DataFrame:
    """The rows of ``ngram.modified_kneser_ney`` from ``counted``'s table of ``buckets`` rows; those asked for if ``only_asked``."""
    asks = grams.select("bucket", F.explode("asks").alias("a")).select("bucket", "a.*")
    told = written(asks.repartition(buckets, "part").mapInArrow(answers, ANSWER), "packed-words")
    sums = lambda df, many: [int(x or 0) for x in df.agg(*(F.sum(F.get("seen", F.lit(k))).alias(f"s{k}") for k in range(many))).first()]
    ones, rest = sums(told.where("bucket IS NULL"), 6), sums(grams, 4 * (order - 1))
    cuts = {1: discounts_of(ones[:4])} | {k: discounts_of(rest[4 * (k - 2) : 4 * (k - 1)]) for k in range(2, order + 1)}
    cuts[0] = [ones[0], ones[1], ones[5] - ones[0] - ones[1]]
    each = lambda df, name: df.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "bucket"])).alias(name))
    back = each(told.where("bucket IS NOT NULL").select("bucket", "part", "before"), "answers")
    sent = each(grams.select(F.explode("contexts").alias("c")).select(F.col("c.home").alias("bucket"), "c.sizes", "c.words", "c.grams", "c.sums"), "contexts")
    rows = grams.select("bucket", "words", "windows").hint("merge").join(back.hint("merge"), "bucket").join(sent.hint("merge"), "bucket", "left").drop("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from model_rows(r, order, buckets, prune, cuts, ones[4], ones[5], only_asked)

    return rows.mapInArrow(run, MODEL)

"""Language-model scores: a weighted backoff automaton over smoothed n-grams counted on all training rows.

A state is a history: none (the root), a word or the start of a text, two words, up to ``order`` - 1. An arc
reads a word seen after the history in training and leads to the state of the longest history that ends with
it; a word not seen there takes the failure arc to the history without its first word. An arc weighs log10 of
p(w|h) = (c(h,w) + mu * p(w|h')) / (c(h) + mu), a failure arc log10 of mu / (c(h) + mu), the root's arcs
log10 of p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). So the weights of each state sum to one.

Texts are handled in blocks of bounded size. A block asks for the counts of the n-grams that its texts
hold, one sorted list a bucket of n-gram hashes; a bucket adds up what all blocks bring and answers each
block with the totals in the order asked. So n-grams are counted before they are shuffled, each crosses
once and only its count comes back, and each block is read by the part of the automaton that its texts can
enter. Nothing of the model goes through the driver but the two sums N and V. A block sends no row to a
bucket that it asks nothing of: there are never more rows than n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import as_bytes, few

#: Stand-ins, no words since words hold no white space, for the end and the start of a text.
END, START = b"\n", b" "
#: Bytes of text in a block, tokens to a bucket, words of an n-gram, and the weight of the lower order for each order from two on.
BLOCK_BYTES, BUCKET_TOKENS, ORDER = 6 << 20, 2_000_000, 3
MU = (300.0, 20.0)
#: Bits by which the keys of longer n-grams exceed the number of tokens: about one of 2^18 shares its key with another.
SPARE_BITS = 18


def shrink(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def expand(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def shrink_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, their bytes by place: the upper places are mostly zero."""
    return shrink(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy())


def expand_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(expand(x, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of tokenized rows: ``block``, ``ids``, ``held``, ``sizes`` (tokens a row), ``words`` (of the block), ``tokens`` (numbers of words, row after row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for here in joined(batches, BLOCK_BYTES):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            number[END], number[START]
            tokens, sizes = [], []
            for text in as_bytes(here.column(1)):
                row = [number[w] for w in text.lower().split()] if text else []
                row.append(0)
                tokens.append(np.array(row, dtype=np.int32))
                sizes.append(len(row))
            flat = np.concatenate(tokens)
            words = zstandard.ZstdCompressor(level=1).compress(b"\n".join(w for w in number if w not in (END, START)))
            one = lambda values, kind: pa.array([values], type=pa.list_(kind))
            ids = pa.ListArray.from_arrays(pa.array([0, here.num_rows], type=pa.int32()), here.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([block]), ids, one(here.column(2).to_pylist(), pa.bool_()), one(sizes, pa.int32()), pa.array([len(number)], type=pa.int32()), pa.array([words], type=pa.binary()), pa.array([shrink(flat)], type=pa.binary())], names=["block", "ids", "held", "sizes", "n_words", "words", "tokens"])
            block += 1

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(id_col, text_col, held.alias("held")).mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, sizes array<int>, n_words int, words binary, tokens binary")


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows together until their texts (the second column) hold about ``most`` bytes; a longer text ends its block."""
    held: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        start = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            size += n
            if size >= most:
                held.append(batch.slice(start, k + 1 - start))
                yield whole()
                held, size, start = [], 0, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield whole()


class Block:
    """The n-grams of one block's texts, by length: distinct ones as (number of the history, number of the word)."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, n_words: int, words: bytes, tokens: bytes, order: int, bits: int):
        import xxhash

        self.sizes = sizes = np.asarray(sizes, dtype=np.int64)
        self.tokens = expand(tokens, "<i4").astype(np.int64)
        self.n_words = n_words
        text = zstandard.ZstdDecompressor().decompress(words)
        spelled = text.split(b"\n") if n_words > 2 else []  # no word holds a line end
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [END, START, *spelled]), dtype=np.uint64, count=n_words)
        self.starts = np.cumsum(sizes) - sizes
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, sizes)
        trained = np.repeat(~np.asarray(held, dtype=bool), sizes)
        self.grams: list[np.ndarray] = [np.arange(n_words)]  # history * n_words + word, ascending
        self.keys = [hashes]
        self.counts = [np.bincount(self.tokens[trained], minlength=n_words)]
        # of each token: the number of the gram that ends with it, one word shorter than those to come; the start stands before a text
        ends, full = self.tokens, hashes
        for k in range(2, order + 1):
            before = np.empty_like(ends)
            before[1:] = ends[:-1]
            before[place == 0] = 1  # for k = 2 the start; longer histories begin one word later
            there = place >= k - 2
            packed = before[there] * n_words + self.tokens[there]
            grams, inverse = np.unique(packed, return_inverse=True)
            ends = np.zeros_like(self.tokens)
            ends[there] = inverse
            # of a history and a word in order; the constants are the fixed ones of a common 64-bit mixer
            mixed = full[grams // n_words] * np.uint64(0x9E3779B97F4A7C15) + hashes[grams % n_words] + np.uint64(k)
            mixed ^= mixed >> np.uint64(31)
            full = mixed * np.uint64(0xBF58476D1CE4E5B9)
            full ^= full >> np.uint64(32)
            self.grams.append(grams)
            self.keys.append(full >> np.uint64(64 - bits) << np.uint64(64 - bits))
            self.counts.append(np.bincount(inverse[trained[there]], minlength=len(grams)))

    def asked(self, k: int, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Bucket, and the n-grams of ``k`` + 1 words (their numbers) that fall into it, in order of their keys; buckets without any are left out."""
        order = np.argsort(self.keys[k], kind="stable")
        bucket = (self.keys[k][order] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        kinds, first = np.unique(bucket, return_index=True)
        yield from zip(kinds.tolist(), np.split(order, first[1:]), strict=True)


class Automaton:
    """States, arcs and failure arcs that the texts of one block can use.

    State 0 is the root, then come the words, then the longer histories. ``arcs`` holds state * words + word,
    ascending; ``weight`` and ``target`` go with it. Histories and n-grams never seen in training have none.
    """

    def __init__(self, n_words: int, grams: list[np.ndarray], counts: list[np.ndarray], total: float, kinds: float, mu: tuple[float, ...]):
        n, order = n_words, len(grams)
        self.n_words = n
        below = (counts[0] + 0.1) / (total + 0.1 * (kinds + 1))  # p of every gram, seen or not
        self.root = np.log10(below)
        first = np.cumsum([1, *map(len, grams)])  # the state of the first gram of each length
        times = counts[0].copy()
        times[1] = counts[0][0]  # a text starts as often as it ends
        arcs, weight, target = [np.arange(n)], [self.root], [np.where(times > 0, 1 + np.arange(n), 0)]
        fail, given_up, states = [np.zeros(1, dtype=np.int64)], [np.zeros(1)], np.zeros(n, dtype=np.int64)
        for k in range(1, order):
            history, word = grams[k] // n, grams[k] % n
            fail.append(states)  # of the histories of k words
            given_up.append(np.log10(mu[k - 1] / (times + mu[k - 1])))
            # the same n-gram without its first word: its history's failure state, read by the same word
            shorter = word if k == 1 else np.searchsorted(grams[k - 1], (states[history] - first[k - 2]) * n + word)
            below = (counts[k] + mu[k - 1] * below[shorter]) / (times[history] + mu[k - 1])
            seen = counts[k] > 0
            arcs.append((first[k - 1] + history[seen]) * n + word[seen])
            weight.append(np.log10(below[seen]))
            # after the word: the gram itself as a history, or its own shorter end if no longer history is kept
            here = first[k] + np.arange(len(grams[k])) if k < order - 1 else first[k - 1] + shorter
            target.append(here[seen])
            states = first[k - 1] + shorter
            times = counts[k]
        self.arcs, self.weight, self.target = map(np.concatenate, (arcs, weight, target))
        self.fail, self.given_up = np.concatenate(fail), np.concatenate(given_up)

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-probability of each text: all texts are read together, one word a step from left to right, each in its own state."""
        order = np.argsort(-sizes, kind="stable")
        starts, longest = starts[order], sizes[order]
        state, score = np.full(len(sizes), 1 + 1, dtype=np.int64), np.zeros(len(sizes))  # at the start
        active = len(sizes)
        for step in range(int(longest[0]) if len(longest) else 0):
            while longest[active - 1] <= step:
                active -= 1
            word, todo = tokens[starts[:active] + step], np.arange(active)
            while len(todo):
                want = state[todo] * self.n_words + word[todo]
                at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
                found = self.arcs[at] == want
                hit, at = todo[found], at[found]
                score[hit] += self.weight[at]
                state[hit] = self.target[at]
                todo = todo[~found]
                score[todo] += self.given_up[state[todo]]
                state[todo] = self.fail[state[todo]]
        out = np.empty_like(score)
        out[order] = score
        return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def ask(order: int, bits: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 1):
            for row in batch.select(["block", "sizes", "held", "n_words", "words", "tokens"]).to_pylist():
                number, block, rows = row.pop("block"), Block(**row, order=order, bits=bits), []
                for k in range(order):
                    counts = block.counts[k].astype("<u4")
                    rows += [(order * b + k, number, shrink_sorted(block.keys[k][at]), shrink(counts[at])) for b, at in block.asked(k, n_buckets)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "counts"])

    return run


def answer(order: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Totals of one bucket, sent back to each block; for words also a row of their kinds and tokens."""
        keys = [expand_sorted(k) for k in frame["keys"]]
        counts = np.concatenate([expand(c, "<u4") for c in frame["counts"]]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        replies = [shrink(total[place[e - len(k) : e]].astype("<i8")) for e, k in zip(ends, keys, strict=True)]
        out = pd.DataFrame({"bucket": key[0], "block": frame["block"].to_numpy(), "totals": replies, "kinds": 0, "sum": 0})
        if key[0] % order == 0:
            out = pd.concat([out, pd.DataFrame({"bucket": [key[0]], "block": [-1], "totals": [b""], "kinds": [int((total > 0).sum())], "sum": [int(total.sum())]})])
        return out

    return run


def key_bits(n_tokens: int) -> int:
    return min(64, max(1, n_tokens).bit_length() + SPARE_BITS)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: tuple[float, ...] = MU) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    The model learns from all rows whose crc32 of the id as text leaves a remainder mod 10 other than 0.
    Tokens are words between ASCII white space, A-Z lower-cased, then one end. A null text is empty (the
    end alone); a null id counts as empty text, which is held out; repeated rows count and stay; an empty
    table gives an empty result; other columns are ignored. Words are told apart by 64-bit hashes, longer
    n-grams by as many bits as make about one in 2^``SPARE_BITS`` share its key. ``order`` words at most make
    an n-gram; ``mu`` has a value for each length from two on.
    """
    if not 2 <= order <= len(mu) + 1:
        raise ValueError("n-grams have two words or more, and mu a value for each length from two on")
    blocks = written(in_blocks(docs, id_col, text_col), "lm-blocks")
    n_tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets, bits = max(4, -(-n_tokens // BUCKET_TOKENS)), key_bits(n_tokens)
    asked = blocks.mapInArrow(ask(order, bits, n_buckets), "bucket long, block long, keys binary, counts binary")
    replies = written(asked.repartition(order * n_buckets, "bucket").groupBy("bucket").applyInPandas(answer(order), "bucket long, block long, totals binary, kinds long, sum long"), "lm-counts")
    kinds, total = replies.where("block = -1").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))).first()
    kind = docs.schema[id_col].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block = Block(row.sizes, row.held, row.n_words, row.words, row.tokens, order, bits)
            told, counts = dict(zip(right["bucket"], right["totals"], strict=True)), []
            for k in range(order):
                counts.append(np.zeros(len(block.keys[k]), dtype=np.int64))
                for bucket, at in block.asked(k, n_buckets):
                    counts[k][at] = expand(told.pop(order * bucket + k), "<i8")
            auto = Automaton(block.n_words, block.grams, counts, total, kinds, mu)
            known = sums((counts[0][block.tokens] > 0).astype(np.int64), block.sizes)
            out.append(pd.DataFrame({id_col: pd.Series(list(row.ids), dtype=object), "held_out": np.asarray(row.held, dtype=bool), "n_tokens": block.sizes, "n_known": known, "train_tokens": total, "base_score": sums(auto.root[block.tokens], block.sizes), "score": auto.traverse(block.tokens, block.starts, block.sizes)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    said = replies.where("block >= 0").select("block", "bucket", "totals")
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(score, schema)

"""Best-two-fit packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import few

#: Documents aimed at in a group that is packed together: so many that what its last sequences waste is far below a thousandth.
GROUP = 50_000


@lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str | None):
    """Ids of a text as the tokenizer file gives them without added special tokens.

    With ``rank_path`` (the same vocabulary as ranks) a faster encoder does the work; it gives the same
    ids, the end-of-text string in a text being that one id in both. Where it gives up, the file's own
    tokenizer takes over.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    if rank_path is None:
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {token.content: number for number, token in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except (ValueError, RuntimeError, OverflowError):
            return plain(text)

    return encode


def pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``length``: ``id_col``, ``piece``, ``start``, ``length``, ``ids``, ``deal``.

    ``deal`` is a number of the piece's own, from its task and its place there, the same when a task over a
    file is run again. Only documents longer than ``length`` are cut; then the first piece is what full ones leave over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, deal = encoder(json_path, rank_path), TaskContext.get().partitionId() << 40
        for batch in few(batches):
            row, piece, start, ids = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                all_ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                first = (len(all_ids) - 1) % length + 1
                cuts = [0, *range(first, len(all_ids) + 1, length)]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(k)
                    piece.append(j)
                    start.append(a)
                    ids.append(all_ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(ids, type=pa.binary()), pa.array(np.arange(deal, deal + len(ids)))], names=[id_col, "piece", "start", "length", "ids", "deal"])
            deal += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary, deal long")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``lengths`` (1 to ``size``).

    The longest piece left opens a bin; the longest that fits is added until none does. If a gap is left,
    the bin's smallest added piece is given back for the two pieces left that fill its place and the gap
    most tightly, where they fill more than it did.
    """
    stock: list[list[int]] = [[] for _ in range(size + 1)]
    for k in np.argsort(lengths, kind="stable")[::-1].tolist():
        stock[lengths[k]].append(k)
    there = 0  # bit n: a piece of length n is left
    for n in range(1, size + 1):
        there |= bool(stock[n]) << n
    below = [(1 << (n + 1)) - 1 for n in range(size + 1)]
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)

    def take(n: int) -> int:
        nonlocal there
        k = stock[n].pop()
        if not stock[n]:
            there &= ~(1 << n)
        return k

    number = 0
    while there:
        n = there.bit_length() - 1
        held, gap = [(n, take(n))], size - n
        while gap and (n := (there & below[gap]).bit_length() - 1) > 0:
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            small, k = held[-1]  # lengths never grow while a bin is filled
            room, best, pair = small + gap, small, None
            left = there & below[room - 1]
            while left and best < room:
                a = left.bit_length() - 1
                if 2 * a <= best:
                    break  # no pair of pieces up to a holds more
                left ^= 1 << a
                b = (there & below[min(a, room - a)]).bit_length() - 1
                if b == a and len(stock[a]) < 2:
                    b = (there & below[min(a - 1, room - a)]).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                held.pop()
                held += [(n, take(n)) for n in pair]
                stock[small].append(k)
                there |= 1 << small
        at = 0
        for n, k in held:
            bins[k], offsets[k] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(cut: DataFrame, n_groups: int, length: int = 2048) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``. ``cut``: ``length``, ``deal`` and any other columns.

    Pieces are dealt into ``n_groups`` groups by a hash of ``deal``, so that copies, and repeated rows too, are
    spread; groups are packed one by one. A sequence's number is its group's number times 2^32 and its own.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(frame["length"].to_numpy(np.int64), length)
        return frame.drop(columns="group").assign(sequence_id=(frame["group"].to_numpy(np.int64) << 32) + bins, offset=offsets)

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("deal"), F.lit(n_groups)).cast("int")).drop("deal")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "deal")
    return dealt.groupBy("group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, json_path: str, rank_path: str | None = None, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids`` if kept).

    Null text is empty: one piece of ``end_id`` alone. Null ids, repeated rows and ties are packed like
    any other; an empty table gives an empty result; other columns are ignored.
    """
    cut = pieces(docs, json_path, rank_path, length, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    n_groups = max(1, round(docs.count() / GROUP))
    return pack(cut if keep_ids else cut.drop("ids"), n_groups, length)

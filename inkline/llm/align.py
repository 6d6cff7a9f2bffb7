"""Cross-tokenizer alignment: where the tokens of two tokenizers over the same bytes end together, and which of them overlap.

A transducer reads the tokens of both sides. Its state is the side that leads and the bytes of that side's last
token that the other has not matched yet (the dangling suffix); the side behind reads its next token. Transitions
are remembered by state and token. An empty suffix closes a group; each step that reads against a suffix is one
overlap of two tokens.

Both tokenizers treat each part of a text (see ``bpe.parts``) by itself, so that a part is aligned once and
remembered. Texts are handled in blocks of bounded size: a block adds up in how many of its documents each
pair of ids is linked; those sums are grouped, and only the totals of the pairs that a block holds come back
to it. Every pair crosses once a block, whatever the number of documents or occurrences.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMORABLE, parts
from .common import written
from .words import few

#: Bytes of text in a block at most (a longer text is a block of its own), parts (some 400 bytes each) and transitions remembered at most.
BLOCK_BYTES, REMEMBERED, STEPS = 24 << 20, 600_000, 300_000
NONE = np.zeros(0, dtype=np.int64)


class Transducer:
    """Reads two sides of tokens. ``names`` are the decimals of ids, a list a side."""

    def __init__(self, names: tuple[list[str], list[str]]) -> None:
        self.names = names
        self.steps: dict[tuple[bool, bytes, bytes], tuple[bool, bytes]] = {}

    def step(self, leads: bool, rest: bytes, token: bytes) -> tuple[bool, bytes] | None:
        """The state after the side behind reads ``token`` against the suffix ``rest`` of side ``leads``; None where the bytes differ."""
        if rest.startswith(token):
            found = leads, rest[len(token) :]
        elif token.startswith(rest):
            found = not leads, token[len(rest) :]
        else:
            return None
        if len(self.steps) >= STEPS:
            self.steps.clear()
        self.steps[leads, rest, token] = found
        return found

    def align(self, ids: tuple[list[int], list[int]], tokens: tuple[list[bytes], list[bytes]]) -> tuple[str, list[int]] | None:
        """The groups as text, and the links as ``a << 32 | b``; None where the joined bytes of the sides differ. Tokens hold a byte at least."""
        steps, names, ends = self.steps, self.names, (len(ids[0]), len(ids[1]))
        at, groups, links = [0, 0], [], []
        while at[0] < ends[0] and at[1] < ends[1]:
            leads, last, rest = False, ids[0][at[0]], tokens[0][at[0]]
            at[0] += 1
            read: tuple[list[str], list[str]] = ([names[0][last]], [])
            while rest:
                behind = not leads
                k = at[behind]
                if k == ends[behind]:
                    return None
                at[behind] = k + 1
                number, token = ids[behind][k], tokens[behind][k]
                read[behind].append(names[behind][number])
                links.append(number << 32 | last if leads else last << 32 | number)
                found = steps.get((leads, rest, token)) or self.step(leads, rest, token)
                if found is None:
                    return None
                if found[0] is not leads:
                    last = number
                leads, rest = found
            groups.append(f"{','.join(read[0])}|{','.join(read[1])}")
        return None if (at[0], at[1]) != ends else (";".join(groups), links)


class Pair:
    """Both tokenizers, and what is known of parts: the groups as text, the links as 64-bit ``a << 32 | b``, and the number of A's tokens."""

    def __init__(self, json_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
        byte = {chr(b): b for b in letters} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in letters)}
        self.a_bytes = {k: bytes(byte[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        # a piece with a blank behind anything else, or with a new line, could reach over the end of a part
        self.apart = not any("\n" in p or any(x != "▁" and y == "▁" for x, y in zip(p, p[1:], strict=False)) for p in pieces) and self.b.encode(" ") == [self.b.piece_to_id("▁▁")] and self.b.encode("\n")[:1] == [self.blank]
        self.transducer = Transducer(([*map(str, range(self.a.get_vocab_size()))], [*map(str, range(len(pieces)))]))
        self.known: dict[str, tuple[bytes, bytes, int] | None] = {}

    def look_up(self, some: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes, int] | None]]:
        """Of each part, which begins with a blank or a new line; None where the tokens' bytes are not the text's."""
        # side B adds a blank: it takes the place of the part's own, and goes where there is a new line, which it never joins
        own = [p.removeprefix(" ") for p in some]
        a_bytes, b_bytes, blank, align = self.a_bytes, self.b_bytes, [self.blank], self.transducer.align
        for part, a, b in zip(some, self.a.encode_batch_fast(some, add_special_tokens=False), self.b.encode(own, num_threads=1) if own else [], strict=True):
            b = b[1:] if part[0] == "\n" else b or blank  # an empty text gets no blank
            a = a.ids
            left, right = [a_bytes.get(k, b"") for k in a], [b_bytes[k] for k in b]
            raw = part.encode()
            aligned = align((a, b), (left, right)) if b"".join(left) == raw and b"".join(right) == raw else None
            yield part, None if aligned is None else (aligned[0].encode(), pack(f"<{len(aligned[1])}q", *aligned[1]), len(a))

    def read(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes, int]] | None]:
        """Of each text what is known of its parts; None for no tokens."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        cut = [(parts(f" {t}") if self.apart else [f" {t}"]) if t else [] for t in texts]
        keys = list(set().union(*cut).difference(known))
        known.update(self.look_up(keys))
        out: list[list[tuple[bytes, bytes, int]] | None] = []
        for c in cut:
            here = [*map(known.__getitem__, c)]
            out.append(here if here and None not in here else None)
        for key in keys:
            if len(key) > MEMORABLE:
                del known[key]
        return out


@lru_cache(maxsize=2)
def pair(json_path: str, piece_path: str) -> Pair:
    """Read once a process, by tasks on the machine that they run on."""
    return Pair(json_path, piece_path)


class Block:
    """What a block's documents share: its parts with links, each numbered, and in how many documents a pair of ids is linked."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.parts: defaultdict[bytes, int] = defaultdict()  # by the part's groups, which tell its links
        self.parts.default_factory = self.parts.__len__
        self.links: list[bytes] = []
        self.pairs: list[np.ndarray] = []

    def add(self, found: list[tuple[bytes, bytes, int]]) -> tuple[bytes, bytes]:
        """The numbers of a document's parts, ascending, as differences, and how often each occurs."""
        times = Counter(map(self.parts.__getitem__, [x[0] for x in found]))
        if len(self.parts) > len(self.links):
            links = dict((x[0], x[1]) for x in found)
            fresh = [g for g in links if self.parts[g] >= len(self.links)]
            self.links += [links[g] for g in sorted(fresh, key=self.parts.__getitem__)]
        part = np.array(sorted(times), dtype=np.int64)
        self.pairs.append(np.unique(np.frombuffer(b"".join([self.links[k] for k in part.tolist()]), dtype="<i8")))
        if len(self.pairs) >= 2000:
            self.pairs = [self.counted()]
        return np.diff(part, prepend=0).astype("<u4").tobytes(), np.array([times[k] for k in part.tolist()], dtype="<u4").tobytes()

    def counted(self) -> np.ndarray:
        """Pairs so far, each as often as there are documents with it."""
        return np.sort(np.concatenate(self.pairs)) if self.pairs else NONE

    def told(self) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
        """The pairs and their documents; of each part how many links and where their pairs are in that list."""
        pairs, documents = np.unique(self.counted(), return_counts=True)
        flat = np.frombuffer(b"".join(self.links), dtype="<i8")
        return pairs, documents, np.array([len(x) // 8 for x in self.links], dtype="<u4").tobytes(), np.searchsorted(pairs, flat).astype("<u4").tobytes()


ALIGNED = "block long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, part binary, times binary, pairs array<long>, documents array<long>, sizes binary, places binary"


def in_blocks(docs: DataFrame, json_path: str, piece_path: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """A row for each document (``pairs`` null), and one for each block (``n_a`` null) behind its documents."""
    kinds = [docs.schema[id_col].dataType.simpleString()]
    names = [id_col, *(x.split()[0] for x in ALIGNED.split(", "))]
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(json_path, piece_path)
        first = TaskContext.get().partitionId() << 32
        block = Block(first)

        def rows(ids: pa.Array, values: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*values, strict=True)) if values else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, t in zip(columns, arrow, strict=True))], names=names)

        def end() -> pa.RecordBatch:
            pairs, documents, sizes, places = block.told()
            return rows(pa.nulls(1, kind), [(block.number, None, None, None, None, None, None, None, pairs, documents, sizes, places)])

        kind = pa.null()
        for batch in few(batches):
            kind = batch.schema.field(0).type
            texts, start, values = batch.column(1).to_pylist(), 0, []
            for k, (text, found) in enumerate(zip(texts, both.read(texts), strict=True)):
                size = len(text or "")
                if block.size and block.size + size > BLOCK_BYTES:
                    yield rows(batch.column(0).slice(start, k - start), values)
                    yield end()
                    block, start, values = Block(block.number + 1), k, []
                block.size += size
                if found is None:
                    values.append((block.number, 0, 0, 0, "", "" if keep_groups else None, b"", b"", None, None, None, None))
                    continue
                groups = b";".join([x[0] for x in found])
                n_a, n_groups = sum([x[2] for x in found]), groups.count(b"|")
                # a group of x and y tokens has x - 1 and y - 1 commas
                values.append((block.number, n_a, groups.count(b",") + 2 * n_groups - n_a, n_groups, hashlib.sha256(groups).hexdigest(), groups.decode() if keep_groups else None, *block.add(found), None, None, None, None))
            yield rows(batch.column(0).slice(start), values)
        if block.links:
            yield end()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, {ALIGNED}")


def align(docs: DataFrame, json_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``n_links``, ``n_best``, ``count_sum`` of every row (and ``groups`` if kept).

    Side A encodes a blank and the text by the byte-level tokenizer at ``json_path``, side B the text by the
    pieces at ``piece_path``, which add the blank. Texts that are null, empty, or not what B's (or A's) bytes
    join to have no tokens: zeros and ''. A pair's count is the number of rows of ``docs`` that hold it linked, repeated
    rows each for itself; ``n_best`` counts the links whose count is the highest of their A id, ties
    included. Ids may be null or repeat; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(in_blocks(docs, json_path, piece_path, id_col, text_col, keep_groups), "aligned-blocks")
    held = rows.where("n_a IS NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("of", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a = F.shiftright("pair", 32)
    # a row for each of A's ids, whose number the tokenizer bounds
    best = F.broadcast(counts.groupBy(a.alias("a")).agg(F.max("count").alias("best")))
    judged = counts.join(best, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    told = held.drop("n").join(judged, "pair").select("of", "place", "count", "best")
    more = ["groups"] if keep_groups else []
    names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", *more]

    def judge(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        mine, shared = docs[docs["n_a"].notna()], docs[docs["n_a"].isna()]
        values = np.zeros((3, len(mine)), dtype=np.int64)
        if len(shared):
            order = np.argsort(totals["place"].to_numpy())
            count, best = totals["count"].to_numpy()[order], totals["best"].to_numpy().astype(np.int64)[order]
            sizes, places = (np.frombuffer(shared[c].iloc[0], dtype="<u4") for c in ("sizes", "places"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            per_part = np.zeros((3, len(sizes)), dtype=np.int64)
            for k, x in enumerate((np.ones(len(places), dtype=np.int64), best[places], count[places])):
                np.add.at(per_part[k], owner, x)
            for k, (part, times) in enumerate(zip(mine["part"], mine["times"], strict=True)):
                if part:
                    values[:, k] = per_part[:, np.cumsum(np.frombuffer(part, dtype="<u4"), dtype=np.int64)] @ np.frombuffer(times, dtype="<u4").astype(np.int64)
        out = mine[names].copy()
        out["n_links"], out["n_best"], out["count_sum"] = values
        return out.astype({c: np.int64 for c in ("n_a", "n_b", "n_groups")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema) + ", n_links long, n_best long, count_sum long"
    kept = rows.select(*names, "block", "part", "times", "sizes", "places")
    return kept.groupBy("block").cogroup(told.groupBy("of")).applyInPandas(judge, schema)

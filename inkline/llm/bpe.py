"""Byte-level BPE by merge ranks, as recursive DuckDB queries inside each task; decoding as an ordered aggregation.

A text is cut where the split pattern cuts it. A word that is a token is that token; any other starts as a
row for each byte. One recursive query contracts all words of a batch: in each round the rows of a word join
the merge table with their right neighbours, the leftmost pair of the least rank becomes one row, and a word
without such a pair leaves the recursion. Long words have a query of their own that contracts further places of
that rank in the same round, as long as nothing that a contraction leads to has to come before the next.
Words are worked out once and remembered, in a memory of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import few

#: Unicode white space; and a part of a text: white space and what follows up to a blank or a new line behind none.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INNER = WHITE.replace("\n", "", 1).replace(" ", "", 1)
PART = re.compile(f"[{WHITE}]*(?:[^{WHITE}]+(?:[{INNER}][{WHITE}]*)?)+|[{WHITE}]+")
#: Parts and words remembered at most (some 200 bytes each), letters of one that is remembered, bytes from which a word counts as long, and rows of all rounds of a query.
REMEMBERED, MEMORABLE, LONG, HELD_ROWS = 900_000, 64, 48, 8_000_000


def parts(text: str) -> list[str]:
    """``text`` cut before each blank or new line that stands behind no white space; the split pattern of byte-level tokenizers never matches across such a place."""
    return PART.findall(text)


def contraction(every_place: bool) -> str:
    """The recursive query over ``bytes`` (``word``, ``place``, ``id``), of ``most`` rounds: ``word``, ``id`` in order of places, and whether the word has pairs left (``again``).

    ``pairs`` are the rows with the merge of each and its right neighbour, ``best`` a word's least rank and its leftmost place.
    """
    if every_place:
        # of neighbouring places of that rank the first, third and so on (what is left of the last place of another rank counts them),
        # up to the first where the new row could merge with one beside it at a lower rank
        beside = "SELECT round, word, id, lag(id) OVER w AS before, lead(id, 2) OVER w AS beyond, lead(id) OVER w AS after, row_number() OVER w AS place FROM held WHERE again AND round < $most WINDOW w AS (PARTITION BY word ORDER BY place)"
        run = "place - coalesce(max(CASE WHEN made = best >> 32 THEN NULL ELSE place END) OVER (PARTITION BY word ORDER BY place), 0)"
        taken = f"""tried AS (SELECT *, coalesce(made = best >> 32 AND ({run}) % 2 = 1, false) AS tried FROM pairs JOIN best ON word = w),
sided AS (SELECT *, CASE WHEN lag(tried, 2, false) OVER (PARTITION BY word ORDER BY place) THEN made ELSE before END AS beside FROM tried),
risky AS (SELECT s.word AS r, min(s.place) AS last FROM sided s LEFT JOIN merges a ON a.first = s.beside AND a.second = s.made LEFT JOIN merges b ON b.first = s.made AND b.second = s.beyond WHERE s.tried AND (a.made < s.made OR b.made < s.made) GROUP BY s.word),
marked AS (SELECT *, tried AND place <= coalesce(last, place) AS taken FROM sided LEFT JOIN risky ON word = r),
kept AS (SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY place) AS eaten, place AS spot FROM marked)"""
    else:
        beside = "SELECT a.round, a.word, a.place, a.id, b.id AS after FROM rows a LEFT JOIN rows b ON b.word = a.word AND b.place = a.place + 1"
        taken = """marked AS (SELECT *, place - (best & 4294967295) AS off FROM pairs JOIN best ON word = w),
kept AS (SELECT *, coalesce(off = 0, false) AS taken, coalesce(off = 1, false) AS eaten, place - coalesce(off > 0, false)::INTEGER AS spot FROM marked)"""
    return f"""WITH RECURSIVE held(round, word, place, id, again) AS (
SELECT 0, word, place, id, true FROM bytes
UNION ALL
(WITH rows AS MATERIALIZED (SELECT * FROM held WHERE again AND round < $most),
pairs AS MATERIALIZED (SELECT h.*, m.made FROM ({beside}) h LEFT JOIN merges m ON h.id = m.first AND h.after = m.second),
best AS (SELECT word AS w, min(made::BIGINT << 32 | place) AS best FROM pairs GROUP BY word),
{taken}
SELECT round + 1, word, spot, CASE WHEN taken THEN made ELSE id END, best IS NOT NULL FROM kept WHERE NOT eaten))
SELECT word, id, again FROM held WHERE NOT again OR round = $most ORDER BY word, place"""


class Ranks:
    """A vocabulary of byte strings by rank, as tables of a DuckDB connection of this process."""

    def __init__(self, path: str):
        import duckdb
        import regex
        from public_tokenizers import PATTERN

        # \s of the regex module is not quite Unicode's white space
        self.split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        first, second, made = [], [], []
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    first.append(a)
                    second.append(b)
                    made.append(rank)
        first, second, made = (np.array(x, dtype=np.int32) for x in (first, second, made))
        self.one = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for name, table in (("merges", {"first": first, "second": second, "made": made}), ("vocabulary", {"id": np.array(list(self.rank.values()), dtype=np.int32), "hex": pa.array([t.hex() for t in self.rank])})):
            self.db.register("given", pa.table(table))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.decimal = {k: str(k) for k in self.rank.values()}
        self.known: dict[str, bytes] = {}  # 32-bit ids of parts and of words

    def contract(self, words: list[bytes], every_place: bool) -> Iterator[tuple[int, bytes]]:
        """Each word's number with its 32-bit ids; none is empty. What a query of bounded size leaves undone goes into the next."""
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        ids = self.one[np.frombuffer(b"".join(words), dtype=np.uint8)]
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            place = np.arange(1, len(ids) + 1) - np.repeat(first, np.diff(first, append=len(ids)))
            self.db.register("bytes", pa.table({"word": word, "place": place.astype(np.int32), "id": ids}))
            found = self.db.sql(contraction(every_place), params={"most": max(2, min(64, HELD_ROWS // len(ids)))}).to_arrow_table()
            self.db.unregister("bytes")
            word, ids, again = (found.column(c).to_numpy() for c in ("word", "id", "again"))
            done, raw = word[~again], ids[~again].astype("<u4").tobytes()
            first = np.flatnonzero(np.diff(done, prepend=-1))
            yield from ((k, raw[4 * a : 4 * b]) for k, a, b in zip(done[first].tolist(), first.tolist(), [*first[1:].tolist(), len(done)][: len(first)], strict=True))
            word, ids = word[again], ids[again]

    def look_up(self, words: set[str]) -> dict[str, bytes]:
        """The 32-bit ids of words."""
        out, rest = {}, ([], [])
        known, rank = self.known, self.rank
        for word in words:
            if word in known:
                out[word] = known[word]
            elif (raw := word.encode()) in rank:
                out[word] = rank[raw].to_bytes(4, "little")
            else:
                rest[len(raw) >= LONG].append((word, raw))
        for every_place, some in enumerate(rest):
            for k in range(0, len(some), 100_000):
                fresh = {some[k + n][0]: ids for n, ids in self.contract([raw for _, raw in some[k : k + 100_000]], bool(every_place))}
                out.update(fresh)
                if not every_place:
                    known.update(fresh)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The 32-bit ids of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        cut = [parts(t) if t else [] for t in texts]
        keys = list(set().union(*cut).difference(known))
        pieces = [self.split(k) for k in keys]
        ids = self.look_up({w for p in pieces for w in p})
        known.update((key, ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p])) for key, p in zip(keys, pieces, strict=True))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for key in keys:
            if len(key) > MEMORABLE:
                del known[key]
        return out

    def listed(self, ids: bytes) -> str:
        """Ids as decimals with commas between."""
        return ",".join(map(self.decimal.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids; an id that is no token is an error."""
        flat = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)
        self.db.register("ids", pa.table({"row": np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) // 4 for r in rows]), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        found = self.db.sql("SELECT row, count(*) AS n, unhex(string_agg(hex, '' ORDER BY pos)) AS decoded FROM ids JOIN vocabulary USING (id) GROUP BY row").to_arrow_table()
        self.db.unregister("ids")
        if sum(found.column("n").to_pylist()) < len(flat):
            raise ValueError("ids that are not in the vocabulary")
        out = [b""] * len(rows)
        for row, decoded in zip(found.column("row").to_pylist(), found.column("decoded").to_pylist(), strict=True):
            out[row] = decoded
        return out


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    """Read once a process, by tasks on the machine that they run on."""
    return Ranks(path)


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``ids_sha256`` (of the decimals with commas between) of every row.

    The ids are those of the ranks at ``rank_path`` for each match of the split pattern; strings of special
    tokens are plain text. Null and empty texts have no ids. Rows are taken as they come, whatever their ids
    are; other columns are ignored; an empty table gives an empty result. Texts of any length are taken whole:
    a word of n letters takes up to n rounds over its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, 1000):
            both = ranks(rank_path)
            ids = both.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(ids, type=pa.binary()), pa.array([hashlib.sha256(both.listed(x).encode()).hexdigest() for x in ids], type=pa.string())], names=[id_col, "n_tokens", "ids", "ids_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, ids_sha256 string")


def decode(rows: DataFrame, rank_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``, the bytes of their ids; null ids are none. An id that is no token is an error."""
    if out_col in rows.columns:
        raise ValueError(f"there is a column {out_col} already")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            decoded = ranks(rank_path).decode([x or b"" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, type=pa.binary())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out_col}` binary")

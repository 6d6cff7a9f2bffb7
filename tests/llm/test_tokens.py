"""Alignment, whitening and byte-pair encoding: the queries against plain versions, and awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PythonException

from inkline.llm import align, bpe, queries, whiten

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " \n\t\r\x0b\x1c\x85\xa0  　'smtre12½²é▁!?.aabbc漢字😀‍́"
AWKWARD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n\na \n b", "x▁y", "<|endoftext|> <s></s><unk><0x41>", "don't we'll", "\x00\x01", "ab" * 300, "aa" * 700, "\r\n;\r\n x", "日本語 テキスト 😀😀", "word " * 4000, "é ½ ﬁ‍", "one\n two\t three"]


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(k if k % 7 else None, t, 1, "x", "y") for k, t in enumerate(texts)] + [(1, "a  b", 1, "x", "y")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, block long, ids string, part string").repartition(3)


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_parts_are_tokenized_apart():
    rng = random.Random(5)
    ranks = bpe.Ranks(RANKS)
    for _ in range(300):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 30)))
        cut = bpe.parts(text)
        assert "".join(cut) == text
        assert [w for p in cut for w in ranks.split(p)] == ranks.split(text)


def test_words_of_every_kind_contract_as_the_library_does(tokenizer):
    rng = random.Random(7)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éüñß漢字") for n in (2, 7, 40, 60, 300)]
    words += ["a" * 5000, "ab" * 500, "the" * 200]
    for found, word in zip(bpe.Ranks(RANKS).encode(words), words, strict=True):
        assert np.frombuffer(found, dtype="<u4").tolist() == tokenizer.encode_ordinary(word)


def test_a_query_of_few_rounds_goes_on(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_ROWS", 1)  # two rounds a query
    words = ["international", "aaaaaaaaabaaab" * 8, "zq" * 60]
    for found, word in zip(bpe.Ranks(RANKS).encode(words), words, strict=True):
        assert np.frombuffer(found, dtype="<u4").tolist() == tokenizer.encode_ordinary(word)


def test_memory_is_emptied(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    ranks = bpe.Ranks(RANKS)
    for text in ("some words of it", "other words here", "some words of it"):
        assert ranks.listed(ranks.encode([text])[0]) == ",".join(map(str, tokenizer.encode_ordinary(text)))


def encoded(rows, tokenizer):
    out = Counter()
    for r in rows:
        ids = tokenizer.encode_ordinary(r.text or "")
        out[(r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode_bytes(ids)))] += 1
    return out


def test_op13(spark, sf, tokenizer):
    found = queries.op13_bpe(spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, found.collect())) == encoded(spark.read.parquet(f"{sf}/documents.parquet").collect(), tokenizer)


def test_bpe_of_awkward_rows(odd, tokenizer):
    rows = bpe.encode(odd, RANKS)
    back = bpe.decode(rows, RANKS).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, digest(bytes(r.decoded))) for r in back) == encoded(odd.collect(), tokenizer)
    assert bpe.decode(bpe.encode(odd.limit(0), RANKS), RANKS).count() == 0
    with pytest.raises(PythonException, match="not in the vocabulary"):
        bpe.decode(odd.limit(1).selectExpr("X'FFFFFF00' AS ids"), RANKS).collect()


def aligned(texts):
    """Whole texts through both libraries, all pairs of tokens compared by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in letters)}
    assert set(byte) == set(ByteLevel.alphabet())
    rows, holds = [], Counter()
    for text in texts:
        raw = f" {text or ''}".encode()
        left = a.encode(f" {text or ''}", add_special_tokens=False).ids
        right = b.encode(text or "")
        la = [bytes(byte[c] for c in a.id_to_token(k)) for k in left]
        lb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in right]
        if not text or b"".join(la) != raw or b"".join(lb) != raw:
            rows.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in la]), np.cumsum([len(x) for x in lb])
        ends = np.intersect1d(ea, eb)
        groups = [(left[i:j], right[k:m]) for i, j, k, m in zip(np.searchsorted(ea, [0, *ends[:-1]], side="right"), np.searchsorted(ea, ends) + 1, np.searchsorted(eb, [0, *ends[:-1]], side="right"), np.searchsorted(eb, ends) + 1, strict=True)]
        sa, sb = ea - [len(x) for x in la], eb - [len(x) for x in lb]
        links = []
        for i in range(len(left)):
            links += [(left[i], right[k]) for k in range(np.searchsorted(eb, sa[i], side="right"), np.searchsorted(sb, ea[i]))]
        holds.update(set(links))
        rows.append((len(left), len(right), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), len(groups), links))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        out.append((0, 0, 0, "", 0, 0, 0) if r is None else (r[0], r[1], r[3], digest(r[2]), len(r[4]), sum(holds[x] == best[x[0]] for x in r[4]), sum(holds[x] for x in r[4])))
    return out


def test_op11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d.doc_id, *x) for d, x in zip(docs, aligned([d.text for d in docs]), strict=True))
    found = queries.op11_align(spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert Counter(map(tuple, found.collect())) == want


@pytest.mark.parametrize("block", [align.BLOCK_BYTES, 50])
def test_alignment_of_awkward_rows(odd, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    rows = odd.collect()
    want = Counter((d.doc_id, *x) for d, x in zip(rows, aligned([d.text for d in rows]), strict=True))
    found = align.align(odd, A, B, keep_groups=True)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in found.collect()) == want
    assert all(r.groups_sha256 == (digest(r.groups) if r.groups else "") for r in found.collect())
    assert align.align(odd.limit(0), A, B).count() == 0


def test_transducer_of_sides_that_differ():
    names = [*map(str, range(9))]
    t = align.Transducer((names, names))
    assert t.align(([1, 2], [3, 4]), ([b"ab", b"c"], [b"a", b"bc"])) == ("1,2|3,4", [1 << 32 | 3, 1 << 32 | 4, 2 << 32 | 4])
    assert t.align(([1, 2], [3, 4]), ([b"ab", b"c"], [b"ab", b"c"])) == ("1|3;2|4", [1 << 32 | 3, 2 << 32 | 4])
    assert len(t.steps) == 5
    assert t.align(([1], [3]), ([b"ab"], [b"a"])) is None
    assert t.align(([1], [3]), ([b"ab"], [b"ax"])) is None
    assert t.align(([1], [3, 4]), ([b"a"], [b"a", b"b"])) is None
    assert t.align(([], []), ([], [])) == ("", [])


def whitened(vectors, most):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    n = len(x)
    exact = [[n * int(v) - int(s) for v, s in zip(row, x.sum(0), strict=True)] for row in x]
    c = np.array(exact, dtype=np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(e)[::-1][:most]
    return [sum(d * d for d in row) for row in exact], e[order], v[:, order], c, e.sum()


def test_op12(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, e, v, c, total = whitened([r.embedding for r in given], 32)
    found = queries.op12_whiten(spark, sf)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * len(given) and {r.n for r in rows} == {len(given)} and max(r.identity_error for r in rows) < 1e-9
    assert [r.deviation for r in rows[::32]] == deviation
    got = np.array([r.whitened for r in rows]).reshape(len(given), 32)
    want = c @ v / np.sqrt(e)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-6
    assert np.allclose([r.explained for r in rows[:32]], e / total, rtol=1e-9)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    nan, inf = math.nan, math.inf
    flat = [[float(a), 2.0 * float(a), 1.0, 5.0] for a in rng.normal(size=40)]  # two of four dimensions say the same, two never change
    vectors = [*flat, *[[1.0, 2.0]] * 3, [7.0, 8.0, 9.0], [], None, [nan, 1.0, 1.0, 1.0], [inf, 0.0, 0.0, 0.0], [None, 1.0, 1.0, 1.0]]
    given = spark.createDataFrame([(k if k % 5 else None, v, 1, 2) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, n long, whitened long")
    rows = whiten.whiten(given, 32).collect()
    assert Counter(r.n for r in rows) == {40: 40, 3: 3, 1: 2}
    assert {len(r.whitened) for r in rows if r.n == 40} <= {1, 2} and {len(r.whitened) for r in rows if r.n < 40} == {0}
    assert all(r.deviation == 0 and r.identity_error == 0 for r in rows if r.n < 40)
    assert max(r.identity_error for r in rows) < 1e-4
    deviation = whitened(flat, 4)[0]
    assert Counter(int(r.deviation) for r in rows if r.n == 40) == Counter(deviation)
    assert whiten.whiten(given.limit(0)).count() == 0
    assert whiten.whiten(given.where("embedding IS NULL")).count() == 0

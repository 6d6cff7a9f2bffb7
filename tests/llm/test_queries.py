"""The queries themselves over whole tables: against their SQL, or every column against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from inkline.llm import licenses, lm, pii, queries, toxicity
from tests.compare import difference
from tests.llm.test_operators import PATTERNS, plain_lm, right, words


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def lowered(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, sf, name):
    assert difference(spark, queries.queries()[name], queries.SQL[name], sf) == ({}, {})


def test_op1(spark, sf, texts):
    prints = {}
    for doc, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
        prints[doc] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    group = {d: d for d in prints}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in prints:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", group[d]) for d, f in prints.items()}


def test_op3(spark, sf, texts):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model, sigmoid = toxicity.fit(docs, labels), lambda x: 1 / (1 + math.exp(-x))
    found = queries.op3_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        score = sum(model.weights[f] for f in {f for w in words(texts[r.doc_id]) for f in toxicity.features_of(w.encode())})
        below = [sigmoid(t - score) for t in model.thresholds]
        assert math.isclose(r.p_toxic, 1 - below[0], abs_tol=1e-6) and math.isclose(r.expected_severity, 2 - below[0] - below[1], abs_tol=1e-6)
        assert r.rejected == (r.p_toxic >= 0.5)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts}
    assert np.mean([r.rejected == bool(toxic[r.doc_id]) for r in found if r.doc_id in toxic]) >= 0.95


def test_op5(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_files()["json_path"])
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    assert pieces.keys() == ids.keys()
    for d, rows in pieces.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids[d]) // 2048))) and all(r.length == 2048 for r in rows[1:])
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1  # no packing needs fewer than all tokens fill


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def plain_candidates(text):
    """Kind, start, end and features of each candidate."""
    text = text.translate({1: 3, 2: 3})
    for number, pattern in enumerate((pii.NEAR_EMAIL, pii.NEAR_NUMBER, pii.NEAR_SECRET)):
        if number == 0 and "@" not in text:
            continue
        places = [m.span() for m in re.finditer(pattern.replace(r"\u0001-\u0003", "\x01-\x03"), text, re.ASCII)]
        for k, (a, b) in enumerate(places):
            w = text[a:b]
            from_ = places[k - 2][0] if k > 1 else 0
            before, after = text[max(a - 24, from_) : a].lower(), text[b : b + 1]
            n = len(re.sub("[^0-9]", "", w))
            kind = (0, 1 if re.search(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", w) else 2 if not w.startswith("+") and n >= 13 else 3, 4)[number]
            count = lambda c, w=w: float(len(re.sub(f"[^{c}]", "", w)))
            share = lambda c, w=w: count(c) / len(w)
            has = lambda p, x: float(bool(re.search(p, x, re.ASCII)))
            values = {"length": float(min(len(w), 80)), "digits": count("0-9"), "digit_share": share("0-9"), "upper_share": share("A-Z"), "lower_share": share("a-z"), "hex_share": share("0-9a-f"), "dots": count("."), "dashes": count("-"), "blanks": count(" "), "parentheses": count("()"), "distinct": float(len(set(w))), "assigned": has(r"[=:]\s*['\"]?$", before), "quoted": has(r"['\"]$", before) * has(r"['\"]", after), "cue": has(pii.CUES, before), "joined": has(r"[\w]$", before), "ends_word": 1 - has(r"[\w]", after)}
            yield kind, a, b, [float(kind), *(values[x] for x in pii.FEATURES)]


def test_op8(spark, sf, texts):
    selector = pii.fit_selector(queries.table(spark, sf, "documents"))
    assert selector.trees and selector.thresholds

    def leaf(node, values):
        while isinstance(node, tuple):
            node = node[2] if values[node[0]] <= node[1] else node[3]
        return node

    for r in queries.op8_pii(spark, sf).collect():
        text = texts[r.doc_id]
        base = [(kind, *m.span()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if right(kind, m.group())]
        of = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (of["email"], of["ip"], of["card"], of["phone"])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        added = []
        for kind, a, b, values in plain_candidates(text):
            score = round(sum(w * leaf(t, values) for w, t in selector.trees), 6)
            if kind in selector.thresholds and score >= selector.thresholds[kind] and not any(x < b and a < y for _, x, y in base):
                added.append((pii.KINDS[kind], a, b))
        order = {k: n for n, k in enumerate(pii.KINDS)}
        assert r.spans == listed(sorted([*base, *added], key=lambda s: (order[s[0]], s[1], s[2]))), r.doc_id


def test_op9(spark, sf, texts):
    rows = [(d, [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(t).encode()), b"\n"], zlib.crc32(str(d).encode()) % 10 == 0) for d, t in texts.items()]
    count, total, base, score = plain_lm(rows, lm.ORDER, lm.MU)
    got = {r.doc_id: r for r in queries.op9_lm(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, w, held in rows:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(w), sum(count[(x,)] > 0 for x in w), total)
        assert math.isclose(r.base_score, base(w), rel_tol=1e-9) and math.isclose(r.score, score(w), rel_tol=1e-9)


def test_op10(spark, sf, texts):
    found = {r.doc_id: r for r in queries.op10_licenses(spark, sf).collect()}
    assert found.keys() == texts.keys() and any(r.labels for r in found.values())
    for d, text in texts.items():
        w = words(text)
        places = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in {*licenses.BASE, *licenses.NOTICES, licenses.TAG}}
        base = sorted(k for p in licenses.BASE for k in places[p])
        labels = {(licenses.BASE | licenses.NOTICES)[p] for p, at in places.items() if at and p != licenses.TAG}
        score = max((licenses.binding(x) for x in labels), default=0.0)
        ends = [m.end() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
        for k in places[licenses.TAG]:
            names, value = licenses.read_expression(text[ends[k + 2] :].split("\n")[0].encode())
            labels |= set(names)
            score = max(score, value or 0.0)
        r = found[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), base[0] if base else None, base[-1] if base else None)
        assert r.base_labels == ",".join(sorted({v for p, v in licenses.BASE.items() if places[p]})) and r.labels == ",".join(sorted(labels)) and math.isclose(r.score, score)

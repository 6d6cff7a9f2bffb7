"""Each operator on a small table of awkward rows, against a plain version of its own."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from inkline.llm import chat, common, decontaminate, embeddings, jaccard, licenses, lm, packing, pii, simhash, toxicity, warc
from inkline.llm.queries import tokenizer_files

DOCS = "doc_id long, text string, lang string, row string, fp string, spans string, n_words int, score string, kind string, id string"
BASE = "the quick brown fox jumps over the lazy dog and then walks home slowly under old trees by the river"
LONG = " ".join(f"word{k % 97} thing{k % 89}" for k in range(30_000))
TEXTS = [BASE, BASE, BASE + " now", "", None, "   \n\t", "one", "A@b.co.uk, call +1 (555) 123-4567 from 10.0.0.255 or 300.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", LONG, "Çtion école \u0001\u0002 x@y.org " + BASE.upper(), "SPDX-License-Identifier: (MIT OR GPL-2.0) AND CC-BY-4.0\nall rights reserved", "1 2 3 4 " * 3000, "a.b@c.d.e_f@g.hh %@x.y 1.2.3.4.5.6.7.8"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, "r", None, "s", None, "x", "y", "z") for k, t in enumerate(TEXTS)] + [(None, BASE, "en", None, None, None, 1, None, None, None), (3, "", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_majority_bits_and_short_texts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 254, 255, 256, 1000):
        h = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert simhash.majority_bits(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n ") == 0


@pytest.mark.parametrize("half", [0, 1])
def test_shard_links_join_all_pairs_within_reach(half):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 64, 2)] for _ in range(900)], dtype=np.uint64)
    points = np.unique(np.concatenate([seeds, seeds[rng.integers(0, 300, 900)] ^ flips[:, 0] ^ flips[:, 1]]))
    a, b = simhash.shard_links(points, np.ones(len(points), dtype=bool), half, 3)
    label = simhash.stars(len(points), a, b)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    mask = np.bitwise_count((points[:, None] ^ points[None, :]) & simhash.HALVES[half]) <= 1
    i, j = np.nonzero(near & mask)
    assert (label[i] == label[j]).all()
    want = simhash.stars(len(points), *np.nonzero(near))  # no group holds more than links within reach join
    assert all(len(set(want[label == x].tolist())) == 1 for x in set(label.tolist()))


def test_shard_links_of_a_leaf_that_nothing_divides(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 10**9)
    points = np.unique(np.random.default_rng(2).integers(0, 1 << 13, 5000, dtype=np.uint64))
    a, b = simhash.shard_links(points, np.arange(len(points)) % 7 > 0, 0, 1)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 1
    near &= (np.arange(len(points)) % 7 > 0)[None, :]
    assert np.array_equal(simhash.stars(len(points), a, b), simhash.stars(len(points), *np.nonzero(near)))


def test_samples_never_collapse(spark):
    for n in (10**3, 10**6, 10**9, 10**11, 10**13):
        share = simhash.sample_share(n)
        assert min(n / 8, 2048) * 0.99 <= share * n <= 65_536 * 1.01
        assert abs((common.drawn_below(share) + 2.0**63) / 2.0**64 * n - share * n) < 1 and common.drawn_below(20_000 / n if n > 20_000 else 1.0) > -(1 << 63) + 10**5
    assert 9_000 < spark.range(100_000).where(common.drawn(0.1, 1, "id")).count() < 11_000 and spark.range(9).where(common.drawn(1.0, 1, "id")).count() == 9


@pytest.mark.parametrize("most", [0, 3, 100])
def test_join_each(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most or 1)
    keys = [0] * 3000 + list(range(1, 40)) + [99]
    rows = spark.createDataFrame([(k, f"r{j}") for j, k in enumerate(keys)], "key long, row string")
    told = spark.createDataFrame([(k, keys.count(k), f"t{k}") for k in range(41)], "key long, weight long, told string")
    assert sorted((r.row, r.told) for r in common.join_each(rows, told, "key", "weight").collect()) == sorted((f"r{j}", f"t{k}") for j, k in enumerate(keys) if k != 99)


def test_near_duplicates(docs, empty):
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {k: int(f, 16) for k, f in found if k is not None}
    group = {k: k for k in fps}
    for _ in range(len(fps)):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {k: v for (k, _), v in found.items() if k is not None} == group
    assert [v for (k, _), v in found.items() if k is None] == [0]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").distinct().collect()) == sorted(set(group.values()))


def test_one_of_each_keeps_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{k * 7919 % 101}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, d), (None, d), (7, b), (7, b), (9, None), (9, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (None, d), (9, "")], key=str)
    assert simhash.one_of_each(table.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each_jaccard_group(spark, sf):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    rows = []
    for group in range(60):
        text = [f"g{group}w{k}" for k in range(int(rng.integers(20, 200)))]
        rows.append(" ".join(text))
        for copy in range(int(rng.integers(1, 8))):
            changed = [f"c{copy}x{k}" if rng.random() < 0.03 else w for k, w in enumerate(text)]
            rows.append(" ".join([*changed, *(f"t{copy}t{k}" for k in range(int(rng.integers(0, len(text) // 4))))]))
    rows += [rows[0], "  " + rows[1].upper(), "one two", "one  two", None, "", "one two three"]
    sets = [set(jaccard.shingles(t.encode() if t else None, 5).tolist()) for t in rows]
    same = [[not (s or t) or len(s & t) >= 0.8 * len(s | t) for t in sets] for s in sets]
    label = simhash.stars(len(rows), *np.nonzero(np.array(same)))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, table, sf)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == np.flatnonzero(label == np.arange(len(rows))).tolist()


def test_jaccard_finds_links_that_no_hub_shows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "bands", lambda grams: np.zeros(1, dtype=np.int64))  # all in one bucket
    texts = [" ".join(f"a{k}" for k in range(60)), *(" ".join(f"a{k}" for k in range(at, at + 60)) for at in (20, 4, 8, 12, 16, 40))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in jaccard.one_of_each(table).orderBy("doc_id").collect()] == [0, 6]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    roots = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_decontaminate(spark, docs, empty):
    items = [(1, "brown fox jumps over the lazy dog and then walks home slowly"), (2, "word3 thing3"), (10, ""), (11, None), (12, "one"), (None, "river")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for r in decontaminate.contaminated_spans(docs, benchmark).collect():
        w, hit, held = words(r.text), set(), set()
        for phrase, owners in windows.items():
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit |= set(range(k, k + len(phrase)))
                    held |= owners
        assert r.n_words == len(w) and {k for s in r.spans for k in range(s.start, s.end)} == hit
        assert r["items"] == sorted(str(x) for x in held if x is not None)
    cleaned = decontaminate.decontaminate(docs, benchmark)
    assert cleaned.schema == docs.schema and cleaned.count() == docs.count()
    assert {r.text for r in cleaned.where("doc_id = 0").collect()} == {"the quick  under old trees by the "}
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert decontaminate.contaminated_spans(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_decontaminate_in_parts(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(k, f"{a} {b}") for k, (a, b) in enumerate(zip(BASE.split(), BASE.split()[1:], strict=False))], "item_id long, text string")
    whole = decontaminate.contaminated_spans(docs, benchmark).orderBy("doc_id", "text").drop("text").collect()
    cleaned = sorted(map(str, decontaminate.decontaminate(docs, benchmark, length_col="n_words").collect()))
    monkeypatch.setattr(decontaminate, "PART_BYTES", 60)
    assert decontaminate.contaminated_spans(docs, benchmark).orderBy("doc_id", "text").drop("text").collect() == whole
    assert sorted(map(str, decontaminate.decontaminate(docs.withColumnRenamed("lang", "_spans"), benchmark, length_col="n_words").withColumnRenamed("_spans", "lang").collect())) == cleaned


def test_decontaminate_cuts_long_items_into_pieces(spark, monkeypatch):
    words_ = [f"w{k * 7919 % 1009}" for k in range(400)]
    benchmark = spark.createDataFrame([(1, " ".join(words_)), (2, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(["x", *words_[k : k + 12], "y"])) for k in range(0, 388, 5)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 100)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    pieces, n = decontaminate.in_parts(benchmark, "item_id", "text", 10)
    assert n > 1 and pieces.groupBy("part").count().count() > 1 and pieces.where("length(text) > 150").count() == 0
    for r in decontaminate.contaminated_spans(docs, benchmark).collect():
        assert [(s.start, s.end) for s in r.spans] == [(1, 13)] and r["items"] == ["1"]
    assert {r.text for r in decontaminate.decontaminate(docs, benchmark).collect()} == {"x  y"}


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 3000)
    text[-1] = 0
    index = decontaminate.FMIndex(text)
    phrases = np.array([[0, 1, 2], [1, 1, 1], [3, 2, 1], [0, 0, 3]])
    which, low, high = index.search(phrases, np.array([2, 3, 3, 1]))
    for p, a, b in zip(which, low, high, strict=True):
        want = [x for x in phrases[p] if x]
        assert sorted(index.locate(np.arange(a, b))) == [k for k in range(3001 - len(want)) if list(text[k : k + len(want)]) == want]


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(3)
    plain = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(600):
        bad = ["nastyword", "vilethings", f"scornful{k % 7}"][: 1 + k % 3] if k % 3 == 0 or k % 5 == 0 else []
        rows.append((k, " ".join([*rng.choice(plain, 40), *bad]), int(bool(bad))))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen, held = table.where("doc_id % 5 <> 1"), table.where("doc_id % 5 = 1")
    model = toxicity.fit(seen.drop("toxic"), seen.select("doc_id", "toxic"))
    assert list(model.thresholds) == sorted(model.thresholds)
    graded = toxicity.grade(held, model).join(held.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.rejected == bool(r.toxic) for r in graded]) >= 0.97
    assert all(0 <= r.expected_severity <= 2 for r in graded)
    assert toxicity.grade(docs, model).count() == docs.count() and toxicity.grade(empty, model).count() == 0
    assert toxicity.without_toxic(docs, model).schema == docs.schema
    blind = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic").limit(0))
    assert toxicity.grade(table, blind).where("rejected").count() == 0
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for r in toxicity.grade(docs.where("doc_id is not null and doc_id != 3"), model).collect():
        places = {f for w in set(words(TEXTS[r.doc_id])) for f in toxicity.features_of(w.encode())}
        score = sum(model.weights[f] for f in places)
        clean, mild = sigmoid(model.thresholds[0] - score), sigmoid(model.thresholds[1] - score)
        assert math.isclose(r.p_toxic, 1 - clean, abs_tol=1e-9) and math.isclose(r.expected_severity, (mild - clean) + 2 * (1 - mild), abs_tol=1e-9)
        assert r.rejected == (r.p_toxic >= 0.5) and r.grade == max(range(3), key=[clean, mild - clean, 1 - mild].__getitem__)


def test_a_row_labelled_both_ways_is_toxic_and_repeated_ids_count_once(spark):
    table = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(table, labels, "doc_id", "text", "toxic", 10).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in found) == [(1, "a", 1), (2, None, 0)]


def test_ordinal_fit_finds_the_least_loss():
    rng = np.random.default_rng(13)
    x = (rng.random((200, 6)) < 0.4) * rng.random((200, 6))
    grades = np.digitize(x @ [3, -2, 1, 0, 0, 2] + 0.5 * rng.normal(size=200), [0.5, 1.5])
    owner, column = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(owner, column, x[owner, column], grades, 6, 3, l2=0.01, rounds=3000, rate=0.02)

    def loss(w, theta):
        below = 1 / (1 + np.exp(-(np.array([-np.inf, *theta, np.inf])[None, :] - (x @ w)[:, None])))
        return -np.mean(np.log(np.diff(below, axis=1)[np.arange(200), grades])) + 0.005 * (w @ w)

    assert theta[0] < theta[1]
    for _ in range(200):
        assert loss(w, theta) <= loss(w + 0.02 * rng.normal(size=6), theta + 0.02 * rng.normal(size=2)) + 1e-9


def test_ordinal_probabilities_sum_to_one():
    model = toxicity.OrdinalModel(np.zeros(toxicity.DIMS), [-1.0, 0.5, 2.0])
    p = model.probabilities(np.linspace(-5, 5, 11))
    assert p.shape == (11, 4) and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 40] + 0.12 * rng.normal(size=16) * (k % 3)]) for k in range(600)]
    rows += [(700 + k, v) for k, v in enumerate([None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [], [2.0, 4.1], [0.0, -1.0], [-0.0, -1.0]])] + [(None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string, least string")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert len(found) == len(rows)
    x = np.array([v for _, v in rows[:600]], dtype=np.float32).astype(float)
    x = np.concatenate([x, x[:1]])  # the row without an id
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = simhash.stars(601, *np.nonzero(near))
    for k in range(600):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (near[k].sum(), label[k], label[k] == k)
    assert [(found[k].n_links, found[k].component_id) for k in (700, 701, 702, 703, 704, 707)] == [(0, k) for k in (700, 701, 702, 703, 704, 707)]
    assert [(found[k].n_links, found[k].component_id) for k in (705, 706, 708, 709, 710)] == [(2, 705), (2, 705), (2, 705), (1, 709), (1, 709)]
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(embeddings, "FRAGMENT", 3)
    rng = np.random.default_rng(5)
    x = (np.ones((60, 8)) + 0.05 * rng.normal(size=(60, 8))).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()} == {(59, 0)}


def brute_force_links(x, threshold=0.95):
    x = embeddings.unit(x.astype(float))
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = simhash.stars(len(x), *np.nonzero(near))
    return {k: (near[k].sum(), label[k]) for k in range(len(x))}


def test_embeddings_cut_those_that_ask_into_blocks(spark, monkeypatch):
    plain = embeddings.links_of_block

    def bounded(frame, *how):
        assert frame["n"].sum() <= 120, frame["n"].sum()
        return plain(frame, *how)

    for name, value in (("BLOCK", 20), ("CELL", 10), ("FRAGMENT", 4), ("links_of_block", bounded)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(30, 12))[np.arange(300) % 30] + 0.15 * rng.normal(size=(300, 12))).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    assert found == brute_force_links(x)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_with_centres_of_two_levels(spark, monkeypatch, kind):
    for name, value in (("FAN", 4), ("CELL", 20), ("FRAGMENT", 7), ("BLOCK", 30)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(60, 12))[np.arange(900) % 60] + 0.15 * rng.normal(size=(900, 12))).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    cells = embeddings.fit(table.select(F.col("vec_id").alias("class"), F.col("embedding").alias("vector")))[12]
    assert len(cells.sub) < cells.first[-1]
    for threshold in (0.95, 0.8):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, threshold=threshold).collect()}
        assert found == brute_force_links(x, threshold)
    home, row, cell = cells.ask(embeddings.unit(x.astype(float)), 0.95)
    assert all(h in cell[row == k] for k, h in enumerate(home))


@pytest.mark.parametrize("fan", [embeddings.FAN, 3])
def test_many_cells_lose_no_link(spark, monkeypatch, fan):
    """Over several cells of the usual size, of one level and of two: 5,000 vectors about 400 seeds, few of them clear of the threshold."""
    monkeypatch.setattr(embeddings, "FAN", fan)
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(400, 24))[rng.integers(0, 400, 5000)] + 0.22 * rng.normal(size=(5000, 24))).astype(np.float32)
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    for threshold in (0.95, 0.8):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, threshold=threshold).collect()}
        assert found == brute_force_links(x, threshold)


def test_pairs_between_two_clusters_are_found(spark):
    """Most vectors lie about two axes; a few pairs lie between, their ends on different sides."""
    rng = np.random.default_rng(12)
    ends = rng.integers(0, 2, 1800)
    x = 0.05 * rng.normal(size=(1840, 64))
    x[np.arange(1800), ends] += 1.0
    for k in range(20):
        angle, spin = np.pi / 4, np.arccos(0.951) / 2
        for side in (0, 1):
            a = angle + (spin if side else -spin)
            x[1800 + 2 * k + side] = 0
            x[1800 + 2 * k + side, 0], x[1800 + 2 * k + side, 1] = np.cos(a), np.sin(a)
        x[1800 + 2 * k : 1802 + 2 * k, 2 + k] = 0.3 * (k + 1) / 20
    x = x.astype(np.float32)
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    for threshold in (0.95, 0.85):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, threshold=threshold).collect()}
        assert found == brute_force_links(x, threshold)


def test_a_vector_is_packed_once(spark, monkeypatch):
    """Vectors without clusters ask many cells: none is copied there, and pairs of blocks are read where they are written."""
    for name, value in (("CELL", 20), ("BLOCK", 50)):
        monkeypatch.setattr(embeddings, name, value)
    x = np.random.default_rng(13).normal(size=(600, 16)).astype(np.float32)
    classes = spark.createDataFrame([(k, 1, r.tolist()) for k, r in enumerate(x)], "class long, weight long, vector array<float>")
    cells = embeddings.fit(classes)
    assert len(cells[16].ask(embeddings.unit(x.astype(float)), 0.95)[1]) > 1200
    blocks = embeddings.written(embeddings.in_blocks(classes, cells, 0.95).withColumn("block", F.monotonically_increasing_id()), "blocks")
    assert blocks.agg(F.sum("n"), F.max("n")).first() == (600, 50)
    plan = embeddings.links(blocks, cells, 0.95, "<f4")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("size", [16, 64])
def test_best_two_fit(size):
    rng = np.random.default_rng(6)
    for n in (0, 1, 50, 400):
        lengths = rng.integers(1, size + 1, n)
        bins, offsets = packing.best_two_fit(lengths, size)
        held = {}
        for length, b, o in zip(lengths, bins, offsets, strict=True):
            held.setdefault(b, []).append((o, o + length))
        for spans in held.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= size and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(held) <= math.ceil(lengths.sum() / size * 1.05) + 1  # of the bins that all lengths together fill


def test_two_smaller_pieces_take_a_smaller_ones_place():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packing_gives_the_tokenizers_ids(spark, docs, empty):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    tokenizer = Tokenizer.from_file(files["json_path"])
    odd = [(100, "<|endoftext|> x <|endoftext|>"), (101, "　  \n\n  '́s 12³"), (102, " " * 5000 + "a"), (103, "é" * 4100)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack_documents(table, **files, keep_ids=True).collect()
    got: dict = {}
    for p in sorted(pieces, key=lambda p: p.piece):
        ids = np.frombuffer(p.ids, "<u4")
        assert p.length == len(ids) <= 2048 and p.ids_crc32 == zlib.crc32(p.ids)
        got.setdefault(p.doc_id, []).extend(ids.tolist())
    for r in table.collect():
        if r.doc_id is not None and r.doc_id != 3:
            assert got[r.doc_id] == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
    full = Counter()
    for p in pieces:
        full[p.sequence_id] += p.length
    assert max(full.values()) <= 2048
    assert packing.pack_documents(empty, **files).count() == 0


def test_fast_encoder_equals_the_tokenizer_on_whole_documents(spark):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    slow = Tokenizer.from_file(files["json_path"]).encode_batch(texts, add_special_tokens=False)
    fast = packing.encoder(files["json_path"], files["rank_path"])
    assert all(fast(t) == s.ids for t, s in zip(texts, slow, strict=True))


TURNS = "conv_id long, turn long, role string, text string, position string, loss string"


def test_chat(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>\n<\\|x"), (1, 0, "user", "<|im_start|>a\n"), (2, 0, "assistant", "x"), (2, 0, "assistant", None), (3, 0, None, "t"), (3, 1, "a\nb\\n", ""), (None, 0, "user", "é"), (None, 1, "assistant", "y"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, None, "user", "w")]
    table = spark.createDataFrame([(*r, "p", "l") for r in rows], TURNS)
    segments = chat.format_chat(table)
    found = {r.conv_id: r for r in chat.read_chat(segments).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (found[conv].n_turns, found[conv].turns_sha256, found[conv].loss_chars, found[conv].loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert chat.read_chat(chat.format_chat(table.limit(0))).count() == 0
    other = chat.Template("[/{role}]: ", "[/end]\n", "[/", frozenset({"user"}))
    again = {r.conv_id: r for r in chat.read_chat(chat.format_chat(table, other), other).collect()}
    assert {c: (r.n_turns, r.turns_sha256) for c, r in again.items()} == {c: (r.n_turns, r.turns_sha256) for c, r in found.items()}
    assert again[1].loss_sha256 == hashlib.sha256(b"<|im_start|>a\n").hexdigest()
    for before in ("{{\"{role}\": <|s|>", "{x<|{role}|"):  # braces of the template's own are text
        braced = chat.Template(before, "<|e|>", "<|")
        again = {r.conv_id: r for r in chat.read_chat(chat.format_chat(table, braced), braced).collect()}
        assert {c: (r.n_turns, r.turns_sha256, r.loss_sha256) for c, r in again.items()} == {c: (r.n_turns, r.turns_sha256, r.loss_sha256) for c, r in found.items()}
    with pytest.raises(Exception, match="doesn't match the template"):
        chat.read_chat(segments, other).collect()
    with pytest.raises(ValueError):
        chat.Template("{role}: ", "end")
    for text in ("[/end]\n[\\/", "[[/"):
        assert chat.unescape(chat.escape(text, other), other) == text and "[/" not in chat.escape(text, other)
    for text in ("<|", "<\\|", "<\\\\||<|<", "<<||", "\\<|\\"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    for role in ("a\nb", "\\n", "\\\\n\n", "<|x|>", "\\", "\\41;", "é🙂"):
        assert chat.unescape_role(chat.escape_role(role)) == role and re.fullmatch(r"[A-Za-z0-9_ ;\\-]*", chat.escape_role(role))


def test_warc(spark):
    big, other = "é" * 5000, "WARC/1.1\r\n\r\n" * 300
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "u", "x" * 999), (12, "u", "x" * 999), (None, "u", "n")]
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, sha1 string, n int")
    for chunk in (64, 1 << 20):
        found = warc.write_and_read(table, chunk=chunk).collect()
        assert len(found) == len(rows)
        for r in found:
            payload = next((h or "") for p, _, h in rows if p == r.page_id).encode()
            top = max((p for p, _, h in rows if p is not None and (h or "").encode() == payload), default=None)
            again = len(payload) >= 1000 and top != r.page_id
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None)
    assert warc.write_and_read(table.limit(0)).count() == 0
    odd = spark.createDataFrame([("a\r\nb>", "u", "x" * 2000), ("ü %41", "u", "x" * 2000)], "page_id string, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.write_and_read(odd).collect()) == [("a\r\nb>", "revisit", "ü %41"), ("ü %41", "response", None)]
    archive = warc.to_archive(table, chunk=64).orderBy("record", "chunk").collect()
    assert b"".join(bytes(r.data) for r in archive).startswith(b"WARC/1.1\r\nWARC-Type: ")
    reader = warc.Reader()
    with pytest.raises(ValueError):
        for r in archive:
            reader.feed(r.chunk, r["last"], bytes(r.data)[:-1] + b"?", r.crc)


def test_warc_with_many_repeated_payloads(spark, monkeypatch):
    rows = [(k, "u", f"{k % 9 if k % 3 else 'hot'}" * 1500 if k % 5 else "short") for k in range(90)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.write_and_read(table).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    assert sorted(map(str, warc.write_and_read(table).collect())) == want and sum("revisit" in x for x in want) == 65


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, m):
    d = re.sub("[^0-9]", "", m)
    doubled = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and doubled % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark, docs, empty):
    rng = np.random.default_rng(7)
    noise = ["".join(rng.choice(list("ab@.%_-+ 0123456789().\n"), 80)) for _ in range(400)]
    hard = ["1" * 30_000, "a" * 30_000 + "@", "x@y" + ".z" * 20_000, "1 " * 20_000, "+1" + " " * 9 + "234567 8", "0.0.0.0000000000000000000000000000001 1.2.3.99999999999999999999"]
    table = docs.unionByName(spark.createDataFrame([(200 + k, t) for k, t in enumerate(noise + hard)], "doc_id long, text string"), allowMissingColumns=True)
    for r in pii.find_spans(table, pii.Selector([], {})).collect():
        for kind, pattern in PATTERNS.items():
            assert [(s.start, s.end) for s in r[kind]] == [m.span() for m in re.finditer(pattern, r.text or "") if right(kind, m.group())], (kind, r.text[:200])
    assert pii.find_spans(empty, pii.Selector([], {})).count() == 0


def test_pii_selects_and_redacts(spark, docs, empty):
    rows = [(k, f"w{k} token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" and id {hashlib.md5(str(k).encode()).hexdigest()[:20]} mail u{k}@ex{k % 9}.org") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    selector = pii.fit_selector(table)
    assert 4 in selector.thresholds and selector.trees
    for r in pii.find_spans(table, selector).collect():
        assert [r.text[s.start : s.end] for s in r.added] == [hashlib.sha1(str(r.doc_id).encode()).hexdigest()]
    assert pii.redact(table, selector).where("doc_id = 7").first().text == f"w7 token = \"<PII>\" and id {hashlib.md5(b'7').hexdigest()[:20]} mail <PII>"
    cleaned = pii.redact(docs, selector)
    assert cleaned.schema.simpleString() == docs.schema.simpleString() and cleaned.count() == docs.count()
    assert cleaned.where("doc_id = 7").first().text == "<PII>, call <PII> from <PII> or 300.1.1.1"
    assert cleaned.where("doc_id = 4").first().text is None
    assert pii.fit_selector(empty).thresholds == {} and pii.redact(empty, selector).count() == 0


def test_pii_takes_time_in_proportion_to_a_text(spark):
    n = 20_000
    mails = spark.createDataFrame([(0, " ".join(f"u{k}@ex.org" for k in range(n)))], "doc_id long, text string")
    selector = pii.Selector([(1.0, 1.0)], {0: 0.5})
    began = time.perf_counter()
    found = pii.find_spans(mails, selector).first()
    assert len(found.email) == n and (found.email[-1].end, found.added) == (len(mails.first().text), [])
    assert pii.redact(mails, selector).first().text == " ".join(["<PII>"] * n)
    assert time.perf_counter() - began < 60


def test_running_totals(spark):
    rng = np.random.default_rng(11)
    rows = [([int(x) for x in rng.integers(-9, 9, n)],) for n in (0, 1, 2, 3, 7, 50, 99, 100, 101)] 
    table = spark.createDataFrame(rows, "v array<int>")
    for r in table.select("v", pii.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), pii.running(F.col("v"), F.greatest, F.lit(0)).alias("m")).collect():
        assert r.s == np.cumsum(r.v).tolist() and r.m == np.maximum.accumulate([0, *r.v])[1:].tolist()


def test_pii_selects_a_kind_that_the_sample_misses(spark):
    secret = {k: hashlib.sha1(str(k).encode()).hexdigest() for k in (11, 222, 555)}
    rows = [(k, (f"token = \"{secret[k]}\" and " if k in secret else "") + f"w{k} id {hashlib.md5(str(k).encode()).hexdigest()[:20]} mail u{k}@ex{k % 9}.org") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    selector = pii.fit_selector(table, sample_docs=60)
    found = {r.doc_id: [r.text[s.start : s.end] for s in r.added] for r in pii.find_spans(table, selector).collect()}
    assert {k: v for k, v in found.items() if v} == {k: [v] for k, v in secret.items()}


def plain_lm(rows, order, mu):
    """Counts of all n-grams of training rows and a backoff scorer that walks one arc at a time: (id, words with the end, held out) -> score."""
    count = Counter()
    for _, w, held in rows:
        padded = [b" ", *w]
        for k in range(1, order + 1) if not held else ():
            count.update(tuple(padded[j : j + k]) for j in range(0 if k > 1 else 1, len(padded) - k + 1))
        if not held:
            count[(b" ",)] += 1
    total = sum(n for g, n in count.items() if len(g) == 1 and g != (b" ",))
    kinds = sum(len(g) == 1 and g != (b" ",) for g in count)

    def p(history, w):
        if not history:
            return (count[(w,)] + 0.1) / (total + 0.1 * (kinds + 1))
        m = mu[len(history) - 1]
        return (count[(*history, w)] + m * p(history[1:], w)) / (count[history] + m)

    def score(words_):
        state, told = (b" ",), 0.0
        for w in words_:
            while state and not count[(*state, w)]:
                m = mu[len(state) - 1]
                told += math.log10(m / (count[state] + m))
                state = state[1:]
            told += math.log10(p(state, w))
            state = (*state, w)[-(order - 1) :]
            while state and not count[state]:
                state = state[1:]
        return told

    base = lambda words_: sum(math.log10(p((), w)) for w in words_)
    return count, total, base, score


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm(spark, docs, empty, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 5000)
    mu = (30.0, 7.0, 2.0)[: order - 1]
    table = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(k, f"a{k % 7} b{k % 3} \0 c d{k % 2} a1 b{k % 5} c d1", None) for k in range(300, 360)], "doc_id long, text string, score string"))
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"\n"], zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0) for r in table.collect()]
    count, total, base, score = plain_lm(rows, order, mu)
    want = sorted(((d is None, d or 0), held, len(w), sum(count[(x,)] > 0 for x in w), total, base(w), score(w)) for d, w, held in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_texts(table, order=order, mu=mu).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-6) and math.isclose(a[6], b[6], abs_tol=1e-6)
    assert lm.score_texts(empty).count() == 0


def test_states_weights_sum_to_one():
    rng = np.random.default_rng(9)
    sizes, held = np.array([40, 1, 25, 30]), [False, False, True, False]
    tokens = np.concatenate([[*rng.integers(2, 9, n - 1), 0] for n in sizes]).astype(np.int32)
    words_ = zstandard.ZstdCompressor().compress(b"\n".join(b"w%d" % k for k in range(7)))
    block = lm.Block(sizes, held, 9, words_, lm.shrink(tokens), 3, 64)
    total, kinds = int(block.counts[0].sum()), int((block.counts[0] > 0).sum())
    auto = lm.Automaton(9, block.grams, block.counts, total, kinds, (5.0, 3.0))

    def read(state, word):
        told = 0.0
        while (at := np.flatnonzero(auto.arcs == state * 9 + word)).size == 0:
            told, state = told + auto.given_up[state], auto.fail[state]
        return 10 ** (told + auto.weight[at[0]])

    def unseen(state):
        told = 0.0
        while state:
            told, state = told + auto.given_up[state], auto.fail[state]
        return 10**told * 0.1 / (total + 0.1 * (kinds + 1))

    known = np.flatnonzero(block.counts[0])
    last = [0, *range(9), *(block.grams[1] % 9)]
    for state in {*range(len(auto.fail))} - {1 + k for k in range(len(last) - 1) if last[1 + k] == 0}:  # nothing is read after the end
        assert math.isclose(sum(read(state, w) for w in known) + unseen(state), 1)


def test_lm_keys_grow_with_the_corpus():
    assert [lm.key_bits(n) for n in (0, 1000, 10**9, 10**13, 10**16)] == [19, 28, 48, 62, 64]


def test_licenses(docs, empty):
    for r in licenses.scan_licenses(docs).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else BASE
        w = words(text)
        want = [k for phrase in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(w) and sorted(r.base) == sorted(want) and 0 <= r.score <= 1
        if r.doc_id == 11:
            assert r.labels == ["cc-by", "cc-by-4.0", "gpl-2.0", "mit", "reserved"] and r.base_labels == ["cc-by", "reserved"]
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(("line", "names", "value"), [(b" MIT", ["mit"], 0.1), (b" MIT OR GPL-3.0", ["mit", "gpl-3.0"], 0.1), (b" MIT AND (Apache-2.0 OR GPL-3.0)", ["mit", "apache-2.0", "gpl-3.0"], 0.2), (b" GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0"], 0.56), (b" (MIT", [], None), (b" MIT */ more text", ["mit"], 0.1), (b" ) OR", [], None), (b"", [], None), (b" MIT OR", ["mit"], 0.1)])
def test_expressions(line, names, value):
    found = licenses.read_expression(line)
    assert found[0] == names and (found[1] == value or math.isclose(found[1], value))


def test_many_tags_on_one_line_take_time_in_proportion():
    began = time.perf_counter()
    for line in (b"SPDX-License-Identifier: MIT ", b"SPDX-License-Identifier: MIT AND ", b"SPDX-License-Identifier: (", b"MIT AND "):
        found = licenses.scan(b"SPDX-License-Identifier: " + line * 20_000)
        assert found["labels"] in (["mit"], [])
    # tags that are joined to their licence, so that an expression could go on over all that follow
    found = licenses.scan(b"SPDX-License-Identifier-MIT OR " * 20_000 + b"SPDX-License-Identifier: (Apache-2.0 AND ISC)")
    assert found["labels"] == ["apache-2.0", "isc", "mit"]
    assert time.perf_counter() - began < 10


def test_a_benchmark_of_repeats_and_rows_without_words_stays_in_bounds(spark, docs, monkeypatch):
    """10,000 repeats of an item, 10,000 rows without words and 10,000 null ids: what a part collects is bounded, for the query's operator and the stage's."""
    monkeypatch.setattr(decontaminate, "PART_BYTES", 10_000)
    collected, plain = [], decontaminate.Phrases

    def counted(rows, window):
        collected.append(sum(len(text) + len(item or "") + decontaminate.ROW_BYTES for item, text in rows))
        return plain(rows, window)

    monkeypatch.setattr(decontaminate, "Phrases", counted)
    numbers = spark.range(10_000)
    items = numbers.select(F.lit("same").alias("item_id"), F.lit(BASE).alias("text")).unionAll(numbers.select(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " .,; "))).unionAll(numbers.select(F.lit(None).cast("string"), F.when(F.col("id") < 9_000, BASE).otherwise(F.concat(F.lit("odd item number "), F.col("id").cast("string")))))
    found = decontaminate.contaminated_spans(docs, items).select("doc_id", "items", F.size("spans").alias("n")).collect()
    hit = [r for r in found if r.n]
    assert len(hit) == sum(BASE in (r.text or "") or BASE.upper() in (r.text or "") for r in docs.collect()) and all(r["items"] == ["same"] for r in hit)
    cut = decontaminate.decontaminate(docs, items)
    assert cut.where(F.lower("text").contains("quick brown fox")).count() == 0
    assert len(collected) > 2 and max(collected) < 1.5 * 10_000


def plain_cut(text, windows):
    """``text`` without what lies from the first to the last word of each merged run of windows."""
    lowered = text.translate({k: k + 32 for k in range(65, 91)})
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]
    w, hit = words(text), set()
    for k in range(len(w)):
        for n in {len(x) for x in windows}:
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    out, at = "", 0
    for k, (a, b) in enumerate(places):
        if k in hit:
            out, at = out + ("" if k - 1 in hit else text[at:a]), b
    return out + text[at:]


def test_pipeline(spark, sf):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = {}
    for name, run in corpus_pipeline.STAGES:
        kept[name] = common.written(run(spark, docs if name == "toxicity" else kept[before], sf), f"test-{name}")
        assert run(spark, docs.limit(0), sf).count() == 0
        assert name == "packing" or kept[name].schema.simpleString() == docs.schema.simpleString()
        before = name
    whole = text(docs)
    rejected = {r.doc_id for r in toxicity.grade(docs, toxicity.fit(docs, labels)).where("rejected").collect()}
    assert text(kept["toxicity"]) == {d: t for d, t in whole.items() if d not in rejected} and 0 < len(rejected) < len(whole) / 2

    known = sorted(text(kept["toxicity"]).items())
    sets = [set(jaccard.shingles(t.encode() if t else None, 5).tolist()) for _, t in known]
    same = [[not (x or y) or len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets]
    label = simhash.stars(len(sets), *np.nonzero(np.array(same)))
    assert text(kept["near_duplicates"]) == {d: t for k, (d, t) in enumerate(known) if label[k] == k}

    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
    cut = {d: plain_cut(t or "", windows) for d, t in text(kept["near_duplicates"]).items()}
    assert text(kept["decontamination"]) == cut and cut != text(kept["near_duplicates"])

    source = kept["decontamination"]
    for r in pii.find_spans(source, pii.fit_selector(source)).collect():
        out, at = "", 0
        for a, b in sorted((s.start, s.end) for k in (*pii.KINDS[:4], "added") for s in r[k]):
            out, at = out + (r.text[at:a] + "<PII>" if a >= at else ""), max(at, b)
        cut[r.doc_id] = out + r.text[at:]
    assert text(kept["personal_data"]) == cut and all(r.n_chars == len(r.text) for r in kept["personal_data"].collect() if r.text != whole[r.doc_id])
    packed = kept["packing"]
    assert {r.doc_id for r in packed.collect()} == set(cut) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == packed.count() and stage.keys() == kept.keys()

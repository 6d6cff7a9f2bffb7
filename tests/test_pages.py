"""Rasters, losses, beams and model lookups against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkline.functions import ctc, pixels
from inkline.operators import beam, ngram, packed, profile, raster
from inkline.plans import pages
from inkline.plans.queries import QUERIES

RASTER = "page long, y int, x int, v int"


def rows_of(image, page=1):
    return [(page, y, x, int(v)) for y, row in enumerate(image) for x, v in enumerate(row)]


def frame(spark, *images):
    return spark.createDataFrame([r for k, image in enumerate(images, 1) for r in rows_of(image, k)], RASTER)


def array_of(found, column, page=1):
    rows = [(r.y, r.x, r[column]) for r in found.where(F.col("page") == page).collect()]
    out = np.zeros((max(y for y, _, _ in rows) + 1, max(x for _, x, _ in rows) + 1))
    for y, x, v in rows:
        out[y, x] = v
    assert len(rows) == out.size
    return out


def plain_otsu(image):
    best, level = -1.0, 0
    for t in range(256):
        low, high = image[image <= t], image[image > t]
        if len(low) and len(high):
            between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if between > best * (1 + 1e-12):
                best, level = between, t
    return level


@pytest.fixture(scope="module")
def scans():
    rng = np.random.default_rng(4)
    image = np.clip(rng.normal(200, 12, (23, 17)), 0, 255).astype(int)
    image[4:9, 3:14] = rng.integers(10, 90, (5, 11))
    return image, np.full((3, 4), 90), np.array([[7, 200]]), rng.integers(0, 256, (1, 9)), rng.integers(0, 256, (12, 1))


def test_otsu(spark, scans):
    found = {r.page: r.level for r in raster.otsu(frame(spark, *scans)).collect()}
    assert found == {k: plain_otsu(s) for k, s in enumerate(scans, 1)}
    assert raster.otsu(frame(spark, scans[0]).limit(0)).count() == 0


@pytest.mark.parametrize("window", [3, 6, 25])
def test_sauvola(spark, scans, window):
    reach = window // 2
    found = raster.sauvola(frame(spark, *scans), window)
    for k, image in enumerate(scans, 1):
        wide = np.pad(image.astype(float), reach, mode="reflect") if min(image.shape) > 1 else np.pad(np.pad(image.astype(float), ((reach, reach), (0, 0)), mode="reflect" if image.shape[0] > 1 else "edge"), ((0, 0), (reach, reach)), mode="reflect" if image.shape[1] > 1 else "edge")
        boxes = np.lib.stride_tricks.sliding_window_view(wide, (2 * reach + 1, 2 * reach + 1))
        want = image < boxes.mean((2, 3)) * (1 + 0.2 * (boxes.std((2, 3)) / 127.5 - 1))
        assert (array_of(found, "ink", k) == want).all()


def test_adaptive(spark, scans):
    found = raster.adaptive(frame(spark, *scans), 7, 10)
    sigma = 0.3 * ((7 - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(7) - 3) ** 2) / (2 * sigma**2))
    g /= g.sum()
    for k, image in enumerate(scans, 1):
        boxes = np.lib.stride_tricks.sliding_window_view(np.pad(image.astype(float), 3, mode="edge"), (7, 7))
        assert (array_of(found, "ink", k) == (image <= np.rint((boxes * np.outer(g, g)).sum((2, 3))) - 10)).all()
    with pytest.raises(ValueError):
        raster.binarize(found, "magic")


def test_distance_is_that_of_the_nearest_ink(spark):
    rng = np.random.default_rng(5)
    marks = [rng.random((13, 19)) < 0.03, np.zeros((4, 5), dtype=bool), np.ones((3, 3), dtype=bool), rng.random((1, 12)) < 0.2, rng.random((30, 2)) < 0.1]
    marks[3][0, 5] = marks[4][7, 1] = marks[0][12, 18] = True
    ink = frame(spark, *[m.astype(int) for m in marks]).withColumn("ink", F.col("v") == 1)
    found = raster.distance(ink)
    for k, m in enumerate(marks, 1):
        if not m.any():
            assert found.where((F.col("page") == k) & F.col("distance").isNotNull()).count() == 0
            continue
        at = np.argwhere(m)
        want = np.array([[min(math.hypot(y - a, x - b) for a, b in at) for x in range(m.shape[1])] for y in range(m.shape[0])])
        assert np.allclose(array_of(found, "distance", k), want)
        energy = array_of(raster.energy(ink), "energy", k)
        assert np.allclose(energy, want.max() - want if want.max() else 1)
    assert (array_of(raster.energy(ink), "energy", 2) == 1).all()


def test_stroke_width(spark):
    image = np.full((40, 60), 255)
    image[10:15, 5:55] = 0  # five rows thick
    image[25:30, 5:55] = 0
    strokes = {r.page: r.stroke for r in raster.stroke_width(raster.binarize(frame(spark, image, np.full((5, 5), 255)).withColumn("v", F.col("v")), "otsu").withColumn("ink", F.col("ink") & (F.col("v") < 128))).collect()}
    assert strokes == {1: 6.0, 2: 2.0}  # the middle row lies three pixels from paper


@pytest.mark.parametrize("degrees", [-9.5, 0, 3, 12])
def test_skew(spark, degrees):
    image = np.full((150, 120), 255)
    for top in (50, 70, 90):
        for x in range(120):
            y = round(top + (x - 60) * math.tan(math.radians(degrees)))
            image[y : y + 3, x] = 0
    found = raster.skew(raster.binarize(frame(spark, image), "otsu")).first()
    assert abs(found.angle - degrees) <= 0.5
    few = spark.createDataFrame([(1, 0, k, 0, True) for k in range(9)], RASTER + ", ink boolean")
    assert raster.skew(few).first().angle == 0.0


def plain_seam(energy):
    cost = energy.copy()
    for x in range(1, cost.shape[1]):
        for y in range(cost.shape[0]):
            cost[y, x] += cost[max(y - 1, 0) : y + 2, x - 1].min()
    rows = [int(cost[:, -1].argmin())]
    for x in range(cost.shape[1] - 2, -1, -1):
        low = max(rows[-1] - 1, 0)
        rows.append(low + int(cost[low : rows[-1] + 2, x].argmin()))
    return rows[::-1]


def test_lines_are_cut_along_seams(spark):
    image = np.full((60, 50), 255)
    for top in (5, 25, 45):
        image[top : top + 9, 4:46] = 0
    image[14:18, 20:22] = 0  # a tail that hangs from the first line into the gap
    ink = raster.binarize(frame(spark, image), "otsu").cache()
    lines = profile.lines_at(profile.smooth(ink.groupBy("page", "y").agg(F.count_if("ink").alias("p"))), 0.5)
    bounds = sorted((r.y0, r.y1) for r in lines.collect())
    assert len(bounds) == 3
    energy = raster.energy(ink)
    seams = {r.gap: (r.low, r.seam) for r in raster.seams(energy, lines).collect()}
    e = array_of(energy, "energy")
    for gap, ((_, above), (below, _)) in enumerate(zip(bounds, bounds[1:], strict=False)):
        assert seams[gap] == (above - 5, plain_seam(e[above - 5 : below + 5]))
    cut = raster.cut_lines(ink, lines, raster.seams(energy, lines)).where("ink").collect()
    assert Counter(r.line for r in cut) == {0: 9 * 42 + 8, 1: 9 * 42, 2: 9 * 42}


def test_gaps_without_rows_are_cut_in_the_middle(spark):
    energy = spark.createDataFrame([(1, y, x, 1.0) for y in range(6) for x in range(3)], "page long, y int, x int, energy double")
    lines = spark.createDataFrame([(1, 0, 3), (1, 3, 6)], "page long, y0 int, y1 int")
    assert [tuple(r) for r in raster.seams(energy, lines, margin=0).collect()] == [(1, 0, 3, [0, 0, 0])]
    assert raster.seams(energy, lines.limit(1)).count() == 0
    whole = raster.cut_lines(energy.withColumn("v", F.lit(0)), lines.limit(1), raster.seams(energy, lines.limit(1)))
    assert whole.count() == 18


def test_resampling(spark, scans):
    image = scans[0]
    given = frame(spark, image)
    to = lambda h, w: raster.resample(given, spark.createDataFrame([(1, h, w)], "page long, height int, width int"))
    assert np.allclose(array_of(to(*image.shape), "v"), image)
    assert math.isclose(array_of(to(7, 5), "v").mean(), image.mean())
    assert array_of(to(46, 40), "v").shape == (46, 40)
    half = image[:22, :16].reshape(11, 2, 8, 2).mean((1, 3))
    assert np.allclose(array_of(raster.resample(frame(spark, image[:22, :16]), spark.createDataFrame([(1, 11, 8)], "page long, height int, width int")), "v"), half)
    size = spark.range(1).select(raster.target_size(F.lit(120), F.lit(200)).alias("a"), raster.target_size(F.lit(10), F.lit(5000)).alias("b")).first()
    assert tuple(size.a) == (64, 107) and tuple(size.b) == (64, 1536)


def plain_equalized(image, clip, tiles):
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((tiles, tiles, 256))
    for a, b in itertools.product(range(tiles), repeat=2):
        hist = np.bincount(wide[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=256).astype(float)
        over = np.maximum(hist - limit, 0).sum()
        maps[a, b] = (np.minimum(hist, limit) + over / 256).cumsum() * 255 / (th * tw)
    out = np.zeros(image.shape)
    for y, x in np.ndindex(h, w):
        fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
        a, b = math.floor(fy), math.floor(fx)
        for da, db in itertools.product((0, 1), repeat=2):
            weight = (fy - a if da else 1 - (fy - a)) * (fx - b if db else 1 - (fx - b))
            out[y, x] += weight * maps[min(max(a + da, 0), tiles - 1), min(max(b + db, 0), tiles - 1), image[y, x]]
    return out


def test_equalization(spark):
    image = np.random.default_rng(6).integers(60, 130, (22, 30))
    got, want = array_of(raster.equalize(frame(spark, image), tiles=4), "v"), plain_equalized(image, 2.0, 4)
    assert np.abs(got - want).max() <= 0.5 + 1e-6
    assert got.max() - got.min() > image.max() - image.min()


def test_pixels(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(pixels.gray(F.array(*map(F.lit, (10, 20, 30))))) == 22 and one(pixels.gray(F.array(F.lit(7)))) == 7
    with pytest.raises(Exception, match="not a pixel"):
        one(pixels.gray(F.array(F.lit(7), F.lit(8))))
    assert math.isclose(pixels.pad_value(), 2.43916, abs_tol=1e-5)
    assert np.allclose(one(pixels.shown(pixels.normalized(F.lit(51)))), [0.2] * 3)
    assert one(pixels.pad_row(F.array(F.lit(1.0), F.lit(2.0)), 3, 9.0)) == [1, 2, 9] and one(pixels.pad_row(F.array(F.lit(1.0), F.lit(2.0)), 1, 9.0)) == [1]


def paths_of(p):
    """Each label's probability over all paths."""
    total = {}
    for path in itertools.product(range(p.shape[1]), repeat=len(p)):
        label = tuple(c for k, c in enumerate(path) if c and (k == 0 or path[k - 1] != c))
        total[label] = total.get(label, 0) + math.prod(p[t, c] for t, c in enumerate(path))
    return total


def softmax(x):
    return np.exp(x) / np.exp(x).sum(1, keepdims=True)


def test_loss_is_that_of_all_paths(spark):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for _ in range(12):
        logits = rng.normal(size=(5, 4)) * 2
        total = paths_of(softmax(logits))
        for label in [(), (1,), (2, 2), (1, 3, 1), (1, 1, 1), (3, 3, 3, 1), (1, 2, 3, 1, 2)]:
            rows.append((logits.tolist(), list(label)))
            want.append(-math.log(total[label]) if label in total else 0.0)
    given = spark.createDataFrame(rows, "logits array<array<double>>, label array<int>")
    got = given.select(ctc.loss(ctc.log_softmax("logits"), F.col("label")).alias("v"), ctc.loss(ctc.log_softmax("logits"), F.col("label"), zero_infinity=False).alias("w")).collect()
    assert np.allclose([r.v for r in got], want)
    assert all((r.w == math.inf) == (w == 0.0) for r, w in zip(got, want, strict=True))
    empty = spark.createDataFrame([([], []), ([], [1])], "logits array<array<double>>, label array<int>")
    assert [r.v for r in empty.select(ctc.loss(F.col("logits"), F.col("label")).alias("v")).collect()] == [0.0, 0.0]


def test_beam_finds_the_likeliest_labelling(spark):
    rng = np.random.default_rng(1)
    cases = [rng.normal(size=(5, 3)) * 2 for _ in range(25)]
    found = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cases)], "k int, logits array<array<double>>").select("k", beam.prefix_beam(ctc.log_softmax("logits"), 100, token_floor=-99, beam_drop=99).alias("ids")).collect()
    for r in found:
        total = paths_of(softmax(cases[r.k]))
        assert tuple(r.ids) == max(total, key=total.get)


def plain_beam(logits, width, floor, drop):
    """The same search with dictionaries."""
    beams = {(): (0.0, -math.inf)}
    for row in np.log(softmax(logits)):
        tried = [c for c in range(1, len(row)) if row[c] >= floor] or [int(row[1:].argmax()) + 1]
        grown = {}
        for p, (blank, other) in beams.items():
            total = np.logaddexp(blank, other)
            moves = [(p, total + row[0], -math.inf)] + [((*p, c), -math.inf, (blank if p and p[-1] == c else total) + row[c]) for c in tried]
            for q, b, o in moves + ([(p, -math.inf, other + row[p[-1]])] if p and p[-1] in tried else []):
                was = grown.get(q, (-math.inf, -math.inf))
                grown[q] = (np.logaddexp(was[0], b), np.logaddexp(was[1], o))
        order = sorted(grown.items(), key=lambda kv: (-np.logaddexp(*kv[1]), kv[0]))
        beams = {q: v for q, v in order[:width] if np.logaddexp(*v) >= np.logaddexp(*order[0][1]) - drop}
    return list(next(iter(beams)))


@pytest.mark.parametrize(("width", "floor", "drop"), [(1, -5.0, 10.0), (3, -2.0, 10.0), (4, -0.1, 1.5)])
def test_narrow_beams(spark, width, floor, drop):
    cases = [np.random.default_rng(k).normal(size=(9, 5)) * 2 for k in range(15)]
    found = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(cases)], "k int, logits array<array<double>>").select("k", beam.prefix_beam(ctc.log_softmax("logits"), width, token_floor=floor, beam_drop=drop).alias("ids")).collect()
    assert {r.k: list(r.ids) for r in found} == {k: plain_beam(c, width, floor, drop) for k, c in enumerate(cases)}


def test_beam_follows_the_language_model(spark):
    outputs = spark.createDataFrame([([[math.log(x) for x in (0.1, 0.5, 0.4)]],), (None,), ([],)], "logits array<array<double>>")
    weights = spark.createDataFrame([("<s>", "b", 0.8), ("<s>", "a", 0.001)], "context string, token string, p double")
    gains = beam.language_gains(weights, ["", "a", "b"])
    assert gains.first().gains[0] == [0.5 * -6 * math.log(10) + 1, 0.5 * math.log(0.001) + 1, 0.5 * math.log(0.8) + 1]
    ids = lambda *how: [r.ids for r in beam.decode(outputs, *how).collect()]
    assert ids("beam", 10) == [[1], [], []] and ids("beam_lm", 10, gains) == [[2], [], []]
    assert ids("greedy")[0] == [1] and ids("anything else")[0] == [1]
    with pytest.raises(ValueError):
        beam.decode(outputs, "beam_lm")
    with pytest.raises(ValueError):
        beam.language_gains(weights, [str(k) for k in range(2001)])


def plain_model(texts, order):
    """Modified Kneser-Ney with dictionaries: p and backoff of each n-gram."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        w = ("<s>", *t.split(), "</s>")
        for k in range(1, order + 1):
            counts[k].update(w[i : i + k] for i in range(len(w) - k + 1))
    p, backoff, lower = {}, {}, None
    for k in range(1, order + 1):
        n = dict(counts[k])
        if k < order:
            left = Counter(g[1:] for g in counts[k + 1])
            n = {g: left.get(g, c) for g, c in n.items()}
        n.pop(("<s>",), None)
        of = Counter(n.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
        cut = {}
        for j in (1, 2, 3):
            d = j - (j + 1) * y * of[j + 1] / of[j] if y is not None and of[j] else None
            cut[j] = d if d is not None and 0 <= d <= j else 0.75 * min(j, 1.5)
        total, given = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            given[g[:-1]] += cut[min(c, 3)]
        for g, c in n.items():
            h = g[:-1]
            p[g] = (c - cut[min(c, 3)]) / total[h] + given[h] / total[h] * (1 / len(n) if k == 1 else lower[g[1:]])
        backoff.update((h, given[h] / total[h]) for h in total if h)
        lower = {g: p[g] for g in n}
    return p, backoff


@pytest.mark.parametrize("order", [1, 2, 4])
def test_model_and_its_lookups(spark, order, monkeypatch):
    rng = random.Random(2)
    words = "a b c d e f g".split()
    texts = [" ".join(rng.choices(words, weights=[9, 6, 4, 3, 2, 1, 1], k=rng.randint(1, 14))) for _ in range(60)]
    model = ngram.modified_kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    p, backoff = plain_model(texts, order)
    rows = {tuple(f"{r.context} {r.token}".split()): r for r in model.collect()}
    assert set(rows) == set(p) | ({("<s>",)} if order > 1 else set())
    for g, r in rows.items():
        assert math.isclose(r.p, p.get(g, 0.0), abs_tol=1e-12) and (r.backoff is None or math.isclose(r.backoff, backoff[g])) and (len(g) == order or (r.backoff is None) == (g not in backoff))
    asked = [" ".join(rng.choices([*words, "zz", "yy"], k=rng.randint(0, 12))) for _ in range(40)] + [None, "zz", texts[0], texts[0]]
    table = ngram.model_table(model, 4)
    for share in (ngram.HOT_SHARE, 5):
        monkeypatch.setattr(ngram, "HOT_SHARE", share)
        found = ngram.score(spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string"), table, order, "k").collect()
        assert sorted(r.k for r in found) == list(range(len(asked)))
        for r in found:
            w = ("<s>", *(asked[r.k] or "").split(), "</s>")
            total, unknown = 0.0, 0
            for i in range(1, len(w)):
                if (w[i],) not in p:
                    unknown += 1
                    continue
                h = w[max(0, i - order + 1) : i]
                while (*h, w[i]) not in p:
                    total += math.log10(backoff.get(h, 1.0))
                    h = h[1:]
                total += math.log10(p[(*h, w[i])])
            assert (r.n_tokens, r.n_unknown) == (len(w) - 1, unknown) and math.isclose(r.log10_p, total, abs_tol=1e-9)
            assert math.isclose(r.perplexity, 10 ** (-total / (len(w) - 1 - unknown)))


@pytest.mark.parametrize(("order", "prune"), [(2, 0), (3, 0), (4, 0), (5, 0), (3, 1)])
def test_a_model_of_many_blocks_and_buckets(spark, order, prune, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_TOKENS", 90)
    monkeypatch.setattr(packed, "BUCKET_BYTES", 300)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("the of é 的 d e f g </s> #".split(), weights=[20, 6, 4, 3, 2, 1, 1, 1, 1, 1], k=rng.randint(1, 30))) for _ in range(150)]
    given = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    assert len(packed.labels_of(given, "text")) > 10
    p, backoff = plain_model(texts, order)
    rows = {(*r.context.split(), r.token): r for r in ngram.modified_kneser_ney(given, order, prune).collect()}
    if not prune:
        assert set(rows) == {*p, ("<s>",)}
    for g, r in rows.items():
        assert r.length == len(g) and math.isclose(r.p, p.get(g, 0.0), abs_tol=1e-12) and (r.backoff is None or math.isclose(r.backoff, backoff[g]))
        assert len(g) == order or (r.backoff is None) == (g not in backoff)
    few = spark.createDataFrame([("the of zz d",), (None,), ("é the the </s>",)], "text string")
    asked = {tuple(w[i : i + k]) for t in ("the of zz d", "", "é the the </s>") for w in [["<s>", *t.split(), "</s>"]] for k in range(1, order + 1) for i in range(len(w) - k + 1)}
    found = ngram.modified_kneser_ney(given, order, prune, asked=few).collect()
    assert {(*r.context.split(), r.token): r for r in found} == {g: r for g, r in rows.items() if g in asked} and len(found) < len(rows)


def test_a_model_of_nothing(spark):
    found = ngram.modified_kneser_ney(spark.createDataFrame([], "text string"), 3).collect()
    assert [tuple(r) for r in found] == [(1, "", "<s>", 0.0, None)]


def test_the_model_is_not_shuffled_for_a_lookup(spark):
    texts = spark.createDataFrame([("a b a c",), ("b c a",)], "text string")
    table = ngram.model_table(ngram.modified_kneser_ney(texts, 2), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = texts.selectExpr("explode(split(text, ' ')) AS gram").groupBy("gram").count().join(table, "gram")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_letters_after_letters(spark):
    texts = ["aaaa", "abab#aa", "", None, "é😀ab a", "aaa##", "b", "##a-"]
    found = {(r.context, r.token): r.p for r in pages.letters_after(spark.createDataFrame([(t,) for t in texts], "text string"), ["a", "b", "#"]).collect()}
    pairs = Counter(p for t in texts if t for p in zip(["<s>", *t], t, strict=False))
    total = Counter(a for p, n in pairs.items() for a in [p[0]] * n)
    assert found == {(a, b): n / total[a] for (a, b), n in pairs.items() if a in ("<s>", "a", "b", "#") and b in "ab#"}


def test_characters_of_texts_are_no_rows(spark, sf):
    plan = QUERIES["prefix_beam_lm"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" not in plan and "Generate explode(zip_with" not in plan

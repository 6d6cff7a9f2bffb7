"""Golden values and properties of the operators that tables and SQL don't cover."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkline.functions import ctc, metrics, text
from inkline.operators import evaluate, labels, ngram, profile
from inkline.sources import files, sinks
from inkline.streaming import evaluate as live


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], kinds).select(column.alias("v")).first().v


@pytest.mark.parametrize(("ref", "hyp", "edits", "cer", "wer"), [("xin chào", "xin chao", 1, 0.125, 0.5), ("thiện tâm", "thien tam", 2, 2 / 9, 1.0), ("", "", 0, 0.0, 0.0), ("", "a", 1, 1.0, 1.0), ("a b c d", "a x c", 3, 3 / 7, 0.5), ("hoà", "hòa", 2, 2 / 3, 1.0)])
def test_error_rates(spark, ref, hyp, edits, cer, wer):
    c = one(spark, metrics.comparison(F.col("r"), F.col("h")), r=ref, h=hyp)
    assert c.levenshtein == edits and math.isclose(c.cer, cer) and math.isclose(c.wer, wer) and c.exact == (ref == hyp)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_edits(spark):
    rng = random.Random(0)
    rows = [(" ".join(rng.choices("a b cc đ é".split(), k=rng.randint(0, 12))), " ".join(rng.choices("a b cc đ x".split(), k=rng.randint(0, 12)))) for _ in range(200)]
    for r in spark.createDataFrame(rows, "r string, h string").select("r", "h", metrics.word_edits(F.col("r"), F.col("h")).alias("v")).collect():
        assert r.v == plain_edits(r.r.split(), r.h.split())


def test_empty_corpus_has_zero_rates(spark):
    found = evaluate.corpus_rates(spark.createDataFrame([], "gt string, predict string")).first()
    assert (found.cer, found.wer, found.n) == (0.0, 0.0, 0)


@pytest.mark.parametrize(("old", "new"), [("hoà", "hòa"), ("toàn", "toàn"), ("quý", "quý"), ("huý", "húy"), ("uýt", "uýt"), ("oàđ", "oàđ"), ("Oẻ, thuỷ", "Ỏe, thủy")])
def test_tones(spark, old, new):
    assert one(spark, text.place_tones("t"), t=old) == new


def test_text(spark):
    assert one(spark, text.fix_punctuation("t"), t="a , b ( c ) %") == "a, b (c)%"
    assert one(spark, text.squeeze("t"), t="  a\t b \n") == "a b"
    assert one(spark, text.nfc("t"), t="é") == "é" and one(spark, text.nfc("t"), t=None) is None
    assert [one(spark, f("p"), p="/x/a.b.JPG") for f in (text.basename, text.stem, text.suffix)] == ["a.b.JPG", "a.b", ".jpg"]
    assert one(spark, text.stem("p"), p=".hidden") == ".hidden"
    assert one(spark, text.listed("t", "double"), t="0.5, ,1") == [0.5, 1.0]
    assert one(spark, text.variant("t"), t="fp16_x_b16") == ("fp16_x", 16) and one(spark, text.variant("t"), t="fp16") is None


def test_ctc(spark):
    ids = F.array(*(F.lit(x) for x in [0, 1, 1, 0, 1, 2, 2, 3, 0, 0, 3]))
    assert one(spark, ctc.collapse(ids)) == [1, 1, 2, 3, 3]
    assert [one(spark, ctc.time_steps("w"), w=w) for w in (1, 3, 4, 7, 1536)] == [1, 1, 1, 1, 384]
    charset = ["<BLANK>", "a", "đ", " "]
    assert one(spark, ctc.encode(F.col("t"), charset), t="đ a") == [2, 3, 1]
    assert one(spark, ctc.decode(F.array(*(F.lit(x) for x in [2, 0, -1, 9, 1])), charset)) == "đa"
    with pytest.raises(Exception, match="not in the charset"):
        one(spark, ctc.encode(F.col("t"), charset), t="z")
    assert one(spark, ctc.feasible(F.lit(8), F.array(F.lit(1), F.lit(1)))) and not one(spark, ctc.feasible(F.lit(8), F.array(F.lit(1), F.lit(1)), strict=True))


PROFILE = [0, 0, 8, 9, 9, 8, 0, 1, 0, 7, 9, 8, 7, 0, 0, 3, 0, 9, 9, 8, 9, 0, 0]


def test_profile(spark):
    rows = spark.createDataFrame([("p", y, p) for y, p in enumerate(PROFILE)] + [("flat", y, 0) for y in range(5)], "page string, y int, p int")
    smoothed = profile.smooth(rows)
    want = np.convolve(PROFILE, np.ones(3) / 3, mode="same")
    assert np.allclose([r.s for r in smoothed.where("page = 'p'").orderBy("y").collect()], want)
    found = {r.page: r for r in profile.stable_threshold(smoothed).collect()}
    assert math.isclose(found["p"].threshold_ratio, 0.31) and found["p"].n_lines == 3 and found["flat"].n_lines == 0
    lines = profile.lines_at(smoothed.where("page = 'p'"), 0.31).orderBy("y0").collect()
    assert [(r.y0, r.y1) for r in lines] == [(2, 7), (9, 13), (16, 22)]
    tall = spark.createDataFrame([("q", y, 10 * (y % 50 < 20)) for y in range(400)], "page string, y int, p int")
    assert np.allclose([r.s for r in profile.smooth(tall).orderBy("y").collect()], np.convolve([10 * (y % 50 < 20) for y in range(400)], np.ones(5) / 5, mode="same"))
    assert profile.line_pitch(profile.smooth(tall)).first().pitch == 50 and profile.multiline(tall).first().multiline


def test_seam(spark):
    energy = [[1.0, 9.0, 9.0, 1.0], [2.0, 1.0, 9.0, 1.0], [3.0, 9.0, 1.0, 9.0]]
    df = spark.createDataFrame([(energy,), ([[2.0], [1.0]],)], "e array<array<double>>")
    costs = df.select(profile.seam_costs(F.col("e")).alias("c")).select("c", profile.seam(F.col("c")).alias("s")).collect()
    assert [list(r) for r in zip(*costs[0].c, strict=True)] == [[1, 10, 11, 12], [2, 2, 11, 4], [3, 11, 3, 12]] and costs[0].s == [0, 1, 2, 1] and costs[1].s == [1]


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("a b a b c",), ("b c d a",), ("a b d",), ("",), ("c",)], "text string")
    model = ngram.modified_kneser_ney(texts, 3).collect()
    uni = {r.token: r for r in model if r.length == 1}
    assert math.isclose(sum(r.p for r in uni.values()), 1)
    p2 = {(r.context, r.token): r for r in model if r.length == 2}
    for h in {c for c, _ in p2}:
        seen = {t: r.p for (c, t), r in p2.items() if c == h}
        back = uni[h].backoff if h in uni else None
        if back is not None:
            assert math.isclose(sum(seen.values()) + back * (1 - sum(uni[t].p for t in seen)), 1, abs_tol=1e-9)
    assert all(0 < r.p <= 1 or r.token == ngram.START and r.p == 0 for r in model)
    pairs = [p for (t,) in texts.collect() if t for p in itertools.pairwise(["<s>", *t.split(), "</s>"])] + [("<s>", "</s>")]
    kinds, found = set(pairs), ngram.kneser_ney_bigrams(texts).collect()
    for context in {a for a, _ in kinds}:
        seen = {r.token: r.p for r in found if r.context == context}
        rest = 0.75 * len(seen) / sum(a == context for a, _ in pairs) * sum(b not in seen for _, b in kinds) / len(kinds)
        assert math.isclose(sum(seen.values()) + rest, 1)
    pruned = {(r.length, r.context, r.token) for r in ngram.modified_kneser_ney(texts, 2, 1).collect()}
    assert {t for n, _, t in pruned if n == 1} <= set(uni) and (2, "a", "b") in pruned and (2, "c", "d") not in pruned


def test_word_edits_beyond_the_first_codes(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FIRST_CODE", 0xD7F0)
    rng = random.Random(1)
    rows = [(" ".join(a), " ".join(b)) for a, b in ((rng.sample(range(60), 50), rng.sample(range(70), 50)) for _ in range(20)) for a, b in ((map(str, a), map(str, b)),)]
    for r in spark.createDataFrame(rows, "r string, h string").select("r", "h", metrics.word_edits(F.col("r"), F.col("h")).alias("v")).collect():
        assert r.v == plain_edits(r.r.split(), r.h.split())


def test_reading_and_sizes(spark):
    charset = ["<BLANK>", "h", "o", "à", " ", ","]
    assert one(spark, ctc.read(F.array(*map(F.lit, (1, 2, 3, 4, 5, 4, 4))), charset), x=0) == "hòa,"
    assert one(spark, ctc.read(F.array(*map(F.lit, (1, 2, 3))), charset, tones=False), x=0) == "hoà"
    assert one(spark, ctc.read(F.array(F.lit(1), F.lit(2)), ["<BLANK>", "a", "\u0300"]), x=0) == "à"
    assert one(spark, text.absolute("/d/", F.col("p")), p="a/b.png") == "/d/a/b.png" and one(spark, text.absolute("/d", F.col("p")), p="/x") == "/x"
    assert tuple(one(spark, profile.limited(F.lit(4096), F.lit(3)), x=0)) == (2048, 2) and tuple(one(spark, profile.limited(F.lit(100), F.lit(1)), x=0)) == (100, 1)
    assert one(spark, profile.scale_to(F.lit(150 / 1.05)), x=0) != 1.0 and one(spark, profile.scaled(F.lit(1), F.lit(0.01)), x=0) == 1
    assert one(spark, profile.row_projection(F.array(F.array(F.lit(1), F.lit(0), F.lit(1)), F.array(F.lit(0)))), x=0) == [2, 0]
    assert [r.t for r in text.compose(spark.createDataFrame([("e\u0301",), ("ascii",), (None,)], "t string"), "t").orderBy("t").collect()] == [None, "ascii", "é"]


def test_evaluate_split(spark):
    samples = spark.createDataFrame([(f"p{k}", "abcd", "abcx" if k % 2 else "abcd") for k in range(10)], "path string, gt string, raw string")
    rates, failed = evaluate.evaluate_split(samples, F.col("raw"))
    assert (rates.first().n, rates.first().n_failures, failed.count()) == (10, 5, 5) and math.isclose(rates.first().cer, 0.125)
    assert evaluate.evaluate_split(samples, F.col("raw"), 4)[0].first().n == 4
    assert [r.path for r in evaluate.shuffled(samples, "path", 1).orderBy("pos").collect()] != [r.path for r in evaluate.shuffled(samples, "path", 1, 1).orderBy("pos").collect()]
    assert sorted(r.pos for r in evaluate.shuffled(samples, "path", 1).collect()) == list(range(10))
    with pytest.raises(ValueError):
        evaluate.score_grid(samples, spark.range(evaluate.MOST_POINTS + 1).selectExpr("id AS alpha", "id AS beta"), F.col("raw"))
    assert evaluate.score_grid(samples, spark.range(0).selectExpr("id AS alpha", "id AS beta"), F.col("raw")).count() == 0


def test_reports(spark):
    times = spark.createDataFrame([(float(x),) for x in (10, 12, 11, 30, 13)], "ms double")
    assert tuple(evaluate.latency_summary(times, (), batch=16).first()) == (12.0, 26.6, 1333.33)
    rng = random.Random(4)
    groups = [(g, rng.choice([1.5, 2.0, rng.random() * 9])) for g, n in (("a", 1), ("b", 2), ("c", 37), ("d", 400)) for _ in range(n)] + [("d", None), ("e", None)]
    found = {r.g: (r.low, r.mid, r.top) for r in evaluate.quantiles(spark.createDataFrame(groups, "g string, v double"), ("g",), "v", low=0.0, mid=0.37, top=1.0).collect()}
    for g in "abcd":
        assert np.allclose(found[g], np.quantile([v for h, v in groups if h == g and v is not None], [0, 0.37, 1]))
    assert set(found) == set("abcd") and evaluate.quantiles(times.limit(0), (), "ms", half=0.5).first().half is None
    failed = spark.createDataFrame([("p/2", 'a"b', "é"), ("p/1", "x\ny", "")], "path string, gt string, predict string")
    text_of = lambda df: "\n".join(r.line for r in sinks.failure_array(df).orderBy("pos").collect())
    assert text_of(failed) == json.dumps([{"path": "p/1", "gt": "x\ny", "predict": ""}, {"path": "p/2", "gt": 'a"b', "predict": "é"}], ensure_ascii=False, indent=2)
    assert json.loads(text_of(failed.limit(0))) == []
    few = spark.createDataFrame([(k,) for k in range(3)], "k int")
    assert [(r.k, r.batch_id, r.slot) for r in evaluate.calibration_batches(few, 4, "k").orderBy("slot").collect()] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (0, 0, 3)]
    many = spark.createDataFrame([(k,) for k in range(10)], "k int")
    assert evaluate.calibration_batches(many, 4, "k").count() == 8
    assert sorted(r.k for r in evaluate.calibration_batches(many, 4, "k", 7).collect()) == [0, 1, 2, 3]
    rates = spark.createDataFrame([("keras", 0.1, 0.2), ("int8", 0.125, 0.2)], "model string, cer double, wer double")
    assert {r.model: (r.cer_delta, r.wer_delta) for r in evaluate.accuracy_deltas(rates, ("keras", "ov_fp16")).collect()} == {"keras": (0.0, 0.0), "int8": (0.025, 0.0)}
    assert [r.line for r in sinks.report(rates.orderBy("model"), {"model": 6, "cer": 7}).collect()] == ["int8     0.125", "keras      0.1"]
    losses = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (3.0,)], "loss double")
    assert evaluate.masked_mean(losses).first().mean_loss == 1.0


@pytest.fixture
def tree(tmp_path):
    for writer, name, held in (("w1", "label.json", {"a.jpg": "mot", "b.png": "hai", "gone.jpg": "x"}), ("w1", "labels.json", {"a.jpg": "old"}), ("w2", "labels.json", {"c.jpg": "bá"})):
        folder = tmp_path / "train_data" / writer
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(held))
    (tmp_path / "train_data" / "w3").mkdir()
    (tmp_path / "train_data" / "w3" / "label.json").write_text("[1, 2]")
    for name in ("w1/a.jpg", "w1/b.JPEG", "w2/c.jpg", "w2/notes.txt", "w3/d.jpg"):
        (tmp_path / "train_data" / name).write_bytes(b"x")
    return str(tmp_path)


def test_discovery(spark, tree):
    found = [tuple(r) for r in files.discover(spark, tree, "train").collect()]
    assert found == [("train_data/w1/a.jpg", "mot", "w1"), ("train_data/w1/b.JPEG", "hai", "w1"), ("train_data/w2/c.jpg", "bá", "w2")]
    shown = files.images(spark, f"{tree}/train_data", "*/*").withColumn("writer", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    assert [r.name for r in labels.unmatched(files.label_files(spark, f"{tree}/train_data"), shown).collect()] == ["gone.jpg"]
    assert [r.text for r in files.load_split(spark, tree, "train", ["<BLANK>", *"motbaá"]).collect()] == ["mot", "bá"]
    told = {text_.path.rsplit("/", 1)[1]: text_.gt for text_ in labels.label_of_image(shown.select("path"), files.label_files(spark, f"{tree}/train_data").select("name", "text")).collect()}
    assert told == {"a.jpg": "mot", "b.JPEG": "hai", "c.jpg": "bá", "d.jpg": None}
    assert {tuple(r) for r in files.folder_labels(spark, f"{tree}/train_data/w2").collect()} == {("c.jpg", "bá")}
    assert labels.matched(files.label_files(spark, f"{tree}/train_data"), shown).first().n == 2
    with pytest.raises(ValueError):
        files.split_folder("dev")


def test_token_files_and_checks(spark, tmp_path):
    (tmp_path / "charset.txt").write_text("## comment\n<BLANK>\n#\n \n\na\n")
    assert files.load_charset(spark, str(tmp_path / "charset.txt")) == ["<BLANK>", "#", " ", "a"]
    (tmp_path / "bad.txt").write_text("a\na\n")
    with pytest.raises(ValueError):
        files.load_charset(spark, str(tmp_path / "bad.txt"))
    assert files.missing_files(spark, str(tmp_path), ("charset.txt", "model.xml")) == ["model.xml"]
    assert {r.sha256[:8] for r in files.digests(spark, str(tmp_path)).where("path LIKE '%bad.txt'").collect()} == {__import__("hashlib").sha256(b"a\na\n").hexdigest()[:8]}


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame([(" b a ",), ("",), ("a c",)], "text string")
    sinks.write_corpus(samples, str(tmp_path / "corpus"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "corpus")).collect()) == ["a c", "b a"]
    sinks.write_vocabulary(samples, str(tmp_path / "vocabulary"), spark.createDataFrame([("## no",), (" z ",), ("",)], "token string"))
    assert [r.value for r in spark.read.text(str(tmp_path / "vocabulary")).orderBy("value").collect()] == ["a", "b", "c", "z"]
    sinks.write_model(samples, str(tmp_path / "model"), 2)
    assert spark.read.parquet(str(tmp_path / "model")).where("length = 2").count() > 0
    with pytest.raises(RuntimeError):
        sinks.write_corpus(samples.where("text = ''"), str(tmp_path / "none"))


def test_streamed_rates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-01T00:01:00", "abcd", "abcx"), ("2024-01-01T00:02:00", "ab", "ab"), ("2024-01-01T01:00:00", "a", "b")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"ts": t, "gt": g, "predict": p}) for t, g, p in rows))
    live.windowed_rates(live.read_pairs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(60)
    assert [(r.cer, r.n) for r in spark.table("rates").orderBy("window").collect()] == [(0.125, 2), (1.0, 1)]

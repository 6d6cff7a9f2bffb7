"""What a query moves must not grow faster than its tables: plans and small tables that tell."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import inkline.plans.pages  # noqa: F401 adds its queries
from inkline.operators import beam, ngram, packed
from inkline.plans.queries import QUERIES

RASTERS = "otsu_ink page_equalized sauvola_ink sauvola_ink_small adaptive_ink ink_distance energy_rows stroke_widths skew_angles line_seams cut_pages page_shrunk page_stretched".split()


@pytest.mark.parametrize("name", RASTERS)
def test_pixels_are_neither_sorted_nor_joined(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page#" in plan
    assert not re.search(r"windowspecdefinition\(page#\d+L?, [xy]#\d+, |Join \[page#\d+L?, ", plan)
    assert len(re.findall(r"hashpartitioning\(page#\d+L?, [a-z]+#", plan)) <= 1 + (name == "cut_pages")  # counts of events, sums of lines


def test_only_the_longest_ngrams_are_counted_in_texts(spark, monkeypatch):
    asked, count = [], ngram.ngram_counts
    monkeypatch.setattr(ngram, "ngram_counts", lambda texts, order, *a, **b: asked.append(order) or count(texts, order, *a, **b))
    texts = spark.createDataFrame([("a <s> b",), ("<s> b a",)], "text string")  # a word that looks like the beginning
    found = {(r.context, r.token) for r in ngram.modified_kneser_ney(texts, 3).where("length = 2").collect()}
    assert asked == [3] and found == {("<s>", "a"), ("<s>", "b"), ("b", "</s>"), ("b", "a"), ("a", "</s>")}  # the beginning has no probability


def test_a_models_rows_are_not_shuffled(spark, monkeypatch):
    """N-grams go between tasks packed, some bytes a token, and are rows of words only where they are returned."""
    monkeypatch.setattr(packed, "BLOCK_TOKENS", 2000)
    texts = spark.range(3000).selectExpr("concat_ws(' ', transform(sequence(1, 20), k -> concat('w', hash(id, k) % 500))) AS text").coalesce(2).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ngram.modified_kneser_ney(texts, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\((context|token|gram|rest)#", plan) and "hashpartitioning(bucket#" in plan
    kept = ngram.ngram_counts(texts, 4, buckets=packed.labels_of(texts, "text"))
    size = kept.selectExpr("sum(length(words)) + sum(aggregate(windows, 0L, (a, w) -> a + length(w.grams) + length(w.counts)))").first()[0]
    assert kept.where("size(windows) <> 2").count() == 0 and size < 8 * 21 * 3000  # 63,000 windows, nearly all of them different
    texts.unpersist()


@pytest.mark.parametrize("order", [2, 3])
def test_runs_of_words_are_dealt_before_they_are_counted(spark, order):
    """No task collects the runs of its own texts: nearly all of them are new, and the table outgrows its memory."""
    texts = spark.createDataFrame([("a b\u3000a  b",), ("",), (None,), (" <s> ",), ("é,é a b",)], "text string")
    found = ngram.ngram_counts(texts, order)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" in plan and not re.search(r"Exchange.*HashAggregate", plan, re.S)
    runs = [tuple(w[k : k + order]) for t in ("a b a b", "", "<s>", "é,é a b") for w in [["<s>", *t.split(), "</s>"]] for k in range(len(w) - order + 1)]
    assert {(*r.context.split(" "), r.token): r.n for r in found.collect()} == {r: runs.count(r) for r in runs}


def test_a_bucket_is_one_file(spark):
    model = spark.range(0, 1000, 1, 6).selectExpr("'' AS context", "CAST(id AS string) AS token", "0.5D AS p", "0.1D AS backoff")
    assert len(ngram.model_table(model, 4).inputFiles()) == 4


def test_a_lookup_broadcasts_hot_ngrams_only(spark, sf, monkeypatch):
    """Spark takes a table of texts for small that has a large table of n-grams: it must not go through the driver."""
    plans, write = {}, ngram.written
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngram, "written", lambda df, name: plans.update({name: shown(df)}) or write(df, name))
    model = spark.range(1000).selectExpr("'' AS context", "CAST(id AS string) AS token", "0.5D AS p", "0.1D AS backoff")
    found = ngram.score(spark.read.parquet(f"{sf}/conversations.parquet"), ngram.model_table(model, 4), 3, "conv_id", "turn")
    assert "BroadcastHashJoin" not in plans["found-grams"] and "SortMergeJoin" in plans["found-grams"]
    assert not re.search(r"BroadcastHashJoin \[_row#|BroadcastHashJoin[^\n]*BuildLeft", shown(found)) and shown(found).count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("name", ["nfc", "normalize_transcripts", "normalize_deployed"])
def test_batches_of_whole_texts_are_bounded(spark, sf, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    QUERIES[name](spark, sf)
    assert int(spark.conf.get(key)) == 1000
    spark.conf.set(key, "10")
    QUERIES[name](spark, sf)
    assert int(spark.conf.get(key)) == 10  # a smaller bound stays
    spark.conf.unset(key)


def test_a_beams_weights_are_worked_out_once_a_prefix(spark):
    found = spark.range(1).select(beam.prefix_beam(F.expr("array(array(0.0D, 0.0D))"), 5))
    shown = found._jdf.queryExecution().analyzed().expressions().head().sql().lower()
    assert 0 < shown.count(" exp(") + shown.count("(exp(") <= 10  # 20 where each class that is tried adds them up anew

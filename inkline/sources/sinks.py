"""Writing failures, corpora, vocabularies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, ngram
from .files import BLANK


def failure_lines(failures: DataFrame) -> DataFrame:
    """``line``: a failure as a JSON object, non-ASCII kept."""
    return failures.select(F.to_json(F.struct("path", "gt", "predict"), {"ignoreNullFields": "false"}).alias("line"))


def write_failures(failures: DataFrame, path: str) -> None:
    """One JSON object a line."""
    failure_lines(failures).write.mode("overwrite").text(path)


def failure_array(failures: DataFrame) -> DataFrame:
    """``pos``, ``line``: the failures by path as one indented JSON array, a bracket, object by object and a bracket; in order of ``pos`` they are the document."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(?s)(.*)\}$', 1)
    placed = evaluate.numbered(failures.select("path", "gt", "predict"), F.col("path"))
    n = placed.agg(F.count("*").alias("n"))
    fields = F.concat_ws(",\n", *(F.concat(F.lit(f'    "{c}": '), quoted(c)) for c in ("path", "gt", "predict")))
    rows = placed.crossJoin(F.broadcast(n)).select((F.col("pos") + 1).alias("pos"), F.concat(F.lit("  {\n"), fields, F.lit("\n  }"), F.when(F.col("pos") + 1 < F.col("n"), ",").otherwise("")).alias("line"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("[").alias("line")), F.struct((F.col("n") + 1).alias("pos"), F.lit("]").alias("line")))).alias("e")).select("e.*")
    return rows.unionByName(ends)


def write_charset(tokens: DataFrame, path: str) -> None:
    """The blank, then ``token`` in code-point order, one a line in one file: a charset is bounded by the characters there are."""
    first = tokens.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(BLANK).alias("value"))
    rows = first.unionAll(tokens.select(F.lit(1), "token").distinct())
    rows.coalesce(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def write_corpus(samples: DataFrame, path: str) -> None:
    """Stripped transcripts, one a line; without any it is an error."""
    texts = ngram.corpus(samples)
    if texts.isEmpty():
        raise RuntimeError("the corpus is empty")
    texts.write.mode("overwrite").text(path)


def write_vocabulary(samples: DataFrame, path: str, lexicon: DataFrame | None = None) -> None:
    """Distinct words in order; range-partitioned, so that the files follow each other."""
    ngram.vocabulary(samples, lexicon).write.mode("overwrite").text(path)


def write_model(texts: DataFrame, path: str, order: int = 4, prune: int = 0) -> None:
    """A modified Kneser-Ney model as Parquet, a folder an n-gram length."""
    ngram.modified_kneser_ney(texts, order, prune).write.mode("overwrite").partitionBy("length").parquet(path)


def report(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines: numbers to the right, texts to the left."""
    kinds = dict(df.dtypes)
    cells = [F.rpad(F.coalesce(F.col(c), F.lit("")), w, " ") if kinds[c] == "string" else F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]
    return df.select(F.concat_ws(" ", *cells).alias("line"))

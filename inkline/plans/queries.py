"""One query for each operator family over the shared tables, with the same result in DuckDB's SQL where SQL can say it.

``documents`` stand in for transcripts (``source`` for the writer), neighbouring ``conversations`` turns for
reference and hypothesis, ``embeddings`` for 8 x 8 scores with class 0 as blank, ``events`` counted by user
and hour for row profiles, and event values for latencies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ctc, metrics, text
from ..operators import evaluate, labels, ngram, profile
from ..sources import files, sinks
from ..sources.scratch import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The classes of 8 x 8 scores, and the characters that texts may hold in the codec queries, after the blank.
LETTERS = ["<BLANK>", *"ho a,()"]
CHARSET = ["<BLANK>", *" abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()%-\n"]
#: Rows of whole texts in an Arrow batch at most.
BATCH = 1000


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A turn's text against the next turn's."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predict"))
    return turns.withColumnRenamed("text", "gt").join(after, ["conv_id", "turn"])


def rated_sql(source: str) -> str:
    """CTEs that give ``source`` (``gt``, ``predict``) its edits, rates and word rates as ``rates``. Distances count bytes, so that characters and common words become one byte each; words of one side alone match nothing."""
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
    code = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda c: chr(list_position(d, c))), '')"
    word_code = lambda ws, alone: f"array_to_string(list_transform({ws}, lambda w: chr(CASE WHEN list_contains(k, w) THEN list_position(k, w)::INT + 2 ELSE {alone} END)), '')"
    return f"""coded AS (SELECT *, list_distinct(list_concat(string_split(gt, ''), string_split(predict, ''))) AS d, {words('gt')} AS r, {words('predict')} AS h FROM {source}),
known AS (SELECT *, list_distinct(list_intersect(r, h)) AS k FROM coded),
rated AS (SELECT * EXCLUDE (d, k), levenshtein({code('gt')}, {code('predict')}) AS edits, levenshtein({word_code('r', 1)}, {word_code('h', 2)}) AS word_edits FROM known),
rates AS (SELECT *, CASE WHEN length(gt) > 0 THEN edits / length(gt) WHEN length(predict) = 0 THEN 0.0 ELSE 1.0 END AS cer, CASE WHEN len(r) > 0 THEN word_edits / len(r) WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END AS wer FROM rated)"""


PAIRS = f"""pairs AS (SELECT a.conv_id, a.turn, a.text AS gt, b.text AS predict FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1),
{rated_sql('pairs')}"""


@query(f"WITH {PAIRS} SELECT conv_id, turn, edits::BIGINT AS edits, round(cer, 9) AS cer FROM rates")
def pair_error_rates(spark, sf):
    gt, predict = F.col("gt"), F.col("predict")
    found = pairs(spark, sf).withColumn("edits", metrics.char_edits(gt, predict))
    return found.select("conv_id", "turn", F.col("edits").cast("long").alias("edits"), F.round(metrics.cer(gt, predict, F.col("edits")), 9).alias("cer"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, word_edits::INTEGER AS edits, round(wer, 9) AS wer FROM rates")
def pair_word_rates(spark, sf):
    gt, predict = F.col("gt"), F.col("predict")
    return pairs(spark, sf).select("conv_id", "turn", metrics.word_edits(gt, predict).alias("edits"), F.round(metrics.wer(gt, predict), 9).alias("wer"))


@query(f"WITH {PAIRS} SELECT round(coalesce(avg(cer), 0), 9) AS cer, round(coalesce(avg(wer), 0), 9) AS wer, round(coalesce(sum(edits) / sum(length(gt)), 0), 9) AS micro_cer, count(*) AS n FROM rates")
def corpus_error_rates(spark, sf):
    return evaluate.corpus_rates(pairs(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("cer", "wer", "micro_cer")), "n")


SAMPLED = "picked AS (SELECT conv_id || '/' || turn AS path, gt, predict FROM pairs ORDER BY md5('42:' || path), path LIMIT 100)"


def split(spark, sf) -> DataFrame:
    return pairs(spark, sf).withColumn("path", F.concat_ws("/", "conv_id", "turn"))


@query(f"WITH {PAIRS.partition(',' + chr(10))[0]}, {SAMPLED}, {rated_sql('picked')} SELECT round(avg(cer), 9) AS cer, round(avg(wer), 9) AS wer, count(*) AS n, count(*) FILTER (gt <> predict) AS n_failures FROM rates")
def split_rates(spark, sf):
    rates, _ = evaluate.evaluate_split(split(spark, sf), F.col("predict"), 100)
    return rates.select(F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "n", "n_failures")


@query(f"WITH {PAIRS.partition(',' + chr(10))[0]}, {SAMPLED} SELECT * FROM picked WHERE gt <> predict")
def split_failures(spark, sf):
    return evaluate.evaluate_split(split(spark, sf), F.col("predict"), 100)[1]


@query(f"WITH {PAIRS} SELECT conv_id, turn, gt, predict FROM pairs WHERE gt <> predict")
def failures(spark, sf):
    return evaluate.failures(pairs(spark, sf)).select("conv_id", "turn", "gt", "predict")


@query(f"WITH {PAIRS} SELECT conv_id, turn, gt AS reference, predict AS hypothesis, edits::BIGINT AS levenshtein, round(cer, 9) AS cer, round(wer, 9) AS wer, length(gt)::BIGINT AS ref_len, gt = predict AS exact FROM rates")
def compare_prediction(spark, sf):
    c = F.col("c")
    found = pairs(spark, sf).select("conv_id", "turn", metrics.comparison(F.col("gt"), F.col("predict")).alias("c"))
    return found.select("conv_id", "turn", c["reference"].alias("reference"), c["hypothesis"].alias("hypothesis"), c["levenshtein"].cast("long").alias("levenshtein"), F.round(c["cer"], 9).alias("cer"), F.round(c["wer"], 9).alias("wer"), c["ref_len"].cast("long").alias("ref_len"), c["exact"].alias("exact"))


ALLOWED = "[" + ", ".join("chr(%d)" % ord(c) for c in CHARSET[1:]) + "]"
INSIDE = f"len(list_filter(string_split(text, ''), lambda c: c <> '' AND NOT list_contains({ALLOWED}, c))) = 0"


@query(f"SELECT doc_id FROM documents WHERE {INSIDE}")
def oov_filter(spark, sf):
    return table(spark, sf, "documents").where(ctc.has_only(F.col("text"), CHARSET)).select("doc_id")


@query("SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents")
def charset_build(spark, sf):
    return table(spark, sf, "documents").select(F.explode(text.chars("text")).alias("ch")).distinct()


@query(f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: list_position({ALLOWED}, c)), ',')) AS ids_md5, length(text)::BIGINT AS n FROM documents WHERE {INSIDE} AND text <> ''")
def charset_encode(spark, sf):
    known = table(spark, sf, "documents").where(ctc.has_only(F.col("text"), CHARSET) & (F.col("text") != ""))
    coded = known.select("doc_id", ctc.encode(F.col("text"), CHARSET).alias("ids"))
    return coded.select("doc_id", F.md5(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")).alias("ids_md5"), F.size("ids").cast("long").alias("n"))


@query(f"SELECT doc_id, text FROM documents WHERE {INSIDE}")
def charset_round_trip(spark, sf):
    known = table(spark, sf, "documents").where(ctc.has_only(F.col("text"), CHARSET))
    return known.select("doc_id", ctc.decode(ctc.encode(F.col("text"), CHARSET), CHARSET).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.squeeze("text").alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+([,.;:!?%)])', '\\1', 'g'), '\\(\\s+', '(', 'g') AS text FROM documents")
def fix_punctuation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fix_punctuation("text").alias("text"))


def tones_sql(value: str) -> str:
    """All moves twice: a match takes the characters beside it, which the next one may need."""
    for _ in range(2):
        for old, new in text.tone_moves().items():
            before = "(^|[^qQ])" if old[0] in "uU" else "()"
            value = f"regexp_replace({value}, '{before}{old}($|[^\\pL\\pM\\pN\\p{{Pc}}])', '\\1{new}\\2', 'g')"
    return value


@query(f"SELECT doc_id, {tones_sql('text')} AS text FROM documents")
def tone_placement(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.place_tones("text").alias("text"))


def short_batches(spark: SparkSession) -> None:
    """Texts can be long: batches for Python are bounded, so that its memory doesn't grow with the rows of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    spark.conf.set(key, str(min(held, BATCH) if held > 0 else BATCH))


def composed(spark, sf) -> DataFrame:
    """Documents in NFC."""
    short_batches(spark)
    return text.compose(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc(spark, sf):
    return composed(spark, sf)


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({tones_sql('nfc_normalize(text)')}, '\\s+([,.;:!?%)])', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_transcripts(spark, sf):
    return composed(spark, sf).select("doc_id", text.normalize("text", composed=True).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\s+([,.;:!?%)])', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_deployed(spark, sf):
    """As a deployed reader does: tones stay where they are."""
    return composed(spark, sf).select("doc_id", text.normalize("text", tones=False, composed=True).alias("text"))


@query("WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS token FROM documents) SELECT token FROM w WHERE token NOT LIKE '##%'")
def unigram_file(spark, sf):
    """The vocabulary written as a file and read again."""
    path = shared(spark, "unigrams")
    sinks.write_vocabulary(table(spark, sf, "documents"), path)
    return files.token_file(spark, path).select("token")


@query("WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents), k AS (SELECT token FROM c WHERE NOT regexp_matches(token, '^[\\r\\n\\x0B\\f\\x85\\x{2028}\\x{2029}]*$') AND token <> '') SELECT 0 AS pos, '<BLANK>' AS token UNION ALL SELECT row_number() OVER (ORDER BY encode(token)), token FROM k")
def charset_file(spark, sf):
    """The charset of all texts, a token a line behind the blank, written as a file and read again."""
    path = shared(spark, "charset")
    known = table(spark, sf, "documents").select(F.explode(text.chars("text")).alias("token")).distinct().where(~F.col("token").rlike(r"^[\r\n\x0b\f\x85\u2028\u2029]$"))
    sinks.write_charset(known, path)
    return spark.createDataFrame(list(enumerate(files.load_charset(spark, path))), "pos long, token string")


STEPS = "list_transform(range(8), lambda t: embedding[t * 8 + 1 : t * 8 + 8])"
IDS = f"list_transform({STEPS}, lambda r: list_position(r, list_max(r)) - 1)"


def scores(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", ctc.matrix("embedding", 8).alias("logits"))


def joined_ids(ids: Column) -> Column:
    return F.concat_ws(",", ids.cast("array<string>"))


@query(f"WITH x AS (SELECT vec_id, {IDS} AS ids FROM embeddings) SELECT vec_id, array_to_string(list_filter(list_transform(range(1, 9), lambda t: CASE WHEN ids[t] <> 0 AND (t = 1 OR ids[t] <> ids[t - 1]) THEN ids[t] END), lambda c: c IS NOT NULL), ',') AS ids FROM x")
def ctc_greedy(spark, sf):
    return scores(spark, sf).select("vec_id", joined_ids(ctc.greedy("logits")).alias("ids"))


@query(f"""WITH x AS (SELECT vec_id, unnest(range(8)) AS t, unnest({STEPS}) AS r FROM embeddings), y AS (SELECT vec_id, t, unnest(range(8)) AS c, unnest(r)::DOUBLE AS v FROM x)
SELECT vec_id, t, c, round(v - max(v) OVER w - ln(sum(exp(v - m)) OVER w), 6) AS lp FROM (SELECT *, max(v) OVER (PARTITION BY vec_id, t) AS m FROM y) WINDOW w AS (PARTITION BY vec_id, t)""")
def log_softmax(spark, sf):
    steps = scores(spark, sf).select("vec_id", F.posexplode(ctc.log_softmax("logits")).alias("t", "row"))
    return steps.select("vec_id", F.col("t").cast("long").alias("t"), F.posexplode("row").alias("c", "lp")).select("vec_id", "t", F.col("c").cast("long").alias("c"), F.round("lp", 6).alias("lp"))


@query("SELECT vec_id, least(greatest(label * 3 // 4, 1), 8)::BIGINT AS steps FROM embeddings")
def ctc_trim(spark, sf):
    return scores(spark, sf).select("vec_id", F.size(ctc.trim(F.col("logits"), F.col("label") * 3)).cast("long").alias("steps"))


@query(f"WITH x AS (SELECT vec_id, label, {IDS} AS ids FROM embeddings), y AS (SELECT *, len(list_filter(range(1, 9), lambda t: ids[t] <> 0 AND (t = 1 OR ids[t] <> ids[t - 1]))) AS n FROM x) SELECT vec_id FROM y WHERE greatest(label * 3 // 4, 1) >= n")
def ctc_feasible(spark, sf):
    return scores(spark, sf).withColumn("ids", ctc.greedy("logits")).where(ctc.feasible(F.col("label") * 3, F.col("ids"))).select("vec_id")


def rows_of_pages(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    counted = events.groupBy(F.col("user_id").alias("page"), F.hour("ts").alias("y")).agg(F.count("*").alias("p"))
    grid = events.select(F.col("user_id").alias("page")).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(counted, ["page", "y"], "left").select("page", "y", F.coalesce("p", F.lit(0)).alias("p"))


PROFILE = """c AS (SELECT user_id AS page, hour(ts) AS y, count(*) AS p FROM events GROUP BY ALL),
prof AS (SELECT page, y, coalesce(p, 0) AS p FROM (SELECT DISTINCT user_id AS page FROM events) CROSS JOIN (SELECT unnest(range(24)) AS y) LEFT JOIN c USING (page, y)),
sm AS (SELECT page, y, p, sum(p) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM prof)"""


def lines_sql(source: str, ratio: str, by: str, least: str) -> str:
    return f"""e AS (SELECT *, s > max(s) OVER (PARTITION BY {by}) * {ratio} AS ink FROM {source}),
r AS (SELECT *, (ink AND NOT lag(ink, 1, false) OVER (PARTITION BY {by} ORDER BY y))::INT AS rise FROM e),
u AS (SELECT *, sum(rise) OVER (PARTITION BY {by} ORDER BY y) AS run FROM r),
l AS (SELECT {by}, run, min(y) AS y0, max(y) + 1 AS y1 FROM u WHERE ink GROUP BY ALL),
j AS (SELECT *, median(y1 - y0) OVER (PARTITION BY {by}) AS m, count(*) OVER (PARTITION BY {by}) AS n FROM l),
lines AS (SELECT {by}, y0, y1 FROM j WHERE n < 2 OR y1 - y0 >= m * {least})"""


@query(f"WITH {PROFILE} SELECT page, y::BIGINT AS y, p, round(s, 9) AS s FROM sm")
def profile_smooth(spark, sf):
    return profile.smooth(rows_of_pages(spark, sf)).select("page", F.col("y").cast("long").alias("y"), "p", F.round("s", 9).alias("s"))


@query(f"WITH {PROFILE}, {lines_sql('sm', '0.5::DOUBLE', 'page', '0.3')} SELECT page, y0::BIGINT AS y0, y1::BIGINT AS y1 FROM lines")
def line_boundaries(spark, sf):
    return profile.lines_at(profile.smooth(rows_of_pages(spark, sf)), 0.5).select("page", F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


@query(f"""WITH {PROFILE}, g AS (SELECT sm.*, k, 0.01::DOUBLE + k * (0.49::DOUBLE / 49) AS ratio FROM sm CROSS JOIN (SELECT unnest(range(50)) AS k)),
{lines_sql('g', 'ratio', 'page, k', '0.3')},
n AS (SELECT page, k, count(lines.y0) AS n FROM (SELECT DISTINCT page FROM prof) CROSS JOIN (SELECT unnest(range(50)) AS k) LEFT JOIN lines USING (page, k) GROUP BY ALL),
i AS (SELECT *, k - row_number() OVER (PARTITION BY page, n ORDER BY k) AS island FROM n),
p AS (SELECT page, n, min(k) AS start, count(*) AS len FROM i GROUP BY page, n, island),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY len DESC, start) AS place FROM p)
SELECT page, round(0.01::DOUBLE + (start + len // 2) * (0.49::DOUBLE / 49), 9) AS threshold_ratio, n::BIGINT AS n_lines FROM b WHERE place = 1""")
def stability_threshold(spark, sf):
    return profile.stable_threshold(profile.smooth(rows_of_pages(spark, sf))).select("page", F.round("threshold_ratio", 9).alias("threshold_ratio"), "n_lines")


@query(f"""WITH {PROFILE}, {lines_sql('sm', '0.8::DOUBLE', 'page', '0')}, d AS (SELECT page, (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page ORDER BY y0) AS step FROM lines), q AS (SELECT page, median(step) AS pitch FROM d GROUP BY page)
SELECT page, pitch, round(CASE WHEN pitch >= 10 THEN pitch / (10 / 25.4::DOUBLE) ELSE 2.0 / (0.4 / 25.4::DOUBLE) END, 6) AS dpi FROM q""")
def line_pitch_dpi(spark, sf):
    found = profile.line_pitch(profile.smooth(rows_of_pages(spark, sf)), 0.8)
    return found.select("page", "pitch", F.round(profile.dpi(F.col("pitch"), F.lit(2.0)), 6).alias("dpi"))


@query(f"WITH {PROFILE}, e AS (SELECT *, p > max(p) OVER (PARTITION BY page) * 0.8 AS ink FROM prof), r AS (SELECT *, (ink AND NOT lag(ink, 1, false) OVER (PARTITION BY page ORDER BY y))::INT AS rise FROM e) SELECT page, count(*) >= 24 AND sum(rise) >= 2 AS multiline FROM r GROUP BY page")
def multiline_flag(spark, sf):
    return profile.multiline(rows_of_pages(spark, sf), 24, 0.8)


@query(f"""WITH RECURSIVE m AS (SELECT vec_id, list_transform({STEPS}, lambda r: list_transform(r, lambda v: v::DOUBLE)) AS e FROM embeddings),
c AS (SELECT vec_id, e, 1 AS x, [list_transform(e, lambda r: r[1])] AS a FROM m UNION ALL SELECT vec_id, e, x + 1, list_append(a, list_transform(range(1, 9), lambda y: e[y][x + 1] + least(CASE WHEN y > 1 THEN a[x][y - 1] END, a[x][y], CASE WHEN y < 8 THEN a[x][y + 1] END))) FROM c WHERE x < 8),
b AS (SELECT vec_id, a, 8 AS x, [list_position(a[8], list_min(a[8]))] AS s FROM c WHERE x = 8
UNION ALL SELECT vec_id, a, x - 1, list_prepend(greatest(s[1] - 1, 1) - 1 + list_position(a[x - 1][greatest(s[1] - 1, 1) : least(s[1] + 1, 8)], list_min(a[x - 1][greatest(s[1] - 1, 1) : least(s[1] + 1, 8)])), s) FROM b WHERE x > 1)
SELECT vec_id, array_to_string(list_transform(s, lambda v: v - 1), ',') AS seam FROM b WHERE x = 1""")
def seam_dp(spark, sf):
    costs = scores(spark, sf).withColumn("energy", F.transform("logits", lambda r: F.transform(r, lambda x: x.cast("double")))).withColumn("costs", profile.seam_costs(F.col("energy")))
    return costs.select("vec_id", joined_ids(profile.seam(F.col("costs"))).alias("seam"))


WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
BIGRAMS = f"w AS (SELECT list_concat(['<s>'], {WORDS}, ['</s>']) AS w FROM documents), g AS (SELECT unnest(w[1:-2]) AS context, unnest(w[2:]) AS token FROM w), c AS (SELECT context, token, count(*) AS n FROM g GROUP BY ALL)"


@query(f"WITH {BIGRAMS} SELECT context, token, n FROM c")
def ngram_counts(spark, sf):
    return ngram.ngram_counts(table(spark, sf, "documents"), 2)


@query(f"""WITH {BIGRAMS}, a AS (SELECT context, sum(n) AS total, count(*) AS kinds FROM c GROUP BY ALL), b AS (SELECT token, count(*) AS histories FROM c GROUP BY ALL)
SELECT context, token, round((n - 0.75::DOUBLE) / total + 0.75::DOUBLE * kinds / total * histories / (SELECT count(*) FROM c), 9) AS p FROM c JOIN a USING (context) JOIN b USING (token)""")
def kn_probs(spark, sf):
    return ngram.kneser_ney_bigrams(table(spark, sf, "documents")).withColumn("p", F.round("p", 9))


@query()
def modified_kn(spark, sf):
    short_batches(spark)
    return ngram.modified_kneser_ney(ngram.corpus(table(spark, sf, "documents")), 4).select("length", "context", "token", F.round("p", 9).alias("p"), F.round("backoff", 9).alias("backoff"))


@query("SELECT line FROM (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> ''")
def corpus_lines(spark, sf):
    return ngram.corpus(table(spark, sf, "documents")).withColumnRenamed("text", "line")


@query(f"WITH {PAIRS.partition(',' + chr(10))[0]} SELECT to_json(struct_pack(path := conv_id || '/' || turn, gt := gt, predict := predict))::VARCHAR AS line FROM pairs WHERE gt <> predict")
def failure_lines(spark, sf):
    return sinks.failure_lines(evaluate.failures(split(spark, sf)))


@query(f"""WITH {PAIRS.partition(',' + chr(10))[0]}, f AS (SELECT conv_id || '/' || turn AS path, gt, predict, row_number() OVER (ORDER BY conv_id || '/' || turn) AS k, count(*) OVER () AS n FROM pairs WHERE gt <> predict)
SELECT k AS pos, '  {{{{' || chr(10) || '    "path": ' || to_json(path) || ',' || chr(10) || '    "gt": ' || to_json(gt) || ',' || chr(10) || '    "predict": ' || to_json(predict) || chr(10) || '  }}}}' || CASE WHEN k < n THEN ',' ELSE '' END AS line FROM f
UNION ALL SELECT 0, '[' UNION ALL SELECT count(*) + 1, ']' FROM f""".replace("{{", "{").replace("}}", "}"))
def failure_array(spark, sf):
    return sinks.failure_array(evaluate.failures(split(spark, sf)))


@query("SELECT rpad(event_type, 12, ' ') || ' ' || lpad(count(*)::VARCHAR, 8, ' ') AS line FROM events GROUP BY event_type")
def report_lines(spark, sf):
    return sinks.report(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), {"event_type": 12, "n": 8})


@query(f"SELECT DISTINCT token FROM (SELECT unnest({WORDS}) AS token FROM documents UNION ALL SELECT unnest({WORDS}) FROM benchmark)")
def unigram_vocab(spark, sf):
    lexicon = table(spark, sf, "benchmark").select(F.explode(text.tokens("text")).alias("token"))
    return ngram.vocabulary(table(spark, sf, "documents"), lexicon)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 3) AS latency_ms_p50, round(quantile_cont(value, 0.95), 3) AS latency_ms_p95, CASE WHEN quantile_cont(value, 0.5) > 0 THEN round(16000 / quantile_cont(value, 0.5), 2) ELSE 0 END AS images_per_s FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    return evaluate.latency_summary(table(spark, sf, "events"), ("event_type",), "value", 16)


@query("""WITH r AS (SELECT lang AS model, avg(toxic) AS cer, avg(quality) AS wer, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang), b AS (SELECT cer AS bc, wer AS bw FROM r WHERE model IN ('xx', 'en') ORDER BY model = 'en' LIMIT 1)
SELECT model, round(cer, 9) AS cer, round(wer, 9) AS wer, n, round(cer - bc, 4) AS cer_delta, round(wer - bw, 4) AS wer_delta FROM r CROSS JOIN b""")
def accuracy_delta(spark, sf):
    rates = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy(F.col("lang").alias("model")).agg(F.avg("toxic").alias("cer"), F.avg("quality").alias("wer"), F.count("*").alias("n"))
    return evaluate.accuracy_deltas(rates, ("xx", "en")).withColumns({"cer": F.round("cer", 9), "wer": F.round("wer", 9)})


PRIOR = [0.0, -0.3, -0.9, -0.6, -1.2, -0.7, -0.8, -1.0]
GRID_SQL = f"""WITH g AS (SELECT a / 2 AS alpha, b::DOUBLE AS beta FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(2)) AS b)),
u AS (SELECT vec_id, alpha, beta, list_transform({{steps}}, lambda r: list_transform(range(1, 9), lambda c: r[c]::DOUBLE + alpha * {PRIOR}[c]::DOUBLE + beta * (c > 1)::INT)) AS m, {{ids}} AS plain FROM embeddings, g),
i AS (SELECT vec_id, alpha, beta, plain, list_transform(m, lambda r: list_position(r, list_max(r)) - 1) AS tried FROM u),
x AS (SELECT alpha, beta, {{plain}} AS gt, {{tried}} AS predict FROM i), {rated_sql('x')}, y AS (SELECT alpha, beta, avg(cer) AS cer, avg(wer) AS wer, count(*) AS n FROM rates GROUP BY ALL)"""


def read_sql(ids: str) -> str:
    """Text of argmax ids: collapsed, decoded, punctuation and white space set right."""
    kept = f"list_filter(list_transform(range(1, 9), lambda t: CASE WHEN {ids}[t] <> 0 AND (t = 1 OR {ids}[t] <> {ids}[t - 1]) THEN {ids}[t] END), lambda c: c IS NOT NULL)"
    letters = "[" + ", ".join(f"'{c}'" for c in LETTERS[1:]) + "]"
    joined = f"array_to_string(list_transform({kept}, lambda c: {letters}[c]), '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({joined}, '\\s+([,.;:!?%)])', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+', ' ', 'g'))"


GRID_SQL = GRID_SQL.format(steps=STEPS, ids=IDS, plain=read_sql("plain"), tried=read_sql("tried"))


def tuned(spark, sf) -> DataFrame:
    """Each grid point's rates: scores plus ``alpha`` times a character's log weight and ``beta`` a character, decoded anew; log-probabilities are worked out once a row."""
    outputs = scores(spark, sf).select(ctc.read(ctc.greedy("logits"), LETTERS).alias("gt"), ctc.log_softmax("logits").alias("lp"))
    grid = spark.range(6).select((F.floor(F.col("id") / 2) * 0.5).cast("double").alias("alpha"), (F.col("id") % 2).cast("double").alias("beta"))
    prior = F.array(*(F.lit(x) for x in PRIOR))
    weighed = F.transform("lp", lambda row: F.transform(row, lambda x, c: x + F.col("alpha") * F.get(prior, c) + F.col("beta") * (c > 0).cast("int")))
    return evaluate.score_grid(outputs, grid, ctc.read(ctc.greedy(weighed), LETTERS))


@query(f"{GRID_SQL} SELECT alpha, beta, round(cer, 9) AS cer, round(wer, 9) AS wer, n FROM y")
def tuning_grid(spark, sf):
    return tuned(spark, sf).select("alpha", "beta", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "n")


@query(f"{GRID_SQL} SELECT alpha, beta, round(cer, 9) AS cer, round(wer, 9) AS wer, n FROM y ORDER BY y.cer, alpha, beta LIMIT 1")
def grid_best(spark, sf):
    return evaluate.best_point(tuned(spark, sf)).select("alpha", "beta", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), "n")


@query(f"WITH x AS (SELECT vec_id, {IDS} AS ids FROM embeddings) SELECT vec_id, {read_sql('ids')} AS text FROM x")
def decode_normalize(spark, sf):
    return scores(spark, sf).select("vec_id", ctc.read(ctc.greedy("logits"), LETTERS).alias("text"))


@query(f"WITH x AS (SELECT vec_id, unnest(range(8)) AS y, unnest({STEPS}) AS r FROM embeddings) SELECT vec_id, y, len(list_filter(r, lambda v: v > 0))::BIGINT AS p FROM x")
def row_projection(spark, sf):
    ink = F.transform("logits", lambda row: F.transform(row, lambda v: (v > 0).cast("int")))
    return scores(spark, sf).select("vec_id", F.posexplode(profile.row_projection(ink)).alias("y", "p")).select("vec_id", F.col("y").cast("long").alias("y"), "p")


@query("""WITH x AS (SELECT doc_id, n_chars, doc_id % 3000 + 1 AS w, CASE WHEN greatest(n_chars, doc_id % 3000 + 1) <= 2048 THEN 1.0 ELSE 2048::DOUBLE / greatest(n_chars, doc_id % 3000 + 1) END::DOUBLE AS scale FROM documents)
SELECT doc_id, greatest(1, round_even(n_chars * scale, 0))::INTEGER AS height, greatest(1, round_even(w * scale, 0))::INTEGER AS width FROM x""")
def size_limit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", profile.limited(F.col("n_chars"), F.col("doc_id") % 3000 + 1).alias("size")).select("doc_id", "size.height", "size.width")


#: Names of model folders that events make: a precision, or the event's type, and a batch; some are no variants.
NAMES_SQL = """names AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'notes' ELSE CASE event_id % 4 WHEN 0 THEN 'int8' WHEN 1 THEN 'fp16' WHEN 2 THEN 'fp16_x' ELSE event_type END || '_b' || (user_id % 3 * 15 % 29 + 1) END AS name FROM events),
variants AS (SELECT user_id, name, regexp_extract(name, '^(.+)_b(\\d+)$', 1) AS precision, regexp_extract(name, '^(.+)_b(\\d+)$', 2)::INTEGER AS batch FROM names WHERE name <> 'notes')"""


def variants(spark, sf) -> DataFrame:
    precision = F.when(F.col("event_id") % 4 == 0, "int8").when(F.col("event_id") % 4 == 1, "fp16").when(F.col("event_id") % 4 == 2, "fp16_x").otherwise(F.col("event_type"))
    named = F.when(F.col("event_id") % 5 == 0, "notes").otherwise(F.concat(precision, F.lit("_b"), (F.col("user_id") % 3 * 15 % 29 + 1).cast("string")))
    return table(spark, sf, "events").select("user_id", named.alias("name")).withColumn("v", text.variant("name")).where("v IS NOT NULL").select("user_id", "name", "v.precision", "v.batch")


@query(f"WITH {NAMES_SQL} SELECT name, precision, batch, count(*) AS n FROM variants GROUP BY ALL")
def variant_names(spark, sf):
    return variants(spark, sf).groupBy("name", "precision", "batch").agg(F.count("*").alias("n"))


@query(f"WITH {NAMES_SQL} SELECT DISTINCT user_id, precision, batch, (CASE precision WHEN 'fp16' THEN 0 ELSE 1 END + CASE batch WHEN 1 THEN 0 ELSE 2 END)::INTEGER AS place FROM variants WHERE precision IN ('fp16', 'int8') AND batch IN (1, 16)")
def variant_grid(spark, sf):
    return evaluate.variant_grid(("fp16", "int8"), (1, 16), variants(spark, sf), ("user_id",))


@query(f"""WITH {NAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE precision || batch WHEN 'int81' THEN 0 WHEN 'fp161' THEN 1 WHEN 'int816' THEN 2 WHEN 'fp1616' THEN 3 ELSE 4 END, precision <> 'int8', batch, precision) AS k FROM variants)
SELECT user_id, precision, batch FROM r WHERE k = 1""")
def pick_variant(spark, sf):
    return evaluate.pick_variant(variants(spark, sf), by=("user_id",))


@query("SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0)")
def matched_labels(spark, sf):
    return labels.matched(*named(spark, sf))


@query("SELECT page_id, CASE WHEN url LIKE '/%' THEN url ELSE '/data/' || url END AS path FROM pages")
def absolute_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.absolute("/data", "url").alias("path"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:2:' || doc_id), doc_id) - 1 AS pos FROM documents")
def seeded_shuffle(spark, sf):
    return evaluate.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 7, 2)


@query("SELECT source AS writer, doc_id::VARCHAR || '.png' AS name, toxic::VARCHAR AS text, source || '/' || doc_id || CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN '.jpg' ELSE '.png' END AS path FROM documents JOIN labels USING (doc_id)")
def label_join(spark, sf):
    return labels.resolve_images(*named(spark, sf)).select("writer", "name", "text", "path")


def named(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labels called after .png files; images of low quality are .jpg files, so that only their stem is the same."""
    docs, known = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    shown = docs.join(known.select("doc_id", "quality"), "doc_id", "left")
    ending = F.when(F.col("quality") == 0, ".jpg").otherwise(".png")
    images = shown.select(F.col("source").alias("writer"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"))
    found = docs.join(known, "doc_id").select(F.col("source").alias("writer"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), F.col("toxic").cast("string").alias("text"))
    return found, images


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_count(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def sample_n(spark, sf):
    return evaluate.sample_n(table(spark, sf, "documents").select("doc_id"), 50, "doc_id")


@query("WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark) SELECT item_id, (pos // 16)::INTEGER AS batch_id, (pos % 16)::INTEGER AS slot FROM p WHERE pos < n // 16 * 16")
def calibration_batches(spark, sf):
    return evaluate.calibration_batches(table(spark, sf, "benchmark").select("item_id"), 16, "item_id")


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_labels(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "text"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, length(url)::BIGINT AS n FROM pages")
def basenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.basename("url").alias("name"), F.length("url").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, sum(length(text))::BIGINT AS ms FROM conversations GROUP BY conv_id")
def paragraphs(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("line_no"), "text", F.length("text").cast("long").alias("ms"))
    return evaluate.paragraph(lines, "conv_id")


@query("SELECT event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def best_so_far(spark, sf):
    return evaluate.best_so_far(table(spark, sf, "events"), "event_id", "value", "user_id").select("event_id", "best", "improved")


@query("SELECT round(avg(CASE WHEN value > 1 THEN ln(value) ELSE 0 END), 9) AS mean_loss FROM events")
def masked_mean(spark, sf):
    losses = table(spark, sf, "events").select(F.when(F.col("value") > 1, F.log("value")).otherwise(float("nan")).alias("loss"))
    return evaluate.masked_mean(losses).select(F.round("mean_loss", 9).alias("mean_loss"))


@query("WITH r AS (SELECT CASE WHEN label % 2 = 0 THEN 'int8' ELSE 'fp16' END AS precision, embedding[1]::DOUBLE AS cer FROM embeddings) SELECT round(avg(cer) FILTER (precision = 'int8') - avg(cer) FILTER (precision = 'fp16'), 9) AS cer_drop, avg(cer) FILTER (precision = 'int8') - avg(cer) FILTER (precision = 'fp16') > 0.01 AS warn FROM r")
def precision_drop(spark, sf):
    rates = table(spark, sf, "embeddings").select(F.when(F.col("label") % 2 == 0, "int8").otherwise("fp16").alias("precision"), F.get("embedding", F.lit(0)).cast("double").alias("cer"))
    return evaluate.precision_drop(rates).withColumn("cer_drop", F.round("cer_drop", 9))


@query("SELECT '| ' || event_type || ' | ' || count(*) || ' |' AS line FROM events GROUP BY event_type")
def markdown_rows(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(text.markdown_row("event_type", "n").alias("line"))

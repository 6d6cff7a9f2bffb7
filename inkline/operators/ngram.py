"""n-gram counts, interpolated Kneser-Ney probabilities and vocabularies by grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import strip, tokens
from ..sources.scratch import bucketed, written
from . import packed
from .packed import END, START

#: Shares of the n-grams asked for from which one is hot: there are as many at most, and they are broadcast.
HOT_SHARE = 10_000


def corpus(samples: DataFrame, text: str = "text") -> DataFrame:
    """Stripped transcripts, empty ones dropped."""
    return samples.select(strip(text).alias("text")).where(F.col("text") != "")


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(END)))


def grams(words: Column, order: int) -> Column:
    """All runs of ``order`` words, sentence marks included."""

    def runs(w: Column) -> Column:
        last = F.size(w) - order
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(w, k + 1, F.lit(order)))

    return let(padded(words), runs)


def ngram_counts(texts: DataFrame, order: int, prune: int = 0, text: str = "text", buckets: Sequence[int] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``context`` (blank-joined), ``token``, ``n``: counts above ``prune``. With ``buckets`` all counts, packed (``packed.counted``).

    Single words are combined before the shuffle. About every second pair of neighbours is a new one, so that a table of them outgrows a task's memory
    and is sorted on disk, for few rows saved: longer runs are dealt to tasks first and counted there, pairs as one string, as no word holds a blank.
    """
    if buckets is not None:
        return packed.counted(texts, order, buckets, text, asked)
    words, parts = tokens(text), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that they aren't merged into few large ones
    if order == 1:
        counted = texts.select(F.lit("").alias("context"), F.explode(padded(words)).alias("token")).groupBy("context", "token").agg(F.count("*").alias("n"))
    elif order == 2:
        pairs = F.arrays_zip(F.concat(F.array(F.lit(START)), F.col("w")).alias("context"), F.concat(F.col("w"), F.array(F.lit(END))).alias("token"))
        each = texts.select(words.alias("w")).select(F.explode(pairs).alias("g")).select(F.concat_ws(" ", "g.context", "g.token").alias("g"))
        counted = each.repartition(parts, "g").groupBy("g").agg(F.count("*").alias("n")).select(F.substring_index("g", " ", 1).alias("context"), F.substring_index("g", " ", -1).alias("token"), "n")
    else:
        each = texts.select(F.explode(grams(words, order)).alias("g")).repartition(parts, "g").groupBy("g").agg(F.count("*").alias("n"))
        counted = each.select(F.array_join(F.slice("g", 1, order - 1), " ").alias("context"), F.get("g", F.lit(order - 1)).alias("token"), "n")
    return counted.where(F.col("n") > prune) if prune else counted


def discounts(counts: DataFrame, fallback: float = 0.75) -> DataFrame:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen once to four times; ``fallback`` times the count where they don't give one."""
    many = lambda k: F.sum((F.col("n") == k).cast("double"))
    n = counts.agg(*(many(k).alias(f"n{k}") for k in range(1, 5)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
    good = lambda k: F.when(d(k).between(0, k), d(k)).otherwise(F.lit(fallback * min(k, 1.5)))
    return n.select(*(good(k).alias(f"d{k}") for k in (1, 2, 3)))


def kneser_ney_bigrams(texts: DataFrame, discount: float = 0.75, text: str = "text") -> DataFrame:
    """``context``, ``token``, ``p``: interpolated Kneser-Ney with one discount over all bigrams seen."""
    pairs = written(ngram_counts(texts, 2, text=text), "bigrams")
    after = pairs.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    before = pairs.groupBy("token").agg(F.count("*").alias("histories"))
    whole = before.agg(F.sum("histories").alias("all_pairs"))  # one row
    p = (F.col("n") - discount) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("histories") / F.col("all_pairs")
    return pairs.join(after, "context").join(before, "token").crossJoin(F.broadcast(whole)).select("context", "token", p.alias("p"))


def modified_kneser_ney(texts: DataFrame, order: int = 4, prune: int = 0, text: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """All orders up to ``order``: ``length``, ``context``, ``token``, ``p`` and ``backoff`` (of the n-gram as a context; null for the longest).

    Lower orders count distinct words to the left instead of occurrences; each order has three discounts
    and interpolates with the one below. Probabilities of a context, the rest backed off, sum to one. The sentence's
    beginning is a context only: its row has the probability 0.
    ``prune``: n-grams of any order with no higher a count are left out, and those whose shorter end is.
    Only the longest n-grams are counted in the texts. Those of each length below follow from the ones a word longer: all that don't begin a
    text end one of these. N-grams stay packed until their rows are made (``packed``).
    ``asked`` (texts in its column ``text``): n-grams that none of these texts holds may be left out.
    """
    if order > 1:
        buckets = packed.labels_of(texts, text)
        return packed.model(ngram_counts(texts, order, text=text, buckets=buckets, asked=asked), order, len(buckets), prune, asked is not None)
    counts = written(ngram_counts(texts, 1, text=text), "weights-1").where(F.col("token") != START)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    taken = counts.crossJoin(F.broadcast(discounts(counts))).withColumn("cut", cut)
    total = taken.agg(F.sum("n").alias("total"), F.sum("cut").alias("given"), F.count("*").alias("v"))
    p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("given") / F.col("total") / F.col("v")
    return taken.where(F.col("n") > prune).crossJoin(F.broadcast(total)).select(F.lit(1).alias("length"), "context", "token", p.alias("p"), F.lit(None).cast("double").alias("backoff"))


def model_table(model: DataFrame, buckets: int) -> DataFrame:
    """``gram`` (blank-joined), ``p``, ``backoff`` of a model, bucketed by the n-gram: what ``score`` looks up without moving it."""
    gram = F.when(F.col("context") == "", F.col("token")).otherwise(F.concat_ws(" ", "context", "token"))
    return bucketed(model.select(gram.alias("gram"), "p", "backoff"), "model", "gram", buckets)


def score(texts: DataFrame, table: DataFrame, order: int, *ids: str, text: str = "text") -> DataFrame:
    """``ids``, ``n_tokens`` (the sentence's end included), ``n_unknown``, ``log10_p`` and ``perplexity`` of each text by the model of ``table`` (see ``model_table``).

    A token's probability is that of the longest n-gram of the model that ends with it, times the backoff weights of the longer
    contexts; tokens that the model doesn't know are counted and left out, as in the perplexity. Null is empty.
    Each n-gram is looked up once, whatever the number of texts that ask for it; what is found is joined to the tokens that ask, n-grams
    that more than one in ``HOT_SHARE`` asks for by broadcast. Nothing else is: the sizes that Spark expects are those of the packed texts, not of all their n-grams.
    """
    rows = written(texts.select(F.monotonically_increasing_id().alias("_row"), *ids, tokens(F.coalesce(text, F.lit(""))).alias("words")), "scored-rows")

    def ends(padded: Column) -> Column:
        """All n-grams that end at each place, from the sentence's beginning on."""
        at = F.sequence(F.lit(0), F.size(padded) - 1)
        here = lambda p: F.transform(F.sequence(F.lit(1), F.least(p + 1, F.lit(order))), lambda k: F.struct(p.alias("pos"), k.alias("k"), F.array_join(F.slice(padded, p - k + 2, k), " ").alias("gram")))
        return F.flatten(F.transform(at, here))

    asked = rows.select("_row", F.explode(let(F.concat(F.array(F.lit(START)), F.col("words"), F.array(F.lit(END))), ends)).alias("a")).select("_row", "a.*")
    found = written(asked.groupBy("gram").agg(F.count("*").alias("n")).hint("merge").join(table, "gram"), "found-grams")
    most = F.broadcast(found.agg((F.sum("n") / HOT_SHARE).alias("most")))
    told = found.crossJoin(most).withColumn("hot", F.col("n") > F.col("most")).select("gram", "p", "backoff", "hot")
    hot, cold = (told.where(which).drop("hot") for which in ("hot", "NOT hot"))
    common = F.broadcast(hot)
    each = asked.join(common, "gram").unionByName(asked.join(common.select("gram"), "gram", "left_anti").join(cold.hint("merge"), "gram"))
    per = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    places = each.groupBy("_row", "pos").agg(*(per("p", k).alias(f"p{k}") for k in range(1, order + 1)), *(per("backoff", k).alias(f"b{k}") for k in range(1, order)))
    # places of which nothing is known have no row: the window must not take another for the one before
    wanted = rows.select("_row", F.explode(F.sequence(F.lit(0), F.size("words") + 1)).alias("pos"))
    lined = wanted.join(places.hint("merge"), ["_row", "pos"], "left")
    before = Window.partitionBy("_row").orderBy("pos")
    lined = lined.withColumns({f"b{k}": F.coalesce(F.log10(F.lag(f"b{k}").over(before)), F.lit(0.0)) for k in range(1, order)})
    value = F.lit(None).cast("double")
    for k in range(1, order + 1):  # the longest comes first
        lost = sum((F.col(f"b{j}") for j in range(k, order)), F.lit(0.0))
        value = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}") + lost).otherwise(value)
    sums = lined.where("pos > 0").withColumn("v", value).groupBy("_row").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("v").isNull()).alias("n_unknown"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("log10_p"))
    known = F.col("n_tokens") - F.col("n_unknown")
    return rows.drop("words").hint("merge").join(sums, "_row").select(*ids, "n_tokens", "n_unknown", "log10_p", F.when(known > 0, F.pow(F.lit(10.0), -F.col("log10_p") / known)).alias("perplexity"))


def vocabulary(texts: DataFrame, lexicon: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Distinct words of the texts and the lexicon (comments and blanks dropped), in code-point order."""
    words = texts.select(F.explode(tokens(text)).alias("token"))
    if lexicon is not None:
        words = words.unionAll(lexicon.select(strip("token").alias("token")).where((F.col("token") != "") & ~F.col("token").startswith("##")))
    return words.distinct().orderBy("token")


def ranked(counts: DataFrame, top: int, by: str = "context") -> DataFrame:
    """The ``top`` most frequent continuations of each context."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= top)

"""Prefix beam search over per-time-step scores as a fold: the beam is an array that each step grows, merges and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ctc
from ..functions.binding import let

#: Paths whose score falls this far below the best are given up, and classes below this log-probability aren't tried.
BEAM_DROP, TOKEN_FLOOR = 10.0, -5.0
#: Classes of a model that is broadcast at most, its weight of a pair it doesn't know (log10), and the narrowest beam with a model.
MOST_CLASSES, UNKNOWN, NARROW = 2000, -6.0, 50
NEVER = float("-inf")


def prefix_beam(log_probs: Column, width: int = 100, gains: Column | None = None, token_floor: float = TOKEN_FLOOR, beam_drop: float = BEAM_DROP) -> Column:
    """The likeliest label sequence (classes; 0 is the blank) of a row of log-probabilities a step.

    A beam holds prefixes with the weights of all their paths that end in a blank and of those that don't.
    A step lengthens each by each class above ``token_floor`` (the best class if there is none); a prefix that is there
    already takes what its own shorter prefix brings, so that equal prefixes are one. The ``width`` best stay, of
    equals those with the smaller prefix, and none ``beam_drop`` below the best. ``gains``: what a class earns after
    another (``gains[last][class]``, row 0 for the beginning), see ``language_gains``. Null and empty scores give no classes.
    """
    none = F.array().cast("array<int>")
    start = F.array(F.struct(F.lit(0.0).alias("cost"), none.alias("prefix"), none.alias("head"), F.lit(0.0).alias("blank"), F.lit(NEVER).alias("other"), F.lit(0.0).alias("gain")))
    last = lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0))
    gain = lambda p, c: F.lit(0.0) if gains is None else F.coalesce(F.get(F.get(gains, last(p)), c), F.lit(0.0))

    def entry(prefix: Column, head: Column, blank: Column, other: Column, weight: Column, earned: Column) -> Column:
        """``head``: the prefix without its last class, so that looking for relatives cuts nothing."""
        return F.struct((-(weight + earned)).alias("cost"), prefix.alias("prefix"), head.alias("head"), blank.alias("blank"), other.alias("other"), earned.alias("gain"))

    def longer(b: Column, c: Column, row: Column, total: Column) -> Column:
        """The weight that ``b`` (of weight ``total``) brings to itself and ``c``: after an equal class only through a blank."""
        return F.when(last(b["prefix"]) == c, b["blank"]).otherwise(total) + F.get(row, c)

    def step(beam: Column, row: Column) -> Column:
        likely = F.filter(F.sequence(F.lit(1), F.greatest(F.size(row) - 1, F.lit(1))), lambda c: (c < F.size(row)) & (F.get(row, c) >= token_floor))
        rest = F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))
        best = F.filter(F.array(F.array_position(rest, F.array_max(rest)).cast("int")), lambda c: c > 0)

        def grown(tried: Column) -> Column:
            def stays(b: Column) -> Column:
                own = last(b["prefix"])
                parent = F.filter(beam, lambda p: (F.size(p["prefix"]) == F.size(b["head"])) & (p["prefix"] == b["head"]))
                read = F.array_contains(tried, own) & (F.size(b["prefix"]) > 0)
                brought = F.when(read, F.coalesce(F.get(F.transform(parent, lambda p: longer(p, own, row, ctc.log_sum(p["blank"], p["other"]))), F.lit(0)), F.lit(NEVER))).otherwise(NEVER)
                again = F.when(read, b["other"] + F.get(row, own)).otherwise(NEVER)
                parts = F.struct((ctc.log_sum(b["blank"], b["other"]) + F.get(row, F.lit(0))).alias("blank"), ctc.log_sum(again, brought).alias("other"))
                return let(parts, lambda s: entry(b["prefix"], b["head"], s["blank"], s["other"], ctc.log_sum(s["blank"], s["other"]), b["gain"]))

            def grows(b: Column) -> Column:
                deeper = F.filter(beam, lambda q: (F.size(q["prefix"]) == F.size(b["prefix"]) + 1) & (q["head"] == b["prefix"]))
                there = F.transform(deeper, lambda q: last(q["prefix"]))
                fresh = F.array_except(tried, there)
                # without paths that end in a blank the weight is that of the others
                added = lambda c, total: let(longer(b, c, row, total), lambda w: entry(F.concat(b["prefix"], F.array(c)), b["prefix"], F.lit(NEVER), w, w, b["gain"] + gain(b["prefix"], c)))
                return let(ctc.log_sum(b["blank"], b["other"]), lambda total: F.transform(fresh, lambda c: added(c, total)))

            return F.concat(F.transform(beam, stays), F.flatten(F.transform(beam, grows)))

        tried = F.when(F.size(likely) > 0, likely).otherwise(best)
        ranked = F.slice(F.sort_array(let(tried, grown)), 1, width)
        return let(ranked, lambda r: F.filter(r, lambda b: b["cost"] <= F.get(r, F.lit(0))["cost"] + beam_drop))

    return F.get(F.aggregate(F.coalesce(log_probs, F.array().cast("array<array<double>>")), start, step), F.lit(0))["prefix"]


def language_gains(weights: DataFrame, charset: list[str], alpha: float = 0.5, beta: float = 1.0, floor: float = UNKNOWN) -> DataFrame:
    """One row, ``gains``: ``alpha`` times the natural log of a character's weight after another, and ``beta`` a character.

    ``weights``: ``context``, ``token``, ``p`` (probabilities; the context of the first is ``<s>``), each pair once. The charset's size bounds the
    matrix; a charset of over ``MOST_CLASSES`` classes is an error.
    """
    if len(charset) > MOST_CLASSES:
        raise ValueError(f"a model that is broadcast has {MOST_CLASSES} classes at most")
    spark = weights.sparkSession
    classes = spark.createDataFrame([(c, k) for k, c in enumerate(["<s>", *charset[1:]])], "token string, class int")
    known = weights.join(F.broadcast(classes), "token").join(F.broadcast(classes.toDF("context", "before")), "context")
    none = F.lit(floor * 2.302585092994046)
    rows = known.groupBy("before").agg(F.map_from_entries(F.collect_list(F.struct("class", F.log("p")))).alias("known"))
    log = lambda k: F.coalesce(F.col("known")[k], none) * alpha + beta
    each = classes.join(rows, F.col("class") == F.col("before"), "left").select("class", F.transform(F.sequence(F.lit(0), F.lit(len(charset) - 1)), lambda k: F.when(F.col("known").isNull(), none * alpha + beta).otherwise(log(k))).alias("row"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "row"))), lambda r: r["row"]).alias("gains"))


def decode(outputs: DataFrame, method: str = "greedy", width: int = 100, gains: DataFrame | None = None, logits: str = "logits") -> DataFrame:
    """``outputs`` with ``ids``: by ``beam``, by ``beam_lm`` with the one row of ``gains`` (beams narrower than ``NARROW`` widened to 100), else greedy, as an unknown method is."""
    if method == "beam_lm":
        if gains is None:
            raise ValueError("beam_lm needs a model")
        beam = prefix_beam(ctc.log_softmax(logits), width if width >= NARROW else 100, F.col("gains"))
        return outputs.crossJoin(F.broadcast(gains)).withColumn("ids", beam).drop("gains")
    if method == "beam":
        return outputs.withColumn("ids", prefix_beam(ctc.log_softmax(logits), width))
    return outputs.withColumn("ids", ctc.greedy(logits))

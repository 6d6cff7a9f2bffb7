"""Per-time-step scores (array of arrays, class 0 blank) as column expressions: argmax, collapse, trimming, codecs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import normalize


def matrix(flat: Column | str, width: int) -> Column:
    """A flat array as rows of ``width``."""
    flat = F.col(flat) if isinstance(flat, str) else flat
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1), lambda t: F.slice(flat, t * width + 1, F.lit(width)))


def argmax_ids(logits: Column | str) -> Column:
    """The best class of each step, the first of equals."""
    return F.transform(logits, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def collapse(ids: Column) -> Column:
    """Without repeats and blanks; a blank between two equal classes keeps both."""
    return let(ids, lambda a: F.filter(a, lambda c, t: (c != 0) & (c != F.coalesce(F.get(a, t - 1), F.lit(-1)))))


def greedy(logits: Column | str) -> Column:
    return collapse(argmax_ids(logits))


def log_softmax(logits: Column | str) -> Column:
    def of_row(row: Column) -> Column:
        top = F.array_max(row).cast("double")
        total = F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
        return F.transform(row, lambda x: x.cast("double") - top - F.log(total))

    return F.transform(logits, of_row)


def time_steps(width: Column | str, downsample: int = 4) -> Column:
    return F.greatest(F.floor(F.col(width) / downsample if isinstance(width, str) else width / downsample), F.lit(1)).cast("int")


def trim(logits: Column, width: Column, downsample: int = 4) -> Column:
    """The steps that belong to the true width, one at least."""
    return F.slice(logits, F.lit(1), F.least(time_steps(width, downsample), F.size(logits)))


def feasible(width: Column, label: Column, downsample: int = 4, strict: bool = False) -> Column:
    """Whether a label fits into the steps; ``strict`` also counts the blank that each repeat needs."""
    repeats = F.size(F.filter(label, lambda c, t: c == F.get(label, t - 1)))
    return time_steps(width, downsample) >= F.size(label) + (repeats if strict else 0)


def log_sum(*terms: Column) -> Column:
    """Log of the sum of what ``terms`` are the logs of; minus infinity for none. Terms may be any expressions: they are worked out once."""

    def total(x: Column) -> Column:
        top = F.array_max(x)
        return F.when(top == float("-inf"), top).otherwise(top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))

    return let(F.array(*terms), total)


def loss(log_probs: Column, label: Column, zero_infinity: bool = True) -> Column:
    """Minus the log of the probability of all paths that collapse to ``label`` (classes without blanks), by the forward recursion.

    ``log_probs``: a row of log-probabilities a step. The label stands between blanks, and one array, a value a place of it, goes
    through the steps: a place is reached from itself, the one before and, over a blank between two different classes, the
    one before that. A label that doesn't fit into the steps has an infinite loss, 0 if ``zero_infinity``. No steps give
    0 for an empty label.
    """
    never = F.lit(float("-inf"))

    def over(both: Column) -> Column:
        rows, places = both["rows"], both["places"]
        start = F.transform(places, lambda c, s: F.when(s == 0, F.lit(0.0)).otherwise(never))  # before the first step: nothing read

        def step(held: Column, row: Column) -> Column:
            before = lambda s, k: F.coalesce(F.get(held, s - k), never)
            over_blank = lambda c, s: F.when((c != 0) & (c != F.coalesce(F.get(places, s - 2), F.lit(0))), before(s, 2)).otherwise(never)
            return F.transform(places, lambda c, s: log_sum(before(s, 0), before(s, 1), over_blank(c, s)) + F.get(row, c))

        def end(held: Column) -> Column:
            return log_sum(F.get(held, F.size(held) - 1), F.coalesce(F.get(held, F.size(held) - 2), never))

        # the start also lets the first class begin without a blank: the place after it is reached from the start's 0
        return let(F.aggregate(rows, start, step), end)

    places = F.transform(F.sequence(F.lit(0), 2 * F.size(label)), lambda s: F.when(s % 2 == 0, 0).otherwise(F.get(label, F.floor(s / 2).cast("int"))).cast("int"))
    found = let(F.struct(log_probs.alias("rows"), places.alias("places")), over)
    return F.when(found == float("-inf"), F.lit(0.0 if zero_infinity else float("inf"))).otherwise(-found + 0.0)


def encode(text: Column, charset: list[str]) -> Column:
    """Class of each character; one that is missing raises an error."""
    known = F.create_map(*(F.lit(x) for pair in ((c, k) for k, c in enumerate(charset) if k) for x in pair))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(known[c], F.raise_error(F.concat(F.lit("not in the charset: "), c)).cast("int")))


def decode(ids: Column, charset: list[str]) -> Column:
    """Text of the classes; blank and numbers out of range are skipped."""
    known = F.array(*(F.lit(c) for c in charset))
    return F.array_join(F.transform(F.filter(ids, lambda i: (i > 0) & (i < len(charset))), lambda i: F.get(known, i)), "")


def read(ids: Column, charset: list[str], tones: bool = True) -> Column:
    """Decoded and normalized text of the classes. A charset of composed characters gives composed text unless marks stand alone in it."""
    joins = any(unicodedata.combining(c) for token in charset[1:] for c in token)
    return normalize(decode(ids, charset), tones, composed=not joins and all(unicodedata.is_normalized("NFC", c) for c in charset[1:]))


def has_only(text: Column, charset: list[str]) -> Column:
    return F.size(F.array_except(F.filter(F.split(text, ""), lambda c: c != ""), F.array(*(F.lit(c) for c in charset[1:])))) == 0

"""Character and word error rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import tokens

#: Common words of a pair become code points from here on, but for the 2,048 surrogates; words of one side alone are the two before.
FIRST_CODE, SURROGATES, CODES = 258, 0xD800, 1_000_000


def rate(edits: Column, length: Column, other: Column) -> Column:
    """Edits to length; of an empty reference 0 if the other is empty too, else 1."""
    return F.when(length > 0, edits / length).when(other == 0, 0.0).otherwise(1.0)


def char_edits(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edits between the words: each word that both sides hold becomes one code point, words of one side alone, which match nothing, one a side.

    Pairs with more than ``CODES`` common words raise an error rather than give a wrong figure.
    """

    def edits(both: Column) -> Column:
        r, h, known = both["r"], both["h"], both["known"]

        def coded(words: Column, alone: int) -> Column:
            number = lambda at: F.when(at == 0, alone).otherwise(at + FIRST_CODE + F.when(at + FIRST_CODE >= SURROGATES, 2048).otherwise(0))
            code = lambda w: F.decode(F.unhex(F.lpad(F.hex(number(F.array_position(known, w))), 8, "0")), "UTF-32")
            return F.array_join(F.transform(words, code), "")

        fits = F.size(known) <= CODES
        return F.when(fits, F.levenshtein(coded(r, FIRST_CODE - 2), coded(h, FIRST_CODE - 1))).otherwise(F.raise_error(F.lit("too many common words in a pair")).cast("int"))

    words = F.struct(tokens(ref).alias("r"), tokens(hyp).alias("h"))
    return let(words, lambda w: let(F.struct(w["r"].alias("r"), w["h"].alias("h"), F.array_intersect(w["r"], w["h"]).alias("known")), edits))


def cer(ref: Column, hyp: Column, edits: Column | None = None) -> Column:
    """``edits``: where they are worked out already."""
    return rate(char_edits(ref, hyp) if edits is None else edits, F.length(ref), F.length(hyp))


def wer(ref: Column, hyp: Column) -> Column:
    return rate(word_edits(ref, hyp), F.size(tokens(ref)), F.size(tokens(hyp)))


def comparison(ref: Column, hyp: Column) -> Column:
    """One pair in full; nulls are empty."""
    ref, hyp = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return let(char_edits(ref, hyp), lambda n: F.struct(ref.alias("reference"), hyp.alias("hypothesis"), n.alias("levenshtein"), cer(ref, hyp, n).alias("cer"), wer(ref, hyp).alias("wer"), F.length(ref).alias("ref_len"), (ref == hyp).alias("exact")))

"""Transcript text as column expressions: splitting, spacing, tone marks, names. All but ``nfc`` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Glide and vowel of the open syllables whose mark moves, and the five tone marks.
GLIDES = ("oa", "oe", "uy")
TONES = "̣̀́̉̃"


def nfc(text: Column | str) -> Column:
    """Unicode NFC; Spark has no built-in, so whole Arrow batches go to Python. Null stays null."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(text)


def compose(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` in NFC. ASCII is composed already, so that only rows with other characters go to Python."""
    plain = F.coalesce(~F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(True))
    return df.where(plain).unionAll(df.where(~plain).withColumn(text, nfc(text)).select(df.columns))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def chars(text: Column | str) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def fix_punctuation(text: Column | str) -> Column:
    """No blank before , . ; : ! ? % and ), none after (."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+([,.;:!?%)])", "$1"), r"(?U)\(\s+", "(")


def tone_moves() -> dict[str, str]:
    """What open syllables are written like, and how they are to be written."""
    composed = lambda a, b: unicodedata.normalize("NFC", a + b)
    return {g + composed(v, t): composed(g, t) + v for pair in GLIDES for g, v in (pair, pair.capitalize()) for t in TONES}


def place_tones(text: Column | str) -> Column:
    """The tone mark of an open oa, oe or uy goes to the first letter; closed syllables and qu stay. Rows without any are passed over at once."""
    text = F.col(text) if isinstance(text, str) else text
    moved = text
    for old, new in tone_moves().items():
        guard = "(?<![qQ])" if old[0] in "uU" else ""
        moved = F.regexp_replace(moved, f"(?U){guard}{old}(?!\\w)", new)
    return F.when(text.rlike("|".join(tone_moves())), moved).otherwise(text)


def normalize(text: Column | str, tones: bool = True, composed: bool = False) -> Column:
    """NFC (unless ``composed`` says that the text is), tone marks, punctuation, white space; deployments leave the tones."""
    text = (F.col(text) if isinstance(text, str) else text) if composed else nfc(text)
    return squeeze(fix_punctuation(place_tones(text) if tones else text))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def absolute(root: str, path: Column | str) -> Column:
    """The place of a relative ``path`` under ``root``; an absolute one stays."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def listed(text: Column | str, kind: str) -> Column:
    """Comma-separated values, blanks dropped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast(kind))


def variant(name: Column | str) -> Column:
    """``<precision>_b<batch>`` as a struct, null if it isn't one."""
    precision, batch = (F.regexp_extract(name, r"^(.+)_b(\d+)$", k) for k in (1, 2))
    return F.when(precision != "", F.struct(precision.alias("precision"), batch.cast("int").alias("batch")))


def markdown_row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))

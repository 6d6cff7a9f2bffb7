"""Personal data by DataFrame functions alone: fixed patterns, and candidate spans selected by boosted trees.

Fixed patterns give the base spans. Loose generators propose overlapping candidates besides; features of
a candidate's format and context go through gradient-boosted trees, fitted on a bounded sample with the
strict checks as labels and written out as conditional expressions, and a threshold for each kind, calibrated
over all rows, selects what is added. All spans of a row are found within the row: nothing is exploded or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import drawn, written

#: Marks around a match; a text's own are swapped for a third control character of the same length, which no pattern takes.
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
#: In the order in which spans are listed; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The fixed patterns, written so that no start within a run that has failed is tried again and no group nests the stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators of candidates.
NEAR_EMAIL = r"[^\s@\u0001-\u0003]{1,64}@[^\s@\u0001-\u0003]{1,255}"
NEAR_NUMBER = r"[+(]?[0-9][0-9 ().-]{5,}[0-9]"
NEAR_SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+"
#: Words before a span that speak for one kind or another.
CUES = r"mail|phone|tel|call|fax|card|visa|address|server|host"
SECRET_CUES = r"(?:password|passwd|token|secret|key|auth|pin)[^a-z0-9]{0,6}$"
#: Documents whose candidates the trees are fitted on at most, right candidates of a kind added to them at most,
#: and the share of right ones that a threshold must reach.
SAMPLE_DOCS, RIGHT_EACH, PRECISION = 20_000, 2_000, 0.98
SPANS = "array<struct<start:int,end:int,word:string>>"
CONTEXT_SPANS = "array<struct<start:int,end:int,word:string,before:string,after:string>>"
#: Code points that a text is cut into before pieces of it are taken, and binary digits of the largest number of spans of a kind.
STRIDE, DIGITS = 4096, 26


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``join`` of each value with all before it. In two levels of the size's square root, as arrays grow by copying."""
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), zero)
    grown = lambda acc, x: F.concat(acc, F.array(join(last(acc), x)))
    none = F.slice(F.array(zero), 1, 0)

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda k: F.aggregate(F.slice(v, k + 1, step), none, grown))
        return let(parts, lambda ps: let(F.aggregate(F.transform(ps, last), F.array(zero), grown), lambda before: F.flatten(F.transform(ps, lambda p, k: F.transform(p, lambda x: join(F.get(before, k), x))))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(none))


def found_by(text: Column, pattern: str, guard: Column | None = None, context: bool = False) -> Column:
    """Leftmost non-overlapping matches as (start, end, word), in code points, in time in proportion to the text; rows that ``guard`` excludes are not searched.

    With ``context`` also ``before``, 24 characters at most and none before the last match but one, and ``after``, one character.
    """
    kind = CONTEXT_SPANS if context else SPANS
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)
    plain = lambda part: F.translate(F.coalesce(part, F.lit("")), CLOSE, "")

    def of(parts: Column, ends: Column) -> Column:
        def span(part: Column, k: Column) -> Column:  # the part at k + 1; what stands before it ends at ends[k]
            word = F.substring_index(part, CLOSE, 1)
            fields = [F.get(ends, k).alias("start"), (F.get(ends, k) + F.length(word)).alias("end"), word.alias("word")]
            if context:
                before = F.right(F.concat(plain(F.get(parts, k - 1)), plain(F.get(parts, k))), F.lit(24))
                tail = F.concat(F.substring_index(part, CLOSE, -1), plain(F.get(parts, k + 2)))
                fields += [F.lower(before).alias("before"), F.substring(tail, 1, 1).alias("after")]
            return F.struct(*fields)

        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), span)

    def spans(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p) - F.contains(p, F.lit(CLOSE)).cast("int"))
        found = let(running(sizes, lambda a, b: a + b, F.lit(0)), lambda ends: of(parts, ends))
        return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(kind)).cast(kind)

    found = let(marked, spans)
    return found if guard is None else F.when(guard, found).otherwise(F.array().cast(kind))


def digits(word: Column) -> Column:
    return F.translate(word, " ().+-", "")


def luhn(word: Column) -> Column:
    """Of a word of digits, blanks and dashes."""
    d = digits(word)

    def value(k: Column) -> Column:
        v = F.substring(d, F.length(d) - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda n, k: n + value(k)) % 10 == 0


def is_ip(word: Column) -> Column:
    return F.forall(F.split(word, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)


def is_card(word: Column) -> Column:
    return F.when(F.length(digits(word)).between(16, 19), luhn(word)).otherwise(False)


def is_phone(word: Column) -> Column:
    return F.length(digits(word)).between(8, 15)


def base_columns(text: Column) -> dict[str, Column]:
    """Spans that pass their check, by kind."""
    return {
        "email": found_by(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(found_by(text, IP), lambda s: is_ip(s["word"])),
        "card": F.filter(found_by(text, CARD), lambda s: is_card(s["word"])),
        "phone": F.filter(found_by(text, PHONE, F.contains(text, F.lit("+"))), lambda s: is_phone(s["word"])),
    }


def share(word: Column, class_: str) -> Column:
    return F.length(F.regexp_replace(word, f"[^{class_}]", "")) / F.length(word)


def counted(word: Column, class_: str) -> Column:
    return F.length(F.regexp_replace(word, f"[^{class_}]", "")).cast("double")


#: Features of a candidate (its word, up to 24 characters before it, one after it), all numbers: format and
#: context, none of them a check that labels are made by.
FEATURES = {
    "length": lambda w, before, after: F.least(F.length(w), F.lit(80)).cast("double"),
    "digits": lambda w, before, after: counted(w, "0-9"),
    "digit_share": lambda w, before, after: share(w, "0-9"),
    "upper_share": lambda w, before, after: share(w, "A-Z"),
    "lower_share": lambda w, before, after: share(w, "a-z"),
    "hex_share": lambda w, before, after: share(w, "0-9a-f"),
    "dots": lambda w, before, after: counted(w, "."),
    "dashes": lambda w, before, after: counted(w, "-"),
    "blanks": lambda w, before, after: counted(w, " "),
    "parentheses": lambda w, before, after: counted(w, "()"),
    "distinct": lambda w, before, after: F.size(F.array_distinct(F.split(w, ""))).cast("double"),
    "assigned": lambda w, before, after: before.rlike(r"[=:]\s*['\"]?$").cast("double"),
    "quoted": lambda w, before, after: (before.rlike(r"['\"]$") & after.rlike(r"['\"]")).cast("double"),
    "cue": lambda w, before, after: before.rlike(CUES).cast("double"),
    "joined": lambda w, before, after: before.rlike(r"[\w]$").cast("double"),
    "ends_word": lambda w, before, after: (~after.rlike(r"[\w]")).cast("double"),
}


def candidates(text: Column) -> Column:
    """Overlapping proposals of all generators: kind, start, end, word, before, after. Those of a generator don't overlap and come in order."""

    def shaped(s: Column, kind: Column) -> Column:
        return F.struct(kind.alias("kind"), *(s[x].alias(x) for x in ("start", "end", "word", "before", "after")))

    def number(s: Column) -> Column:
        w = s["word"]
        n = F.length(F.regexp_replace(w, "[^0-9]", ""))
        return F.when(w.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 1).when(~w.startswith("+") & (n >= 13), 2).otherwise(3)

    return F.concat(
        F.transform(found_by(text, NEAR_EMAIL, F.contains(text, F.lit("@")), True), lambda s: shaped(s, F.lit(0))),
        F.transform(found_by(text, NEAR_NUMBER, None, True), lambda s: shaped(s, number(s))),
        F.transform(found_by(text, NEAR_SECRET, None, True), lambda s: shaped(s, F.lit(4))),
    )


def strict(c: Column) -> Column:
    """The checks that label candidates for training, on the word without marks at its ends."""
    w = F.regexp_replace(c["word"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    secret = w.rlike("^AKIA[0-9A-Z]{16}$") | c["before"].rlike(SECRET_CUES)
    return F.when(c["kind"] == 0, w.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")).when(c["kind"] == 1, is_ip(w)).when(c["kind"] == 2, is_card(w)).when(c["kind"] == 3, w.startswith("+") & is_phone(w)).otherwise(secret)


def features(c: Column) -> list[Column]:
    return [c["kind"].cast("double"), *(f(c["word"], c["before"], c["after"]) for f in FEATURES.values())]


@dataclass
class Selector:
    """Boosted trees as nested tuples (feature, value, at most, above) or leaves, with their weights, and a threshold for each kind."""

    trees: list[tuple[float, tuple | float]]
    thresholds: dict[int, float]

    def margin(self, values: list[Column]) -> Column:
        def grow(node: tuple | float) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, value, low, high = node
            return F.when(values[feature] <= value, grow(low)).otherwise(grow(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + weight * grow(tree)
        return F.round(total, 6)  # equal scores must tie: sums in another order differ in the last places

    def accepts(self, c: Column) -> Column:
        chosen = F.lit(False)
        score = self.margin(features(c))
        for kind, least in self.thresholds.items():
            chosen = F.when(c["kind"] == kind, score >= least).otherwise(chosen)
        return chosen


def read_trees(told: str) -> list[tuple[float, tuple | float]]:
    """The trees in a fitted model's description."""
    trees: list[tuple[float, tuple | float]] = []
    lines = [line.strip() for line in told.splitlines()]
    at = 0

    def node() -> tuple | float:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.removeprefix("Predict:"))
        test = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = node()
        at += 1  # Else
        return int(test[1]), float(test[2]), low, node()

    while at < len(lines):
        head = re.match(r"Tree \d+ \(weight (\S+)\):", lines[at])
        at += 1
        if head:
            trees.append((float(head[1]), node()))
    return trees


def fit_selector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Selector:
    """Trees from a bounded sample, thresholds from the candidates of all rows.

    The trees are fitted on the candidates of about ``sample_docs`` rows, chosen by a hash of id and text, and on
    about ``RIGHT_EACH`` other right candidates of each kind, differing in their features, so that a rare kind is
    learned too. The threshold of a kind is the lowest score down to which the share of right candidates among
    all rows' is at least ``precision``. A kind without right candidates is never added to; without both right
    and wrong candidates there are no trees.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = drawn(min(1.0, sample_docs / max(docs.count(), 1)), 9, id_col, text_col)
    found = docs.select(chosen.alias("drawn"), clean(text_col).alias("text")).select("drawn", F.explode(candidates(F.col("text"))).alias("c"))
    names = ["kind", *FEATURES]
    rows = written(found.select("drawn", strict(F.col("c")).cast("double").alias("label"), *(f.alias(n) for f, n in zip(features(F.col("c")), names, strict=True))), "pii-candidates")
    others = rows.where("not drawn and label = 1").select("label", *names).distinct()
    chance = F.lit(False)
    for r in others.groupBy("kind").count().collect():  # a row a kind
        chance |= (F.col("kind") == r.kind) & drawn(RIGHT_EACH / r["count"], 5, *names)
    rare = others.where(chance)
    sample = written(rows.where("drawn").select("label", *names).unionAll(rare).coalesce(4), "pii-sample")
    counts = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if not 0 < counts[0] < counts[1]:
        return Selector([], {})
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=1, maxBins=32).fit(vectors.select("label", "features"))
    selector = Selector(read_trees(model.toDebugString), {})
    scored = rows.select("kind", "label", selector.margin([F.col(n) for n in names]).alias("score")).groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count("*").alias("all"))
    so_far = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = scored.withColumn("share", F.sum("right").over(so_far) / F.sum("all").over(so_far))
    least = shares.where(F.col("share") >= precision).groupBy("kind").agg(F.min("score").alias("least")).collect()  # a row a kind
    selector.thresholds = {int(r.kind): float(r.least) for r in least}
    return selector


def clean(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, OTHER + OTHER)


def find_spans(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text``, an array of base spans for each of email, ip, card, phone, and ``added``; a row for every row.

    ``added``: selected candidates that overlap no base span, as (kind, start, end), those of a kind in order.
    Positions are code points, ends exclusive. A null text is empty. A text of any length with any number of
    matches takes time nearly in proportion to it. Repeated rows and null ids stay;
    other columns are ignored.
    """
    text = docs.select(F.col(id_col), F.col(text_col).alias("text"), clean(text_col).alias("_t"))
    based = text.select(id_col, "text", "_t", *(c.alias(k) for k, c in base_columns(F.col("_t")).items()))
    if not selector.thresholds:
        return based.select(id_col, "text", *KINDS[:4], F.array().cast("array<struct<kind:int,start:int,end:int>>").alias("added"))
    chosen = F.filter(candidates(F.col("_t")), selector.accepts)
    with_all = based.select(id_col, "text", *KINDS[:4], chosen.alias("_c"))
    free = F.filter("_c", lambda c: ~(overlaps("email", c) | overlaps("ip", c) | overlaps("card", c) | overlaps("phone", c)))
    added = F.transform(free, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return with_all.select(id_col, "text", *KINDS[:4], added.alias("added"))


def overlaps(spans: str, c: Column) -> Column:
    """Whether one of ``spans``, in order and apart from each other, overlaps ``c``: the last that starts before its end, by halving."""
    bits = F.array(*(F.lit(1 << k) for k in range(DIGITS, -1, -1)))
    before = F.aggregate(bits, F.lit(0), lambda at, bit: at + F.when(F.get(spans, at + bit - 1)["start"] < c["end"], bit).otherwise(0))
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, before - 1)["end"] > c["start"], F.lit(False))).otherwise(False)


def listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def all_listed() -> Column:
    """All spans as kind:start:end, by kind, then start."""

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def of_kind(number: int) -> Column:
        return bare(F.filter("added", lambda s: s["kind"] == number))

    each = [F.array_sort(F.concat(bare(F.col(k)), of_kind(n))) for n, k in enumerate(KINDS[:4])]
    return F.concat(*(listed(e, k) for e, k in zip([*each, of_kind(4)], KINDS, strict=True)))


def redact(docs: DataFrame, selector: Selector, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with each stretch of overlapping spans in ``text_col`` replaced by ``<PII>``; rows, nulls and other columns stay."""
    names = docs.columns
    others = F.struct(*(F.lit(None).cast(docs.schema[n].dataType).alias(n) if n == text_col else F.col(n) for n in names))
    packed = docs.select(others.alias("row"), F.col(text_col).alias("text"))
    found = find_spans(packed, selector, "row", "text")
    pairs = F.concat(*(F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in (*KINDS[:4], "added")))
    placed = found.select("row", "text", F.array_sort(pairs).alias("_p"))
    placed = placed.select("row", "text", "_p", running(F.col("_p")["end"], F.greatest, F.lit(0)).alias("_e"), F.when(F.size("_p") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRIDE}}}"), F.lit(0))).alias("_s"))

    def piece(start: Column, end: Column) -> Column:
        """From the strides that hold it: a place in a long text is found by counting from its start."""
        first = F.floor(start / STRIDE).cast("int")
        near = F.array_join(F.slice("_s", first + 1, F.ceil(end / STRIDE).cast("int") - first), "")
        return F.when(end > start, F.substring(near, start - first * STRIDE + 1, end - start)).otherwise("")

    def cut(s: Column, k: Column) -> Column:
        begin = F.coalesce(F.get("_e", k - 1), F.lit(0))
        return F.when(s["start"] >= begin, F.concat(piece(begin, s["start"]), F.lit("<PII>"))).otherwise("")

    rest = piece(F.get("_e", F.size("_e") - 1), F.length("text"))
    text = F.when(F.size("_p") > 0, F.concat(F.array_join(F.transform("_p", cut), ""), rest)).otherwise(F.col("text"))
    merged = placed.select("row", text.alias("text"))
    return merged.select(*(F.col("text").alias(n) if n == text_col else F.length("text").cast(docs.schema[n].dataType).alias(n) if n == length_col else F.col("row")[n].alias(n) for n in names))

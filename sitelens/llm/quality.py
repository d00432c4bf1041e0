"""Quality rules: a threshold table compiled into one projection.

Features are column expressions over the whole text; each rule compares one
feature with a bound; the verdict is one boolean expression.  No user
function, no shuffle: a document's features need its own row only.

Defined cases: a null or empty text has no words, so all counts are 0 and the
base check fails; repeated rows give equal repeated rows; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

# Frequent function words of the languages served.
STOP_WORDS = (
    "the be to of and a in that have it is was for on are with as at by this from or an not you "
    "der die das und ein eine ist von zu den mit sich auf für dem nicht im des auch es "
    "le la les un une et est de du que en dans pour par qui sur au avec ne pas "
    "el los las y por con para una se al lo como su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= feature <= high``; a missing bound does not apply."""

    feature: str
    low: float | None = None
    high: float | None = None


#: The method's verdict.  Shares are of words or of lines that have a word.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.5),
    Rule("ellipsis_line_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the base counts and the features of every document.

    Repeated words: texts without an equal pair of window hashes, seen by a
    distinct over them, end there.  The others sort (hash, place) pairs, keep
    the places with an equal neighbour, and count what the windows at those
    places cover.  Each step of the chain carries only what later ones read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    symbols = F.when(text.rlike("[" + SYMBOLS + "]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    counted = split.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: F.ltrim(line).rlike("^[-*•‣●]"))).alias("bullets"),
        F.size(F.filter("lines", lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))).alias("ellipses"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    scalars = [c for c in counted.columns if c != "hashes"]
    hashes = F.col("hashes")
    n = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    tails = F.zip_with(F.slice(hashes, F.lit(2), n), F.slice(hashes, F.lit(3), n), lambda b, c: F.shiftleft(b, 1).bitwiseXOR(F.shiftleft(c, 2)))
    windows = F.zip_with(F.slice(hashes, F.lit(1), n), tails, lambda a, bc: a.bitwiseXOR(bc))
    windowed = counted.select(*scalars, windows.alias("windows"))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = windowed.select(*scalars, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).alias("pairs"))
    near = lambda x, k: F.get(F.col("pairs"), k)["h"].eqNullSafe(x["h"])
    again = F.filter("pairs", lambda x, k: near(x, k + 1) | near(x, k - 1))
    placed = sorted_.select(*scalars, F.sort_array(F.transform(again, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - a, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return placed.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _share(F.col("stops"), F.col("n_words")).alias("stop_word_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.col("ellipses"), F.col("n_lines")).alias("ellipsis_line_share"),
        _share(F.col("bullets"), F.col("n_lines")).alias("bullet_line_share"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression: true if every bound holds."""
    tests = [F.col(r.feature) >= r.low for r in rules if r.low is not None] + [F.col(r.feature) <= r.high for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Counts, features, ``base_failed`` and ``kept`` of every document."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return features(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))

"""Keyword density and title / description suggestions (single precision like the reference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import capitalize, col, lit, whitespace_words
from sitelens.operators.keywords import f32, fdiv

# Optimal density band (percent), stuffing limit, over-use limit.
DENSITY_LOW, DENSITY_HIGH, STUFFED_ABOVE, OVERUSED_ABOVE = 1.0, 3.0, 5.0, 2.0
TITLE_MAX_BYTES, DESCRIPTION_MAX_BYTES = 60, 160

# Suggestion templates ({0}, {1}, {2} are keyword slots), in the
# reference's order, with their fixed scores and texts.
TITLE_TEMPLATES = [
    ("{0} - Professional {1} Solutions", 0.85, "Combines primary keyword with benefit-focused language"),
    ("Need {0}? Get Expert Help Today", 0.80, "Question format triggers curiosity and engagement"),
    ("Top {0} Services | Trusted Experts", 0.75, "Authority positioning with trust signal"),
    ("{0} Guide {year} - Expert Resources", 0.78, "Year signals freshness, improves CTR"),
]
DESCRIPTION_TEMPLATES = [
    (
        "Looking for {0}? Our {1} experts deliver {2} results. Get started today with a free consultation.",
        0.90, ["free", "expert"], True,
    ),
    (
        "Transform your {0} with our professional {1} services. Trusted by businesses worldwide for quality and reliability.",
        0.85, ["transform", "trusted"], False,
    ),
    (
        "Join thousands who trust us for {0}. {1} solutions backed by expertise and dedication. Contact us now.",
        0.82, ["trust", "join"], True,
    ),
]
DEFAULT_SECOND_TITLE_WORD = "Business"
DEFAULT_THIRD_DESCRIPTION_WORD = "proven"


def keyword_totals(keywords: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, total_keyword_freq, keyword_count`` over every kept keyword (a partial aggregate)."""
    return keywords.groupBy(key).agg(
        F.sum("frequency").cast("bigint").alias("total_keyword_freq"),
        F.count(lit(1)).alias("keyword_count"),
    )


def density_columns(word_count: Column, total: Column) -> list[Column]:
    """density, density_score, is_stuffed from whitespace word count and keyword frequency total."""
    wc = word_count
    # the divisor is floored at 1 only to stay clear of ANSI division errors; a
    # zero word count is answered by the CASE below
    d = fdiv(total, F.greatest(wc, lit(1))) * f32(100.0)
    low = fdiv(d, lit(DENSITY_LOW))
    high = f32(1.0) - F.least(fdiv(d - f32(DENSITY_HIGH), lit(10.0)), f32(1.0))
    score = F.when(d < f32(DENSITY_LOW), low).when(d > f32(DENSITY_HIGH), high).otherwise(f32(1.0))
    empty = wc == 0
    return [
        F.when(empty, f32(0.0)).otherwise(d).cast("double").alias("density"),
        F.when(empty, f32(0.0)).otherwise(score).cast("double").alias("density_score"),
        F.when(empty, lit(False)).otherwise(d > f32(STUFFED_ABOVE)).alias("is_stuffed"),
    ]


def keyword_density(analysis: DataFrame, keywords: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, word_count, total_keyword_freq, density, density_score, is_stuffed``.

    density = 100 * sum(keyword frequency) / whitespace words of the text;
    score 1 inside 1-3 %, d/1 below, falling by 10 points per point above;
    stuffed above 5 %.  No words: all zero.
    """
    a = analysis.select(key, whitespace_words("raw_text").alias("word_count"))
    j = a.join(keyword_totals(keywords, key), key, "left").withColumn(
        "total_keyword_freq", F.coalesce("total_keyword_freq", lit(0)).cast("bigint")
    )
    return j.select(key, col("word_count").cast("bigint").alias("word_count"), "total_keyword_freq",
                    *density_columns(col("word_count"), col("total_keyword_freq")))


def over_used(analysis: DataFrame, keywords: DataFrame, key: str = "page_id", order: list | None = None) -> DataFrame:
    """Keywords above 2 % of the words on their own: ``key, word, frequency`` plus list order."""
    from sitelens.plans.skew import salted_join

    order = order or (["rank"] if key == "page_id" else ["first_page_id", "first_rank"])
    a = analysis.select(key, whitespace_words("raw_text").alias("word_count"))
    # many keywords of a site meet one word count: salted by word
    j = keywords.join(a, key) if key == "page_id" else salted_join(keywords, a, key, spread_by="word", how="inner")
    share = fdiv(col("frequency"), F.greatest(col("word_count"), lit(1))) * f32(100.0)
    # one condition over both sides: a test of the word count alone would be pushed below
    # the join and count the words of every text a second time
    return j.where(F.when(col("word_count") > 0, share > f32(OVERUSED_ABOVE))).select(key, "word", "frequency", *order)


def _slot(arr: Column, i: int) -> Column:
    return F.get(arr, i)


def title_suggestions(top3: DataFrame, key: str = "page_id", year: int = 2026) -> DataFrame:
    """``key, suggestion_rank, text, score, reasoning`` from the packed top-3 keywords (``top3`` column).

    Four templates on the capitalized keywords; kept if at most 60 bytes;
    ordered by score.  ``year`` is a parameter so results are repeatable.
    """
    k0 = capitalize(_slot(col("top3"), 0))
    k1 = F.coalesce(capitalize(_slot(col("top3"), 1)), lit(DEFAULT_SECOND_TITLE_WORD))
    texts = []
    for tpl, score, why in TITLE_TEMPLATES:
        parts = tpl.replace("{year}", str(year)).split("{")
        pieces: list[Column] = [lit(parts[0])]
        for p in parts[1:]:
            slot, rest = p.split("}", 1)
            pieces.append(k0 if slot == "0" else k1)
            pieces.append(lit(rest))
        texts.append(F.struct(F.concat(*pieces).alias("text"), lit(score).alias("score"), lit(why).alias("reasoning")))
    rows = top3.where(F.size("top3") > 0).select(key, F.explode(F.array(*texts)).alias("s"))
    rows = rows.where(F.octet_length("s.text") <= TITLE_MAX_BYTES).select(key, "s.*")
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(col("score").desc())
    return rows.withColumn("suggestion_rank", F.row_number().over(w)).select(key, "suggestion_rank", "text", "score", "reasoning")


def description_suggestions(top5: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, suggestion_rank, text, score, emotional_triggers, cta_included`` from packed top-5 keywords."""
    k0 = _slot(col("top5"), 0)
    k1 = F.coalesce(_slot(col("top5"), 1), k0)
    k2 = F.coalesce(_slot(col("top5"), 2), lit(DEFAULT_THIRD_DESCRIPTION_WORD))
    slots = {"0": k0, "1": k1, "2": k2}
    texts = []
    for i, (tpl, score, triggers, cta) in enumerate(DESCRIPTION_TEMPLATES):
        parts = tpl.split("{")
        pieces: list[Column] = [lit(parts[0])]
        for p in parts[1:]:
            slot, rest = p.split("}", 1)
            # the third template capitalizes its second keyword
            pieces.append(capitalize(slots[slot]) if (i == 2 and slot == "1") else slots[slot])
            pieces.append(lit(rest))
        texts.append(
            F.struct(
                F.concat(*pieces).alias("text"),
                lit(score).alias("score"),
                F.array(*[lit(t) for t in triggers]).alias("emotional_triggers"),
                lit(cta).alias("cta_included"),
            )
        )
    rows = top5.where(F.size("top5") > 0).select(key, F.explode(F.array(*texts)).alias("s"))
    rows = rows.where(F.octet_length("s.text") <= DESCRIPTION_MAX_BYTES).select(key, "s.*")
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(col("score").desc())
    return rows.withColumn("suggestion_rank", F.row_number().over(w)).select(
        key, "suggestion_rank", "text", "score", "emotional_triggers", "cta_included"
    )

"""The scoring stage ("ML engine"): sentiment, density, suggestions, trends, score, advice.

Every function works at any grain: ``key='page_id'`` with page analysis and
page keywords, or ``key='site'`` with the site roll-ups (merged keywords,
``order`` = first page then list position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit, whitespace_words
from sitelens.operators import content as C
from sitelens.operators import score as S
from sitelens.operators.keywords import packed_top
from sitelens.operators.sentiment import sentiment

SITE_ORDER = ["first_page_id", "first_rank"]
PAGE_ORDER = ["rank"]


def _over_used(frequency) -> Column:
    """Is the keyword, on its own, above the over-use limit of the row's ``word_count``?"""
    share = C.fdiv(frequency, F.greatest(col("word_count"), lit(1))) * C.f32(100.0)
    return (col("word_count") > 0) & (share > C.f32(C.OVERUSED_ABOVE))


def page_keyword_features(texts: DataFrame, keywords: DataFrame, key: str = "page_id") -> DataFrame:
    """Page grain: a page keeps at most 60 keywords, so one bounded aggregate per page
    yields the top-10 list, the frequency total and the list-ordered keywords; the
    over-used filter then runs in the row, against the page's word count."""
    k = keywords.groupBy(key).agg(
        F.sum("frequency").cast("bigint").alias("total_keyword_freq"),
        F.array_sort(F.collect_list(F.struct((-col("score")).alias("neg"), "rank", "word"))).alias("by_score"),
        F.array_sort(F.collect_list(F.struct("rank", "word", "frequency"))).alias("by_rank"),
    )
    wc = texts.select(key, whitespace_words("raw_text").alias("word_count"))
    j = k.join(wc, key)
    top10 = F.transform(F.slice("by_score", 1, 10), lambda s: s["word"])
    return j.select(
        key,
        top10.alias("top10"),
        F.slice(top10, 1, 5).alias("top5"),
        F.slice(top10, 1, 3).alias("top3"),
        "total_keyword_freq",
        F.transform(F.filter("by_rank", lambda s: _over_used(s["frequency"])), lambda s: s["word"]).alias("over_used"),
    )


def keyword_features(analysis: DataFrame, keywords: DataFrame, key: str = "page_id", order: list[str] | None = None) -> DataFrame:
    """Per key: ``top10/top5/top3`` arrays, frequency total and the over-used words (list order).

    A site may have any number of over-used words (all of its keywords, if its
    text is short): a reader that needs them one by one takes the rows of
    ``operators.content.over_used``.  One that does not select the list does
    not pay for it.

    ``analysis`` only needs ``key, raw_text`` (the text the density is measured on).
    Pages take the bounded single-aggregate path; sites (unbounded merged
    lists) use a top-k window with a partial group limit.
    """
    if key == "page_id" and not order:
        return page_keyword_features(analysis, keywords, key)
    order = order or (PAGE_ORDER if key == "page_id" else SITE_ORDER)
    top = packed_top(keywords, 10, key, "top10", [col(c) for c in order])
    top = top.select(key, "top10", F.slice("top10", 1, 5).alias("top5"), F.slice("top10", 1, 3).alias("top3"))
    wc = analysis.select(key, whitespace_words("raw_text").alias("word_count"))
    # many keywords per site meet one word count per site: salt by word
    from sitelens.plans.skew import salted_join

    kw = salted_join(keywords, wc, key, spread_by="word", how="inner")
    # null for the others, which the list leaves out
    listed = F.when(_over_used(col("frequency")), F.struct(*order, "word"))
    tot = kw.groupBy(key).agg(
        F.sum("frequency").cast("bigint").alias("total_keyword_freq"),
        F.transform(F.array_sort(F.collect_list(listed)), lambda s: s["word"]).alias("over_used"),
    )
    return top.join(tot, key, "full")


def ml_result(analysis: DataFrame, keywords: DataFrame, key: str = "page_id", order: list[str] | None = None,
              texts: DataFrame | None = None, over_used: bool | None = None) -> DataFrame:
    """One wide row per key: sentiment, density, additions, over-use, suggestions count, score.

    Joins only per-key frames (one row per key each); the keyword branch
    carries at most ten words and the over-used ones per key.  ``texts`` (``key,
    title, description, raw_text``; default: ``analysis``) feeds the text-derived
    branches, so a page plan can read them from its persisted base and consume
    the analysis frame once.  ``over_used``: list the over-used words in the row;
    by default at page grain, where they are few.
    """
    texts = texts if texts is not None else analysis
    feats = keyword_features(texts, keywords, key, order)
    senti = sentiment(texts, key)
    wc = texts.select(key, whitespace_words("raw_text").alias("word_count"))
    a = analysis.select(key, "completeness_score", "keyword_count")
    j = a.join(wc, key, "left").join(senti, key, "left").join(feats, key, "left")
    j = j.withColumn("total_keyword_freq", F.coalesce("total_keyword_freq", lit(0)))
    j = j.select("*", *C.density_columns(col("word_count"), col("total_keyword_freq")))
    empty = F.array().cast("array<string>")
    additions = F.when((col("word_count") > 0) & (col("density") < C.DENSITY_LOW), F.coalesce("top3", empty)).otherwise(empty)
    if over_used is None:
        over_used = key == "page_id"
    over = [F.coalesce("over_used", empty).alias("over_used")] if over_used else []
    return j.select(
        key,
        "sentiment_score",
        "sentiment_label",
        "sentiment_confidence",
        "power_words",
        "emotional_triggers",
        "negative_words",
        col("word_count").cast("bigint").alias("word_count"),
        col("total_keyword_freq").cast("bigint").alias("total_keyword_freq"),
        "density",
        "density_score",
        "is_stuffed",
        additions.alias("recommended_additions"),
        *over,
        "keyword_count",
        "completeness_score",
        S.optimization_score(col("completeness_score"), col("sentiment_score"), col("density_score"),
                             col("keyword_count")).alias("optimization_score"),
    )


def recommendations_for(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """Trend advice then audit rules, ranked by priority (``rec_rank``)."""
    return S.ranked_recommendations(analysis, key)


def suggestions_for(keywords: DataFrame, key: str = "page_id", order: list[str] | None = None, year: int = 2026):
    if key == "page_id" and not order:
        from sitelens.operators.keywords import page_top

        top = page_top(keywords, 10)
    else:
        order = order or SITE_ORDER
        top = packed_top(keywords, 10, key, "top10", [col(c) for c in order])
    top = top.select(key, F.slice("top10", 1, 5).alias("top5"), F.slice("top10", 1, 3).alias("top3"))
    return C.title_suggestions(top, key, year), C.description_suggestions(top, key)

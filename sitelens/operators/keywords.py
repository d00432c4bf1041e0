"""Keywords and phrases: explode, anti-join, aggregate, top-k window, site merge.

Scores are computed in FLOAT (IEEE single precision) on purpose: the
reference computes them in f32, and doing the same arithmetic in the same
order gives the same numbers and therefore the same top-k cut-offs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit, memo

from sitelens.functions import patterns as P
from sitelens.operators import dims

MAX_WORDS = 50
MAX_PHRASES = 10
#: Keys of which one value is one text.
TEXT_KEYS = ("page_id", "doc_id")


def f32(x) -> Column:
    """A FLOAT literal or a column cast to FLOAT (keeps arithmetic in single precision)."""
    if isinstance(x, (int, float)):
        return memo(("f32", float(x)), lambda: lit(x).cast("float"))
    return x.cast("float")


def fdiv(a: Column, b: Column) -> Column:
    """Single-precision quotient.

    Spark divides in double; rounding the double quotient of two floats back
    to float gives exactly the IEEE single-precision quotient.
    """
    return (f32(a) / f32(b)).cast("float")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, lit(P.LONG_WORD), lit(0))


def _phrases(text: Column) -> Column:
    n_words = lambda p: F.size(F.regexp_extract_all(p, lit(P.NON_SPACE_RUN), lit(0)))
    return F.filter(F.regexp_extract_all(text, lit(P.PHRASE), lit(0)), lambda p: n_words(p) <= 4)


def keyword_tokens(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    """Words and phrases of each text as one stream: ``key, is_phrase, word``.

    Words: ASCII-letter runs, lower-cased, at least 3 long, minus stop words
    (broadcast left-anti join against a fixed 103-row list).  Phrases: runs of
    two or more Capitalized words, greedy and non-overlapping, lower-cased, at
    most 4 words.  One explode serves both, so the text is scanned once.
    """
    spark = base.sparkSession
    arrays = base.select(key, _words(col(text)).alias("words"), _phrases(col(text)).alias("phrases"))
    # whole words are exploded and lower-cased as rows: lambdas over the array cost twice as much
    arr = arrays.select(key, F.size("words").alias("n_words"), F.concat("words", "phrases").alias("arr"))
    # outer: behind a plain explode Catalyst may infer a size() > 0 filter that extracts all again
    tok = arr.select(key, "n_words", F.posexplode_outer("arr").alias("pos", "word"))
    # the words come first; a text without tokens gives no row
    tok = tok.where(col("pos").isNotNull()).select(key, (col("pos") >= col("n_words")).alias("is_phrase"), F.lower("word").alias("word"))
    # phrases hold a space, so they never meet a stop word
    return tok.join(dims.small(dims.stop_words(spark)), "word", "left_anti").select(key, "is_phrase", "word")


def word_tokens(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    return keyword_tokens(base, key, text).where(~col("is_phrase")).select(key, "word")


def phrase_tokens(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    return keyword_tokens(base, key, text).where(col("is_phrase")).select(key, col("word").alias("phrase"))


def keyword_frequency(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Count per (key, kind, word); ``total_words`` = kept tokens of that kind and key.

    The count is a partial aggregate (combined per task before the shuffle).
    One text's words fit one window; a site's or source's may not, so there the
    totals are an aggregate of their own, joined back (a skewed join splits).
    """
    counts = tokens.groupBy(key, "is_phrase", "word").agg(F.count(lit(1)).alias("frequency"))
    if key not in TEXT_KEYS:
        totals = counts.groupBy(key, "is_phrase").agg(F.sum("frequency").alias("total_words"))
        return counts.join(totals, [key, "is_phrase"])
    return counts.withColumn("total_words", F.sum("frequency").over(Window.partitionBy(key, "is_phrase")))


def word_frequency(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    f = keyword_frequency(word_tokens(base, key, text).withColumn("is_phrase", lit(False)), key)
    return f.select(key, "word", "frequency", "total_words")


def word_score(frequency="frequency", total="total_words", word="word") -> Column:
    """100 * (f / total) * (1 + min(len/10, 1)), in single precision like the reference."""
    tf = fdiv(col(frequency), F.greatest(col(total), lit(1)))
    bonus = F.least(fdiv(F.octet_length(word), lit(10)), f32(1.0))
    return tf * f32(100.0) * (f32(1.0) + bonus)


def keyword_scores(freq: DataFrame, key: str = "page_id") -> DataFrame:
    """Score and keep the best 50 words and 10 phrases per key.

    Words score ``word_score``, phrases ``5 * count``; ties break on the word.
    ``rank`` is the position in the reference's keyword list (words 1..50,
    phrases 51..60) and breaks score ties stably later on.
    """
    score = F.when(col("is_phrase"), f32(col("frequency")) * f32(5.0)).otherwise(word_score())
    w = Window.partitionBy(key, "is_phrase").orderBy(col("score").desc(), col("word"))
    ranked = freq.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    kept = ranked.where(col("rank") <= MAX_WORDS).where(~col("is_phrase") | (col("rank") <= MAX_PHRASES))
    return kept.select(
        key,
        "word",
        "frequency",
        col("score").cast("double").alias("score"),
        "is_phrase",
        (col("rank") + F.when(col("is_phrase"), lit(MAX_WORDS)).otherwise(lit(0))).cast("int").alias("rank"),
    )


def page_keywords(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    """Words (up to 50) then phrases (up to 10): ``key, word, frequency, score, is_phrase, rank``."""
    return keyword_scores(keyword_frequency(keyword_tokens(base, key, text), key), key)


def phrase_scores(base: DataFrame, key: str = "page_id", text: str = "raw_text") -> DataFrame:
    return page_keywords(base, key, text).where(col("is_phrase"))


def top_keywords(keywords: DataFrame, n: int, key: str = "page_id", order: list | None = None) -> DataFrame:
    """Best ``n`` keywords per key by score, stable on list order (``rank``).

    The ``row_number() <= n`` filter lets Spark insert a partial group limit
    below the shuffle, so a key with millions of keywords ships at most ``n``
    rows per task.
    """
    order = order or [col("rank")]
    w = Window.partitionBy(key).orderBy(col("score").desc(), *order)
    return keywords.withColumn("top_rank", F.row_number().over(w)).where(col("top_rank") <= n)


def packed_top(keywords: DataFrame, n: int, key: str = "page_id", name: str | None = None, order: list | None = None) -> DataFrame:
    """``key, <name>`` with the top ``n`` words as an ordered array (at most n per key)."""
    name = name or f"top{n}"
    t = top_keywords(keywords, n, key, order)
    return t.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("top_rank", "word"))), lambda s: s["word"]).alias(name)
    )


def page_top(keywords: DataFrame, n: int = 10, key: str = "page_id", name: str | None = None) -> DataFrame:
    """Page grain top-``n`` as an ordered array from one bounded aggregate.

    A page keeps at most 60 keywords, so collecting them per page is bounded
    by the page; order is score descending, then list position (``rank``).
    Unbounded keys (sites) use ``packed_top`` (window with a partial limit).
    """
    name = name or f"top{n}"
    srt = F.array_sort(F.collect_list(F.struct((-col("score")).alias("neg"), "rank", "word")))
    return keywords.groupBy(key).agg(F.transform(F.slice(srt, 1, n), lambda s: s["word"]).alias(name))


def site_keywords(keywords: DataFrame, pages: DataFrame, key: str = "page_id", site: str = "site") -> DataFrame:
    """Union of page keyword lists per site, first page (lowest page_id) wins.

    The aggregate by (site, word) only finds the first page (``min`` of an id: a
    hash aggregate, pre-combined per task; a hot site is spread over tasks by
    word).  Frequency and score then come from that page's own row, looked up
    by (page, word), by which the keyword lists are partitioned already.
    ``first_page_id, first_rank`` keep the merged list order for stable top-k.
    """
    kp = keywords.select(key, "word").join(pages.select(key, site), key)
    first = kp.groupBy(site, "word").agg(F.min(key).alias("first_page_id"))
    own = keywords.select(col(key).alias("first_page_id"), "word", "frequency", "score", "is_phrase", col("rank").alias("first_rank"))
    return first.join(own, ["first_page_id", "word"]).select(site, "word", "frequency", "score", "is_phrase", "first_page_id", "first_rank")


def site_order() -> list[Column]:
    """Merged-list order of site keywords: first page, then position in that page's list."""
    return [col("first_page_id"), col("first_rank")]

"""Lexicon sentiment: tokens, lexicon hits, score, confidence, label.

Works on any key (``page_id`` or ``site``).  Arithmetic is single precision
like the reference, so labels flip at exactly the same scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

from sitelens.functions import patterns as P
from sitelens.operators import dims
from sitelens.operators.keywords import f32, fdiv

# Label cuts (lower bound inclusive) and boosts.
LABEL_CUTS = [(-0.6, "VeryNegative"), (-0.2, "Negative"), (0.2, "Neutral"), (0.6, "Positive")]
POWER_BOOST, POWER_CAP = 0.05, 0.2
EMOTION_BOOST, EMOTION_CAP = 0.03, 0.15


def sentiment_text(title="title", description="description", raw_text="raw_text") -> Column:
    """Title, description and body text joined by spaces (title and description count twice)."""
    return F.concat_ws(
        " ", F.coalesce(col(title), lit("")), F.coalesce(col(description), lit("")), F.coalesce(col(raw_text), lit(""))
    )


def token_array(text: Column) -> Column:
    """Lower-cased runs of letters, digits and '-'."""
    return F.regexp_extract_all(F.lower(text), lit(P.SENTIMENT_TOKEN), lit(0))


def sentiment_tokens(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, pos, token`` for every token of the sentiment text."""
    pre = analysis.select(key, token_array(sentiment_text()).alias("toks"))
    # outer: a plain posexplode makes Catalyst infer a size() > 0 filter that cleans and tokenises the text again
    return pre.select(key, F.posexplode_outer("toks").alias("pos", "token")).where(col("pos").isNotNull())


def lexicon_hits(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, pos, token, list``: broadcast equi-join with the fixed lexicon (a token may hit several lists)."""
    lex = dims.small(dims.lexicon(tokens.sparkSession).withColumnRenamed("word", "token"))
    return tokens.join(lex, "token").select(key, "pos", "token", "list")


def label_of(score: Column) -> Column:
    out = None
    for cut, name in LABEL_CUTS:
        out = (F.when(score < f32(cut), lit(name)) if out is None else out.when(score < f32(cut), lit(name)))
    return out.otherwise(lit("VeryPositive"))


def _among(list_name: str) -> list[str]:
    return dict(dims.LEXICON_LISTS)[list_name]


def sentiment(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, token_count, positive_count, negative_count, sentiment_score, sentiment_confidence,
    sentiment_label, power_words, emotional_triggers, negative_words``.

    Computed in the row: one filter of the token array keeps the words of the
    fixed lexicon (a set of literals), and the four lists are filters of what
    is left.  No join, no group, no exchange; a row stays without any token.
    """
    lexicon = sorted({w for _, words in dims.LEXICON_LISTS for w in words})
    pre = analysis.select(key, token_array(sentiment_text()).alias("toks"))
    hits = pre.select(key, F.size("toks").cast("bigint").alias("token_count"), F.filter("toks", lambda t: t.isin(*lexicon)).alias("hits"))
    of = lambda name: F.filter("hits", lambda t: t.isin(*_among(name)))
    found = hits.select(
        key,
        F.coalesce("token_count", lit(0)).cast("bigint").alias("token_count"),
        F.size(of("positive")).cast("bigint").alias("positive_count"),
        F.size(of("negative")).cast("bigint").alias("negative_count"),
        of("power").alias("power_words"),
        of("emotional").alias("emotional_triggers"),
        of("negative").alias("negative_words"),
    )
    return score_columns(found, key)


def score_columns(agg: DataFrame, key: str) -> DataFrame:
    p, n = col("positive_count"), col("negative_count")
    base = fdiv(f32(p) - f32(n), F.greatest(p + n, lit(1)))
    power = F.least(f32(F.size("power_words")) * f32(POWER_BOOST), f32(POWER_CAP))
    emo = F.least(f32(F.size("emotional_triggers")) * f32(EMOTION_BOOST), f32(EMOTION_CAP))
    raw = F.greatest(F.least(base + power + emo, f32(1.0)), f32(-1.0))
    empty = col("token_count") == 0
    score = F.when(empty, f32(0.0)).otherwise(raw)
    conf = F.when(empty, f32(0.0)).otherwise(F.least(fdiv(p + n, F.greatest(col("token_count"), lit(1))) * f32(5.0), f32(1.0)))
    return agg.select(
        key,
        "token_count",
        "positive_count",
        "negative_count",
        score.cast("double").alias("sentiment_score"),
        conf.cast("double").alias("sentiment_confidence"),
        label_of(score).alias("sentiment_label"),
        "power_words",
        "emotional_triggers",
        "negative_words",
    )

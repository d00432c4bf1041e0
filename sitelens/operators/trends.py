"""Structured-data trends per business type, and the advice they trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

from sitelens.operators import dims

# Advice added when a trending schema applies.
TREND_ADVICE = [
    ("FAQPage", "Schema", "High", "FAQPage schema is trending - 30%+ CTR increase potential",
     "Add FAQ section with FAQPage structured data"),
    ("Review", "Schema", "High", "Review/Rating schema drives highest CTR improvements",
     "Add customer reviews with Review/AggregateRating schema"),
]


def schema_trends(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, trend_ord, schema_type, trend_score, has_rich_snippets, description, action``.

    Broadcast equi-join of each key's business type with the fixed
    (schema, applicable type) dimension (35 rows); Unknown matches nothing.
    """
    t = dims.small(dims.schema_trends(analysis.sparkSession))
    j = analysis.select(key, "business_type").join(t, "business_type")
    return j.select(
        key,
        "trend_ord",
        "schema_type",
        "trend_score",
        "has_rich_snippets",
        "description",
        F.concat(lit("Add "), col("schema_type"), lit(" schema to your page")).alias("action"),
    )


def trend_recommendations(trends: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, seq, category, priority, message, action`` for FAQPage / Review when they apply."""
    adv = dims.small(
        trends.sparkSession.createDataFrame(
            [(i, *a) for i, a in enumerate(TREND_ADVICE)],
            "seq int, schema_type string, category string, priority string, message string, action string",
        )
    )
    hits = trends.select(key, "schema_type").join(adv, "schema_type")
    return hits.select(key, "seq", "category", "priority", "message", "action")

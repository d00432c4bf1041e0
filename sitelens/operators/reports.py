"""Reports: the Markdown site report, the console summary as a row, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

# Report glyphs and headings.
CHECK, CROSS = "✅", "❌"
PRIORITY_LABELS = {"Critical": "🔴 Critical", "High": "🟠 High", "Medium": "🟡 Medium", "Low": "🟢 Low"}
AUDIT_ROWS = [
    ("Title", "has_title"),
    ("Description", "has_description"),
    ("Open Graph", "has_og_tags"),
    ("Twitter Cards", "has_twitter_cards"),
    ("Schema.org", "has_schema"),
]
SUMMARY_CHECKS = ["has_title", "has_description", "has_og_tags", "has_twitter_cards", "has_schema", "has_canonical", "has_viewport"]


def two_decimals(x: Column) -> Column:
    """Fixed two decimals, ties to even (how the reference prints floats)."""
    return F.format_string("%.2f", F.bround(x, 2))


def _priority_label(priority: Column) -> Column:
    out = None
    for k, v in PRIORITY_LABELS.items():
        out = F.when(priority == k, lit(v)) if out is None else out.when(priority == k, lit(v))
    return out


def packed_recommendations(recs: DataFrame, key: str = "site") -> DataFrame:
    """``key, recs_md, rec_messages``: recommendations in rank order (at most a few per key)."""
    md = F.concat(lit("### "), _priority_label(col("priority")), lit(" - "), col("message"),
                  lit("\n**Action**: "), col("action"), lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("rec_rank", md.alias("md"), col("message").alias("msg"))))
    return recs.groupBy(key).agg(parts.alias("p")).select(
        key,
        F.array_join(F.transform("p", lambda s: s["md"]), "").alias("recs_md"),
        F.array_join(F.transform("p", lambda s: s["msg"]), " | ").alias("rec_messages"),
    )


def packed_keywords(top10: DataFrame, key: str = "site") -> DataFrame:
    """``key, keywords, keywords_md, keywords_line`` from ranked top-10 rows (``top_rank``)."""
    md = F.concat(col("top_rank").cast("string"), lit(". "), col("word"), lit(" (score: "),
                  two_decimals(col("score")), lit(")\n"))
    line = F.concat(col("word"), lit(" (freq: "), col("frequency").cast("string"), lit(", score: "),
                    two_decimals(col("score")), lit(")"))
    entry = F.struct("word", "frequency", "score", "is_phrase")
    parts = F.array_sort(F.collect_list(F.struct("top_rank", md.alias("md"), line.alias("line"), entry.alias("entry"))))
    return top10.groupBy(key).agg(parts.alias("p")).select(
        key,
        F.transform("p", lambda s: s["entry"]).alias("keywords"),
        F.array_join(F.transform("p", lambda s: s["md"]), "").alias("keywords_md"),
        F.array_join(F.transform("p", lambda s: s["line"]), "; ").alias("keywords_line"),
    )


def site_report(row: DataFrame, generated_at: str, key: str = "site") -> DataFrame:
    """``key, report_md``: the Markdown report, one per site.

    ``row`` holds per site: framework, business_type, page_count, audit flags,
    completeness_score, optimization_score, recs_md, keywords_md.
    ``generated_at`` is a parameter so the text is repeatable.
    """
    audit = [F.concat(lit(f"| {label} | "), F.when(col(flag), lit(CHECK)).otherwise(lit(CROSS)), lit(" |\n"))
             for label, flag in AUDIT_ROWS]
    md = F.concat(
        lit("# SEO Analysis Report\n\n"),
        lit(f"Generated: {generated_at}\n\n"),
        lit("## Overview\n\n"),
        lit("- **Framework**: "), col("framework"), lit("\n"),
        lit("- **Business Type**: "), col("business_type"), lit("\n"),
        lit("- **HTML Files**: "), col("page_count").cast("string"), lit("\n"),
        lit("- **SEO Score**: "), col("completeness_score").cast("string"), lit("/100\n"),
        lit("- **Optimization Score**: "), col("optimization_score").cast("string"), lit("/100\n\n"),
        lit("## SEO Audit\n\n"),
        lit("| Element | Status |\n"),
        lit("|---------|--------|\n"),
        *audit,
        lit("\n## Recommendations\n\n"),
        F.coalesce(col("recs_md"), lit("")),
        lit("## Top Keywords\n\n"),
        F.coalesce(col("keywords_md"), lit("")),
    )
    return row.select(key, md.alias("report_md"))


def analysis_summary(row: DataFrame, key: str = "site") -> DataFrame:
    """What the console shows, as one row per site."""
    checks = [col(c) for c in SUMMARY_CHECKS]
    return row.select(
        key,
        "framework",
        "main_page_id",
        "page_count",
        "business_type",
        "language",
        F.concat(two_decimals(col("sentiment_score")), lit(" ("), col("sentiment_label"), lit(")")).alias("sentiment"),
        F.array_join(F.coalesce(col("power_words"), F.array().cast("array<string>")), ", ").alias("power_words"),
        F.coalesce(col("keywords_line"), lit("")).alias("top_keywords"),
        *checks,
        col("completeness_score").alias("seo_score"),
        "optimization_score",
        F.coalesce(col("trends_line"), lit("")).alias("trending_schemas"),
        F.coalesce(col("rec_messages"), lit("")).alias("recommendations"),
        F.coalesce(col("titles_line"), lit("")).alias("title_suggestions"),
    )

"""Optimization score and ranked recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

from sitelens.operators import dims
from sitelens.operators.keywords import f32
from sitelens.operators.trends import TREND_ADVICE

# Priority order (higher first) and the audit rules, in the
# reference's order: (condition, category, priority, message, action).
PRIORITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
CONTENT_SCORE_CAP_KEYWORDS = 10


def _rec(cond: Column, seq: int, category: str, priority: str, message: Column | str, action: str) -> Column:
    msg = lit(message) if isinstance(message, str) else message
    return F.when(
        cond,
        F.struct(
            lit(seq).alias("seq"),
            lit(category).alias("category"),
            lit(priority).alias("priority"),
            msg.alias("message"),
            lit(action).alias("action"),
        ),
    )


def audit_rule_structs() -> list[Column]:
    tlen = F.octet_length("title")
    h1 = col("h1_count")
    img = col("img_without_alt")
    return [
        _rec(~col("has_title"), 10, "Title", "Critical", "Missing title tag",
             "Add a descriptive title tag (50-60 characters)"),
        _rec(col("has_title") & (tlen < 30), 11, "Title", "Medium", "Title too short",
             "Expand title to 50-60 characters for better CTR"),
        _rec(col("has_title") & (tlen > 60), 12, "Title", "Medium", "Title too long",
             "Shorten title to 60 characters to avoid truncation"),
        _rec(~col("has_description"), 13, "Description", "Critical", "Missing meta description",
             "Add a compelling meta description (150-160 characters)"),
        _rec(~col("has_schema"), 14, "Schema", "High", "Missing Schema.org structured data",
             "Add JSON-LD schema for rich snippets in search results"),
        _rec(~col("has_og_tags"), 15, "Social", "High", "Missing Open Graph tags",
             "Add OG tags for better social media sharing"),
        _rec(~col("has_twitter_cards"), 16, "Social", "Medium", "Missing Twitter Cards",
             "Add Twitter Card meta tags for better Twitter previews"),
        _rec(h1 == 0, 17, "Technical", "High", "Missing H1 heading", "Add exactly one H1 heading per page"),
        _rec(h1 > 1, 18, "Technical", "Medium",
             F.concat(lit("Multiple H1 headings ("), h1.cast("string"), lit(")")),
             "Use only one H1 heading per page"),
        _rec(img > 0, 19, "Technical", "Medium",
             F.concat(img.cast("string"), lit(" images missing alt text")),
             "Add descriptive alt text to all images"),
    ]


def audit_recommendations(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, seq, category, priority, message, action``: every rule in one pass (no join)."""
    recs = F.filter(F.array(*audit_rule_structs()), lambda r: r.isNotNull())
    return analysis.select(key, F.explode(recs).alias("r")).select(key, "r.*")


def ranked_recommendations(analysis: DataFrame, key: str = "page_id") -> DataFrame:
    """Trend advice first, then audit rules, stable-sorted by priority: ``key, rec_rank, category, priority, message, action``.

    Both depend on one row only (a key's advice is at most a dozen entries), so
    they are sorted as an array inside the row: no join, window or exchange.
    """
    rank = F.create_map(*(lit(x) for pair in PRIORITY_RANK.items() for x in pair))
    every = F.filter(F.array(*trend_advice_structs(), *audit_rule_structs()), lambda r: r.isNotNull())
    ordered = F.array_sort(F.transform(every, lambda r: F.struct((-F.element_at(rank, r["priority"])).alias("later"), r["seq"].alias("seq"), r.alias("r"))))
    rows = analysis.select(key, ordered.alias("recs"))
    # outer: a plain posexplode would make Catalyst evaluate the rules again in a size() > 0 filter
    out = rows.select(key, F.posexplode_outer("recs").alias("pos", "rec")).where(col("pos").isNotNull())
    return out.select(key, (col("pos") + 1).alias("rec_rank"), *(col(f"rec.r.{c}").alias(c) for c in ("category", "priority", "message", "action")))


def trend_advice_structs() -> list[Column]:
    """The advice of each trending schema that applies to the row's business type."""
    types = {schema: applies for schema, _, _, applies, _ in dims.SCHEMA_TRENDS}
    return [_rec(col("business_type").isin(*types[schema]), seq, *advice) for seq, (schema, *advice) in enumerate(TREND_ADVICE)]


def optimization_score(completeness: Column, sentiment_score: Column, density_score: Column, keyword_count: Column) -> Column:
    """floor(completeness*40/100) + trunc((s+1)/2*20) + trunc(d*20) + min(2*keywords, 20), capped at 100.

    The two truncated terms are single precision like the reference.
    """
    seo = F.floor(completeness * lit(40) / lit(100))
    s = f32(sentiment_score)
    senti = F.greatest(F.floor(((s + f32(1.0)) / f32(2.0)).cast("float") * f32(20.0)), lit(0))
    dens = F.greatest(F.floor(f32(density_score) * f32(20.0)), lit(0))
    content = F.when(keyword_count >= CONTENT_SCORE_CAP_KEYWORDS, lit(20)).otherwise(keyword_count * 2)
    return F.least(seo + senti + dens + content, lit(100)).cast("bigint")

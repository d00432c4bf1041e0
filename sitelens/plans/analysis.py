"""Analysis plans: the per-page base frame and the per-page / per-site analysis.

``page_base`` derives everything a page row alone determines (cleaned markup,
title, description, audit flags, language, body text) in one projection over
the scan -- no shuffle.  The relational operators (keywords, zones, business
type) then key on ``page_id``; site frames key on ``site``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

from sitelens.functions import html as H
from sitelens.operators.audit import audit_columns, completeness_score
from sitelens.sources.pages import site_key

BASE_COLUMNS = [
    "page_id", "url", "site", "title", "description",
    "has_title", "has_description", "has_og_tags", "has_twitter_cards", "has_schema",
    "has_canonical", "has_viewport", "has_charset", "h1_count", "img_without_alt",
    "language", "raw_text",
]


def page_base(pages: DataFrame, keep_clean: bool = False, include_script_text: bool = False,
              keep_html: bool = False) -> DataFrame:
    """One row per page with every row-local extraction; ``clean``/``title_raw`` optional.

    ``include_script_text`` reproduces the reference's leak of script/style
    text into the body text (off by default, see README).
    """
    extra = [H.clean_comments_only("html").alias("raw_clean")] if include_script_text else []
    c = pages.select("page_id", "url", "html", site_key("url").alias("site"), H.clean_html("html").alias("clean"), *extra)
    c = H.with_tag_arrays(c)
    run = H.body_run("raw_clean", include_script_text=True) if include_script_text else H.body_run("clean")
    t = c.select("*", H.title_raw("clean").alias("title_raw"), H.meta_content().alias("description"), run.alias("_run"))
    cols = [
        "page_id", "url", "site",
        *audit_columns("clean", "title_raw", "description"),
        H.detect_language().alias("language"),
        H.body_text("_run").alias("raw_text"),
    ]
    if keep_clean:
        cols += ["clean", "title_raw"]
    if keep_html:
        cols += ["html"]
    return t.select(*cols)


def with_completeness(df: DataFrame) -> DataFrame:
    return df.withColumn("completeness_score", completeness_score())


def body_text(pages: DataFrame) -> DataFrame:
    return page_base(pages).select("page_id", "raw_text")


def _tags(pages: DataFrame) -> DataFrame:
    return H.with_tag_arrays(pages.select("page_id", H.clean_html("html").alias("clean")))


def detect_language(pages: DataFrame) -> DataFrame:
    return _tags(pages).select("page_id", H.detect_language().alias("language"))


def title_text(pages: DataFrame) -> DataFrame:
    c = pages.select("page_id", H.clean_html("html").alias("clean"))
    return c.select("page_id", H.title_text("clean").alias("title"))


def meta_content(pages: DataFrame) -> DataFrame:
    return _tags(pages).select("page_id", H.meta_content().alias("description"))


def tag_presence(pages: DataFrame) -> DataFrame:
    return _tags(pages).select(
        "page_id",
        H.has_og_tags().alias("has_og_tags"),
        H.has_twitter_cards().alias("has_twitter_cards"),
        H.has_schema().alias("has_schema"),
        H.has_canonical().alias("has_canonical"),
        H.has_viewport().alias("has_viewport"),
        H.has_charset().alias("has_charset"),
    )


def element_counts(pages: DataFrame) -> DataFrame:
    return _tags(pages).select("page_id", H.h1_count("clean").alias("h1_count"), H.img_without_alt().alias("img_without_alt"))



def page_analysis(pages: DataFrame, base: DataFrame | None = None, reuse: bool = True,
                  keywords: DataFrame | None = None) -> DataFrame:
    """One row per page: audit, completeness, business type, schema class, language, summary, text.

    The base frame feeds three branches (audit columns, zone tokens, keyword
    tokens); with ``reuse`` it is written once to the shared folder
    (``session.materialize``) so the markup is parsed once.  The
    zone branch arrives partitioned by page (its single exchange); the keyword
    count is a partial aggregate.
    """
    from sitelens.operators.business import business_type, content_summary, schema_type
    from sitelens.operators.keywords import page_keywords
    from sitelens.operators.zones import zone_text
    from sitelens.session import materialize

    if base is None:
        base = page_base(pages, keep_clean=True)
        if reuse:
            base = materialize(base)
    zones = zone_text(base).withColumn("content_summary", content_summary("zone_text"))
    bt = business_type(zones, carry=["content_summary"])
    kw = keywords if keywords is not None else page_keywords(base)
    kc = kw.groupBy("page_id").agg(F.count(lit(1)).alias("keyword_count"))
    out = (
        base.select(*BASE_COLUMNS)
        .join(bt, "page_id", "left")
        .join(kc, "page_id", "left")
        .withColumn("keyword_count", F.coalesce("keyword_count", lit(0)).cast("bigint"))
        .withColumn("business_type", F.coalesce("business_type", lit("Unknown")))
    )
    return with_completeness(schema_type(out))


#: What a site takes from the last page that has it.
LATEST = ["title", "description", "language", "content_summary", "raw_text", "business_type"]


def site_analysis(analysis: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Merge page analyses per site (the reference's merge algebra).

    Flags OR, counters sum; title, description, language, summary and text:
    last non-null in page order; business type: last non-Unknown.

    Values are materialised late: the site aggregate only finds which page each
    value comes from (``max`` of an id, so all buffers are of fixed width: a hash
    aggregate, pre-combined inside each task, that carries no text), and the
    few winning pages (at most one a value and site) are then looked up by id.
    """
    from sitelens.operators.audit import AUDIT_COUNTS, AUDIT_FLAGS
    from sitelens.operators.business import schema_type

    def last_page(c):
        cond = col(c) != lit("Unknown") if c == "business_type" else col(c).isNotNull()
        return F.max(F.when(cond, col("page_id"))).alias(f"{c}_page")

    aggs = [F.bool_or(f).alias(f) for f in AUDIT_FLAGS]
    aggs += [F.sum(c).cast("bigint").alias(c) for c in AUDIT_COUNTS]
    aggs += [F.count(lit(1)).alias("page_count"), F.max("page_id").alias("any_page")]
    merged = analysis.groupBy("site").agg(*aggs, *map(last_page, LATEST))
    kept = ["site", *AUDIT_FLAGS, *AUDIT_COUNTS, "page_count"]
    # a site's last page stands for the site even if it gives no value
    picks = F.array(*(F.struct(lit(c).alias("field"), col(f"{c}_page").alias("page_id")) for c in [*LATEST, "any"]))
    winners = merged.select(*kept, F.explode(picks).alias("w")).select(*kept, "w.field", "w.page_id").where(col("page_id").isNotNull())
    value = None
    for c in LATEST:
        value = F.when(col("field") == lit(c), col(c)) if value is None else value.when(col("field") == lit(c), col(c))
    fetched = winners.join(analysis.select("page_id", *LATEST), "page_id").select(*kept, "field", value.alias("value"))
    entries = F.collect_list(F.struct("field", "value"))  # at most one a value
    per_site = fetched.groupBy(*kept).agg(F.map_from_entries(entries).alias("latest"))
    s = per_site.select(*kept, *(F.try_element_at("latest", lit(c)).alias(c) for c in LATEST))
    s = s.withColumn("business_type", F.coalesce("business_type", lit("Unknown")))
    if keywords is not None:
        kc = keywords.groupBy("site").agg(F.count(lit(1)).alias("keyword_count"))
        s = s.join(kc, "site", "left").withColumn("keyword_count", F.coalesce("keyword_count", lit(0)).cast("bigint"))
    return with_completeness(schema_type(s))

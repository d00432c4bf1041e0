"""SEO audit: page flags, completeness score, per-site roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions.text import col, lit

AUDIT_FLAGS = [
    "has_title",
    "has_description",
    "has_og_tags",
    "has_twitter_cards",
    "has_schema",
    "has_canonical",
    "has_viewport",
    "has_charset",
]
AUDIT_COUNTS = ["h1_count", "img_without_alt"]

# Completeness weights per audit flag.
COMPLETENESS_WEIGHTS = {
    "has_title": 15,
    "has_description": 15,
    "has_og_tags": 20,
    "has_twitter_cards": 15,
    "has_schema": 20,
    "has_canonical": 5,
    "has_viewport": 5,
    "has_charset": 5,
}


def audit_columns(clean: str = "clean", title_raw: str | None = None, description: str | None = None) -> list[Column]:
    """The twelve audit fields, from a cleaned ``html`` column and its tag arrays
    (``functions.html.with_tag_arrays``).

    ``title_raw`` / ``description`` name columns already extracted upstream, so
    a caller that needs them elsewhere does not evaluate the regexps twice.
    """
    from sitelens.functions.text import trim_ws

    title = trim_ws(col(title_raw)) if title_raw else H.title_text(clean)
    desc = col(description) if description else H.meta_content()
    return [
        title.alias("title"),
        desc.alias("description"),
        F.coalesce(title != lit(""), lit(False)).alias("has_title"),
        F.coalesce(desc != lit(""), lit(False)).alias("has_description"),
        H.has_og_tags().alias("has_og_tags"),
        H.has_twitter_cards().alias("has_twitter_cards"),
        H.has_schema().alias("has_schema"),
        H.has_canonical().alias("has_canonical"),
        H.has_viewport().alias("has_viewport"),
        H.has_charset().alias("has_charset"),
        H.h1_count(clean).alias("h1_count"),
        H.img_without_alt().alias("img_without_alt"),
    ]


def completeness_score(prefix: str = "") -> Column:
    total = lit(0)
    for flag, w in COMPLETENESS_WEIGHTS.items():
        total = total + F.when(col(prefix + flag), lit(w)).otherwise(lit(0))
    return total.cast("bigint")


def page_audit(pages: DataFrame) -> DataFrame:
    """One row per page: the audit record plus its completeness score.

    A single projection over the scan; nothing is shuffled and only
    ``page_id, url, html`` are read.
    """
    from sitelens.sources.pages import site_key

    base = pages.select("page_id", site_key("url").alias("site"), H.clean_html("html").alias("clean"))
    base = H.with_tag_arrays(base)
    return base.select("page_id", "site", *audit_columns("clean")).withColumn(
        "completeness_score", completeness_score()
    )


def site_audit(audit: DataFrame, key: str = "site", order: str = "page_id") -> DataFrame:
    """Merge page audits per site: OR of flags, sum of counters, last non-null title/description.

    Pure partial aggregates (bool_or, sum, max_by) so a hot site is combined
    map-side and ships one row per task.
    """
    aggs = [F.bool_or(f).alias(f) for f in AUDIT_FLAGS]
    aggs += [F.sum(c).cast("bigint").alias(c) for c in AUDIT_COUNTS]
    for c in ["title", "description"]:
        aggs.append(F.max_by(col(c), F.when(col(c).isNotNull(), col(order))).alias(c))
    aggs.append(F.count(lit(1)).alias("page_count"))
    return audit.groupBy(key).agg(*aggs).withColumn("completeness_score", completeness_score())


LIFT_FLAGS = ["has_description", "has_og_tags", "has_twitter_cards", "has_schema"]


def audit_lift(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Before/after audit of an injection, from rows holding ``html`` and ``html_after``.

    Both audits run in the same row (one projection each side), so no join is needed.
    """
    arrays = ("_metas", "_links", "_scripts", "_imgs", "_html_tag")
    c = rows.select(key, H.clean_html("html").alias("c0"), H.clean_html("html_after").alias("c1"))
    c = H.with_tag_arrays(c, "c0").withColumnsRenamed({n: "b" + n for n in arrays})
    c = H.with_tag_arrays(c, "c1").withColumnsRenamed({n: "a" + n for n in arrays})
    cols = []
    for pre, clean in (("b", "c0"), ("a", "c1")):
        r = {n: col(pre + n) for n in arrays}
        cols += [x.alias(pre + "_" + name) for x, name in zip(_audit_from(clean, r), _AUDIT_NAMES)]
    a = c.select(key, *cols)
    out = [key, completeness_score("b_").alias("completeness_before"), completeness_score("a_").alias("completeness_after")]
    for f in LIFT_FLAGS:
        out += [col("b_" + f).alias(f + "_before"), col("a_" + f).alias(f + "_after")]
    return a.select(*out)


_AUDIT_NAMES = ["title", "description", *AUDIT_FLAGS, *AUDIT_COUNTS]


def _audit_from(clean: str, r: dict) -> list[Column]:
    title = H.title_text(clean)
    desc = H.meta_content(r["_metas"])
    return [
        title, desc,
        F.coalesce(title != lit(""), lit(False)),
        F.coalesce(desc != lit(""), lit(False)),
        H.has_og_tags(r["_metas"]), H.has_twitter_cards(r["_metas"]), H.has_schema(r["_scripts"]),
        H.has_canonical(r["_links"]), H.has_viewport(r["_metas"]), H.has_charset(r["_metas"]),
        H.h1_count(clean), H.img_without_alt(r["_imgs"]),
    ]

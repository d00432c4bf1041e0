"""Site-level reporting plans: Markdown report, console summary row, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators import reports as R
from sitelens.operators.audit import AUDIT_COUNTS, AUDIT_FLAGS
from sitelens.operators.keywords import site_order, top_keywords
from sitelens.operators.trends import schema_trends
from sitelens.plans.ml import ml_result, recommendations_for, suggestions_for
from sitelens.plans.site import site_frames
from sitelens.sources.files import detect_framework, no_site_files
from sitelens.sources.pages import main_page

DEFAULT_STAMP = "2026-01-01 00:00:00 UTC"


def report_row(pages: DataFrame, files: DataFrame | None = None, reuse: bool = True, year: int = 2026) -> DataFrame:
    """One row per site with everything the report and the console summary print.

    Each joined frame has one row per site (recommendations, keywords, trends
    and suggestions are packed to a handful of entries per site first), so
    the joins are between per-site frames only.
    """
    f = site_frames(pages, reuse)
    sa, sk = f["site_analysis"], f["site_keywords"]
    ml = ml_result(sa, sk, key="site").select(
        "site", "optimization_score", "sentiment_score", "sentiment_label", "power_words"
    )
    recs = R.packed_recommendations(recommendations_for(sa, "site"))
    kws = R.packed_keywords(top_keywords(sk, 10, key="site", order=site_order()))
    files = files if files is not None else no_site_files(pages.sparkSession)
    fw = detect_framework(files, sites=sa)
    mains = main_page(pages).select("site", "main_page_id")
    tr = schema_trends(sa, "site")
    tr = tr.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("trend_ord"))).where("n <= 5")
    trends = tr.groupBy("site").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("n", F.concat("schema_type", F.lit(" (score: "),
                                                                   F.format_string("%.0f", F.col("trend_score") * 100),
                                                                   F.lit("%)")).alias("t")))),
                lambda s: s["t"],
            ),
            "; ",
        ).alias("trends_line")
    )
    titles = suggestions_for(sk, "site", year=year)[0].where("suggestion_rank <= 3")
    titles = titles.groupBy("site").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("suggestion_rank", "text"))), lambda s: s["text"]),
                     " | ").alias("titles_line")
    )
    row = sa
    for other in (ml, recs, kws, fw, mains, trends, titles):
        row = row.join(other, "site", "left")
    return row


def site_report(pages: DataFrame, generated_at: str = DEFAULT_STAMP, **kw) -> DataFrame:
    return R.site_report(report_row(pages, **kw), generated_at)


def analysis_summary(pages: DataFrame, **kw) -> DataFrame:
    return R.analysis_summary(report_row(pages, **kw))


def page_documents(analysis: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row per page with the whole analysis: audit struct, keyword array, summary and raw text.

    A page keeps at most 60 keywords, so its document is bounded by the page.
    """
    entry = F.struct("rank", "word", "frequency", "score", "is_phrase")
    packed = keywords.groupBy("page_id").agg(F.array_sort(F.collect_list(entry)).alias("keywords"))
    packed = packed.withColumn("keywords", F.transform("keywords", lambda k: k.dropFields("rank")))
    audit = F.struct("title", "description", *AUDIT_FLAGS, *AUDIT_COUNTS, "completeness_score")
    none = F.array().cast("array<struct<word:string,frequency:bigint,score:double,is_phrase:boolean>>")
    row = analysis.join(packed, "page_id", "left")
    return row.select(
        "page_id", "url", "site", "business_type", "schema_type", "language", "content_summary",
        audit.alias("audit"), F.coalesce("keywords", none).alias("keywords"), "raw_text",
    )


def analysis_json(pages: DataFrame, **kw) -> DataFrame:
    """``site, json``: one document per site (merged analysis, top keywords, framework, main page).

    Page-level documents are written by ``sinks.write_analysis_json`` from
    ``page_analysis`` -- a site document never embeds all its pages, so no
    site (however large) is gathered into one row.
    """
    row = report_row(pages, **kw)
    none = F.array().cast("array<struct<word:string,frequency:bigint,score:double,is_phrase:boolean>>")
    result = F.struct(
        "business_type", "language", "content_summary", "title", "description",
        "has_title", "has_description", "has_og_tags", "has_twitter_cards", "has_schema",
        "has_canonical", "has_viewport", "has_charset", "h1_count", "img_without_alt",
        "completeness_score", "keyword_count", F.coalesce("keywords", none).alias("keywords"),
    )
    doc = F.struct(
        F.col("site").alias("root"),
        F.col("main_page_id").alias("main_file"),
        "framework",
        F.col("page_count").alias("files"),
        result.alias("merged"),
    )
    return row.select("site", F.to_json(doc).alias("json"), "optimization_score")


def run_summary(pages: DataFrame, output_dir: str = "out", **kw) -> DataFrame:
    """``site, json`` with the analysis, the output file and the optimization score."""
    a = analysis_json(pages, **kw)
    doc = F.struct(
        F.parse_json(F.col("json")).alias("analysis"),
        F.concat(F.lit(output_dir.rstrip("/") + "/"), F.col("site"), F.lit("/index.html")).alias("output_file"),
        "optimization_score",
    )
    return a.select("site", F.to_json(doc).alias("json"))


#: Where a site document holds what; keywords are listed by place.
DOCUMENT_PATHS = {
    "root": "site", "main_file": "main_page_id", "framework": "framework", "files": "page_count",
    **{f"merged.{c}": c for c in (
        "business_type", "language", "content_summary", "title", "description", "has_title", "has_description",
        "has_og_tags", "has_twitter_cards", "has_schema", "has_canonical", "has_viewport", "has_charset",
        "h1_count", "img_without_alt", "completeness_score", "keyword_count",
    )},
}
NUMBER_PATHS = r"(main_file|files|_count|_without_alt|_score|frequency|score)$"
KEYWORD_FIELDS = ["word", "frequency", "score", "is_phrase"]


def document_values(documents: DataFrame, prefix: str = "", extra: tuple[str, ...] = ()) -> DataFrame:
    """``site, path, value, number``: every value of ``site, json`` documents by its path, absent ones left out.

    Numbers are given as such (``number``), since they may be spelled in more than one way.
    """
    paths = [*extra, *(prefix + p for p in DOCUMENT_PATHS)]
    paths += [f"{prefix}merged.keywords[{i}].{f}" for i in range(10) for f in KEYWORD_FIELDS]
    found = F.array(*(F.struct(F.lit(p).alias("path"), F.get_json_object("json", f"$.{p}").alias("text")) for p in paths))
    rows = documents.select("site", F.explode(found).alias("v")).select("site", "v.path", "v.text").where("text IS NOT NULL")
    number = F.when(F.col("path").rlike(NUMBER_PATHS), F.col("text").cast("double"))
    return rows.select("site", "path", F.when(number.isNull(), F.col("text")).alias("value"), number.alias("number"))

"""Registered queries: each Spark plan with its DuckDB twin.

Every query reads the given tables (``pages`` and frames Spark derives from
it) in full; none uses a row cap or an id subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens import fixtures as X
from sitelens.functions import patterns as P
from sitelens.oracle import duck as D
from sitelens.sources import pages as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def _pages(spark: SparkSession, sf_dir: str, rich: bool = False) -> DataFrame:
    p = S.read_pages(spark, sf_dir)
    return X.pages_rich(p) if rich else p


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.derive_site_config(S.read_pages(spark, sf_dir).select(S.site_key("url").alias("site")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.site_files_from_pages(S.read_pages(spark, sf_dir))


# --- sources -------------------------------------------------------------------


@register("scan_pages", lambda: "SELECT page_id, url, html FROM pages")
def q_scan_pages(spark, sf_dir):
    return S.read_pages(spark, sf_dir)


@register("site_key", lambda: f"SELECT page_id, {D.site_key('url')} AS site FROM pages")
def q_site_key(spark, sf_dir):
    return S.read_pages(spark, sf_dir).select("page_id", S.site_key("url").alias("site"))


@register("main_page", D.main_page)
def q_main_page(spark, sf_dir):
    return S.main_page(S.read_pages(spark, sf_dir))


@register("pages_rich", lambda: D.source(True))
def q_pages_rich(spark, sf_dir):
    return _pages(spark, sf_dir, rich=True)


# --- audit ---------------------------------------------------------------------


@register("page_audit", lambda: D.page_audit(False))
def q_page_audit(spark, sf_dir):
    from sitelens.operators.audit import page_audit

    return page_audit(_pages(spark, sf_dir))


@register("page_audit_rich", lambda: D.page_audit(True))
def q_page_audit_rich(spark, sf_dir):
    from sitelens.operators.audit import page_audit

    return page_audit(_pages(spark, sf_dir, rich=True))


@register("site_audit", lambda: D.site_audit(False))
def q_site_audit(spark, sf_dir):
    from sitelens.operators.audit import page_audit, site_audit

    return site_audit(page_audit(_pages(spark, sf_dir)))


@register("site_audit_rich", lambda: D.site_audit(True))
def q_site_audit_rich(spark, sf_dir):
    from sitelens.operators.audit import page_audit, site_audit

    return site_audit(page_audit(_pages(spark, sf_dir, rich=True)))


# --- extraction --------------------------------------------------------------------


def _base(spark, sf_dir, rich=False):
    from sitelens.plans.analysis import page_base

    return page_base(_pages(spark, sf_dir, rich))


@register("title_text", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, title FROM base")
def q_title_text(spark, sf_dir):
    from sitelens.plans.analysis import title_text

    return title_text(_pages(spark, sf_dir, True))


@register("meta_content", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, description FROM base")
def q_meta_content(spark, sf_dir):
    from sitelens.plans.analysis import meta_content

    return meta_content(_pages(spark, sf_dir, True))


@register(
    "tag_presence",
    lambda: f"WITH {D.base_ctes(True)} SELECT page_id, has_og_tags, has_twitter_cards, has_schema, has_canonical, "
    "has_viewport, has_charset FROM base",
)
def q_tag_presence(spark, sf_dir):
    from sitelens.plans.analysis import tag_presence

    return tag_presence(_pages(spark, sf_dir, True))


@register("element_counts", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, h1_count, img_without_alt FROM base")
def q_element_counts(spark, sf_dir):
    from sitelens.plans.analysis import element_counts

    return element_counts(_pages(spark, sf_dir, True))


@register("detect_language", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, language FROM base")
def q_detect_language(spark, sf_dir):
    from sitelens.plans.analysis import detect_language

    return detect_language(_pages(spark, sf_dir, True))


@register("body_text", lambda: D.body_text_q(False))
def q_body_text(spark, sf_dir):
    from sitelens.plans.analysis import body_text

    return body_text(_pages(spark, sf_dir))


@register("body_text_rich", lambda: D.body_text_q(True))
def q_body_text_rich(spark, sf_dir):
    from sitelens.plans.analysis import body_text

    return body_text(_pages(spark, sf_dir, True))


# --- keywords ----------------------------------------------------------------------


@register("word_tokens", lambda: D.word_tokens(False))
def q_word_tokens(spark, sf_dir):
    from sitelens.operators.keywords import word_tokens

    return word_tokens(_base(spark, sf_dir))


@register("word_frequency", lambda: D.word_frequency(False))
def q_word_frequency(spark, sf_dir):
    from sitelens.operators.keywords import word_frequency

    return word_frequency(_base(spark, sf_dir))


@register("keyword_scores", lambda: D.keyword_scores(False))
def q_keyword_scores(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords

    return page_keywords(_base(spark, sf_dir)).where("NOT is_phrase")


@register("phrase_tokens", lambda: D.phrase_tokens(True))
def q_phrase_tokens(spark, sf_dir):
    from sitelens.operators.keywords import phrase_tokens

    return phrase_tokens(_base(spark, sf_dir, True))


@register("phrase_scores", lambda: D.phrase_scores(True))
def q_phrase_scores(spark, sf_dir):
    from sitelens.operators.keywords import phrase_scores

    return phrase_scores(_base(spark, sf_dir, True))


@register("page_keywords", lambda: D.page_keywords(False))
def q_page_keywords(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords

    return page_keywords(_base(spark, sf_dir))


@register("page_keywords_rich", lambda: D.page_keywords(True))
def q_page_keywords_rich(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords

    return page_keywords(_base(spark, sf_dir, True))


@register("top_keywords", lambda: D.top_keywords(10, True))
def q_top_keywords(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords, top_keywords

    return top_keywords(page_keywords(_base(spark, sf_dir, True)), 10)


@register("site_keywords", lambda: D.site_keywords(True))
def q_site_keywords(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords, site_keywords

    b = _base(spark, sf_dir, True)
    return site_keywords(page_keywords(b), b)


@register("site_top_keywords", lambda: D.site_top_keywords(10, True))
def q_site_top_keywords(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords, site_keywords, site_order, top_keywords

    b = _base(spark, sf_dir, True)
    return top_keywords(site_keywords(page_keywords(b), b), 10, key="site", order=site_order())


# --- zones -------------------------------------------------------------------------


def _zbase(spark, sf_dir, rich=True):
    from sitelens.plans.analysis import page_base

    return page_base(_pages(spark, sf_dir, rich), keep_clean=True)


@register("html_tokens", lambda: D.html_tokens(True))
def q_html_tokens(spark, sf_dir):
    from sitelens.operators.zones import html_tokens

    return html_tokens(_zbase(spark, sf_dir))


@register("element_spans", lambda: D.element_spans(True))
def q_element_spans(spark, sf_dir):
    from sitelens.operators.zones import element_spans, html_tokens

    return element_spans(html_tokens(_zbase(spark, sf_dir)))


@register("zone_text", lambda: D.zone_text(True))
def q_zone_text(spark, sf_dir):
    from sitelens.operators.zones import zone_text

    return zone_text(_zbase(spark, sf_dir))


@register("zone_text_plain", lambda: D.zone_text(False))
def q_zone_text_plain(spark, sf_dir):
    from sitelens.operators.zones import zone_text

    return zone_text(_zbase(spark, sf_dir, rich=False))


# --- business type and analysis ------------------------------------------------------


def _zones(spark, sf_dir, rich=True):
    from sitelens.operators.zones import zone_text

    return zone_text(_zbase(spark, sf_dir, rich))


@register("indicator_scores", lambda: D.indicator_scores(True))
def q_indicator_scores(spark, sf_dir):
    from sitelens.operators.business import indicator_scores

    return indicator_scores(_zones(spark, sf_dir))


@register("business_type", lambda: D.business_type(True))
def q_business_type(spark, sf_dir):
    from sitelens.operators.business import business_type

    return business_type(_zones(spark, sf_dir))


@register("schema_type", lambda: D.schema_type(True))
def q_schema_type(spark, sf_dir):
    from sitelens.operators.business import business_type, schema_type

    return schema_type(business_type(_zones(spark, sf_dir))).select("page_id", "business_type", "schema_type")


@register("content_summary", lambda: D.content_summary(True))
def q_content_summary(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.business import content_summary

    return _zones(spark, sf_dir).select("page_id", content_summary(F.col("zone_text")).alias("content_summary"))


@register("page_analysis", lambda: D.page_analysis(True))
def q_page_analysis(spark, sf_dir):
    from sitelens.plans.analysis import page_analysis

    return page_analysis(_pages(spark, sf_dir, True))


@register("site_analysis", lambda: D.site_analysis(True))
def q_site_analysis(spark, sf_dir):
    from sitelens.plans.site import site_frames

    return site_frames(_pages(spark, sf_dir, True))["site_analysis"]


# --- scoring stage -------------------------------------------------------------------

SENT_COLS = ["token_count", "positive_count", "negative_count", "sentiment_score", "sentiment_confidence",
             "sentiment_label", "power_words", "emotional_triggers", "negative_words"]
SENT_ARRAYS = ["power_words", "emotional_triggers", "negative_words"]
ML_COLS = ["sentiment_score", "sentiment_label", "sentiment_confidence", "power_words", "emotional_triggers",
           "negative_words", "word_count", "total_keyword_freq", "density", "density_score", "is_stuffed",
           "recommended_additions", "over_used", "keyword_count", "completeness_score", "optimization_score"]
ML_ARRAYS = ["power_words", "emotional_triggers", "negative_words", "recommended_additions", "over_used"]


def flat(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Array<string> columns joined into strings (plain values for row-wise comparison)."""
    from pyspark.sql import functions as F

    cols = [
        F.array_join(F.col(f.name), sep).alias(f.name) if f.dataType.simpleString() == "array<string>" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _page_frames(spark, sf_dir, rich=True):
    from sitelens.plans.site import page_frames

    return page_frames(_pages(spark, sf_dir, rich))


def _site_frames(spark, sf_dir, rich=True):
    from sitelens.plans.site import site_frames

    return site_frames(_pages(spark, sf_dir, rich))


def _with_base(tail: str, rich: bool = True) -> str:
    return f"WITH {D.base_ctes(rich)}, {D.sentiment_ctes('base', 'page_id')} {tail}"


@register("sentiment_tokens", lambda: _with_base("SELECT page_id, pos, token FROM st1"))
def q_sentiment_tokens(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment_tokens

    return sentiment_tokens(_base(spark, sf_dir, True))


@register("lexicon_hits", lambda: _with_base("SELECT page_id, pos, token, list FROM sth"))
def q_lexicon_hits(spark, sf_dir):
    from sitelens.operators.sentiment import lexicon_hits, sentiment_tokens

    return lexicon_hits(sentiment_tokens(_base(spark, sf_dir, True)))


@register("page_sentiment", lambda: _with_base(f"SELECT page_id, {D.flat(SENT_COLS, SENT_ARRAYS)} FROM sen"))
def q_page_sentiment(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return flat(sentiment(_base(spark, sf_dir, True)))


@register("sentiment_score", lambda: _with_base("SELECT page_id, sentiment_score FROM sen"))
def q_sentiment_score(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return sentiment(_base(spark, sf_dir, True)).select("page_id", "sentiment_score")


@register("sentiment_confidence", lambda: _with_base("SELECT page_id, sentiment_confidence FROM sen"))
def q_sentiment_confidence(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return sentiment(_base(spark, sf_dir, True)).select("page_id", "sentiment_confidence")


@register("sentiment_label", lambda: _with_base("SELECT page_id, sentiment_label FROM sen"))
def q_sentiment_label(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return sentiment(_base(spark, sf_dir, True)).select("page_id", "sentiment_label")


@register("site_sentiment", lambda: f"{D.site_ml_with(True)} SELECT site, {D.flat(SENT_COLS, SENT_ARRAYS)} FROM sen")
def q_site_sentiment(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return flat(sentiment(_site_frames(spark, sf_dir)["site_analysis"], key="site"))


@register(
    "keyword_density",
    lambda: f"{D.page_ml_with(True)} SELECT page_id, word_count, total_keyword_freq, density, density_score, is_stuffed FROM ml",
)
def q_keyword_density(spark, sf_dir):
    from sitelens.operators.content import keyword_density

    f = _page_frames(spark, sf_dir)
    return keyword_density(f["page_analysis"], f["page_keywords"])


@register(
    "over_used",
    lambda: f"{D.page_ml_with(True)} SELECT k.page_id, k.word, k.frequency, k.rank FROM kw k JOIN wc w USING (page_id) "
    f"WHERE w.word_count > 0 AND ({D.f32('k.frequency')} / {D.f32('greatest(w.word_count, 1)')} * {D.ff(100.0)}) > {D.ff(2.0)}",
)
def q_over_used(spark, sf_dir):
    from sitelens.operators.content import over_used

    f = _page_frames(spark, sf_dir)
    return over_used(f["page_analysis"], f["page_keywords"])


@register("recommended_additions", lambda: f"{D.page_ml_with(True)} SELECT page_id, {D.flat(['recommended_additions'], ['recommended_additions'])} FROM ml")
def q_recommended_additions(spark, sf_dir):
    from sitelens.plans.ml import ml_result

    f = _page_frames(spark, sf_dir)
    return flat(ml_result(f["page_analysis"], f["page_keywords"], texts=f["base"]).select("page_id", "recommended_additions"))


@register("title_suggestions", lambda: f"{D.page_ml_with(True)} SELECT * FROM ts")
def q_title_suggestions(spark, sf_dir):
    from sitelens.plans.ml import suggestions_for

    return suggestions_for(_page_frames(spark, sf_dir)["page_keywords"])[0]


@register("description_suggestions", lambda: f"{D.page_ml_with(True)} SELECT page_id, suggestion_rank, text, score, "
          "array_to_string(emotional_triggers, ', ') AS emotional_triggers, cta_included FROM ds")
def q_description_suggestions(spark, sf_dir):
    from sitelens.plans.ml import suggestions_for

    return flat(suggestions_for(_page_frames(spark, sf_dir)["page_keywords"])[1])


@register("site_title_suggestions", lambda: f"{D.site_ml_with(True)} SELECT * FROM ts")
def q_site_title_suggestions(spark, sf_dir):
    from sitelens.plans.ml import suggestions_for

    return suggestions_for(_site_frames(spark, sf_dir)["site_keywords"], key="site")[0]


@register("schema_trends", lambda: f"{D.page_ml_with(True)} SELECT * FROM trd")
def q_schema_trends(spark, sf_dir):
    from sitelens.operators.trends import schema_trends

    return schema_trends(_page_frames(spark, sf_dir)["page_analysis"])


@register("trend_recommendations", lambda: f"{D.page_ml_with(True)} SELECT * FROM trr")
def q_trend_recommendations(spark, sf_dir):
    from sitelens.operators.trends import schema_trends, trend_recommendations

    return trend_recommendations(schema_trends(_page_frames(spark, sf_dir)["page_analysis"]))


@register("audit_recommendations", lambda: f"{D.page_ml_with(True)} SELECT * FROM aur")
def q_audit_recommendations(spark, sf_dir):
    from sitelens.operators.score import audit_recommendations

    return audit_recommendations(_page_frames(spark, sf_dir)["page_analysis"])


@register("recommendations", lambda: f"{D.page_ml_with(True)} SELECT * FROM rec")
def q_recommendations(spark, sf_dir):
    from sitelens.plans.ml import recommendations_for

    return recommendations_for(_page_frames(spark, sf_dir)["page_analysis"])


@register("site_recommendations", lambda: f"{D.site_ml_with(True)} SELECT * FROM rec")
def q_site_recommendations(spark, sf_dir):
    from sitelens.plans.ml import recommendations_for

    return recommendations_for(_site_frames(spark, sf_dir)["site_analysis"], key="site")


@register(
    "optimization_score",
    lambda: f"{D.page_ml_with(True)} SELECT page_id, completeness_score, sentiment_score, density_score, keyword_count, "
    "optimization_score FROM ml",
)
def q_optimization_score(spark, sf_dir):
    from sitelens.plans.ml import ml_result

    f = _page_frames(spark, sf_dir)
    return ml_result(f["page_analysis"], f["page_keywords"], texts=f["base"]).select(
        "page_id", "completeness_score", "sentiment_score", "density_score", "keyword_count", "optimization_score"
    )


@register("ml_result", lambda: f"{D.page_ml_with(True)} SELECT page_id, {D.flat(ML_COLS, ML_ARRAYS)} FROM ml")
def q_ml_result(spark, sf_dir):
    from sitelens.plans.ml import ml_result

    f = _page_frames(spark, sf_dir)
    return flat(ml_result(f["page_analysis"], f["page_keywords"], texts=f["base"]))


@register(
    "site_over_used",
    lambda: f"{D.site_ml_with(True)} SELECT k.site, k.word, k.frequency, k.first_page_id, k.first_rank FROM sk k JOIN wc w USING (site) "
    f"WHERE w.word_count > 0 AND ({D.f32('k.frequency')} / {D.f32('greatest(w.word_count, 1)')} * {D.ff(100.0)}) > {D.ff(2.0)}",
)
def q_site_over_used(spark, sf_dir):
    from sitelens.operators.content import over_used

    f = _site_frames(spark, sf_dir)
    return over_used(f["site_analysis"], f["site_keywords"], key="site")


@register("site_ml_result", lambda: f"{D.site_ml_with(True)} SELECT site, {D.flat(ML_COLS, ML_ARRAYS)} FROM ml")
def q_site_ml_result(spark, sf_dir):
    from sitelens.plans.ml import ml_result

    f = _site_frames(spark, sf_dir)
    return flat(ml_result(f["site_analysis"], f["site_keywords"], key="site", over_used=True))


# --- generation and injection --------------------------------------------------------


def _gen_frames(spark, sf_dir, rich=True):
    from sitelens.plans.site import generation_frames

    return generation_frames(_pages(spark, sf_dir, rich), _config(spark, sf_dir))


def _gen_col(name: str, expr_sql: str):
    @register(name, lambda: f"{D.page_gen_with(True)} SELECT page_id, {expr_sql} FROM gen")
    def q(spark, sf_dir):
        return _gen_frames(spark, sf_dir)["page_generated"].select("page_id", expr_sql.split(" AS ")[-1] if " AS " in expr_sql else expr_sql)

    return q


_gen_col("meta_block", "meta_tags")
_gen_col("open_graph_block", "open_graph")
_gen_col("twitter_block", "twitter_cards")
_gen_col("json_ld_block", "schema_org")


@register("generate_all", lambda: f"{D.page_gen_with(True)} SELECT * FROM gen")
def q_generate_all(spark, sf_dir):
    return _gen_frames(spark, sf_dir)["page_generated"]


@register("page_injected", lambda: D.page_injected(True))
def q_page_injected(spark, sf_dir):
    return _gen_frames(spark, sf_dir)["page_injected"]


# --- per-function generation and injection queries -----------------------------------


def _gen_expr(name: str):
    @register(name, lambda: D.gen_expr_query(name))
    def q(spark, sf_dir):
        from pyspark.sql import functions as F

        from sitelens.operators import generate as G

        gi = _gen_frames(spark, sf_dir)["gen_input"]
        flag = [F.col("has_faq")] if name in ("faq_schema", "json_ld_graph") else []
        return gi.select("page_id", getattr(G, name)(*flag).alias(name))

    return q


for _name in ["generate_title", "generate_description", "generate_keywords", "og_type", "organization_schema",
              "website_schema", "breadcrumb_schema", "business_schema", "faq_schema", "json_ld_graph"]:
    _gen_expr(_name)


@register("html_escape", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, {D.html_escape('title')} AS title_escaped FROM base")
def q_html_escape(spark, sf_dir):
    from sitelens.functions.text import html_escape

    return _base(spark, sf_dir, True).select("page_id", html_escape("title").alias("title_escaped"))


@register("truncate_words", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, {D.trunc('raw_text', '60')} AS cut60, "
          f"{D.trunc('description', '30')} AS cut30 FROM base")
def q_truncate_words(spark, sf_dir):
    from sitelens.functions.text import truncate_words

    b = _base(spark, sf_dir, True)
    return b.select("page_id", truncate_words("raw_text", 60).alias("cut60"), truncate_words("description", 30).alias("cut30"))


@register("capitalize", lambda: f"{D.with_keywords(True)} SELECT page_id, word, {D.cap('word')} AS capitalized FROM kw")
def q_capitalize(spark, sf_dir):
    from sitelens.functions.text import capitalize
    from sitelens.operators.keywords import page_keywords

    return page_keywords(_base(spark, sf_dir, True)).select("page_id", "word", capitalize("word").alias("capitalized"))


@register("completeness_score", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, {D.completeness()} AS completeness_score FROM base")
def q_completeness_score(spark, sf_dir):
    from sitelens.operators.audit import page_audit

    return page_audit(_pages(spark, sf_dir, True)).select("page_id", "completeness_score")


@register("injection_point", lambda: D.injection_point_q(True))
def q_injection_point(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.inject import injection_point

    return _pages(spark, sf_dir, True).select("page_id", injection_point(F.col("html")).alias("injection_point"))


@register("strip_title", lambda: D.strip_title_q(True))
def q_strip_title(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.inject import strip_title

    return _pages(spark, sf_dir, True).select("page_id", strip_title(F.col("html")).alias("html"))


@register("inject_meta", lambda: D.inject_meta_q(True))
def q_inject_meta(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.inject import inject_meta

    f = _gen_frames(spark, sf_dir)
    j = f["page_generated"].join(_pages(spark, sf_dir, True).select("page_id", "html"), "page_id")
    return j.select("page_id", inject_meta(F.col("html"), F.col("meta_tags")).alias("html"))


@register("audit_lift", lambda: D.audit_lift(True))
def q_audit_lift(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.audit import audit_lift
    from sitelens.operators.inject import inject

    f = _gen_frames(spark, sf_dir)
    j = f["page_generated"].join(_pages(spark, sf_dir, True).select("page_id", "html"), "page_id")
    after = inject(F.col("html"), F.col("meta_tags"), F.col("open_graph"), F.col("twitter_cards"), F.col("schema_org"))
    return audit_lift(j.select("page_id", "html", after.alias("html_after")))


@register("site_main_injected", lambda: D.site_main_injected_q(True))
def q_site_main_injected(spark, sf_dir):
    from sitelens.plans.site import site_generation_frames

    return site_generation_frames(_pages(spark, sf_dir, True), _config(spark, sf_dir))["site_main_injected"]


# --- files, frameworks, reports ---------------------------------------------------------


@register("site_files", D.site_files_q)
def q_site_files(spark, sf_dir):
    return _files(spark, sf_dir)


@register("detect_framework", D.detect_framework_q)
def q_detect_framework(spark, sf_dir):
    from sitelens.sources.files import detect_framework

    return detect_framework(_files(spark, sf_dir))


REPORT_STAMP = "2026-01-01 00:00:00 UTC"


@register("site_report", lambda: D.site_report_q(REPORT_STAMP, True))
def q_site_report(spark, sf_dir):
    from sitelens.plans.report import site_report

    return site_report(_pages(spark, sf_dir, True), REPORT_STAMP, files=_files(spark, sf_dir))


@register("analysis_summary", lambda: D.analysis_summary_q(True))
def q_analysis_summary(spark, sf_dir):
    from sitelens.plans.report import analysis_summary

    return flat(analysis_summary(_pages(spark, sf_dir, True), files=_files(spark, sf_dir)))


@register("analysis_json", lambda: D.analysis_json_q(True))
def q_analysis_json(spark, sf_dir):
    """The documents by path and value, so that two spellings of one document are equal."""
    from sitelens.plans.report import analysis_json, document_values

    return document_values(analysis_json(_pages(spark, sf_dir, True), files=_files(spark, sf_dir)))


@register("run_summary", lambda: D.run_summary_q("out", True))
def q_run_summary(spark, sf_dir):
    from sitelens.plans.report import document_values, run_summary

    documents = run_summary(_pages(spark, sf_dir, True), files=_files(spark, sf_dir))
    return document_values(documents, "analysis.", ("output_file", "optimization_score"))


# --- remaining building blocks ---------------------------------------------------------


@register("clean_html", lambda: f"WITH {D.base_ctes(True)} SELECT page_id, clean FROM base")
def q_clean_html(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.functions.html import clean_html

    return _pages(spark, sf_dir, True).select("page_id", clean_html(F.col("html")).alias("clean"))


@register("decode_entities", lambda: f"WITH {D.base_ctes(False)} SELECT page_id, {D.decode('regexp_extract(clean, ' + D.q(P.TITLE_TEXT) + ', 1)')} AS title_decoded FROM base")
def q_decode_entities(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.functions.html import clean_html
    from sitelens.functions.text import decode_entities

    c = _pages(spark, sf_dir).select("page_id", clean_html(F.col("html")).alias("clean"))
    return c.select("page_id", decode_entities(F.regexp_extract("clean", P.TITLE_TEXT, 1)).alias("title_decoded"))


@register("site_config", lambda: f"WITH {D.base_ctes(False)}, {D.config_cte()} SELECT site, site_name, site_url, default_image, "
          "twitter_handle, facebook_app_id, contact_email, phone, address.street AS street, address.city AS city, "
          "array_to_string(extra_keywords, ', ') AS extra_keywords, locale, generate_canonical, max_description_length, "
          "max_title_length, title_override, description_override FROM cfg")
def q_site_config(spark, sf_dir):
    from pyspark.sql import functions as F

    cfg = _config(spark, sf_dir)
    return cfg.select("site", "site_name", "site_url", "default_image", "twitter_handle", "facebook_app_id",
                      "contact_email", "phone", F.col("address.street").alias("street"), F.col("address.city").alias("city"),
                      F.array_join("extra_keywords", ", ").alias("extra_keywords"), "locale", "generate_canonical",
                      "max_description_length", "max_title_length", "title_override", "description_override")


@register("inject_block", lambda: D.inject_block_q(True))
def q_inject_block(spark, sf_dir):
    from pyspark.sql import functions as F

    from sitelens.operators.inject import inject_block

    f = _gen_frames(spark, sf_dir)
    j = f["page_generated"].join(_pages(spark, sf_dir, True).select("page_id", "html"), "page_id")
    return j.select("page_id", inject_block(F.col("html"), F.col("open_graph")).alias("html"))


# --- plain texts: the same word and sentiment operators over ``documents`` --------------------


DOCUMENT_TEXTS = "SELECT doc_id, source, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description, text AS raw_text FROM documents"


def _documents(spark, sf_dir):
    from pyspark.sql import functions as F

    none = F.lit(None).cast("string")
    docs = S.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", none.alias("title"), none.alias("description"), F.col("text").alias("raw_text"))


@register("document_keywords", lambda: f"WITH base AS ({DOCUMENT_TEXTS}), {D.keyword_ctes('base', 'doc_id')} SELECT * FROM kw")
def q_document_keywords(spark, sf_dir):
    from sitelens.operators.keywords import page_keywords

    return page_keywords(_documents(spark, sf_dir), key="doc_id")


@register("document_sentiment", lambda: f"WITH base AS ({DOCUMENT_TEXTS}), {D.sentiment_ctes('base', 'doc_id')} SELECT doc_id, {D.flat(SENT_COLS, SENT_ARRAYS)} FROM sen")
def q_document_sentiment(spark, sf_dir):
    from sitelens.operators.sentiment import sentiment

    return flat(sentiment(_documents(spark, sf_dir), key="doc_id"))


@register(
    "source_word_frequency",
    lambda: f"WITH base AS ({DOCUMENT_TEXTS}), {D.keyword_ctes('base', 'source')} SELECT source, word, frequency, total_words FROM kf WHERE NOT is_phrase",
)
def q_source_word_frequency(spark, sf_dir):
    """Word counts per source; one source holds a third of all documents."""
    from sitelens.operators.keywords import word_frequency

    return word_frequency(_documents(spark, sf_dir), key="source")

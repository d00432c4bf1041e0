"""Literal pages and frames with known results."""

from pyspark.sql import functions as F

from conftest import one_page, pages_of
from sitelens.operators.audit import page_audit
from sitelens.operators.keywords import page_keywords
from sitelens.operators.sentiment import sentiment
from sitelens.plans.analysis import page_analysis, page_base

SERVICES = (
    "<html lang='en-GB'><head><title>Bike repair service in Basel</title><meta charset=utf-8>"
    "<meta content='Repair service for every bike, ready the same day' name='description'></head>"
    "<body><h1>Repair service</h1><ul><li>Brake service and gear service<li>Wheel truing &amp; frame checks</ul>"
    "<p>Our mechanics repair city bikes, cargo bikes and racing bikes.</body></html>"
)

COMPLETE = (
    "<html><head><META CHARSET='utf-8'><title>Harbour tours</title>"
    "<meta content='width=device-width' name='viewport'><meta name='description' content='Boats > buses'>"
    "<meta property='og:type' content='website'><meta name='twitter:site' content='@h'>"
    "<link href='/tours' rel='CANONICAL'><script type='Application/LD+JSON'>{}</script></head>"
    "<body><img alt='A boat' src='b.png'><h1 class='top'>Tours</h1></body></html>"
)

INCOMPLETE = "<title>Only this</title><h1>One<h1 id=b>Two</h1><img src=a.png><p>x</p>"


def test_services_keywords(spark):
    b = page_base(one_page(spark, SERVICES))
    kws = [r.word for r in page_keywords(b).collect()]
    assert kws and any("service" in w for w in kws)
    a = b.collect()[0]
    assert a.has_title and a.has_description


def test_audit_complete(spark):
    r = page_audit(one_page(spark, COMPLETE)).collect()[0]
    for f in ["has_title", "has_description", "has_og_tags", "has_twitter_cards", "has_schema",
              "has_canonical", "has_viewport", "has_charset"]:
        assert r[f], f
    assert r.h1_count == 1 and r.img_without_alt == 0 and r.completeness_score == 100


def test_audit_incomplete(spark):
    r = page_audit(one_page(spark, INCOMPLETE)).collect()[0]
    assert r.has_title and not r.has_description and not r.has_og_tags
    assert r.h1_count == 2 and r.img_without_alt == 1 and r.completeness_score == 15


def _sent(spark, text):
    df = spark.createDataFrame([(1, None, None, text)], "page_id bigint, title string, description string, raw_text string")
    return sentiment(df).collect()[0]


def test_sentiment_positive_negative_power(spark):
    p = _sent(spark, "This is an amazing, excellent, wonderful product!")
    assert p.sentiment_score == 1.0 and p.sentiment_label == "VeryPositive"  # the cuts, not the reference's test label
    n = _sent(spark, "This is terrible, awful, and disappointing.")
    assert n.sentiment_score == -1.0 and n.sentiment_label == "VeryNegative"
    w = _sent(spark, "Get exclusive free access now! Limited time offer.")
    assert "exclusive" in w.power_words and "free" in w.power_words
    e = _sent(spark, "")
    assert e.sentiment_score == 0.0 and e.sentiment_label == "Neutral" and e.token_count == 0


def test_title_suggestions_two_keywords(spark):
    from sitelens.plans.ml import suggestions_for

    kw = spark.createDataFrame(
        [(1, "software", 10, 0.9, False, 1), (1, "development", 8, 0.8, False, 2)],
        "page_id bigint, word string, frequency bigint, score double, is_phrase boolean, rank int",
    )
    titles, descs = suggestions_for(kw)
    t = [r.text for r in titles.orderBy("suggestion_rank").collect()]
    assert t[0] == "Software - Professional Development Solutions"
    assert "Need Software? Get Expert Help Today" in t
    assert descs.count() == 3


def _analysis_row(spark, business_type, **kw):
    base = dict(page_id=1, site="test.com", title=None, description=None, has_title=False, has_description=False,
                has_og_tags=False, has_twitter_cards=False, has_schema=False, has_canonical=False, has_viewport=False,
                has_charset=False, h1_count=0, img_without_alt=0, business_type=business_type, schema_type=None,
                content_summary=None, raw_text=None, keyword_count=0, completeness_score=0)
    base.update(kw)
    schema = ("page_id bigint, site string, title string, description string, has_title boolean, has_description boolean, "
              "has_og_tags boolean, has_twitter_cards boolean, has_schema boolean, has_canonical boolean, has_viewport boolean, "
              "has_charset boolean, h1_count bigint, img_without_alt bigint, business_type string, schema_type string, "
              "content_summary string, raw_text string, keyword_count bigint, completeness_score bigint")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_trends_service_ecommerce(spark):
    from sitelens.operators.trends import schema_trends

    assert "FAQPage" in [r.schema_type for r in schema_trends(_analysis_row(spark, "Service")).collect()]
    assert "Product" in [r.schema_type for r in schema_trends(_analysis_row(spark, "Ecommerce")).collect()]
    assert schema_trends(_analysis_row(spark, "Unknown")).count() == 0


def test_empty_analysis_gets_recommendations(spark):
    from sitelens.plans.ml import recommendations_for

    recs = recommendations_for(_analysis_row(spark, "Unknown")).orderBy("rec_rank").collect()
    assert recs and recs[0].priority == "Critical"
    assert [r.message for r in recs][:2] == ["Missing title tag", "Missing meta description"]


def test_schema_service_block(spark):
    from sitelens.operators.generate import json_ld_block
    from sitelens.sources.config import site_config

    a = _analysis_row(spark, "Service", schema_type="ProfessionalService").withColumn("top10", F.array().cast("array<string>"))
    cfg = site_config(spark, [dict(site="test.com", site_name="Test Corp", site_url="https://test.com", contact_email="info@test.com")])
    block = a.join(cfg, "site").select(json_ld_block().alias("b")).collect()[0].b
    assert "application/ld+json" in block and "ProfessionalService" in block and "Test Corp" in block
    assert '"email":"info@test.com"' in block


def test_pipeline_injection(spark):
    from sitelens.plans.site import generation_frames

    html = "<html><head><title>Tool rental</title></head><body><h1>Rent a drill</h1><p>Ladders and saws by the day</body></html>"
    out = generation_frames(one_page(spark, html, url="https://example.com/"))["page_injected"].collect()[0]
    assert out.status == "ok"
    for marker in ["og:title", "twitter:card", "application/ld+json"]:
        assert marker in out.html
    assert out.html.count("<title>") == 1


def test_extra_literal_cases(spark):
    rows = [
        (1, "https://a.com/", ""),
        (2, "https://a.com/x", "<h1>Only a heading</h1><p>No head and no body.</p>"),
        (3, "https://a.com/y", '<html lang=""><head><title></title></head><body><!-- <h1>hidden</h1> --><p>x</p></body></html>'),
        (4, "https://a.com/z", "<html><head><title>A title that is 29 bytes long</title></head><body>"
                               "<script>var s = '<h1>fake</h1>';</script></body></html>"),
    ]
    a = {r.page_id: r for r in page_audit(pages_of(spark, rows)).collect()}
    assert a[1].has_title is False and a[1].h1_count == 0
    assert a[2].h1_count == 1
    assert a[3].has_title is False and a[3].h1_count == 0  # comment and script markup do not count
    assert a[4].h1_count == 0 and len("A title that is 29 bytes long".encode()) == 29
    b = {r.page_id: r for r in page_base(pages_of(spark, rows)).collect()}
    assert b[3].language == ""


def test_nested_containers_count_twice(spark):
    from sitelens.operators.zones import zone_text

    html = "<html><head><title>T</title></head><body><main><section><p>Cart Checkout</p></section></main></body></html>"
    z = zone_text(page_base(one_page(spark, html), keep_clean=True)).collect()[0].zone_text
    assert z == "t cart checkout cart checkout "


def test_no_injection_point(spark):
    from sitelens.operators.inject import page_injected

    df = spark.createDataFrame([(1, "<p>plain</p>", "m", "", "", "")],
                               "page_id bigint, html string, meta_tags string, open_graph string, twitter_cards string, schema_org string")
    r = page_injected(df).collect()[0]
    assert r.status == "no_injection_point" and r.html == "<p>plain</p>"


def test_truncate_and_keywords_dedup(spark):
    from sitelens.functions.text import truncate_words
    from sitelens.operators.generate import generate_keywords

    df = spark.createDataFrame([("x" * 170, "short text", "alpha beta gamma delta")], "a string, b string, c string")
    r = df.select(truncate_words("a", 160).alias("a"), truncate_words("b", 160).alias("b"),
                  truncate_words("c", 12).alias("c")).collect()[0]
    assert r.a == "x" * 160 + "..." and r.b == "short text" and r.c == "alpha beta..."
    kw = spark.createDataFrame([(["seo", "web"], ["web", "web", "seo", "web"])], "top10 array<string>, extra_keywords array<string>")
    assert kw.select(generate_keywords().alias("k")).collect()[0].k == "seo, web, seo, web"


def test_nine_and_ten_keywords_content_score(spark):
    from sitelens.operators.score import optimization_score

    df = spark.createDataFrame([(0, 0.0, 0.0, 9), (0, 0.0, 0.0, 10)], "c bigint, s double, d double, k bigint")
    got = [r.o for r in df.select(optimization_score(F.col("c"), F.col("s"), F.col("d"), F.col("k")).alias("o")).collect()]
    assert got == [10 + 18, 10 + 20]


def test_page_analysis_smoke(spark):
    a = page_analysis(one_page(spark, SERVICES)).collect()[0]
    assert a.business_type == "Service" and a.schema_type == "ProfessionalService" and a.language == "en"


def test_script_text_option(spark):
    html = "<html><head><title>T</title></head><body><p>Hello</p><script>var x = '<b>Leaked</b>';</script><p>World</p></body></html>"
    default = page_base(one_page(spark, html)).collect()[0].raw_text
    leaky = page_base(one_page(spark, html), include_script_text=True).collect()[0].raw_text
    assert default == "Hello World T "
    assert leaky == "Hello var x = '<b>Leaked</b>'; World T "


def test_extension_pipelines(spark):
    from pyspark.sql import functions as F

    from sitelens.plans.pipeline import AnalyzerPipeline, InjectorPipeline

    pipe = AnalyzerPipeline.default_pipeline().add(
        "length", lambda base: base.select("page_id", F.length("raw_text").alias("text_length"))
    )
    row = pipe.analyze(one_page(spark, SERVICES)).collect()[0]
    assert row.business_type == "Service" and row.keyword_count > 0 and row.text_length > 0
    inj = InjectorPipeline([("meta_tags", lambda: F.lit("    <meta name=\"x\">"))])
    out = inj.inject(one_page(spark, "<html><head><title>t</title></head><body></body></html>")).collect()[0]
    assert out.html == "<html><head>\n    <meta name=\"x\">\n</head><body></body></html>"


def test_framework_outcomes_and_precedence(spark):
    from sitelens.sources.files import detect_framework

    files = spark.createDataFrame(
        [
            ("a", "index.html", ""),
            ("b", "next.config.js", ""), ("b", "vite.config.js", ""), ("b", "package.json", '{"react": 1}'),
            ("c", "vite.config.ts", ""),
            ("d", "package.json", '{"dependencies": {"react": "18"}}'),
            ("e", "package.json", '{"dependencies": {"vue": "3"}}'),
            ("f", "package.json", '{"devDependencies": {"svelte": "4"}}'),
            ("g", "package.json", '{"name": "x"}'),
            ("h", "src/package.json", '{"react": 1}'),
        ],
        "site string, path string, content string",
    )
    got = {r.site: (r.framework, r.injection_target) for r in detect_framework(files).collect()}
    assert got["a"][0] == "VanillaHtml" and got["b"][0] == "NextJs" and got["c"][0] == "Vite"
    assert got["d"] == ("React", "public/index.html") and got["e"][0] == "Vue" and got["f"] == ("Svelte", "src/app.html")
    assert got["g"][0] == "Unknown" and got["h"][0] == "VanillaHtml"  # only root marker files count


def test_title_length_rules(spark):
    from sitelens.operators.score import audit_recommendations

    rows = []
    for i, n in enumerate([29, 30, 60, 61]):
        rows.append(_analysis_row(spark, "Unknown", page_id=i, title="x" * n, has_title=True, h1_count=1,
                                  has_description=True, has_schema=True, has_og_tags=True, has_twitter_cards=True))
    df = rows[0]
    for r in rows[1:]:
        df = df.unionByName(r)
    msgs = {r.page_id: r.message for r in audit_recommendations(df).collect()}
    assert msgs == {0: "Title too short", 3: "Title too long"}


def test_keyword_ties_break_on_word(spark):
    html = "<html><head><title>t</title></head><body><p>zebra apple mango zebra apple mango</p></body></html>"
    kws = page_keywords(page_base(one_page(spark, html))).orderBy("rank").collect()
    assert [k.word for k in kws] == ["apple", "mango", "zebra"]
    assert len({k.score for k in kws}) == 1 and [k.rank for k in kws] == [1, 2, 3]

"""Literal pages and literal results: HTML extraction without the shared oracle patterns."""

import pytest
from conftest import one_page, pages_of
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import patterns as P
from sitelens.functions.text import decode_entities
from sitelens.operators.inject import injection_point
from sitelens.operators.keywords import phrase_tokens, word_tokens
from sitelens.operators.zones import _zone_stream, zone_segments, zone_text
from sitelens.plans.analysis import page_base

BODY = {
    "<html><head><title>T</title></head><body><p>price < fifty dollars and shipping free</p></body></html>": "price < fifty dollars and shipping free T ",
    '<head></head><body><img alt="a>b" src=x><p>x</p></body>': "x ",
    "<head></head><body><a title='1>0' href=y>in</a> out</body>": "in  out ",
    "<head></head><body><a href=it's>one</a><b title=\">\">two</b></body>": "one two ",
    "<head></head><body>3 <4 and 5<<b>6</b><</body>": "3 <4 and 5 < 6 < ",
    "<title>T</title><!-- <script> --><p>kept</p><script>var a = '<p>no</p>';</script><p>end</p>": "kept end T ",
    "<script>var a = '<!--';</script><p>one</p><!-- two --><p>three</p>": "one three ",
    "<p>before</p><header>top</header><p>after</p>": "before top after ",
    "<style>a > b {}</style><body class='x>y'>z</body>": "z ",
    "": "",
}


@pytest.mark.parametrize("html", list(BODY))
def test_body_text(spark, html):
    assert page_base(one_page(spark, html)).first()["raw_text"] == BODY[html]


def test_title_survives_a_script_mark_in_a_comment(spark):
    row = page_base(one_page(spark, "<!-- <script> --><title>Seen</title><body>b<script>c</script></body>")).first()
    assert (row["title"], row["raw_text"]) == ("Seen", "b Seen ")


ENTITIES = {
    "caf&eacute; &#8217; &rsquo; &#x2019; &#X41;": "café ’ ’ ’ A",
    "&amp;lt; &amp;amp; &lt;b&gt; &quot;&apos;&#39;": "&lt; &amp; <b> \"''",
    "&nbsp;|&#160;|&copy;&middot;&hellip;": " | |©·…",
    "&#146;&#x80;&#0;&#xD800;&#1114112;": "’€���",
    "&nosuch; & &; &# &#x; &eacute AT&T": "&nosuch; & &; &# &#x; é AT&T",
    "&notin; &notit; &not; &copy 2024 &amp &ampx; &ltb&gtc": "∉ ¬it; ¬ © 2024 & &x; <b>c",
    "&CounterClockwiseContourIntegral;&NotEqualTilde;&nGt;&aacutefrac12;": "\u2233\u2242\u0338\u226b\u20d2áfrac12;",
    "&#65 &#x42; &#67= &#000000000068; &#99999999999;&#xffffffffff;": "A B C= D \ufffd\ufffd",
    "?a=1&copy=2&lt=3": "?a=1©=2<=3",
    "&#128512;": "\U0001f600",
    "": "",
}


def test_entities(spark):
    df = spark.createDataFrame([(k,) for k in [*ENTITIES, None]], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", decode_entities("s").alias("d")).collect()}
    assert got == {**ENTITIES, None: None}


ATTRIBUTES = {
    "?a=1&copy=2&lt=3&notit=4&reg": "?a=1&copy=2&lt=3&notit=4®",
    "&copy 1&copy;=2 &notit; &ampx; &#65=&#x42": "© 1©=2 &notit; &ampx; A=B",
}


def test_entities_in_attributes(spark):
    df = spark.createDataFrame([(k,) for k in ATTRIBUTES], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", decode_entities("s", attribute=True).alias("d")).collect()}
    assert got == ATTRIBUTES


@pytest.mark.parametrize("attribute", [False, True])
def test_entities_equal_their_sql_twin(spark, attribute):
    import duckdb

    from sitelens.oracle.duck import decode

    texts = [*ENTITIES, *ATTRIBUTES]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i")
    twin = duckdb.execute(f"SELECT {decode('txt', attribute)} FROM (SELECT unnest(?) AS txt)", [texts]).fetchall()
    assert [r[0] for r in got.select(decode_entities("s", attribute)).collect()] == [r[0] for r in twin]


def test_entities_of_text_equal_the_standard_library(spark):
    from html import unescape
    from html.entities import html5

    texts = [f"a &{name} b &{name}x" for name in html5]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", decode_entities("s").alias("d")).collect()
    assert {r["s"]: r["d"] for r in got} == {t: unescape(t).replace("\u00a0", " ") for t in texts}


POINTS = {
    "<title>t</title><body><header>h</header></body>": 16,
    "<head><title>t</title></head ><body>": 22,
    "<HEAD></HEAD><body>": 6,
    "<header></header>": None,
    "<bodyguard>": None,
}


def test_injection_point_is_not_a_header(spark):
    rows = pages_of(spark, [(i, "u", h) for i, h in enumerate(POINTS)])
    got = {r["html"]: r["p"] for r in rows.select("html", injection_point(F.col("html")).alias("p")).collect()}
    assert got == POINTS


STRAY = [
    "<head></head><body></header><nav><a href=p>Pricing</a></nav></body>",
    "<body></nav></nav><header><a>One</a></header><nav><a>Two</a></body>",
    "<body><nav><a>In</a></header><a>Still</a></nav><a>Out</a></body>",
    "<body><nav><header><a>A</a></nav><a>B</a></header><a>C</a></body>",
    "<body><main>m<section>s</main>t</section><h1>h</body>",
    "<body></main></h1><h2>two</h2><article>x",
]


def test_nav_links_next_to_stray_end_tags(spark):
    base = page_base(one_page(spark, STRAY[0]), keep_clean=True)
    assert "pricing" in zone_text(base).first()["zone_text"]


def test_zone_text_equals_the_interval_join_on_broken_markup(spark):
    base = page_base(pages_of(spark, [(i, "u", h) for i, h in enumerate(STRAY)]), keep_clean=True)
    joined = {}
    for r in sorted(zone_segments(base).collect(), key=lambda r: (r["page_id"], r["grp"], r["open_pos"])):
        joined[r["page_id"]] = joined.get(r["page_id"], "") + r["segment"].lower()
    got = {r["page_id"]: r["zone_text"] for r in zone_text(base).collect()}
    assert got == {i: joined.get(i, "") for i in range(len(STRAY))}


def test_page_of_many_capitalized_words_and_tags(spark):
    page = "<body>" + "Word " * 50_000 + "</body>"
    quoted = "<body><p " + " ".join(f"a{i}='>'" for i in range(20_000)) + ">Two Words</p></body>"
    base = page_base(pages_of(spark, [(1, "u", page), (2, "u", quoted)]))
    words = word_tokens(base).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in words} == {1: 50_000, 2: 2}
    # a run of more than four words is no phrase
    assert [(r["page_id"], r["phrase"]) for r in phrase_tokens(base).collect()] == [(2, "two words")]


@pytest.mark.parametrize("markup", [
    "", "plain", "<p>a</p>\n<p>b</p>", "a < b <<c> d<", "<p>x<", "x<abc", "<a href='x>y'>t</a>tail<!>", "<><b></b></b>&amp;<1", "</p><?x><!y>", "\n", "a\n<p>\n", "<p>\n\n", "< p>é</ p>",
])
def test_text_runs_are_the_text_tokens(spark, markup):
    tokens = F.regexp_extract_all("m", F.lit(P.TOKEN), F.lit(0))
    df = spark.createDataFrame([(markup,)], "m string")
    want = F.filter(tokens, lambda t: ~t.rlike(P.IS_MARKUP))
    words = F.filter(F.regexp_extract_all("m", F.lit(P.WORD), F.lit(0)), lambda w: F.length(w) >= 3)
    r = df.select(H.text_nodes(F.col("m")).alias("got"), want.alias("want"), F.regexp_extract_all("m", F.lit(P.LONG_WORD), F.lit(0)).alias("long"), words.alias("words")).first()
    assert r["got"] == r["want"] and r["long"] == r["words"]


def test_zone_tokens_are_filtered_without_patterns(spark):
    base = spark.createDataFrame([(1, "<P><H1>a</H1>&amp;<br><x class='content'>c</x></p><a/>", "t", None)], "page_id long, clean string, title_raw string, description string")
    stream = _zone_stream(base.union(spark.createDataFrame([(2, None, None, None)], base.schema)))
    rows = [(r["kind"], r["tag"], r["is_content"], r["text"]) for r in stream.orderBy("pos").collect()]
    assert rows == [("head", None, False, "t "), ("head", None, False, ""), ("open", "h1", False, None), ("text", None, False, "a"), ("close", "h1", False, None),
                    ("text", None, False, "&"), ("open", "x", True, None), ("text", None, False, "c"), ("close", "x", False, None), ("open", "a", False, None)]
    plan = stream._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "regexp_extract(" not in above and not any("Filter" in line and "RLIKE" in line for line in above.splitlines())

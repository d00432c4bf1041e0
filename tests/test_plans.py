"""Plan shape: pushdown, pruning, and the number of shuffles per operator."""

import os

from conftest import SF_SMALL
from sitelens.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(spark):
    """Pages as every query reads them."""
    from sitelens.sources.pages import read_pages

    return read_pages(spark, SF_SMALL)


def test_page_local_queries_have_no_shuffle(spark):
    for name in ("page_audit", "page_audit_rich", "body_text", "title_text", "tag_presence", "clean_html"):
        assert "Exchange" not in plan(QUERIES[name](spark, SF_SMALL)), name


def test_site_key_reads_no_markup(spark):
    p = plan(QUERIES["site_key"](spark, SF_SMALL))
    assert "html" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_site_audit_is_partial_aggregate(spark):
    from sitelens.operators.audit import page_audit, site_audit

    p = plan(site_audit(page_audit(scanned(spark))))
    assert p.count("Exchange") == 1 and "partial_" in p


def test_zone_text_single_shuffle(spark):
    from sitelens.operators.zones import zone_text
    from sitelens.plans.analysis import page_base

    p = plan(zone_text(page_base(scanned(spark), keep_clean=True)))
    assert p.count("Exchange") == 1, p


def test_dimensions_are_broadcast(spark):
    p = plan(QUERIES["page_keywords"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_indicators_need_no_join(spark):
    for name in ("indicator_scores", "business_type"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "Join" not in p and p.count("Exchange") == 1, p


def test_bucketed_pages_need_no_shuffle(spark, tmp_dir):
    import os
    from sitelens.operators.keywords import page_keywords
    from sitelens.operators.zones import zone_text
    from sitelens.plans.analysis import page_base
    from sitelens.sources.pages import read_bucketed_pages, read_pages, save_bucketed_pages

    name = "pages_bucketed_" + os.path.basename(tmp_dir).replace("-", "_")
    save_bucketed_pages(read_pages(spark, SF_SMALL), name, 4, path=os.path.join(tmp_dir, "bucketed"))
    pages = read_bucketed_pages(spark, name)
    base = page_base(pages, keep_clean=True)
    for df in (zone_text(base), page_keywords(base)):
        p = plan(df)
        assert "Exchange" not in p.replace("BroadcastExchange", ""), p
    assert zone_text(base).count() == 50


def test_business_type_chain_single_shuffle(spark):
    from sitelens.operators.business import business_type, content_summary
    from sitelens.operators.zones import zone_text
    from sitelens.plans.analysis import page_base

    z = zone_text(page_base(scanned(spark), keep_clean=True)).withColumn("content_summary", content_summary("zone_text"))
    p = plan(business_type(z, carry=["content_summary"]))
    assert p.count("Exchange hashpartitioning") == 1, p
    assert "NestedLoop" not in p


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_heavy_expressions_are_evaluated_once(spark):
    """No filter repeats what a generator below it explodes (Catalyst adds ``size(...) > 0`` to plain ones)."""
    for name in ("indicator_scores", "sentiment_tokens", "lexicon_hits", "zone_text", "recommendations"):
        p = optimized(QUERIES[name](spark, SF_SMALL))
        filters = [x for x in p.splitlines() if "Filter" in x]
        assert not any("size(" in x and ("regexp_extract_all" in x or "from_json" in x or "array_sort" in x) for x in filters), (name, p)


def test_sentiment_and_recommendations_need_no_exchange(spark):
    from sitelens.operators.score import ranked_recommendations
    from sitelens.operators.sentiment import sentiment
    from sitelens.plans.analysis import page_base

    base = page_base(scanned(spark))
    from pyspark.sql import functions as F

    for df in (sentiment(base), ranked_recommendations(base.withColumn("business_type", F.lit("Service")))):
        p = plan(df)
        assert "Exchange" not in p and "Join" not in p and "Window" not in p, p


def test_site_values_are_materialised_late(spark):
    from sitelens.plans.analysis import page_base, site_analysis, with_completeness
    from pyspark.sql import functions as F

    base = page_base(scanned(spark))
    analysis = with_completeness(base).withColumn("business_type", F.lit("Blog")).withColumn("content_summary", F.col("title"))
    p = plan(site_analysis(analysis))
    partial = [x for x in p.splitlines() if "HashAggregate(keys=[site" in x and "partial_max(" in x]
    assert partial and all("raw_text" not in x.split("output=[")[1] for x in partial), p
    assert "SortAggregate" not in p, p


def test_site_keywords_hash_only(spark):
    from sitelens.operators.keywords import page_keywords, site_keywords
    from sitelens.plans.analysis import page_base

    base = page_base(scanned(spark))
    p = plan(site_keywords(page_keywords(base), base))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_generation_joins_no_text(spark):
    from sitelens.operators.generate import generation_input
    from sitelens.plans.analysis import page_base
    from pyspark.sql import functions as F

    base = page_base(scanned(spark))
    top = base.select("page_id", F.array(F.lit("w")).alias("top10"))
    cfg = base.select("site").distinct()
    assert "raw_text" not in generation_input(base, top, cfg).columns


def test_batch_run_moves_no_markup(spark, tmp_dir):
    """The run's page tables share one bucket layout: no exchange carries markup or text."""
    from sitelens.plans.run import injected_pages, page_tables
    from sitelens.plans.report import page_documents
    from sitelens.sources.config import plain_config

    tables = page_tables(scanned(spark), os.path.basename(tmp_dir))
    injected = injected_pages(tables, plain_config(tables["base"].select("site")))
    documents = page_documents(tables["page_analysis"], tables["page_keywords"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, text in ((injected, "html#"), (documents, "raw_text#")):
            p = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            assert text in p
            moved = [x for x in p.split("\n\n") if ") Exchange" in x and text in x]
            assert not moved, moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert injected.where("status = 'ok'").count() == 50


def test_release_deletes_only_unnamed_tables(spark, tmp_dir):
    from sitelens.session import checkpoint_dir, materialize, release

    folder = os.path.join(checkpoint_dir(spark).replace("file:", ""), "tables")
    name = os.path.basename(tmp_dir)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    named, own = materialize(spark.range(3), name), materialize(spark.range(4))
    assert (named.count(), own.count()) == (3, 4)
    release(spark)
    left = {x for x in os.listdir(folder) if x not in before}
    assert left == {name} and named.count() == 3


def test_body_nodes_are_extracted_once(spark):
    """Decoding refers to the body's text several times; its nodes are extracted below it, in one expression."""
    from sitelens.functions import patterns as P
    from sitelens.plans.analysis import page_base

    p = optimized(page_base(scanned(spark)).select("raw_text"))
    assert p.count(P.NEXT_TEXT) == 1, p


def test_indicators_are_found_by_their_longest_match(spark):
    """Overlapping, nested and self-overlapping indicators score as one by one; the pass proposes none that the text lacks."""
    from pyspark.sql import functions as F

    from sitelens.operators import business as B, dims

    texts = ["treatmentreatment saasaas", "cloud computing clouds cloud", "order online orders add to carts", "datai aiai données",
             "the their theme tea", "", None, *dict.fromkeys(i for _, _, i in dims.indicator_rows())]
    zones = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "page_id long, zone_text string")
    want = {}
    for n, t in enumerate(texts):
        for _, o, i in dims.indicator_rows():
            if t and i in t:
                want[n, o] = want.get((n, o), 0) + 1 + (t.count(i) - 1) // 2
    assert {(r.page_id, r.ordinal): r.score for r in B.indicator_scores(zones).collect()} == want
    found = zones.where("page_id = 4").select(B._found(F.col("zone_text")).alias("f")).first().f
    assert found == []


def test_keyword_tokens_run_no_lambda_a_word(spark):
    from sitelens.operators.keywords import keyword_tokens

    texts = ["The Big Red Dog ran. Big\tRed dog", "A b", "One Two Three Four Five", "", None]
    base = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "page_id bigint, raw_text string")
    df = keyword_tokens(base)
    words = {(0, "big"): 2, (0, "red"): 2, (0, "dog"): 2, (0, "ran"): 1, **{(2, w): 1 for w in ("one", "two", "three", "four", "five")}}
    got = {(r.page_id, r.word): r["count"] for r in df.where("NOT is_phrase").groupBy("page_id", "word").count().collect()}
    assert got == words
    assert sorted((r.page_id, r.word) for r in df.where("is_phrase").collect()) == [(0, "big\tred"), (0, "the big red dog")]
    p = optimized(df)
    assert "transform(" not in p and p.count("raw_text#") == optimized(base).count("raw_text#") + 2, p


def test_words_of_a_text_are_counted_once(spark):
    from sitelens.operators.content import over_used

    a = spark.createDataFrame([(1, "buy tea "), (2, " \t\n"), (3, None), (None, "tea")], "page_id bigint, raw_text string")
    k = spark.createDataFrame([(1, "buy", 1, 1), (1, "tea", None, 2), (2, "x", 1, 1), (3, "x", 1, 1), (None, "tea", 1, 1)],
                              "page_id bigint, word string, frequency bigint, rank int")
    df = over_used(a, k)
    assert [tuple(r) for r in df.collect()] == [(1, "buy", 1, 1)]
    assert not any("raw_text" in x for x in optimized(df).splitlines() if "Filter" in x), optimized(df)


def test_page_frames_move_no_tokens(spark):
    from sitelens.operators.content import over_used
    from sitelens.plans.site import page_frames

    f = page_frames(scanned(spark))
    text = f["base"].select("page_id", "raw_text").hint("merge")
    for df in (over_used(text, f["page_keywords"].hint("merge")), f["page_keywords"].groupBy("page_id").count()):
        assert "Exchange" not in plan(df), plan(df)


def test_indicators_pass_the_first_look(spark):
    import re

    from sitelens.operators import business as B

    words = list(B._dispatch())
    look, whole = re.compile(B._may_begin(words)), re.compile(f"(?=({B._longest(words)}))")
    texts = [*words, "ai", "xai", "say ai.", "tech, machine learning? api", "a", "", "qqq", "store hours"]
    for text in texts:
        assert [m.start() for m in whole.finditer(text) if not look.match(text, m.start())] == []
    assert not look.match("qqq") and look.match("ai")


def test_whitespace_words_as_runs(spark):
    from sitelens.functions.text import whitespace_words

    texts = ["", " ", " a", "a ", "a\x0bb", "\ta \r\n b\f", " ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(whitespace_words("t").alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 1, 1, 1, 2, 1, None]

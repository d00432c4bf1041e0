"""The scoring engine over one page of each kind."""

from conftest import pages_of

from sitelens.plans.analysis import page_analysis, page_base
from sitelens.plans.ml import ml_result
from sitelens.operators.keywords import page_keywords


def test_site_grain_has_no_over_used_array(spark):
    """A short last page makes every word of a site over-used; they are rows, not one array."""
    from sitelens.operators.content import over_used
    from sitelens.plans.site import site_frames

    words = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    f = site_frames(pages_of(spark, [(1, "https://a.org/1", f"<body>{words}</body>"), (2, "https://a.org/2", "<body>tiny page</body>")]))
    result = ml_result(f["site_analysis"], f["site_keywords"], key="site")
    assert "over_used" not in result.columns and result.count() == 1
    rows = over_used(f["site_analysis"], f["site_keywords"], key="site").collect()
    assert len(rows) == f["site_keywords"].count() > 40


def test_site_result_lists_over_used_words_in_list_order(spark):
    """Above 2 % of the words of the site's text; words of the first page first, each page's in its own order."""
    from sitelens.plans.ml import keyword_features

    texts = {"a.org": " ".join(["w"] * 50), "b.org": "short text", "c.org": "", "d.org": None, "e.org": "no keywords"}
    a = spark.createDataFrame([(s, None, None, t, 0, 0) for s, t in texts.items()],
                              "site string, title string, description string, raw_text string, completeness_score int, keyword_count bigint")
    k = [("a.org", "late", 2, 9.0, 7, 1), ("a.org", "once", 1, 8.0, 3, 1), ("a.org", "first", 2, 1.0, 3, 2), ("a.org", "pair of", 3, 5.0, 3, 51),
         ("c.org", "none", 5, 1.0, 4, 1), ("d.org", "null", 5, 1.0, 5, 1), (None, "stray", 9, 1.0, 8, 1)]
    k += [("b.org", f"word{i}", 1, 1.0, 6 + i // 60, 1 + i % 60) for i in range(500)]
    k = spark.createDataFrame(k, "site string, word string, frequency bigint, score double, first_page_id bigint, first_rank int")
    want = {"a.org": ["first", "pair of", "late"], "b.org": [f"word{i}" for i in range(500)], "c.org": [], "d.org": []}
    assert {r["site"]: r["over_used"] for r in keyword_features(a, k, "site").where("site IS NOT NULL").collect()} == want
    result = ml_result(a, k, key="site", over_used=True)
    assert {r["site"]: r["over_used"] for r in result.collect()} == {**want, "e.org": []}


def test_site_query_lists_the_over_used_words_of_its_rows(spark, tmp_dir):
    from __spark_entry__ import oracle_sql, queries
    from tools.oracle_check import check, duck_con

    words = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [(1, "https://a.org/1", f"<body>{words}</body>"), (2, "https://a.org/2", "<body>tiny page</body>"),
            (3, "https://b.org/1", "<body>tea tea and tea</body>"), (4, "https://b.org/2", f"<body>{words}</body>"),
            (5, "https://c.org/1", None), (6, "https://c.org/2", "")]
    pages_of(spark, rows).toPandas().to_parquet(f"{tmp_dir}/pages.parquet")
    info = check(spark, duck_con(tmp_dir), "site_ml_result", queries()["site_ml_result"], oracle_sql()["site_ml_result"], tmp_dir)
    assert info["status"] == "OK", info
    listed = {r["site"]: r["over_used"] for r in queries()["site_ml_result"](spark, tmp_dir).collect()}
    of_rows = {}
    for r in sorted(queries()["site_over_used"](spark, tmp_dir).collect(), key=lambda r: (r["first_page_id"], r["first_rank"])):
        of_rows.setdefault(r["site"], []).append(r["word"])
    assert {s: ", ".join(of_rows.get(s, [])) for s in listed} == listed
    assert len(of_rows["a.org"]) > 40 and listed["c.org"] == ""


def test_page_result_covers_empty_and_ordinary_pages(spark):
    pages = pages_of(spark, [(1, "https://a.org/1", ""), (2, "https://a.org/2", "<title>Great</title><body>great great offer for you</body>"), (3, "https://a.org/3", None)])
    base = page_base(pages, keep_clean=True)
    keywords = page_keywords(base)
    rows = {r["page_id"]: r for r in ml_result(page_analysis(pages, base=base, keywords=keywords), keywords, texts=base).collect()}
    assert rows[1]["word_count"] == 0 and rows[1]["over_used"] == []
    assert rows[2]["over_used"][0] == "great" and rows[2]["word_count"] == 6
    assert 0 <= rows[1]["optimization_score"] <= rows[2]["optimization_score"] <= 100


def test_engine_joins_every_scorer(spark):
    from pyspark.sql import functions as F

    from sitelens.plans.pipeline import MlEngine

    pages = pages_of(spark, [(1, "https://a.org/1", "<body>one two three</body>"), (2, "https://a.org/2", "")])
    base = page_base(pages, keep_clean=True)
    keywords = page_keywords(base)
    analysis = page_analysis(pages, base=base, keywords=keywords)
    engine = MlEngine.default_engine().add("length", lambda a, k, key: a.select(key, F.length("raw_text").alias("chars")))
    rows = {r["page_id"]: r for r in engine.process(analysis, keywords).collect()}
    assert rows[1]["chars"] == len("one two three ") and rows[2]["chars"] == 0
    assert rows[1]["word_count"] == 3 and rows[2]["optimization_score"] >= 0

"""A user's analyzer as a table function, through SQL and in the pipeline."""

from conftest import pages_of
from pyspark.sql import functions as F

from sitelens.plans.analysis import page_base
from sitelens.plans.pipeline import AnalyzerPipeline, table_function


@F.udtf(returnType="page_id bigint, shouted int, longest string")
class Shouting:
    """Counts the words in capitals of a page, and names its longest word."""

    def __init__(self):
        self.page, self.shouted, self.longest = None, 0, ""

    def eval(self, row):
        words = (row["raw_text"] or "").split()
        self.page = row["page_id"]
        self.shouted += sum(w.isupper() for w in words)
        self.longest = max([self.longest, *words], key=len)

    def terminate(self):
        yield self.page, self.shouted, self.longest


PAGES = [
    (1, "https://a.org/", "<html><head><title>Boats</title></head><body>BUY NOW quietly</body></html>"),
    (2, "https://a.org/b", "<html><body>nothing here</body></html>"),
    (3, "https://b.org/", "<html><body></body></html>"),
]


def test_table_function_through_sql(spark):
    base = page_base(pages_of(spark, PAGES)).select("page_id", "raw_text")
    got = {r["page_id"]: (r["shouted"], r["longest"]) for r in table_function(base, "shouting", Shouting).collect()}
    assert got == {1: (2, "quietly"), 2: (0, "nothing"), 3: (0, "")}
    base.createOrReplaceTempView("base_pages")
    rows = spark.sql("SELECT page_id FROM shouting(TABLE(base_pages) PARTITION BY page_id) WHERE shouted > 0").collect()
    assert [r["page_id"] for r in rows] == [1]


def test_plugin_columns_join_the_analysis(spark):
    pipeline = AnalyzerPipeline.default_pipeline().add_sql("shouting", Shouting, ["page_id", "raw_text"])
    rows = {r["page_id"]: r for r in pipeline.analyze(pages_of(spark, PAGES)).collect()}
    assert len(rows) == 3 and rows[1]["shouted"] == 2 and rows[1]["title"] == "Boats" and rows[2]["longest"] == "nothing"
    assert {"business_type", "keyword_count", "completeness_score"} <= set(rows[1].asDict())

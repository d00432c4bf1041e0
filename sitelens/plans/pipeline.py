"""Extension surface: analyzer, scorer and injector pipelines built from plain callables.

An analyzer is ``Callable[[DataFrame], DataFrame]`` taking the per-page base
frame (``page_base(..., keep_clean=True)``) and returning one row per
``page_id``; the pipeline joins the results on the key.  A scorer takes
``(analysis, keywords, key)`` and returns one row per key.  An injector is a
``(name, Column)`` block over the generation input.  User code may use
built-in functions or, where they cannot express a rule, ``pandas_udf`` or a
Python table function: ``AnalyzerPipeline.add_sql`` registers one for SQL and
calls it on the base frame partitioned by the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.plans.analysis import page_base
from sitelens.session import materialize

Analyzer = Callable[[DataFrame], DataFrame]
Scorer = Callable[[DataFrame, DataFrame, str], DataFrame]


def _audit(base: DataFrame) -> DataFrame:
    from sitelens.plans.analysis import BASE_COLUMNS, with_completeness

    return with_completeness(base.select(*BASE_COLUMNS))


def _keywords(base: DataFrame) -> DataFrame:
    from sitelens.operators.keywords import page_keywords

    return page_keywords(base).groupBy("page_id").agg(F.count(F.lit(1)).cast("bigint").alias("keyword_count"))


def _business(base: DataFrame) -> DataFrame:
    from sitelens.operators.business import business_type, content_summary
    from sitelens.operators.zones import zone_text

    z = zone_text(base).withColumn("content_summary", content_summary("zone_text"))
    return business_type(z, carry=["content_summary"])


class AnalyzerPipeline:
    def __init__(self, analyzers: list[tuple[str, Analyzer]] | None = None, key: str = "page_id"):
        self.analyzers = list(analyzers or [])
        self.key = key

    @classmethod
    def default_pipeline(cls) -> AnalyzerPipeline:
        return cls([("seo_audit", _audit), ("keywords", _keywords), ("business_type", _business)])

    def add(self, name: str, analyzer: Analyzer) -> AnalyzerPipeline:
        self.analyzers.append((name, analyzer))
        return self

    def add_sql(self, name: str, handler: type, arguments: list[str], order: str | None = None) -> AnalyzerPipeline:
        """Add a Python table function (a UDTF class) as an analyzer that is called through SQL.

        It is registered as ``name`` and gets the rows of the base frame with the
        columns ``arguments`` (the key first), partitioned by the key and ordered
        by ``order``: ``SELECT * FROM name(TABLE(base) PARTITION BY key)``.  It
        returns the key and its own columns, one row a key.
        """

        def analyzer(base: DataFrame) -> DataFrame:
            return table_function(base.select(*arguments), name, handler, self.key, order)

        return self.add(name, analyzer)

    def analyze(self, pages: DataFrame, reuse: bool = True) -> DataFrame:
        """Run every analyzer on one parsed base and join the results by key."""
        base = page_base(pages, keep_clean=True)
        if reuse:
            base = materialize(base)
        out = base.select(self.key)
        for _, fn in self.analyzers:
            out = out.join(fn(base), self.key, "left")
        return out


def table_function(base: DataFrame, name: str, handler: type, key: str = "page_id", order: str | None = None) -> DataFrame:
    """``base`` through the Python table function ``handler``, registered for SQL as ``name``."""
    spark = base.sparkSession
    function = handler if hasattr(handler, "returnType") else F.udtf(handler)
    spark.udtf.register(name, function)
    sorted_by = f" ORDER BY {order}" if order else ""
    return spark.sql(f"SELECT * FROM {name}(TABLE({{base}}) PARTITION BY {key}{sorted_by})", base=base)


class MlEngine:
    def __init__(self, scorers: list[tuple[str, Scorer]] | None = None):
        self.scorers = list(scorers or [])

    @classmethod
    def default_engine(cls) -> MlEngine:
        from sitelens.plans.ml import ml_result

        return cls([("ml_result", lambda a, k, key: ml_result(a, k, key))])

    def add(self, name: str, scorer: Scorer) -> MlEngine:
        self.scorers.append((name, scorer))
        return self

    def process(self, analysis: DataFrame, keywords: DataFrame, key: str = "page_id") -> DataFrame:
        out = analysis.select(key)
        for _, fn in self.scorers:
            out = out.join(fn(analysis, keywords, key), key, "left")
        return out


class InjectorPipeline:
    def __init__(self, injectors: list[tuple[str, Callable[[], Column]]] | None = None):
        self.injectors = list(injectors or [])

    @classmethod
    def default_pipeline(cls) -> InjectorPipeline:
        from sitelens.operators import generate as G

        return cls([("meta_tags", G.meta_block), ("open_graph", G.open_graph_block),
                    ("twitter_cards", G.twitter_block), ("schema_org", lambda: G.json_ld_block(F.col("has_faq")))])

    def add(self, name: str, block: Callable[[], Column]) -> InjectorPipeline:
        self.injectors.append((name, block))
        return self

    def generate_all(self, gen_input: DataFrame, key: str = "page_id") -> DataFrame:
        return gen_input.select(key, *[fn().alias(name) for name, fn in self.injectors])

    def inject(self, gen_input: DataFrame, key: str = "page_id") -> DataFrame:
        """``key, html, status``: every non-empty block inserted at the injection point, in order."""
        from sitelens.operators.inject import has_point, inject

        html = F.col("html")
        return gen_input.select(
            key,
            inject(html, *(fn() for _, fn in self.injectors)).alias("html"),
            F.when(has_point(html), F.lit("ok")).otherwise(F.lit("no_injection_point")).alias("status"),
        )

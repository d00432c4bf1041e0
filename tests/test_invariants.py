"""Invariants over the given tables (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitelens.plans.queries import QUERIES


def test_scores_in_range(spark):
    ml = QUERIES["ml_result"](spark, SF_SMALL)
    r = ml.agg(F.min("optimization_score"), F.max("optimization_score"), F.min("sentiment_score"), F.max("sentiment_score")).collect()[0]
    assert 0 <= r[0] <= r[1] <= 100 and -1.0 <= r[2] <= r[3] <= 1.0


def test_page_keywords_bounded(spark):
    k = QUERIES["page_keywords_rich"](spark, SF_SMALL)
    per = k.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_phrase").cast("int")).alias("p"))
    r = per.agg(F.max("n"), F.max("p")).collect()[0]
    assert r[0] <= 60 and r[1] <= 10


def test_injection_never_lowers_a_flag(spark):
    lift = QUERIES["audit_lift"](spark, SF_SMALL).collect()
    assert lift
    for r in lift:
        assert r.completeness_after >= r.completeness_before
        for f in ["has_description", "has_og_tags", "has_twitter_cards", "has_schema"]:
            assert r[f + "_after"] >= r[f + "_before"]


def test_single_page_site_merge_is_identity(spark):
    pa = QUERIES["page_audit_rich"](spark, SF_SMALL)
    sa = QUERIES["site_audit_rich"](spark, SF_SMALL).where("page_count = 1").drop("page_count")
    cols = sorted(c for c in sa.columns)
    joined = sa.join(pa.select(*[F.col(c).alias("p_" + c) for c in pa.columns]), F.col("site") == F.col("p_site"))
    for r in joined.collect():
        for c in cols:
            if c != "site":
                assert r[c] == r["p_" + c], c


def test_every_query_has_an_oracle(spark):
    import __spark_entry__ as E
    from sitelens.plans.queries import ORACLE

    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"site", "completeness_score", "page_count"}


def test_zone_text_equals_interval_join_formulation(spark):
    from sitelens.operators.zones import zone_segments, zone_text
    from sitelens.plans.analysis import page_base
    from sitelens.fixtures import pages_rich
    from sitelens.sources.pages import read_pages

    base = page_base(pages_rich(read_pages(spark, SF_SMALL)), keep_clean=True)
    segs = zone_segments(base).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "open_pos", "segment"))),
                                 lambda s: s["segment"]), "").alias("zones"))
    head = base.select(
        "page_id",
        F.concat(F.when(F.col("title_raw").isNotNull(), F.concat("title_raw", F.lit(" "))).otherwise(F.lit("")),
                 F.when(F.col("description").isNotNull(), F.concat("description", F.lit(" "))).otherwise(F.lit(""))).alias("head"))
    joined = head.join(segs, "page_id", "left").select(
        "page_id", F.lower(F.concat("head", F.coalesce("zones", F.lit("")))).alias("via_join"))
    both = joined.join(zone_text(base), "page_id")
    rows = both.collect()
    assert len(rows) == 50
    assert all(r.via_join == r.zone_text for r in rows)

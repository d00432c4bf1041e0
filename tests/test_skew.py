"""Skew: one site holding a third of all pages.

Site results are checked against a brute-force computation in pandas on the
small fixture, and the plans must combine the hot site inside each task
(partial aggregates, partial top-k) before the site shuffle.
"""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sitelens.operators.audit import AUDIT_FLAGS, page_audit, site_audit
from sitelens.operators.keywords import page_keywords, site_keywords, site_order, top_keywords
from sitelens.plans.analysis import page_base
from sitelens.sources.pages import read_pages


def hot_pages(spark):
    p = read_pages(spark, SF_SMALL)
    hot = F.concat(F.lit("https://hot.example.com/p"), F.col("page_id").cast("string"))
    return p.withColumn("url", F.when(F.col("page_id") % 3 == 0, hot).otherwise(F.col("url")))


def test_hot_site_audit_matches_brute_force(spark):
    pages = hot_pages(spark)
    pa = page_audit(pages).toPandas()
    got = {r.site: r for r in site_audit(page_audit(pages)).collect()}
    assert got["hot.example.com"].page_count == len(pa[pa.site == "hot.example.com"]) >= 16
    for site, g in pa.sort_values("page_id").groupby("site"):
        r = got[site]
        for f in AUDIT_FLAGS:
            assert r[f] == bool(g[f].any()), (site, f)
        assert r.h1_count == g.h1_count.sum() and r.img_without_alt == g.img_without_alt.sum()
        titles = g.title.dropna()
        assert r.title == (titles.iloc[-1] if len(titles) else None)


def test_hot_site_keywords_match_brute_force(spark):
    pages = hot_pages(spark)
    base = page_base(pages)
    kw = page_keywords(base)
    pk = kw.join(base.select("page_id", "site"), "page_id").toPandas().sort_values(["page_id", "rank"])
    merged = pk.drop_duplicates(["site", "word"], keep="first")  # first page wins
    want = (merged[merged.site == "hot.example.com"]
            .sort_values(["score", "page_id", "rank"], ascending=[False, True, True]).word.head(10).tolist())
    sk = site_keywords(kw, base)
    top = top_keywords(sk, 10, key="site", order=site_order()).where("site = 'hot.example.com'")
    assert [r.word for r in top.orderBy("top_rank").collect()] == want
    assert sk.where("site = 'hot.example.com'").count() == (merged.site == "hot.example.com").sum()


def test_hot_site_plans_combine_before_shuffle(spark):
    pages = hot_pages(spark)
    p = site_audit(page_audit(pages))._jdf.queryExecution().executedPlan().toString()
    # bool_or is planned as a boolean max; both run partially before the exchange
    assert "partial_max(" in p and "partial_max_by" in p and "partial_sum" in p
    base = page_base(pages)
    sk = site_keywords(page_keywords(base), base)
    t = top_keywords(sk, 10, key="site", order=site_order())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in t and "Partial" in t
    assert "partial_min(" in t


def test_hot_site_joins_are_salted(spark):
    from sitelens.plans.site import generation_frames

    f = generation_frames(hot_pages(spark))
    p = f["gen_input"]._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in p
    got = f["gen_input"].where("site = 'hot.example.com'").select("page_id", "site_name").collect()
    assert len(got) >= 16 and all(r.site_name == "hot.example.com" for r in got)
    assert f["gen_input"].count() == 50  # salting neither drops nor duplicates rows

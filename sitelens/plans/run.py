"""End-to-end batch run: analyze, score, generate, inject, report, write.

The shared per-page frames are written once to the folder named by
``spark.checkpoint.dir`` (``session.materialize``): the lineage is cut, every
later output reads compact parquet, and an executor lost mid-run costs only
its running tasks.  They are bucketed by ``page_id``: the input is spread by
page once, and no later step shuffles a page's markup or text again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.generate import generate_all, generation_input
from sitelens.operators.inject import page_injected
from sitelens.operators.keywords import page_keywords, page_top, site_keywords
from sitelens.plans.analysis import page_analysis, page_base, site_analysis
from sitelens.plans.ml import ml_result
from sitelens.plans.report import DEFAULT_STAMP
from sitelens.session import buckets, materialize
from sitelens.sources import sinks
from sitelens.sources.config import plain_config


def page_tables(pages: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """``base``, ``page_keywords`` and ``page_analysis``, all bucketed by ``page_id`` in one layout."""
    rows = pages.select("page_id", "url", "html").repartition(buckets(pages.sparkSession), "page_id")
    base = materialize(page_base(rows, keep_clean=True, keep_html=True), f"{run_id}/page_base", "page_id")
    kw = materialize(page_keywords(base), f"{run_id}/page_keywords", "page_id")
    analysis = materialize(page_analysis(pages, base=base, keywords=kw), f"{run_id}/page_analysis", "page_id")
    return {"base": base, "page_keywords": kw, "page_analysis": analysis}


def injected_pages(tables: dict[str, DataFrame], config: DataFrame) -> DataFrame:
    """Generated blocks put into their page; only the blocks move, the markup stays in its bucket."""
    gen = generate_all(generation_input(tables["page_analysis"], page_top(tables["page_keywords"], 10), config))
    return page_injected(gen.join(tables["base"].select("page_id", "html"), "page_id"))


def run(pages: DataFrame, out_dir: str, config: DataFrame | None = None, generated_at: str = DEFAULT_STAMP,
        run_id: str | None = None, files: DataFrame | None = None) -> dict[str, str]:
    """Write page analysis (JSON Lines), page scores, injected pages, injected main pages and site reports under ``out_dir``.

    ``config`` is a ``site_config`` table and ``files`` a table of site files
    (``sources.files.scan_site_files``); without them no setting is filled in
    but name and URL, and no framework is found.  Intermediate tables go below
    ``run_id`` (a fresh one by default).  Returns the output paths.  Nothing is
    collected to the driver.
    """
    from sitelens.operators import reports as R
    from sitelens.operators.keywords import packed_top, site_order, top_keywords
    from sitelens.plans.ml import recommendations_for
    from sitelens.plans.report import page_documents
    from sitelens.sources.files import detect_framework, no_site_files
    from sitelens.sources.pages import main_page

    out, run_id = out_dir.rstrip("/"), run_id or f"run-{uuid.uuid4().hex[:12]}"
    tables = page_tables(pages, run_id)
    base, kw, analysis = tables["base"], tables["page_keywords"], tables["page_analysis"]

    paths = {}
    paths["page_analysis"] = f"{out}/page_analysis"
    sinks.write_analysis_json(page_documents(analysis, kw), paths["page_analysis"])

    scores = ml_result(analysis, kw, texts=base)
    paths["page_scores"] = f"{out}/page_scores"
    scores.write.mode("overwrite").parquet(paths["page_scores"])

    cfg = config if config is not None else plain_config(base.select("site"))
    paths["page_injected"] = f"{out}/page_injected"
    sinks.write_injected(injected_pages(tables, cfg), paths["page_injected"])

    sk = materialize(site_keywords(kw, base), f"{run_id}/site_keywords")
    sa = materialize(site_analysis(analysis, sk), f"{run_id}/site_analysis")

    top = packed_top(sk, 10, "site", "top10", site_order())
    site_gen = generate_all(generation_input(sa, top, cfg, key="site"), key="site")
    mains = main_page(pages).select("site", F.col("main_page_id").alias("page_id")).join(base.select("page_id", "html"), "page_id")
    paths["site_main_injected"] = f"{out}/site_main_injected"
    sinks.write_injected(page_injected(site_gen.join(mains, "site"), key="site"), paths["site_main_injected"], key="site")

    sml = ml_result(sa, sk, key="site").select("site", "optimization_score")
    recs = R.packed_recommendations(recommendations_for(sa, "site"))
    kws = R.packed_keywords(top_keywords(sk, 10, key="site", order=site_order()))
    fw = detect_framework(files if files is not None else no_site_files(pages.sparkSession), sites=sa)
    row = sa.join(sml, "site", "left").join(recs, "site", "left").join(kws, "site", "left").join(fw, "site", "left")
    paths["site_reports"] = f"{out}/site_reports"
    sinks.write_report(R.site_report(row, generated_at), paths["site_reports"])  # parquet: (site, report_md)
    return paths

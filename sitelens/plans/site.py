"""Site-grain plans: page analysis rolled up per site, with merged keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.operators.keywords import page_keywords, site_keywords
from sitelens.plans.analysis import page_analysis, page_base, site_analysis
from sitelens.session import buckets, materialize


def _keep(df: DataFrame, reuse: bool, key: str | None = None) -> DataFrame:
    """A frame read by several branches, written once to the shared folder, with a ``key`` bucketed by it.

    Later plans start at its scan: they read only the columns they need, are
    planned without the expressions below it, and outlive the executors.
    ``session.release`` deletes the tables.
    """
    return materialize(df, key=key) if reuse else df


def page_frames(pages: DataFrame, reuse: bool = True, keep_html: bool = False) -> dict[str, DataFrame]:
    """``base``, ``page_analysis`` and ``page_keywords`` sharing one parsed base.

    Each is read by several downstream branches (scores, suggestions,
    generation), so with ``reuse`` each is computed once.  The pages are then
    spread by ``page_id`` before anything is extracted and the frames bucketed
    by it: keyword and zone tokens, many times the rows, are never shuffled, and
    every stage keeps all its tasks.
    """
    if reuse:
        pages = pages.repartition(buckets(pages.sparkSession), "page_id")
    base = _keep(page_base(pages, keep_clean=True, keep_html=keep_html), reuse, "page_id")
    kw = _keep(page_keywords(base), reuse, "page_id")
    return {
        "base": base,
        "page_analysis": page_analysis(pages, base=base, keywords=kw),
        "page_keywords": kw,
    }


def site_frames(pages: DataFrame, reuse: bool = True) -> dict[str, DataFrame]:
    """Page frames plus ``site_keywords`` (first page wins) and ``site_analysis``."""
    f = page_frames(pages, reuse)
    sk = _keep(site_keywords(f["page_keywords"], f["base"]), reuse)
    f["site_keywords"] = sk
    # read for the merge and for the values of the winning pages
    f["page_analysis"] = _keep(f["page_analysis"], reuse)
    # one row per site: small, and read by every site-grain branch
    f["site_analysis"] = _keep(site_analysis(f["page_analysis"], sk), reuse)
    return f


def generation_frames(pages: DataFrame, config: DataFrame | None = None, reuse: bool = True, year: int = 2026) -> dict[str, DataFrame]:
    """Page frames plus ``page_generated`` (the four blocks per page) and ``page_injected``.

    ``config`` is a ``site_config`` table (one row per site); without one, name and
    URL come from the site key and nothing else is filled in.  The generated blocks are joined back to the
    page markup by ``page_id`` (the only time markup is shuffled).
    """
    from pyspark.sql import functions as F

    from sitelens.operators.generate import generate_all, generation_input
    from sitelens.operators.inject import page_injected
    from sitelens.operators.keywords import page_top
    from sitelens.sources.config import plain_config

    f = page_frames(pages, reuse, keep_html=True)
    top = page_top(f["page_keywords"], 10)
    cfg = config if config is not None else plain_config(f["base"].select("site"))
    gi = generation_input(f["page_analysis"], top, cfg)
    gen = generate_all(gi)
    f["gen_input"] = gi
    f["site_config"] = cfg
    f["page_generated"] = gen
    f["page_injected"] = page_injected(gen.join(f["base"].select("page_id", "html"), "page_id"))
    return f


def site_generation_frames(pages: DataFrame, config: DataFrame | None = None, reuse: bool = True) -> dict[str, DataFrame]:
    """Site frames plus the site-grain blocks and the injected main page of each site."""
    from pyspark.sql import functions as F

    from sitelens.operators.generate import generate_all, generation_input
    from sitelens.operators.inject import page_injected
    from sitelens.operators.keywords import packed_top
    from sitelens.sources.config import plain_config
    from sitelens.sources.pages import main_page

    f = site_frames(pages, reuse)
    top = packed_top(f["site_keywords"], 10, "site", "top10", [F.col("first_page_id"), F.col("first_rank")])
    cfg = config if config is not None else plain_config(f["site_analysis"].select("site"))
    gen = generate_all(generation_input(f["site_analysis"], top, cfg, key="site"), key="site")
    mains = main_page(pages).select("site", F.col("main_page_id").alias("page_id"))
    main_html = mains.join(pages.select("page_id", "html"), "page_id")
    inj = page_injected(gen.join(main_html, "site"), key="site").join(mains, "site")
    f["site_generated"] = gen
    f["site_main_injected"] = inj.select("site", "page_id", "html", "status")
    return f

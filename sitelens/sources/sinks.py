"""Writers for analysis JSON, injected pages and Markdown reports.

All are distributed DataFrame writes (one file per task), never collected to
the driver, and never written over the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_analysis_json(analysis: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines: one document per row (page or site analysis)."""
    analysis.write.mode(mode).json(path)


def write_injected(injected: DataFrame, path: str, key: str = "page_id", mode: str = "overwrite") -> None:
    """Injected pages as parquet (``key, html, status``); the input files are never overwritten."""
    injected.select(key, "html", "status").write.mode(mode).parquet(path)


def write_injected_files(injected: DataFrame, pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Injected pages as HTML files, one per page at its relative path (``html_tree.file_path`` of its URL).

    Files appear only when every task has succeeded; see ``sources.html_tree``.
    """
    from sitelens.sources.html_tree import file_path, write_tree

    urls = pages.select("page_id", file_path(F.col("url")).alias("path"))
    write_tree(injected.select("page_id", "html").join(urls, "page_id"), path, mode)


def write_report(reports: DataFrame, path: str, key: str = "site", mode: str = "overwrite", per_site_files: bool = False) -> None:
    """Markdown reports.

    By default one parquet table ``(site, report_md)`` -- file count grows with
    the data, not with the number of sites.  ``per_site_files=True`` writes
    one text folder per site (``site=<key>/part-*.txt``), for a few sites.
    """
    df = reports.select(F.col(key).alias("site"), F.col("report_md"))
    if per_site_files:
        df.withColumnRenamed("report_md", "value").write.mode(mode).partitionBy("site").text(path)
    else:
        df.write.mode(mode).parquet(path)

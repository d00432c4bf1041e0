"""Page sources: parquet tables, raw HTML file trees, site keys, main pages."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# scheme://[userinfo@]host[:port]/path?query#fragment
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
INDEX_PATH_RE = r"(^$|^/$|/index\.html?$)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)`` from a parquet table folder, as scanned.

    Markup extraction is CPU-bound and row-local, so it runs in the scan's
    splits (``spark.sql.files.maxPartitionBytes``) at any size, without a
    shuffle of the markup.
    """
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def scan_html_files(spark: SparkSession, root: str, max_depth: int = 5) -> DataFrame:
    """Read a tree of ``.html``/``.htm`` files (one row per file) as ``pages``.

    Directories deeper than ``max_depth`` below ``root`` are not even listed
    (``sources.html_tree``).  The root is the site: it stands percent-encoded as
    the host of ``url``, followed by the file's path below it, and ``page_id``
    is a hash of both, so trees of different roots never share a site or an id.
    ``is_valid_utf8`` is false for files whose bytes are not UTF-8 (their text
    has replacement characters) instead of aborting the job.
    """
    from sitelens.sources.html_tree import read_tree

    root = re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/"))
    return read_tree(spark, root, max_depth).select(
        F.xxhash64(F.lit(root), F.col("path")).alias("page_id"),
        F.concat(F.lit(f"file://{quote(root, safe='')}/"), F.col("path")).alias("url"),
        "html",
        "is_valid_utf8",
    )


def site_key(url="url"):
    """Host of the URL, lower-cased: the grouping key of a site."""
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(c, HOST_RE, 1))


def url_path(url="url"):
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, PATH_RE, 1)


def with_site(pages: DataFrame) -> DataFrame:
    return pages.withColumn("site", site_key("url"))


def main_page(pages: DataFrame) -> DataFrame:
    """Main page per site: an index path (empty, ``/``, ``index.htm[l]``) first, else lowest page_id.

    A partial aggregate (``min_by``) rather than a window, so a site holding a
    third of all pages costs one row per task before the shuffle.
    """
    p = pages.select("page_id", site_key("url").alias("site"), url_path("url").rlike(INDEX_PATH_RE).alias("is_index"))
    rank = F.struct((~F.col("is_index")).alias("not_index"), F.col("page_id"))
    return p.groupBy("site").agg(
        F.min_by("page_id", rank).alias("main_page_id"),
        F.max(F.col("is_index")).alias("has_index_page"),
        F.count(F.lit(1)).alias("page_count"),
    )


def save_bucketed_pages(pages: DataFrame, table: str, num_buckets: int, path: str | None = None) -> None:
    """Write ``pages`` as a table bucketed (and sorted) by ``page_id``.

    A one-time layout cost: afterwards every page-grain operator (keyword
    counts and top-k, zone windows, per-page joins) finds its input already
    hash-partitioned by ``page_id`` and runs without a shuffle.
    """
    w = pages.select("page_id", "url", "html").write.mode("overwrite").bucketBy(num_buckets, "page_id").sortBy("page_id")
    if path:  # an external table on shared storage
        w = w.option("path", path)
    w.format("parquet").saveAsTable(table)


def read_bucketed_pages(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).select("page_id", "url", "html")

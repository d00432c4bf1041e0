"""Site file listings and framework detection."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Framework -> file the injector would target.
INJECTION_TARGETS = [
    ("VanillaHtml", "index.html"),
    ("React", "public/index.html"),
    ("NextJs", "app/layout.tsx or pages/_document.tsx"),
    ("Vue", "index.html"),
    ("Nuxt", "nuxt.config.ts"),
    ("Svelte", "src/app.html"),
    ("Vite", "index.html"),
    ("Angular", "src/index.html"),
    ("Unknown", "index.html"),
]
NEXT_MARKERS = ["next.config.js", "next.config.mjs"]
VITE_MARKERS = ["vite.config.js", "vite.config.ts"]
PACKAGE_JSON = "package.json"

MARKER_GLOB = "{next.config.js,next.config.mjs,vite.config.js,vite.config.ts,package.json}"


def scan_site_files(spark: SparkSession, root: str) -> DataFrame:
    """``site, path, content`` of the marker files that lie directly in ``root``.

    The site key is that of ``scan_html_files`` for the same root.
    """
    root = re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/"))
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", MARKER_GLOB).option("recursiveFileLookup", "false").text(root)
    site = F.lit(quote(root, safe="").lower())
    return files.select(site.alias("site"), F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


def no_site_files(spark: SparkSession) -> DataFrame:
    """The file table of a run whose user gave none: no marker, so every site is plain HTML."""
    return spark.createDataFrame([], "site string, path string, content string")


def detect_framework(files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``site, framework, injection_target`` from root marker files.

    Next > Vite > package.json naming "react" > "vue" > "svelte" > Unknown;
    no package.json: VanillaHtml.  One partial aggregate per site plus a
    broadcast join with the 9-row target dimension.
    """
    path, body = F.col("path"), F.col("content")
    pkg = path == PACKAGE_JSON
    flags = files.groupBy("site").agg(
        F.bool_or(path.isin(*NEXT_MARKERS)).alias("next"),
        F.bool_or(path.isin(*VITE_MARKERS)).alias("vite"),
        F.bool_or(pkg).alias("pkg"),
        F.bool_or(pkg & body.contains('"react"')).alias("react"),
        F.bool_or(pkg & body.contains('"vue"')).alias("vue"),
        F.bool_or(pkg & body.contains('"svelte"')).alias("svelte"),
    )
    fw = (
        F.when(F.col("next"), "NextJs").when(F.col("vite"), "Vite")
        .when(F.col("pkg") & F.col("react"), "React").when(F.col("pkg") & F.col("vue"), "Vue")
        .when(F.col("pkg") & F.col("svelte"), "Svelte").when(F.col("pkg"), "Unknown").otherwise("VanillaHtml")
    )
    out = flags.select("site", fw.alias("framework"))
    if sites is not None:
        out = sites.select("site").distinct().join(out, "site", "left").withColumn(
            "framework", F.coalesce("framework", F.lit("VanillaHtml")))
    targets = F.broadcast(files.sparkSession.createDataFrame(INJECTION_TARGETS, "framework string, injection_target string"))
    return out.join(targets, "framework", "left").select("site", "framework", "injection_target")

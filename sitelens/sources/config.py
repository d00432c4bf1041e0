"""Per-site generation settings (the ``site_config`` table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the generation settings.
DEFAULT_LOCALE = "en_US"
DEFAULT_GENERATE_CANONICAL = True
DEFAULT_MAX_DESCRIPTION = 160
DEFAULT_MAX_TITLE = 60

ADDRESS_TYPE = "struct<street:string,city:string,state:string,postal_code:string,country:string>"
CONFIG_SCHEMA = (
    "site string, site_name string, site_url string, default_image string, twitter_handle string, "
    "facebook_app_id string, contact_email string, phone string, address " + ADDRESS_TYPE + ", "
    "title_override string, description_override string, extra_keywords array<string>, locale string, "
    "generate_canonical boolean, max_description_length int, max_title_length int"
)
OPTIONAL_STRINGS = [
    "default_image", "twitter_handle", "facebook_app_id", "contact_email", "phone",
    "title_override", "description_override",
]


def normalize(config: DataFrame) -> DataFrame:
    """Fill defaults; an empty optional string counts as absent (never a bare '@' or empty image)."""
    cols = []
    for f in CONFIG_SCHEMA.split(", "):
        name = f.split(" ")[0]
        c = F.col(name)
        if name in OPTIONAL_STRINGS:
            c = F.when(c != F.lit(""), c)
        elif name == "extra_keywords":
            c = F.coalesce(c, F.array().cast("array<string>"))
        elif name == "locale":
            c = F.coalesce(c, F.lit(DEFAULT_LOCALE))
        elif name == "generate_canonical":
            c = F.coalesce(c, F.lit(DEFAULT_GENERATE_CANONICAL))
        elif name == "max_description_length":
            c = F.coalesce(c, F.lit(DEFAULT_MAX_DESCRIPTION))
        elif name == "max_title_length":
            c = F.coalesce(c, F.lit(DEFAULT_MAX_TITLE))
        elif name in ("site_name", "site_url"):
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(name))
    return config.select(*cols)


def site_config(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A config table from explicit rows (missing keys take the defaults)."""
    names = [f.split(" ")[0] for f in CONFIG_SCHEMA.split(", ")]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return normalize(spark.createDataFrame(data, CONFIG_SCHEMA))


def plain_config(sites: DataFrame) -> DataFrame:
    """Settings when the user gave none: name and URL from the host, nothing else."""
    given = {"site": F.col("site"), "site_name": F.col("site"), "site_url": F.concat(F.lit("https://"), F.col("site"))}
    fields = [f.split(" ", 1) for f in CONFIG_SCHEMA.split(", ")]
    return normalize(sites.select("site").distinct().select(*(given.get(n, F.lit(None).cast(t)).alias(n) for n, t in fields)))

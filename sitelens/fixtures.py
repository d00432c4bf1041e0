"""Generators of test data: derived pages, settings and file listings.

Only the registered queries, their DuckDB twins and tests use these; nothing
here reaches the output of a production run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.sources.config import DEFAULT_LOCALE, DEFAULT_MAX_DESCRIPTION, DEFAULT_MAX_TITLE, normalize
from sitelens.sources.pages import site_key, url_path

# ----------------------------------------------------------------------------
# pages_rich: a derived view of ``pages`` whose SEO markup varies by page_id.
# The same SQL text runs in Spark and in DuckDB (only replace, concat, CASE,
# %, and one regexp_replace on a single match).  ``{pages}`` is the input.
# ----------------------------------------------------------------------------

_H2_WORDS = [
    "Consulting Solutions Expertise",
    "Cart Checkout Shipping",
    "Blog Author Archive",
    "Portfolio Projects Designer",
    "Software Platform Dashboard",
    "Location Hours Directions",
    "Menu Restaurant Cuisine",
    "Agency Creative Branding",
    "Charity Donate Volunteer",
    "Course Student Curriculum",
    "Medical Clinic Treatment",
    "Property Apartment Mortgage",
    "Innovation Engineering Blockchain",
]

_DESCRIPTIONS = [
    "Trusted professional consulting services &amp; proven results. Get a free quote today!",
    "Discover our amazing software platform with exclusive features, fast setup and reliable support "
    "for every team and every project, backed by a guaranteed refund policy and expert help",
    "Bad service, slow delivery and broken products: a terrible experience.",
    "",
    "Fresh food menu, dining reservations and delivery from our chef",
    "Learn with online courses, training workshops and certification for every student and teacher "
    "who wants to enroll in a curriculum that goes well beyond the usual limit",
    "Property listings: homes, apartments &quot;for rent&quot; and sale",
]


def _case(expr: str, items: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(items))
    return f"CASE {expr} {whens} ELSE '' END"


def pages_rich_sql(pages: str = "{pages}") -> str:
    head = (
        "concat("
        "CASE WHEN page_id % 2 = 0 THEN concat('<meta name=\"description\" content=\"', "
        + _case("page_id % 7", _DESCRIPTIONS)
        + ", '\">') ELSE '' END, "
        "CASE WHEN page_id % 3 = 0 THEN '<meta property=\"og:title\" content=\"Rich Page\">' ELSE '' END, "
        "CASE WHEN page_id % 5 = 0 THEN '<meta content=\"summary\" name=\"twitter:card\">' ELSE '' END, "
        "CASE WHEN page_id % 7 = 0 THEN '<script type=\"application/ld+json\">{{\"@type\":\"Organization\"}}</script>' ELSE '' END, "
        "CASE WHEN page_id % 4 = 1 THEN concat('<link rel=\"canonical\" href=\"https://example.com/p/', CAST(page_id AS STRING), '\">') ELSE '' END, "
        "CASE WHEN page_id % 3 = 1 THEN '<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">' ELSE '' END, "
        "CASE WHEN page_id % 8 = 5 THEN '<meta http-equiv=\"Content-Language\" content=\"en-GB\">' ELSE '' END"
        ")"
    )
    article = (
        "concat("
        "CASE page_id % 4 WHEN 1 THEN '<img src=\"a.png\">' "
        "WHEN 2 THEN '<img src=\"b.png\" alt=\"Good\"><img src=\"c.png\" alt=\"\">' "
        "WHEN 3 THEN '<img src=\"d.png\" alt=\"Photo\">' ELSE '' END, "
        "CASE WHEN page_id % 11 = 0 THEN '<h1>Second Heading Here</h1>' ELSE '' END, "
        "CASE WHEN page_id % 6 = 0 THEN '<p>Read our frequently asked questions before you order.</p>' ELSE '' END, "
        "CASE page_id % 5 "
        "WHEN 0 THEN '<p>Amazing, excellent and wonderful quality from a trusted team.</p>' "
        "WHEN 1 THEN '<p>Terrible, awful and disappointing support with a broken checkout.</p>' "
        "WHEN 2 THEN '<p>Exclusive free bonus now: discover the secret to transform results, guaranteed.</p>' "
        "ELSE '' END, "
        "CASE WHEN page_id % 13 = 0 THEN '<script>var label = \"<h1>Fake Heading</h1>\"; trackVisitor(42);</script>' ELSE '' END"
        ")"
    )
    body = (
        "CASE WHEN page_id % 14 < 13 THEN concat('<main><section><h2>', "
        + _case("page_id % 14", _H2_WORDS)
        + ", '</h2><p>Welcome to our ', lower("
        + _case("page_id % 14", _H2_WORDS)
        + "), ' pages.</p></section></main>') ELSE '' END"
    )
    base = (
        "CASE WHEN page_id % 9 = 4 THEN regexp_replace(h0, '<title>[^<]*</title>', '<title></title>') ELSE h0 END"
    )
    h0 = (
        "CASE WHEN page_id % 10 = 3 THEN replace(h, '<meta charset=\"utf-8\">', "
        "'<meta http-equiv=\"Content-Type\" content=\"text/html; charset=utf-8\">') "
        "WHEN page_id % 10 = 7 THEN replace(h, '<meta charset=\"utf-8\">', '') ELSE h END"
    )
    return (
        "SELECT page_id, url, "
        f"replace(replace(replace({base}, '</head>', concat({head}, '</head>')), "
        f"'</article>', concat({article}, '</article>')), '<body>', concat('<body>', {body})) AS html "
        "FROM (SELECT page_id, url, "
        f"{h0} AS h0 FROM (SELECT page_id, url, "
        "CASE WHEN page_id % 8 = 5 THEN replace(html, '<html lang=', '<html data-lang=') ELSE html END AS h "
        f"FROM {pages}) s1) s2"
    )


def pages_rich(pages: DataFrame) -> DataFrame:
    """``pages`` with varied SEO markup (see FIXTURES.md §3), derived by Spark SQL."""
    return pages.sparkSession.sql(pages_rich_sql(), pages=pages.select("page_id", "url", "html"))


def derive_site_config(sites: DataFrame) -> DataFrame:
    """Settings for every site key in ``sites``: name and URL from the host, optional
    fields switched on by ``length(site) % k`` so every branch of generation is exercised.

    It grows with the number of sites; joins against it are left to the size
    threshold / AQE rather than forced to broadcast.
    """
    s = sites.select("site").distinct()
    n = F.length("site")
    address = F.struct(
        F.lit("1 Main St").alias("street"),
        F.lit("Springfield").alias("city"),
        F.lit("IL").alias("state"),
        F.lit("62701").alias("postal_code"),
        F.lit("US").alias("country"),
    )
    cfg = s.select(
        "site",
        F.col("site").alias("site_name"),
        F.concat(F.lit("https://"), F.col("site")).alias("site_url"),
        F.when(n % 2 == 0, F.concat(F.lit("https://"), F.col("site"), F.lit("/og.png"))).alias("default_image"),
        F.when(n % 3 == 0, F.lit("acme")).when(n % 3 == 1, F.lit("@acme")).alias("twitter_handle"),
        F.when(n % 4 == 0, F.lit("1234567890")).alias("facebook_app_id"),
        F.when(n % 5 < 2, F.concat(F.lit("info@"), F.col("site"))).alias("contact_email"),
        F.when(n % 5 == 0, F.lit("+1-555-0100")).alias("phone"),
        F.when(n % 3 == 0, address).alias("address"),
        F.when(n % 11 == 0, F.concat(F.lit("Official "), F.col("site"), F.lit(" home page with everything you need in one place"))).alias("title_override"),
        F.when(n % 13 == 0, F.concat(F.lit("All about "), F.col("site"), F.lit(": <news> & \"notes\" for readers"))).alias("description_override"),
        F.when(n % 4 == 1, F.array(F.lit("seo"), F.lit("seo"), F.lit("web")))
        .when(n % 4 == 2, F.array(F.lit("web"), F.lit("seo"), F.lit("web")))
        .otherwise(F.array().cast("array<string>")).alias("extra_keywords"),
        F.when(n % 7 == 0, F.lit("fr_FR")).otherwise(F.lit(DEFAULT_LOCALE)).alias("locale"),
        (n % 6 != 0).alias("generate_canonical"),
        F.lit(DEFAULT_MAX_DESCRIPTION).alias("max_description_length"),
        F.lit(DEFAULT_MAX_TITLE).alias("max_title_length"),
    )
    return normalize(cfg)


# marker files given to each site by length(site) % 8 (see derive_site_files)
_MARKER_SETS = {
    1: [("next.config.js", "module.exports = {}")],
    2: [("vite.config.ts", "export default {}")],
    3: [("package.json", '{"dependencies": {"react": "18.2.0"}}')],
    4: [("package.json", '{"dependencies": {"vue": "3.4.0"}}')],
    5: [("package.json", '{"devDependencies": {"svelte": "4.2.0"}}')],
    6: [("next.config.mjs", "export default {}"), ("vite.config.js", "export default {}"),
        ("package.json", '{"dependencies": {"react": "18.2.0", "vue": "3.4.0"}}')],
    7: [("package.json", '{"name": "static-site", "private": true}')],
}


def site_files_from_pages(pages: DataFrame) -> DataFrame:
    """``site, path, content``: every page as a file (path from its URL) plus root marker files.

    Marker files are assigned by ``length(site) % 8`` so every detection
    outcome occurs, including a site with several markers (precedence).
    """
    p = pages.select(site_key("url").alias("site"), F.regexp_replace(url_path("url"), "^/", "").alias("path"),
                     F.lit("").alias("content"))
    sites = pages.select(site_key("url").alias("site")).distinct()
    n = F.length("site") % 8
    options = F.array(*[
        F.when(n == k, F.array(*[F.struct(F.lit(path).alias("path"), F.lit(body).alias("content")) for path, body in files]))
        for k, files in _MARKER_SETS.items()
    ])
    markers = sites.select("site", F.explode(F.flatten(F.filter(options, lambda x: x.isNotNull()))).alias("f"))
    return p.unionByName(markers.select("site", "f.path", "f.content"))

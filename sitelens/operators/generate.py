"""Meta, Open Graph, Twitter Card and JSON-LD generation as column expressions.

Input: one row per key holding the analysis fields, the packed top keywords
(``top10``) and the site's settings (see ``generation_input``).  Every block
is a string expression evaluated row by row; nothing is shuffled here.

JSON-LD objects are built with ``to_json(struct(...))``: fields are declared
in sorted key order (the reference's JSON library sorts keys), absent
optional values are null and therefore omitted, and the result is compact.
``</`` is written ``<\\/`` so a value can never close the script element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import capitalize, col, html_escape, lit, truncate_words

CONTEXT = "https://schema.org"
# Generated tag lines and block wrappers.
VIEWPORT_LINE = '    <meta name="viewport" content="width=device-width, initial-scale=1.0">'
CHARSET_LINE = '    <meta charset="UTF-8">'
ROBOTS_LINE = '    <meta name="robots" content="index, follow">'
OG_IMAGE_SIZE = ("1200", "630")
OG_TEXT_LIMIT, TWITTER_TITLE_LIMIT = 200, 70
FAQ_MARKERS = ["faq", "frequently asked", "questions"]
OG_TYPES = {"Blog": "article", "Ecommerce": "product", "Restaurant": "restaurant"}


def c(name: str) -> Column:
    return col(name)


def _empty_array() -> Column:
    return F.array().cast("array<string>")


def _line(fmt_before: str, value: Column, fmt_after: str = '">') -> Column:
    return F.concat(lit(fmt_before), value, lit(fmt_after))


# --- meta tags ---------------------------------------------------------------------


def generate_title() -> Column:
    """Override, else existing non-empty title, else top-3 capitalized + site name, else site name."""
    top3 = F.slice(c("top10"), 1, 3)
    from_keywords = F.when(
        F.size(top3) > 0,
        F.concat(F.array_join(F.transform(top3, capitalize), " - "), lit(" | "), c("site_name")),
    ).otherwise(c("site_name"))
    existing = F.when(c("title") != lit(""), c("title"))
    return truncate_words(F.coalesce(c("title_override"), existing, from_keywords), c("max_title_length"))


def generate_description() -> Column:
    """Override, else existing non-empty description, else the content summary, else a keyword sentence."""
    top5 = F.slice(c("top10"), 1, 5)
    sentence = F.concat(c("site_name"), lit(" offers "), F.array_join(top5, ", "), lit(". Professional solutions for your needs."))
    existing = F.when(c("description") != lit(""), c("description"))
    return truncate_words(
        F.coalesce(c("description_override"), existing, c("content_summary"), sentence), c("max_description_length")
    )


def generate_keywords() -> Column:
    """Top-10 keywords then the extra keywords; only *adjacent* repeats dropped; joined ', '."""
    kw = F.concat(F.coalesce(c("top10"), _empty_array()), F.coalesce(c("extra_keywords"), _empty_array()))
    kept = F.filter(kw, lambda x, i: (i == 0) | (x != F.get(kw, i - 1)))
    return F.array_join(kept, ", ")


def meta_block() -> Column:
    kw = generate_keywords()
    lines = [
        _line("    <title>", html_escape(generate_title()), "</title>"),
        F.when(~c("has_description"), _line('    <meta name="description" content="', html_escape(generate_description()))),
        F.when(kw != lit(""), _line('    <meta name="keywords" content="', html_escape(kw))),
        F.when(c("generate_canonical") & ~c("has_canonical"), _line('    <link rel="canonical" href="', html_escape(c("site_url")))),
        F.when(~c("has_viewport"), lit(VIEWPORT_LINE)),
        F.when(~c("has_charset"), lit(CHARSET_LINE)),
        lit(ROBOTS_LINE),
    ]
    return F.concat_ws("\n", *lines)


# --- social cards ------------------------------------------------------------------


def og_type() -> Column:
    out = None
    for bt, t in OG_TYPES.items():
        out = F.when(c("business_type") == bt, lit(t)) if out is None else out.when(c("business_type") == bt, lit(t))
    return out.otherwise(lit("website"))


def social_title() -> Column:
    """Override, else the existing title even when empty, else the site name (not truncated)."""
    return F.coalesce(c("title_override"), c("title"), c("site_name"))


def social_description() -> Column:
    top5 = F.slice(c("top10"), 1, 5)
    fallback = F.concat(c("site_name"), lit(" - "), F.array_join(top5, ", "))
    return F.coalesce(c("description_override"), c("description"), c("content_summary"), fallback)


def open_graph_block() -> Column:
    img = c("default_image")
    lines = [
        _line('    <meta property="og:type" content="', og_type()),
        _line('    <meta property="og:title" content="', html_escape(social_title())),
        _line('    <meta property="og:description" content="', html_escape(truncate_words(social_description(), OG_TEXT_LIMIT))),
        _line('    <meta property="og:url" content="', html_escape(c("site_url"))),
        _line('    <meta property="og:site_name" content="', html_escape(c("site_name"))),
        _line('    <meta property="og:locale" content="', c("locale")),
        F.when(img.isNotNull(), _line('    <meta property="og:image" content="', html_escape(img))),
        F.when(img.isNotNull(), lit(f'    <meta property="og:image:width" content="{OG_IMAGE_SIZE[0]}">')),
        F.when(img.isNotNull(), lit(f'    <meta property="og:image:height" content="{OG_IMAGE_SIZE[1]}">')),
        F.when(c("facebook_app_id").isNotNull(), _line('    <meta property="fb:app_id" content="', html_escape(c("facebook_app_id")))),
    ]
    return F.when(c("has_og_tags"), lit("")).otherwise(F.concat_ws("\n", *lines))


def twitter_block() -> Column:
    img = c("default_image")
    handle = F.when(c("twitter_handle").startswith("@"), c("twitter_handle")).otherwise(F.concat(lit("@"), c("twitter_handle")))
    has_handle = c("twitter_handle").isNotNull()
    lines = [
        _line('    <meta name="twitter:card" content="', F.when(img.isNotNull(), lit("summary_large_image")).otherwise(lit("summary"))),
        _line('    <meta name="twitter:title" content="', html_escape(truncate_words(social_title(), TWITTER_TITLE_LIMIT))),
        _line('    <meta name="twitter:description" content="', html_escape(truncate_words(social_description(), OG_TEXT_LIMIT))),
        F.when(has_handle, _line('    <meta name="twitter:site" content="', html_escape(handle))),
        F.when(has_handle, _line('    <meta name="twitter:creator" content="', html_escape(handle))),
        F.when(img.isNotNull(), _line('    <meta name="twitter:image" content="', html_escape(img))),
        F.when(img.isNotNull(), _line('    <meta name="twitter:image:alt" content="', html_escape(social_title()))),
    ]
    return F.when(c("has_twitter_cards"), lit("")).otherwise(F.concat_ws("\n", *lines))


# --- JSON-LD -------------------------------------------------------------------------


def _s(value, name: str) -> Column:
    v = lit(value) if isinstance(value, (str, int)) else value
    return v.alias(name)


def _address() -> Column:
    a = c("address")
    return F.when(
        a.isNotNull(),
        F.struct(
            _s("PostalAddress", "@type"),
            a["country"].alias("addressCountry"),
            a["city"].alias("addressLocality"),
            a["state"].alias("addressRegion"),
            a["postal_code"].alias("postalCode"),
            a["street"].alias("streetAddress"),
        ),
    )


def organization_schema() -> Column:
    img, phone = c("default_image"), c("phone")
    node = F.struct(
        _s(CONTEXT, "@context"),
        _s(c("schema_type"), "@type"),
        _address().alias("address"),
        F.when(phone.isNotNull(), F.struct(_s("ContactPoint", "@type"), _s("customer service", "contactType"),
                                           phone.alias("telephone"))).alias("contactPoint"),
        F.coalesce(c("description_override"), c("description"), c("content_summary")).alias("description"),
        c("contact_email").alias("email"),
        img.alias("image"),
        F.when(img.isNotNull(), F.struct(_s("ImageObject", "@type"), img.alias("url"))).alias("logo"),
        c("site_name").alias("name"),
        _empty_array().alias("sameAs"),
        phone.alias("telephone"),
        c("site_url").alias("url"),
    )
    return F.to_json(node)


def website_schema() -> Column:
    node = F.struct(
        _s(CONTEXT, "@context"),
        _s("WebSite", "@type"),
        c("site_name").alias("name"),
        F.struct(
            _s("SearchAction", "@type"),
            _s("required name=search_term_string", "query-input"),
            F.struct(_s("EntryPoint", "@type"),
                     F.concat(c("site_url"), lit("/search?q={search_term_string}")).alias("urlTemplate")).alias("target"),
        ).alias("potentialAction"),
        c("site_url").alias("url"),
    )
    return F.to_json(node)


def breadcrumb_schema() -> Column:
    item = F.struct(_s("ListItem", "@type"), c("site_url").alias("item"), _s("Home", "name"), _s(1, "position"))
    node = F.struct(_s(CONTEXT, "@context"), _s("BreadcrumbList", "@type"), F.array(item).alias("itemListElement"))
    return F.to_json(node)


def business_schema() -> Column:
    """Type-specific node (service, application, local place, blog) or null."""
    bt = c("business_type")
    services = F.transform(F.slice(F.coalesce(c("top10"), _empty_array()), 1, 5), capitalize)
    offers = F.transform(
        services,
        lambda s: F.struct(_s("Offer", "@type"), F.struct(_s("Service", "@type"), s.alias("name")).alias("itemOffered")),
    )
    service = F.struct(
        _s(CONTEXT, "@context"),
        _s("ProfessionalService", "@type"),
        F.struct(_s("Country", "@type"), _s("United States", "name")).alias("areaServed"),
        F.struct(_s("OfferCatalog", "@type"), offers.alias("itemListElement"), _s("Services", "name")).alias("hasOfferCatalog"),
        c("site_name").alias("name"),
        services.alias("serviceType"),
        c("site_url").alias("url"),
    )
    saas = F.struct(
        _s(CONTEXT, "@context"),
        _s("SoftwareApplication", "@type"),
        _s("BusinessApplication", "applicationCategory"),
        c("site_name").alias("name"),
        F.struct(_s("Offer", "@type"), _s("0", "price"), _s("USD", "priceCurrency")).alias("offers"),
        _s("Web", "operatingSystem"),
        c("site_url").alias("url"),
    )
    local = F.struct(
        _s(CONTEXT, "@context"),
        F.when(bt == "Restaurant", lit("Restaurant")).otherwise(lit("LocalBusiness")).alias("@type"),
        _address().alias("address"),
        c("site_name").alias("name"),
        c("phone").alias("telephone"),
        c("site_url").alias("url"),
    )
    blog = F.struct(
        _s(CONTEXT, "@context"), _s("Blog", "@type"), _empty_array().alias("blogPost"),
        c("site_name").alias("name"), c("site_url").alias("url"),
    )
    return (
        F.when(bt.isin("Service", "Technology"), F.to_json(service))
        .when(bt == "SaaS", F.to_json(saas))
        .when(bt.isin("LocalBusiness", "Restaurant"), F.to_json(local))
        .when(bt == "Blog", F.to_json(blog))
    )


def mentions_faq(raw_text: Column) -> Column:
    """Whether the text speaks of questions and answers."""
    low = F.lower(raw_text)
    hit = None
    for m in FAQ_MARKERS:
        hit = low.contains(m) if hit is None else (hit | low.contains(m))
    return F.coalesce(hit, lit(False))


def faq_schema(has_faq: Column | None = None) -> Column:
    """``has_faq``: the flag of ``generation_input``; by default the row's text is asked."""
    has_faq = mentions_faq(c("raw_text")) if has_faq is None else has_faq
    node = F.struct(_s(CONTEXT, "@context"), _s("FAQPage", "@type"), _empty_array().alias("mainEntity"))
    return F.when(has_faq, F.to_json(node))


def json_ld_graph(has_faq: Column | None = None) -> Column:
    nodes = F.filter(
        F.array(organization_schema(), website_schema(), breadcrumb_schema(), business_schema(), faq_schema(has_faq)),
        lambda x: x.isNotNull(),
    )
    graph = F.concat(lit('{"@context":"' + CONTEXT + '","@graph":['), F.array_join(nodes, ","), lit("]}"))
    return F.replace(graph, lit("</"), lit("<\\/"))


def json_ld_block(has_faq: Column | None = None) -> Column:
    block = F.concat(lit('    <script type="application/ld+json">\n    '), json_ld_graph(has_faq), lit("\n    </script>"))
    return F.when(c("has_schema"), lit("")).otherwise(block)


# --- assembly ----------------------------------------------------------------------


def generation_input(analysis: DataFrame, keywords_top10: DataFrame, config: DataFrame, key: str = "page_id") -> DataFrame:
    """Analysis row + packed top-10 keywords + site settings, one row per key.

    The text is only asked whether it mentions questions (``has_faq``), in its
    own row, so it takes no part in the joins.
    ``config`` has one row per site; it grows with the number of sites, so
    it is not force-broadcast (Spark's size threshold decides).  At page grain
    the join is salted by ``page_id`` so a site holding a third of the pages
    is spread over many tasks.
    """
    flagged = analysis.withColumn("has_faq", mentions_faq(c("raw_text"))).drop("raw_text")
    a = flagged.join(keywords_top10, key, "left").withColumn("top10", F.coalesce(c("top10"), _empty_array()))
    if key == "site":
        return a.join(config, "site", "left")  # one row per site on both sides
    # many pages per site meet one config row per site: salt the hot sites
    from sitelens.plans.skew import salted_join

    return salted_join(a, config, "site", spread_by=key, how="left")


def generate_all(gen: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, meta_tags, open_graph, twitter_cards, schema_org, combined, is_empty`` (the dry run)."""
    out = gen.select(
        key,
        meta_block().alias("meta_tags"),
        open_graph_block().alias("open_graph"),
        twitter_block().alias("twitter_cards"),
        json_ld_block(c("has_faq") if "has_faq" in gen.columns else None).alias("schema_org"),
    )
    combined = F.concat(
        lit("<!-- SEO Meta Tags -->\n"), c("meta_tags"),
        lit("\n\n<!-- Open Graph -->\n"), c("open_graph"),
        lit("\n\n<!-- Twitter Cards -->\n"), c("twitter_cards"),
        lit("\n\n<!-- Schema.org -->\n"), c("schema_org"),
    )
    empty = (c("meta_tags") == "") & (c("open_graph") == "") & (c("twitter_cards") == "") & (c("schema_org") == "")
    return out.select("*", combined.alias("combined"), empty.alias("is_empty"))

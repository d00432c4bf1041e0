"""HTML extraction as Spark column expressions.

There is no DOM parser here: every extraction is a native regexp / string /
higher-order expression over the ``html`` column, evaluated inside the scan
stage (no shuffle, no Python).  ``clean_html`` hides comments and the bodies of
``<script>``/``<style>`` so markup-looking text inside them is not counted,
which is what a DOM gives for free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import col, col_of, decode_entities, lit, regexp_value, trim_ws


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, lit(pattern), lit(0))


def clean_html(html="html") -> Column:
    # all that is hidden begins so: one look spares most places of a page the three branches
    return F.regexp_replace(col_of(html), f"(?=<[sS!])(?:{P.HIDDEN})", "$1$2$3$4" + P.COMMENT_MARK)


def title_raw(clean="clean") -> Column:
    """Decoded text of the first <title>, untrimmed; null if there is none."""
    c = col_of(clean)
    return F.when(c.rlike(P.TITLE_PRESENT), decode_entities(F.regexp_extract(c, P.TITLE_TEXT, 1)))


def title_text(clean="clean") -> Column:
    return trim_ws(title_raw(clean))


def tag_arrays(clean="clean") -> list[Column]:
    """Per-page arrays of the tags the audit reads, extracted once.

    Put them in their own projection (``with_tag_arrays``); every flag below
    then scans a short array instead of the whole document again.
    """
    c = col_of(clean)
    return [
        _all(c, P.META_TAG).alias("_metas"),
        _all(c, P.LINK_TAG).alias("_links"),
        _all(c, P.SCRIPT_TAG).alias("_scripts"),
        _all(c, P.IMG_TAG).alias("_imgs"),
        F.get(_all(c, P.HTML_TAG), 0).alias("_html_tag"),
    ]


def first_tag(tags, attr_pattern: str) -> Column:
    """First tag of an array whose attributes match ``attr_pattern``."""
    return F.get(F.filter(col_of(tags), lambda t: t.rlike(attr_pattern)), 0)


def attr_of(tag_col: Column, present_pattern: str, value_pattern: str) -> Column:
    """Decoded attribute value of one tag, null if the tag or the attribute is absent."""
    return F.when(tag_col.rlike(present_pattern), decode_entities(regexp_value(tag_col, value_pattern), attribute=True))


def meta_content(metas="_metas", name_pattern: str = P.NAME_DESCRIPTION) -> Column:
    """``content`` of the first ``meta`` matching ``name_pattern`` (default: description)."""
    return attr_of(first_tag(metas, name_pattern), P.CONTENT_PRESENT, P.CONTENT_VALUE)


def any_tag(tags, attr_pattern: str) -> Column:
    return F.exists(col_of(tags), lambda t: t.rlike(attr_pattern))


def has_og_tags(metas="_metas") -> Column:
    return any_tag(metas, P.PROPERTY_OG)


def has_twitter_cards(metas="_metas") -> Column:
    return any_tag(metas, P.NAME_TWITTER)


def has_schema(scripts="_scripts") -> Column:
    return any_tag(scripts, P.TYPE_LD_JSON)


def has_canonical(links="_links") -> Column:
    return any_tag(links, P.REL_CANONICAL)


def has_viewport(metas="_metas") -> Column:
    return any_tag(metas, P.NAME_VIEWPORT)


def has_charset(metas="_metas") -> Column:
    return F.exists(col_of(metas), lambda t: t.rlike(P.HAS_CHARSET) | t.rlike(P.HTTP_EQUIV_CONTENT_TYPE))


def h1_count(clean="clean") -> Column:
    return F.regexp_count(col_of(clean), lit(P.H1_START)).cast("bigint")


def img_without_alt(imgs="_imgs") -> Column:
    imgs = col_of(imgs)
    with_alt = F.size(F.filter(imgs, lambda t: t.rlike(P.ALT_NONEMPTY)))
    return F.greatest(F.size(imgs) - with_alt, lit(0)).cast("bigint")


def detect_language(html_tag="_html_tag", metas="_metas") -> Column:
    """Prefix before '-' of html[lang], else of meta content-language, else null."""
    lang = attr_of(col_of(html_tag), P.LANG_PRESENT, P.LANG_VALUE)
    meta_lang = attr_of(first_tag(metas, P.HTTP_EQUIV_LANGUAGE), P.CONTENT_PRESENT, P.CONTENT_VALUE)
    return F.split_part(F.coalesce(lang, meta_lang), lit("-"), lit(1))


def with_tag_arrays(df, clean: str = "clean"):
    """``df`` plus the tag arrays (see ``tag_arrays``)."""
    return df.select("*", *tag_arrays(clean))


def body_part(clean="clean") -> Column:
    """Markup after <body ...>; after </head> without a body tag; else the document minus its title."""
    c = col_of(clean)
    return (
        F.when(c.rlike(P.BODY_PRESENT), F.regexp_extract(c, P.BODY_REST, 1))
        .when(c.rlike(P.HEAD_END_PRESENT), F.regexp_extract(c, P.HEAD_REST, 1))
        .otherwise(F.regexp_replace(c, P.TITLE_ELEMENT, ""))
    )


def text_nodes(markup: Column) -> Column:
    """Runs of text between tags, in document order (still entity-encoded)."""
    return F.filter(F.regexp_extract_all(markup, lit(P.NEXT_TEXT), lit(1)), lambda t: t != lit(""))


def text_nodes_with_scripts(markup: Column) -> Column:
    """Like ``text_nodes`` over markup whose script/style bodies are kept: each
    raw-text element contributes its body as one text node (the reference's leak)."""
    toks = _all(markup, P.RAW_TEXT_TOKEN)
    inner = F.transform(
        toks,
        lambda t: F.when(t.rlike(P.RAW_TEXT_START), F.regexp_extract(t, P.RAW_TEXT_BODY, 1)).otherwise(t),
    )
    kept = F.filter(F.arrays_zip(toks.alias("t"), inner.alias("i")),
                    lambda z: ~z["t"].rlike(P.IS_MARKUP) | (z["t"].rlike(P.RAW_TEXT_START) & (z["i"] != lit(""))))
    return F.transform(kept, lambda z: z["i"])


def clean_comments_only(html="html") -> Column:
    """Comments hidden; script/style bodies kept."""
    return F.regexp_replace(col_of(html), P.COMMENT, P.COMMENT_MARK)


def body_run(clean="clean", include_script_text: bool = False) -> Column:
    """The body's text nodes, each followed by one space, still entity-encoded.

    Script and style text is excluded by default (the reference's stated
    intent).  ``include_script_text=True`` with a ``clean`` column from
    ``clean_comments_only`` reproduces the reference's leak of it.
    """
    nodes = text_nodes_with_scripts(body_part(clean)) if include_script_text else text_nodes(body_part(clean))
    return F.array_join(F.transform(nodes, lambda t: F.concat(t, lit(" "))), "")


def body_text(run, title_raw_col="title_raw", description_col="description") -> Column:
    """Body text nodes, each followed by one space, then title + space, then description.

    Put ``run`` (``body_run``) in a projection of its own: decoding refers to it
    several times, and each reference to an expression would extract the nodes again.
    """
    t = col_of(title_raw_col)
    return F.concat(
        decode_entities(run),
        F.when(t.isNotNull(), F.concat(t, lit(" "))).otherwise(lit("")),
        F.coalesce(col_of(description_col), lit("")),
    )

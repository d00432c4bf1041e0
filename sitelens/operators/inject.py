"""Injection of generated blocks into the page markup (one projection per row).

The reference runs four injectors in a row, each inserting its block right
before the first ``</head>`` (else the first ``<body``).  No block can contain
either marker (values are HTML-escaped, ``</`` is escaped in JSON), so the
four insertions land at one point and the result is one concatenation:
``before + "\\n" + meta + "\\n" + ("\\n" + block + "\\n" for each non-empty block) + after``.
The meta step first removes the first lower-case attribute-less ``<title>``.
A page without an injection point is kept unchanged with
``status = 'no_injection_point'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import col, lit

from sitelens.functions import patterns as P


def strip_title(html: Column) -> Column:
    """Remove the first ``<title>...</title>`` (lower-case, no attributes, no markup inside)."""
    return F.when(
        html.rlike(P.STRIP_TITLE_PRESENT),
        F.concat(F.regexp_extract(html, P.STRIP_TITLE, 1), F.regexp_extract(html, P.STRIP_TITLE, 2)),
    ).otherwise(html)


def has_point(html: Column) -> Column:
    return html.rlike(P.HEAD_END_PRESENT) | html.rlike(P.BODY_PRESENT)


def split_at_point(html: Column) -> tuple[Column, Column]:
    """(before, after) around the first ``</head>``, else the first ``<body``; nulls if neither."""
    head = html.rlike(P.HEAD_END_PRESENT)
    body = html.rlike(P.BODY_PRESENT)
    before = F.when(head, F.regexp_extract(html, P.HEAD_POINT, 1)).when(body, F.regexp_extract(html, P.BODY_POINT, 1))
    after = F.when(head, F.regexp_extract(html, P.HEAD_POINT, 2)).when(body, F.regexp_extract(html, P.BODY_POINT, 2))
    return before, after


def injection_point(html: Column) -> Column:
    """0-based character offset of the injection point, null if none."""
    before, _ = split_at_point(html)
    return F.length(before)


def _wrap(block: Column) -> Column:
    return F.when(block != lit(""), F.concat(lit("\n"), block, lit("\n"))).otherwise(lit(""))


def inject(html: Column, meta: Column, *blocks: Column) -> Column:
    """The title stripped, then the meta block and every non-empty other block at the injection point."""
    before, after = split_at_point(strip_title(html))
    out = F.concat(before, lit("\n"), meta, lit("\n"), *(_wrap(b) for b in blocks), after)
    return F.when(has_point(html), out).otherwise(html)


def inject_meta(html: Column, meta: Column) -> Column:
    """Meta step alone: strip the title, insert the block."""
    stripped = strip_title(html)
    before, after = split_at_point(stripped)
    return F.when(has_point(html), F.concat(before, lit("\n"), meta, lit("\n"), after)).otherwise(html)


def inject_block(html: Column, block: Column) -> Column:
    """Any other step: insert a non-empty block, leave the page alone otherwise."""
    before, after = split_at_point(html)
    return F.when(has_point(html) & (block != lit("")), F.concat(before, lit("\n"), block, lit("\n"), after)).otherwise(html)


def page_injected(gen_html: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, html, status`` from rows holding ``html`` and the four generated blocks."""
    html = col("html")
    return gen_html.select(
        key,
        inject(html, col("meta_tags"), col("open_graph"), col("twitter_cards"), col("schema_org")).alias("html"),
        F.when(has_point(html), lit("ok")).otherwise(lit("no_injection_point")).alias("status"),
    )

"""Zone text: the page regions the business-type detector reads.

The DOM is replaced by a token table and windows:

* ``html_tokens``   -- ``posexplode`` of the cleaned markup into tags and text runs;
* ``element_spans`` -- a running ``sum(+1/-1)`` per (page, tag) gives each tag its
  nesting level; within (page, tag, level) an open tag's ``lead`` is its close;
* ``zone_text``     -- the same windows plus a row index and a nav/header depth
  over the zone-relevant token stream, then one per-page assembly: each zone
  element's text is the slice of the page's ordered tokens between its open
  and close.  ``zone_segments`` states the same result as an interval join.

Everything keys on ``page_id``: the token stream takes one exchange on
``page_id`` (none on a page_id-partitioned input) and every later window and
aggregate reuses that partitioning.  Only zone-relevant tags and text runs
are shuffled, never the markup column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import col, decode_entities, lit

# Elements without content (never closed).
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "meta", "param", "source", "track", "wbr",
]
HEADING_GROUP = {"h1": 2, "h2": 3, "h3": 4}
NAV_CONTAINERS = ["nav", "header"]
CONTAINERS = ["main", "article", "section"]
ZONE_TAGS = ["h1", "h2", "h3", "a", *NAV_CONTAINERS, *CONTAINERS]
# zone groups, in the order the detector concatenates them
G_TITLE, G_DESCRIPTION, G_NAV_LINK, G_CONTAINER = 0, 1, 5, 6
END_OF_PAGE = 2_147_483_647

ANY_OPEN_TAG = rf"<[a-zA-Z](?:{P.QUOTED}>|[^>]*>)"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
MARK = r"^<(/?[a-zA-Z][a-zA-Z0-9]*|[/!?])"
# the mark of the title and description parts: no token's
HEAD_MARK = "<"
# necessary condition for a ".content" element: a class attribute whose value holds "content"
MAY_HAVE_CONTENT_CLASS = r"(?i:class)[ \t\r\n\f]*=[^>]*content"


def content_tag_names(clean: Column) -> Column:
    """Tag names that carry class ``content`` somewhere in the page (tracked for nesting).

    One pass over the page decides whether any tag can carry the class; only
    then are the tags listed and tested one by one.
    """
    opens = F.regexp_extract_all(clean, lit(ANY_OPEN_TAG), lit(0))
    hits = F.filter(opens, lambda t: t.rlike(P.CLASS_CONTENT))
    names = F.array_distinct(F.transform(hits, lambda t: F.lower(F.regexp_extract(t, P.OPEN_TAG_NAME, 1))))
    return F.when(clean.rlike(MAY_HAVE_CONTENT_CLASS), names).otherwise(F.array().cast("array<string>"))


def _classified(t: Column) -> tuple[Column, Column, Column, Column]:
    """(kind, tag, is_content, text) of one token.

    One anchored regexp per markup token yields the tag name; text runs skip it.
    """
    is_markup = t.rlike(P.IS_MARKUP)
    name = F.when(is_markup, F.lower(F.regexp_extract(t, TAG_NAME, 1)))
    kind = (F.when(~is_markup, lit("text"))
            .when(name == lit(""), lit("other"))
            .when(F.substring(t, 2, 1) == lit("/"), lit("close"))
            .otherwise(lit("open")))
    tag = F.when(kind.isin("open", "close"), name)
    is_content = (kind == lit("open")) & t.rlike(P.CLASS_CONTENT)
    text = F.when(kind == lit("text"), decode_entities(t))
    return kind, tag, is_content, text


def html_tokens(base: DataFrame) -> DataFrame:
    """``page_id, pos, kind, tag, is_content, text`` -- the ordered tag/text stream.

    ``kind`` is ``open``, ``close``, ``text`` or ``other`` (comments, doctype);
    ``text`` is entity-decoded.
    """
    src = base.select("page_id", col("clean"), content_tag_names(col("clean")).alias("ctags"))
    tok = src.select("page_id", "ctags", F.posexplode(F.regexp_extract_all("clean", lit(P.TOKEN), lit(0))).alias("pos", "tok"))
    kind, tag, is_content, text = _classified(col("tok"))
    out = tok.select(
        "page_id",
        "pos",
        kind.alias("kind"),
        tag.alias("tag"),
        is_content.alias("is_content"),
        text.alias("text"),
        "ctags",
    )
    return out.drop("ctags")


def element_spans(tokens: DataFrame) -> DataFrame:
    """``page_id, tag, is_content, open_pos, close_pos`` for every non-void element.

    ``close_pos`` is null for an element never closed (it runs to the end of
    the page).  Windows are partitioned by (page, tag): a page is one task's
    worth of rows, so there is no hot key.
    """
    tags = tokens.where(col("kind").isin("open", "close") & ~col("tag").isin(*VOID_TAGS))
    is_open = col("kind") == lit("open")
    running = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = tags.withColumn("depth", F.sum(F.when(is_open, 1).otherwise(-1)).over(running))
    d = d.withColumn("level", F.when(is_open, col("depth")).otherwise(col("depth") + 1))
    nxt = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    d = d.withColumn("next_pos", F.lead("pos").over(nxt)).withColumn("next_kind", F.lead("kind").over(nxt))
    return d.where(is_open).select(
        "page_id",
        "tag",
        "is_content",
        col("pos").alias("open_pos"),
        F.when(col("next_kind") == lit("close"), col("next_pos")).alias("close_pos"),
    )


def zone_elements(spans: DataFrame) -> DataFrame:
    """Elements the detector reads: ``page_id, grp, open_pos, close_pos``.

    h1/h2/h3 (groups 2-4), links inside nav or header (5; a link inside both
    counts once: semi join), and main/article/section/``.content`` (6).
    Nested containers each count, like the reference.
    """
    end = F.coalesce(col("close_pos"), lit(END_OF_PAGE))
    heads = spans.where(col("tag").isin(*HEADING_GROUP)).select(
        "page_id",
        F.expr("CASE tag WHEN 'h1' THEN 2 WHEN 'h2' THEN 3 ELSE 4 END").alias("grp"),
        "open_pos",
        end.alias("end_pos"),
    )
    navs = spans.where(col("tag").isin(*NAV_CONTAINERS)).select(
        "page_id", col("open_pos").alias("c_open"), end.alias("c_end")
    )
    links = spans.where(col("tag") == "a").select("page_id", "open_pos", end.alias("end_pos"))
    inside = (links["page_id"] == navs["page_id"]) & (links["open_pos"] > navs["c_open"]) & (links["open_pos"] < navs["c_end"])
    nav_links = links.join(navs, inside, "left_semi").select("page_id", lit(G_NAV_LINK).alias("grp"), "open_pos", "end_pos")
    boxes = spans.where(col("tag").isin(*CONTAINERS) | col("is_content")).select(
        "page_id", lit(G_CONTAINER).alias("grp"), "open_pos", end.alias("end_pos")
    )
    return heads.unionByName(nav_links).unionByName(boxes)


def _zone_stream(base: DataFrame) -> DataFrame:
    """Zone-relevant tokens of each page, hash-partitioned by ``page_id`` (the one shuffle).

    Positions 0 and 1 carry the title and description parts, so every page
    has rows and no join back to the page table is needed.
    """
    title_part = F.when(col("title_raw").isNotNull(), F.concat("title_raw", lit(" "))).otherwise(lit(""))
    desc_part = F.when(col("description").isNotNull(), F.concat("description", lit(" "))).otherwise(lit(""))
    # the mark of a token is found once, in its array: behind an explode, the filter
    # and every column that asks for the kind would each run the regexps again
    pre = base.select("page_id", title_part.alias("title_part"), desc_part.alias("desc_part"),
                      F.regexp_extract_all("clean", lit(P.TOKEN), lit(0)).alias("toks"), content_tag_names(col("clean")).alias("ctags"))
    named = F.transform("toks", lambda t: F.struct(t.alias("tok"), _mark(t).alias("mark")))

    def keep(x):
        tag = F.ltrim(x["mark"], lit("/"))
        return (x["mark"] == lit("")) | ((tag.isin(*ZONE_TAGS) | F.array_contains(col("ctags"), tag)) & ~tag.isin(*VOID_TAGS))

    head = lambda part: F.struct(col(part).alias("tok"), lit(HEAD_MARK).alias("mark"))
    kept = F.concat(F.array(head("title_part"), head("desc_part")), F.filter(named, keep))
    pre = pre.select("page_id", (F.size("ctags") > 0).alias("has_content"), kept.alias("toks"))
    # outer: the array always holds the two head slots, and a plain explode would
    # make Catalyst infer a size() > 0 filter that re-runs the whole extraction
    src = pre.select("page_id", "has_content", F.posexplode_outer("toks").alias("pos", "x"))
    # a page without markup has no tokens
    src = src.where(col("pos").isNotNull()).select("page_id", "has_content", "pos", "x.tok", "x.mark")
    mark, tok = col("mark"), col("tok")
    kind = (F.when(mark == lit(HEAD_MARK), lit("head")).when(mark == lit(""), lit("text"))
            .when(F.startswith(mark, lit("/")), lit("close")).otherwise(lit("open")))
    # no explicit repartition: the first window below (partitioned by page_id)
    # makes Spark add one exchange on page_id, or none when the input is
    # already hash-partitioned by page_id (bucketed or spread tables)
    return src.select(
        "page_id",
        "pos",
        kind.alias("kind"),
        F.when(~mark.isin(HEAD_MARK, ""), F.ltrim(mark, lit("/"))).alias("tag"),
        # only pages that have a ".content" element pay for the class test
        (col("has_content") & (kind == lit("open")) & tok.rlike(P.CLASS_CONTENT)).alias("is_content"),
        F.when(mark == lit(HEAD_MARK), tok).when(mark == lit(""), decode_entities(tok)).alias("text"),
    )


def _mark(t: Column) -> Column:
    """Of a tag its lower-cased name, after ``/`` if it is an end tag; of other markup its sign; of text an empty string."""
    return F.when(F.startswith(t, lit("<")), F.lower(F.regexp_extract(t, MARK, 1))).otherwise(lit(""))


def zone_text(base: DataFrame) -> DataFrame:
    """``page_id, zone_text``: lower-cased title, description, headings, nav links, containers.

    ``base`` needs ``page_id, clean, title_raw, description`` (``page_base(keep_clean=True)``).

    One exchange: after the token stream is partitioned by page, the nesting
    windows (page, tag), the nav-depth and index windows (page) and the
    per-page assembly all reuse that partitioning.  Each element's text is an
    ``slice`` of the page's ordered token array between its open and close
    indexes, so the cost is linear in text times nesting depth.
    """
    s = _zone_stream(base)
    is_open = col("kind") == lit("open")
    is_close = col("kind") == lit("close")
    by_page = Window.partitionBy("page_id").orderBy("pos")
    s = s.withColumn("idx", F.row_number().over(by_page))
    running = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("depth", F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(running))
    s = s.withColumn("level", F.when(is_open, col("depth")).otherwise(col("depth") + 1))
    nxt = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    s = s.withColumn("next_idx", F.lead("idx").over(nxt)).withColumn("next_kind", F.lead("kind").over(nxt))
    s = s.withColumn("last_kind", F.lag("kind").over(nxt))
    # an end tag closes a nav or header only if it matches an open one: stray ends do not count
    is_nav = col("tag").isin(*NAV_CONTAINERS)
    ends_nav = is_close & is_nav & (col("last_kind") == lit("open"))
    nav_delta = F.when(is_open & is_nav, 1).when(ends_nav, -1).otherwise(0)
    s = s.withColumn("nav_depth", F.sum(nav_delta).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    close_idx = F.when(is_open & (col("next_kind") == lit("close")), col("next_idx"))
    grps = F.filter(
        F.array(
            F.when(col("kind") == lit("head"), col("pos").cast("int")),
            F.when(is_open & col("tag").isin(*HEADING_GROUP),
                   F.expr("CASE tag WHEN 'h1' THEN 2 WHEN 'h2' THEN 3 ELSE 4 END")),
            F.when(is_open & (col("tag") == lit("a")) & (col("nav_depth") > 0), lit(G_NAV_LINK)),
            F.when(is_open & (col("tag").isin(*CONTAINERS) | col("is_content")), lit(G_CONTAINER)),
        ),
        lambda g: g.isNotNull(),
    )
    rows = s.select("page_id", F.struct("idx", "kind", "text", close_idx.alias("close_idx"), grps.alias("grps")).alias("r"))
    per_page = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    n = F.size("rows")

    def segment(e):
        # head parts carry their own text; elements take the text runs up to their close
        start = e["idx"] + 1
        stop = F.coalesce(e["close_idx"], n + 1)
        inner = F.filter(F.slice("rows", start, F.greatest(stop - start, lit(0))), lambda r: r["kind"] == "text")
        return F.when(e["grp"] < 2, e["text"]).otherwise(
            F.concat(F.array_join(F.transform(inner, lambda r: r["text"]), ""), lit(" "))
        )

    members = F.flatten(
        F.transform(
            F.filter("rows", lambda r: F.size(r["grps"]) > 0),
            lambda r: F.transform(r["grps"], lambda g: F.struct(g.alias("grp"), r["idx"].alias("idx"),
                                                                r["close_idx"].alias("close_idx"), r["text"].alias("text"))),
        )
    )
    ordered = F.array_sort(members)
    text = F.array_join(F.transform(ordered, segment), "")
    return per_page.select("page_id", F.lower(text).alias("zone_text"))


def zone_segments(base: DataFrame) -> DataFrame:
    """``page_id, grp, open_pos, segment`` via the explicit interval join (reference formulation).

    Kept as the readable, join-based statement of the semantics; ``zone_text``
    computes the same text in one pass.
    """
    tokens = html_tokens(base)
    elems = zone_elements(element_spans(tokens))
    texts = tokens.where(col("kind") == "text").select(col("page_id").alias("t_page"), "pos", "text")
    within = (elems["page_id"] == texts["t_page"]) & (texts["pos"] > elems["open_pos"]) & (texts["pos"] < elems["end_pos"])
    j = elems.join(texts, within, "left")
    seg = j.groupBy("page_id", "grp", "open_pos").agg(
        F.array_sort(F.collect_list(F.when(col("pos").isNotNull(), F.struct("pos", "text")))).alias("parts")
    )
    return seg.select(
        "page_id",
        "grp",
        "open_pos",
        F.concat(F.array_join(F.transform("parts", lambda s: s["text"]), ""), lit(" ")).alias("segment"),
    )

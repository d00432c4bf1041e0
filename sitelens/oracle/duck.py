"""DuckDB SQL twins of the Spark operators (the correctness oracle).

Each builder returns SQL text over the pre-registered tables (``pages`` ...).
The regexps are the very same strings the Spark expressions use
(``sitelens.functions.patterns``); only the function spelling differs:
``regexp_matches`` for ``rlike``, ``'g'`` for global replace, ``\\1`` for ``$1``,
``lambda x:`` for Spark lambdas, 1-based list indexing.
"""

from __future__ import annotations

from sitelens.functions import patterns as P
from sitelens.functions.text import ESCAPES, bare_values, named_values, windows_values
from sitelens.operators.audit import COMPLETENESS_WEIGHTS
from sitelens.fixtures import pages_rich_sql
from sitelens.sources.pages import HOST_RE, INDEX_PATH_RE, PATH_RE


def q(s: str) -> str:
    """SQL string literal; possessive repetitions of a pattern become greedy ones."""
    return "'" + P.re2(s).replace("'", "''") + "'"


def _map(values: dict) -> str:
    return "map {" + ", ".join(f"{k if isinstance(k, int) else q(k)}: {q(v)}" for k, v in values.items()) + "}"


def decode(x: str, attribute: bool = False) -> str:
    # list_transform over a list of one names a value inside an expression
    body = "rtrim(substr(e, 2), ';=')"
    parts = f"{{'e': e, 'b': {body}, 'r': substr(e, length({body}) + 2), 'd': ltrim(regexp_replace({body}, '^#[xX]?', ''), '0')}}"
    short = "CASE WHEN ent.d = '' THEN '0' WHEN length(ent.d) > 7 THEN '9999999' ELSE ent.d END"
    code = f"CASE WHEN ent.b[1:2] IN ('#x', '#X') THEN CAST('0x' || {short} AS INTEGER) ELSE CAST({short} AS INTEGER) END"
    valid = "n > 0 AND n <= 1114111 AND NOT n BETWEEN 55296 AND 57343"
    point = f"list_transform([{code}], lambda n: coalesce({_map(windows_values())}[n], CASE WHEN {valid} THEN chr(n) ELSE chr(65533) END))[1]"
    whole = f"CASE WHEN ent.r = ';' THEN {_map(named_values())}[ent.b] END"
    if attribute:
        bare = f"CASE WHEN ent.r = '' THEN {_map(bare_values())}[ent.b] END"
    else:
        known = f"regexp_extract(ent.b, '^({'|'.join(sorted(bare_values(), key=len, reverse=True))})')"
        bare = f"{_map(bare_values())}[{known}] || substr(ent.b, length({known}) + 1) || ent.r"
    one = (
        f"list_transform([{parts}], lambda ent: CASE WHEN ent.b[1] = '#' THEN {point} || replace(ent.r, ';', '') "
        f"ELSE coalesce({whole}, {bare}, ent.e) END)[1]"
    )
    values = f"list_append(list_transform(regexp_extract_all(v, {q(P.ENTITY)}), lambda e: {one}), '')"
    joined = f"array_to_string(list_transform(list_zip(string_split_regex(v, {q(P.ENTITY)}), {values}), lambda z: z[1] || z[2]), '')"
    return f"list_transform([{x}], lambda v: CASE WHEN contains(v, '&') THEN {joined} ELSE v END)[1]"


def html_escape(x: str) -> str:
    for ch, ent in ESCAPES:
        x = f"replace({x}, {q(ch)}, {q(ent)})"
    return x


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(P.EDGE_WS)}, '', 'g')"


def extract_all(x: str, pat: str) -> str:
    return f"regexp_extract_all({x}, {q(pat)})"


def rlike(x: str, pat: str) -> str:
    return f"regexp_matches({x}, {q(pat)})"


def regexp_value(x: str, pat: str) -> str:
    return f"concat(regexp_extract({x}, {q(pat)}, 1), regexp_extract({x}, {q(pat)}, 2), regexp_extract({x}, {q(pat)}, 3))"


def clean_html(h: str = "html") -> str:
    return f"regexp_replace({h}, {q(P.HIDDEN)}, '\\1\\2\\3\\4{P.COMMENT_MARK}', 'g')"


def first_tag(clean: str, tag_pat: str, attr_pat: str) -> str:
    return f"list_filter({extract_all(clean, tag_pat)}, lambda t: {rlike('t', attr_pat)})[1]"


def attr_of(tag: str, present: str, value: str) -> str:
    return f"CASE WHEN {rlike(tag, present)} THEN {decode(regexp_value(tag, value), True)} END"


def any_tag(clean: str, tag_pat: str, attr_pat: str) -> str:
    return f"(len(list_filter({extract_all(clean, tag_pat)}, lambda t: {rlike('t', attr_pat)})) > 0)"


def site_key(url: str = "url") -> str:
    return f"lower(regexp_extract({url}, {q(HOST_RE)}, 1))"


def url_path(url: str = "url") -> str:
    return f"regexp_extract({url}, {q(PATH_RE)}, 1)"


def title_raw(clean: str = "clean") -> str:
    return f"CASE WHEN {rlike(clean, P.TITLE_PRESENT)} THEN {decode(f'regexp_extract({clean}, {q(P.TITLE_TEXT)}, 1)')} END"


def description(clean: str = "clean") -> str:
    return attr_of(first_tag(clean, P.META_TAG, P.NAME_DESCRIPTION), P.CONTENT_PRESENT, P.CONTENT_VALUE)


def language(clean: str = "clean") -> str:
    html_tag = f"{extract_all(clean, P.HTML_TAG)}[1]"
    lang = attr_of(html_tag, P.LANG_PRESENT, P.LANG_VALUE)
    meta = first_tag(clean, P.META_TAG, P.HTTP_EQUIV_LANGUAGE)
    meta_lang = attr_of(meta, P.CONTENT_PRESENT, P.CONTENT_VALUE)
    return f"split_part(coalesce({lang}, {meta_lang}), '-', 1)"


def body_part(clean: str = "clean") -> str:
    return (
        f"CASE WHEN {rlike(clean, P.BODY_PRESENT)} THEN regexp_extract({clean}, {q(P.BODY_REST)}, 1) "
        f"WHEN {rlike(clean, P.HEAD_END_PRESENT)} THEN regexp_extract({clean}, {q(P.HEAD_REST)}, 1) "
        f"ELSE regexp_replace({clean}, {q(P.TITLE_ELEMENT)}, '', 'g') END"
    )


def body_text(clean: str = "clean", title_raw_col: str = "title_raw", desc_col: str = "description") -> str:
    nodes = f"list_filter({extract_all(body_part(clean), P.TOKEN)}, lambda t: NOT {rlike('t', P.IS_MARKUP)})"
    joined = f"array_to_string(list_transform({nodes}, lambda t: t || ' '), '')"
    return (
        f"concat({decode(joined)}, CASE WHEN {title_raw_col} IS NOT NULL THEN {title_raw_col} || ' ' ELSE '' END, "
        f"coalesce({desc_col}, ''))"
    )


def completeness(prefix: str = "") -> str:
    parts = [f"CASE WHEN {prefix}{f} THEN {w} ELSE 0 END" for f, w in COMPLETENESS_WEIGHTS.items()]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def source(rich: bool) -> str:
    """CTE body for the page source: the given table or the rich view of it."""
    if rich:
        return pages_rich_sql().format(pages="pages")
    return "SELECT page_id, url, html FROM pages"


def base_ctes(rich: bool = False, src_sql: str | None = None, sfx: str = "") -> str:
    """CTEs ``src``, ``c`` and ``base``: one row per page with every per-page extraction."""
    audit = [
        "title",
        "description",
        "coalesce(title <> '', false) AS has_title",
        "coalesce(description <> '', false) AS has_description",
        f"{any_tag('clean', P.META_TAG, P.PROPERTY_OG)} AS has_og_tags",
        f"{any_tag('clean', P.META_TAG, P.NAME_TWITTER)} AS has_twitter_cards",
        f"{any_tag('clean', P.SCRIPT_TAG, P.TYPE_LD_JSON)} AS has_schema",
        f"{any_tag('clean', P.LINK_TAG, P.REL_CANONICAL)} AS has_canonical",
        f"{any_tag('clean', P.META_TAG, P.NAME_VIEWPORT)} AS has_viewport",
        f"(len(list_filter({extract_all('clean', P.META_TAG)}, lambda t: {rlike('t', P.HAS_CHARSET)} OR "
        f"{rlike('t', P.HTTP_EQUIV_CONTENT_TYPE)})) > 0) AS has_charset",
        f"CAST(len({extract_all('clean', P.H1_START)}) AS BIGINT) AS h1_count",
        f"CAST(greatest(len({extract_all('clean', P.IMG_TAG)}) - len(list_filter({extract_all('clean', P.IMG_TAG)}, "
        f"lambda t: {rlike('t', P.ALT_NONEMPTY)})), 0) AS BIGINT) AS img_without_alt",
    ]
    return (
        f"src{sfx} AS ({src_sql or source(rich)}), "
        f"c{sfx} AS (SELECT page_id, url, {site_key('url')} AS site, {clean_html('html')} AS clean FROM src{sfx}), "
        f"t{sfx} AS (SELECT *, {title_raw('clean')} AS title_raw, {description('clean')} AS description FROM c{sfx}), "
        f"t2{sfx} AS (SELECT *, {trim_ws('title_raw')} AS title FROM t{sfx}), "
        f"base{sfx} AS (SELECT page_id, url, site, clean, title_raw, {', '.join(audit)}, "
        f"{language('clean')} AS language, {body_text('clean')} AS raw_text FROM t2{sfx})"
    )


AUDIT_COLS = (
    "title, description, has_title, has_description, has_og_tags, has_twitter_cards, has_schema, "
    "has_canonical, has_viewport, has_charset, h1_count, img_without_alt"
)


def page_audit(rich: bool = False) -> str:
    return (
        f"WITH {base_ctes(rich)} SELECT page_id, site, {AUDIT_COLS}, {completeness()} AS completeness_score FROM base"
    )


def site_audit(rich: bool = False) -> str:
    flags = [
        "has_title", "has_description", "has_og_tags", "has_twitter_cards",
        "has_schema", "has_canonical", "has_viewport", "has_charset",
    ]
    aggs = [f"bool_or({f}) AS {f}" for f in flags]
    aggs += ["CAST(sum(h1_count) AS BIGINT) AS h1_count", "CAST(sum(img_without_alt) AS BIGINT) AS img_without_alt"]
    aggs += [
        "arg_max(title, page_id) FILTER (WHERE title IS NOT NULL) AS title",
        "arg_max(description, page_id) FILTER (WHERE description IS NOT NULL) AS description",
        "count(*) AS page_count",
    ]
    return (
        f"WITH {base_ctes(rich)}, s AS (SELECT site, {', '.join(aggs)} FROM base GROUP BY site) "
        f"SELECT *, {completeness()} AS completeness_score FROM s"
    )


def main_page() -> str:
    return (
        f"WITH p AS (SELECT page_id, {site_key('url')} AS site, regexp_matches({url_path('url')}, {q(INDEX_PATH_RE)}) AS is_index FROM pages) "
        "SELECT site, arg_min(page_id, (NOT is_index, page_id)) AS main_page_id, bool_or(is_index) AS has_index_page, "
        "count(*) AS page_count FROM p GROUP BY site"
    )


# --- keywords --------------------------------------------------------------------


def f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def stop_list() -> str:
    from sitelens.operators.dims import STOP_WORDS

    return "(" + ", ".join(q(w) for w in STOP_WORDS) + ")"


def word_score(freq: str = "frequency", total: str = "total_words", word: str = "word") -> str:
    tf = f"({f32(freq)} / {f32(f'greatest({total}, 1)')})"
    bonus = f"least({f32(f'strlen({word})')} / {f32('10')}, {f32('1.0')})"
    return f"({tf} * {f32('100.0')} * ({f32('1.0')} + {bonus}))"


def keyword_ctes(src: str = "base", key: str = "page_id", text: str = "raw_text") -> str:
    """CTEs ``kt`` (tokens), ``kf`` (frequencies) and ``kw`` (scored, ranked keywords)."""
    words = f"list_filter(list_transform({extract_all(text, P.WORD)}, lambda x: lower(x)), lambda x: length(x) >= 3)"
    phrases = (
        f"list_filter(list_transform({extract_all(text, P.PHRASE)}, lambda x: lower(x)), "
        f"lambda x: len({extract_all('x', P.NON_SPACE_RUN)}) <= 4)"
    )
    return (
        f"kt AS (SELECT {key}, false AS is_phrase, unnest({words}) AS word FROM {src} "
        f"UNION ALL SELECT {key}, true AS is_phrase, unnest({phrases}) AS word FROM {src}), "
        f"kt2 AS (SELECT {key}, is_phrase, word FROM kt WHERE is_phrase OR word NOT IN {stop_list()}), "
        f"kf0 AS (SELECT {key}, is_phrase, word, count(*) AS frequency FROM kt2 GROUP BY ALL), "
        f"kf AS (SELECT *, CAST(sum(frequency) OVER (PARTITION BY {key}, is_phrase) AS BIGINT) AS total_words FROM kf0), "
        f"ks AS (SELECT *, CASE WHEN is_phrase THEN {f32('frequency')} * {f32('5.0')} ELSE {word_score()} END AS score FROM kf), "
        f"kr AS (SELECT *, row_number() OVER (PARTITION BY {key}, is_phrase ORDER BY score DESC, word) AS rk FROM ks), "
        f"kw AS (SELECT {key}, word, frequency, CAST(score AS DOUBLE) AS score, is_phrase, "
        f"CAST(rk + CASE WHEN is_phrase THEN 50 ELSE 0 END AS INTEGER) AS rank FROM kr "
        f"WHERE rk <= 50 AND (NOT is_phrase OR rk <= 10))"
    )


def with_keywords(rich: bool = False) -> str:
    return f"WITH {base_ctes(rich)}, {keyword_ctes()}"


def word_tokens(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT page_id, word FROM kt2 WHERE NOT is_phrase"


def phrase_tokens(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT page_id, word AS phrase FROM kt2 WHERE is_phrase"


def word_frequency(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT page_id, word, frequency, total_words FROM kf WHERE NOT is_phrase"


def page_keywords(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT * FROM kw"


def keyword_scores(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT * FROM kw WHERE NOT is_phrase"


def phrase_scores(rich: bool = False) -> str:
    return f"{with_keywords(rich)} SELECT * FROM kw WHERE is_phrase"


def top_keywords(n: int, rich: bool = False) -> str:
    return (
        f"{with_keywords(rich)}, tk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rank) AS top_rank FROM kw) "
        f"SELECT page_id, word, frequency, score, is_phrase, rank, CAST(top_rank AS INTEGER) AS top_rank FROM tk WHERE top_rank <= {n}"
    )


def site_keyword_ctes() -> str:
    """CTE ``sk``: union of page keyword lists per site, first page wins."""
    return (
        "sk0 AS (SELECT b.site, k.word, arg_min({'frequency': k.frequency, 'score': k.score, 'is_phrase': k.is_phrase, "
        "'rank': k.rank, 'first_page_id': k.page_id}, k.page_id) AS s FROM kw k JOIN base b USING (page_id) GROUP BY ALL), "
        "sk AS (SELECT site, word, s.frequency AS frequency, s.score AS score, s.is_phrase AS is_phrase, "
        "s.first_page_id AS first_page_id, s.rank AS first_rank FROM sk0)"
    )


def site_keywords(rich: bool = False) -> str:
    return f"{with_keywords(rich)}, {site_keyword_ctes()} SELECT * FROM sk"


def site_top_keywords(n: int, rich: bool = False) -> str:
    return (
        f"{with_keywords(rich)}, {site_keyword_ctes()}, "
        "st AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, first_page_id, first_rank) AS top_rank FROM sk) "
        f"SELECT site, word, frequency, score, is_phrase, first_page_id, first_rank, CAST(top_rank AS INTEGER) AS top_rank FROM st WHERE top_rank <= {n}"
    )


def body_text_q(rich: bool = False) -> str:
    return f"WITH {base_ctes(rich)} SELECT page_id, raw_text FROM base"


# --- zones -----------------------------------------------------------------------


def _in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def token_ctes() -> str:
    """CTEs ``tok`` (every token of each page) and ``spans`` (element open/close positions)."""
    from sitelens.operators.zones import ANY_OPEN_TAG, VOID_TAGS

    ctags = (
        f"list_distinct(list_transform(list_filter({extract_all('clean', ANY_OPEN_TAG)}, lambda t: {rlike('t', P.CLASS_CONTENT)}), "
        f"lambda t: lower(regexp_extract(t, {q(P.OPEN_TAG_NAME)}, 1))))"
    )
    kind = (
        f"CASE WHEN NOT {rlike('tok', P.IS_MARKUP)} THEN 'text' "
        f"WHEN {rlike('tok', '^</[a-zA-Z]')} THEN 'close' WHEN {rlike('tok', '^<[a-zA-Z]')} THEN 'open' ELSE 'other' END"
    )
    tag = (
        f"lower(coalesce(nullif(regexp_extract(tok, {q(P.CLOSE_TAG_NAME)}, 1), ''), "
        f"nullif(regexp_extract(tok, {q(P.OPEN_TAG_NAME)}, 1), '')))"
    )
    return (
        f"tk0 AS (SELECT page_id, {ctags} AS ctags, {extract_all('clean', P.TOKEN)} AS toks FROM base), "
        "tk1 AS (SELECT page_id, ctags, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM tk0), "
        f"tk2 AS (SELECT page_id, ctags, CAST(pos AS INTEGER) AS pos, tok, {kind} AS kind FROM tk1), "
        f"tok AS (SELECT page_id, pos, kind, CASE WHEN kind IN ('open', 'close') THEN {tag} END AS tag, "
        f"(kind = 'open' AND {rlike('tok', P.CLASS_CONTENT)}) AS is_content, "
        f"CASE WHEN kind = 'text' THEN {decode('tok')} END AS text, ctags FROM tk2), "
        f"tg AS (SELECT * FROM tok WHERE kind IN ('open', 'close') AND tag NOT IN {_in_list(VOID_TAGS)}), "
        "tg1 AS (SELECT *, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM tg), "
        "tg2 AS (SELECT *, CASE WHEN kind = 'open' THEN depth ELSE depth + 1 END AS level FROM tg1), "
        "tg3 AS (SELECT *, lead(pos) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS next_pos, "
        "lead(kind) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS next_kind FROM tg2), "
        "spans AS (SELECT page_id, tag, is_content, ctags, pos AS open_pos, "
        "CASE WHEN next_kind = 'close' THEN next_pos END AS close_pos FROM tg3 WHERE kind = 'open')"
    )


def zone_ctes() -> str:
    """CTE ``zone``: ``page_id, zone_text`` (needs ``base`` and ``token_ctes``)."""
    from sitelens.operators.zones import CONTAINERS, END_OF_PAGE, NAV_CONTAINERS, ZONE_TAGS

    tracked = f"(tag IN {_in_list(ZONE_TAGS)} OR list_contains(ctags, tag))"
    return (
        f"zs AS (SELECT page_id, tag, is_content, open_pos, coalesce(close_pos, {END_OF_PAGE}) AS end_pos FROM spans WHERE {tracked}), "
        f"navs AS (SELECT page_id, open_pos AS c_open, end_pos AS c_end FROM zs WHERE tag IN {_in_list(NAV_CONTAINERS)}), "
        "elems AS ("
        "SELECT page_id, CASE tag WHEN 'h1' THEN 2 WHEN 'h2' THEN 3 ELSE 4 END AS grp, open_pos, end_pos FROM zs "
        "WHERE tag IN ('h1', 'h2', 'h3') "
        "UNION ALL SELECT s.page_id, 5 AS grp, s.open_pos, s.end_pos FROM zs s WHERE s.tag = 'a' AND EXISTS "
        "(SELECT 1 FROM navs n WHERE n.page_id = s.page_id AND s.open_pos > n.c_open AND s.open_pos < n.c_end) "
        f"UNION ALL SELECT page_id, 6 AS grp, open_pos, end_pos FROM zs WHERE tag IN {_in_list(CONTAINERS)} OR is_content), "
        "segs AS (SELECT e.page_id, e.grp, e.open_pos, coalesce(string_agg(t.text, '' ORDER BY t.pos), '') || ' ' AS segment "
        "FROM elems e LEFT JOIN tok t ON t.page_id = e.page_id AND t.kind = 'text' AND t.pos > e.open_pos AND t.pos < e.end_pos "
        "GROUP BY e.page_id, e.grp, e.open_pos), "
        "zb AS (SELECT page_id, string_agg(segment, '' ORDER BY grp, open_pos) AS zones FROM segs GROUP BY page_id), "
        "zone AS (SELECT b.page_id, lower(concat(CASE WHEN b.title_raw IS NOT NULL THEN b.title_raw || ' ' ELSE '' END, "
        "CASE WHEN b.description IS NOT NULL THEN b.description || ' ' ELSE '' END, coalesce(zb.zones, ''))) AS zone_text "
        "FROM base b LEFT JOIN zb USING (page_id))"
    )


def html_tokens(rich: bool = True) -> str:
    return f"WITH {base_ctes(rich)}, {token_ctes()} SELECT page_id, pos, kind, tag, is_content, text FROM tok"


def element_spans(rich: bool = True) -> str:
    return f"WITH {base_ctes(rich)}, {token_ctes()} SELECT page_id, tag, is_content, open_pos, close_pos FROM spans"


def zone_text(rich: bool = True) -> str:
    return f"WITH {base_ctes(rich)}, {token_ctes()}, {zone_ctes()} SELECT page_id, zone_text FROM zone"


# --- business type, summary, analysis --------------------------------------------------


def values(rows, cols) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return repr(v)
        return q(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


def indicators_table() -> str:
    from sitelens.operators.dims import BUSINESS_TYPES, INDICATORS

    ordinal = {n: o for n, o, _ in BUSINESS_TYPES}
    rows = [(t, ordinal[t], i) for t, inds in INDICATORS.items() for i in inds]
    return values(rows, ["business_type", "ordinal", "indicator"])


def business_types_table() -> str:
    from sitelens.operators.dims import BUSINESS_TYPES

    return values(BUSINESS_TYPES, ["business_type", "ordinal", "schema_type"])


def summary_expr(z: str = "zone_text") -> str:
    parts = f"list_transform(string_split_regex({z}, {q(P.SENTENCE_SPLIT)}), lambda s: {trim_ws('s')})"
    keep = f"list_filter({parts}, lambda s: strlen(s) > 20 AND strlen(s) < 200)"
    return f"array_to_string(list_slice({keep}, 1, 3), '. ')"


def business_ctes(zone: str = "zone", key: str = "page_id") -> str:
    """CTEs ``isc`` (indicator scores) and ``bt`` (best type per key)."""
    return (
        f"hits AS (SELECT z.{key}, i.business_type, i.ordinal, "
        "1 + ((length(z.zone_text) - length(replace(z.zone_text, i.indicator, ''))) // length(i.indicator) - 1) // 2 AS pts "
        f"FROM {zone} z JOIN {indicators_table()} i ON contains(z.zone_text, i.indicator)), "
        f"isc AS (SELECT {key}, business_type, ordinal, CAST(sum(pts) AS BIGINT) AS score FROM hits GROUP BY ALL), "
        f"bt0 AS (SELECT {key}, arg_max(business_type, (score, -ordinal)) AS business_type, max(score) AS business_score "
        f"FROM isc GROUP BY {key}), "
        f"bt AS (SELECT z.{key}, coalesce(b.business_type, 'Unknown') AS business_type, "
        f"CAST(coalesce(b.business_score, 0) AS BIGINT) AS business_score FROM {zone} z LEFT JOIN bt0 b USING ({key}))"
    )


def _zone_ctes(rich: bool) -> str:
    return f"{base_ctes(rich)}, {token_ctes()}, {zone_ctes()}, {business_ctes()}"


def _zone_all(rich: bool) -> str:
    return f"WITH {_zone_ctes(rich)}"


def indicator_scores(rich: bool = True) -> str:
    return f"{_zone_all(rich)} SELECT page_id, business_type, ordinal, score FROM isc"


def business_type(rich: bool = True) -> str:
    return f"{_zone_all(rich)} SELECT page_id, business_type, business_score FROM bt"


def schema_type(rich: bool = True) -> str:
    return (
        f"{_zone_all(rich)} SELECT b.page_id, b.business_type, d.schema_type FROM bt b "
        f"LEFT JOIN {business_types_table()} d USING (business_type)"
    )


def content_summary(rich: bool = True) -> str:
    return f"{_zone_all(rich)} SELECT page_id, {summary_expr()} AS content_summary FROM zone"


BASE_COLS = (
    "page_id, url, site, title, description, has_title, has_description, has_og_tags, has_twitter_cards, "
    "has_schema, has_canonical, has_viewport, has_charset, h1_count, img_without_alt, language, raw_text"
)


def analysis_ctes(rich: bool = True) -> str:
    """All CTEs up to ``pa`` (page analysis), ``kw`` (page keywords) and ``sk`` (site keywords)."""
    return (
        f"{_zone_ctes(rich)}, {keyword_ctes()}, {site_keyword_ctes()}, "
        "kc AS (SELECT page_id, count(*) AS keyword_count FROM kw GROUP BY page_id), "
        f"pa0 AS (SELECT {BASE_COLS}, coalesce(bt.business_type, 'Unknown') AS business_type, bt.business_score, "
        f"{summary_expr('z.zone_text')} AS content_summary, CAST(coalesce(kc.keyword_count, 0) AS BIGINT) AS keyword_count "
        "FROM base LEFT JOIN bt USING (page_id) LEFT JOIN zone z USING (page_id) LEFT JOIN kc USING (page_id)), "
        f"pa AS (SELECT pa0.*, d.schema_type, {completeness()} AS completeness_score FROM pa0 "
        f"LEFT JOIN {business_types_table()} d USING (business_type))"
    )


def page_analysis(rich: bool = True) -> str:
    return f"WITH {analysis_ctes(rich)} SELECT * FROM pa"


def site_analysis_ctes() -> str:
    flags = [
        "has_title", "has_description", "has_og_tags", "has_twitter_cards",
        "has_schema", "has_canonical", "has_viewport", "has_charset",
    ]
    aggs = [f"bool_or({f}) AS {f}" for f in flags]
    aggs += ["CAST(sum(h1_count) AS BIGINT) AS h1_count", "CAST(sum(img_without_alt) AS BIGINT) AS img_without_alt"]
    for c in ["title", "description", "language", "content_summary", "raw_text"]:
        aggs.append(f"arg_max({c}, page_id) FILTER (WHERE {c} IS NOT NULL) AS {c}")
    aggs.append("arg_max(business_type, page_id) FILTER (WHERE business_type <> 'Unknown') AS bt_last")
    aggs.append("count(*) AS page_count")
    return (
        f"sa0 AS (SELECT site, {', '.join(aggs)} FROM pa GROUP BY site), "
        "skc AS (SELECT site, count(*) AS keyword_count FROM sk GROUP BY site), "
        "sa1 AS (SELECT sa0.* EXCLUDE (bt_last), coalesce(bt_last, 'Unknown') AS business_type, "
        "CAST(coalesce(skc.keyword_count, 0) AS BIGINT) AS keyword_count FROM sa0 LEFT JOIN skc USING (site)), "
        f"sa AS (SELECT sa1.*, d.schema_type, {completeness()} AS completeness_score FROM sa1 "
        f"LEFT JOIN {business_types_table()} d USING (business_type))"
    )


def site_analysis(rich: bool = True) -> str:
    return f"WITH {analysis_ctes(rich)}, {site_analysis_ctes()} SELECT * FROM sa"


# --- scoring stage (any grain) ----------------------------------------------------------


def lexicon_table() -> str:
    from sitelens.operators.dims import LEXICON_LISTS

    return values([(n, w) for n, ws in LEXICON_LISTS for w in ws], ["list", "word"])


def trends_table() -> str:
    from sitelens.operators.dims import SCHEMA_TRENDS

    rows = [(i, s, float(sc), rich, t, d) for i, (s, sc, rich, ts, d) in enumerate(SCHEMA_TRENDS) for t in ts]
    return values(rows, ["trend_ord", "schema_type", "trend_score", "has_rich_snippets", "business_type", "description"])


def ff(v: float) -> str:
    return f"CAST({v!r} AS FLOAT)"


def sentiment_ctes(an: str, key: str) -> str:
    """CTE ``sen``: per-key sentiment over analysis CTE ``an``."""
    from sitelens.operators.sentiment import EMOTION_BOOST, EMOTION_CAP, LABEL_CUTS, POWER_BOOST, POWER_CAP

    text = "concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(raw_text, ''))"
    p, n = "positive_count", "negative_count"
    base = f"(({f32(p)} - {f32(n)}) / {f32(f'greatest({p} + {n}, 1)')})"
    power = f"least({f32('len(power_words)')} * {ff(POWER_BOOST)}, {ff(POWER_CAP)})"
    emo = f"least({f32('len(emotional_triggers)')} * {ff(EMOTION_BOOST)}, {ff(EMOTION_CAP)})"
    raw = f"greatest(least({base} + {power} + {emo}, {ff(1.0)}), {ff(-1.0)})"
    conf = f"least(({f32(f'{p} + {n}')} / {f32('greatest(token_count, 1)')}) * {ff(5.0)}, {ff(1.0)})"
    label = "CASE " + " ".join(f"WHEN sc < {ff(c)} THEN {q(name)}" for c, name in LABEL_CUTS) + " ELSE 'VeryPositive' END"
    lst = lambda name: f"coalesce(list(h.token ORDER BY h.pos) FILTER (WHERE h.list = {q(name)}), [])"
    return (
        f"st0 AS (SELECT {key}, regexp_extract_all(lower({text}), {q(P.SENTIMENT_TOKEN)}) AS toks FROM {an}), "
        f"st1 AS (SELECT {key}, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM st0), "
        f"sth AS (SELECT s.{key}, s.pos, s.token, l.list FROM st1 s JOIN {lexicon_table()} l ON l.word = s.token), "
        f"sag AS (SELECT st0.{key}, CAST(len(st0.toks) AS BIGINT) AS token_count, "
        "count(h.list) FILTER (WHERE h.list = 'positive') AS positive_count, "
        "count(h.list) FILTER (WHERE h.list = 'negative') AS negative_count, "
        f"{lst('power')} AS power_words, {lst('emotional')} AS emotional_triggers, {lst('negative')} AS negative_words "
        f"FROM st0 LEFT JOIN sth h ON h.{key} = st0.{key} GROUP BY st0.{key}, len(st0.toks)), "
        f"sen0 AS (SELECT *, CASE WHEN token_count = 0 THEN {ff(0.0)} ELSE {raw} END AS sc, "
        f"CASE WHEN token_count = 0 THEN {ff(0.0)} ELSE {conf} END AS cf FROM sag), "
        f"sen AS (SELECT {key}, token_count, positive_count, negative_count, CAST(sc AS DOUBLE) AS sentiment_score, "
        f"CAST(cf AS DOUBLE) AS sentiment_confidence, {label} AS sentiment_label, power_words, emotional_triggers, negative_words FROM sen0)"
    )


def density_exprs(wc: str, total: str) -> list[str]:
    d = f"({f32(total)} / {f32(f'greatest({wc}, 1)')} * {ff(100.0)})"
    low = f"({d} / {ff(1.0)})"
    high = f"({ff(1.0)} - least(({d} - {ff(3.0)}) / {ff(10.0)}, {ff(1.0)}))"
    score = f"CASE WHEN {d} < {ff(1.0)} THEN {low} WHEN {d} > {ff(3.0)} THEN {high} ELSE {ff(1.0)} END"
    return [
        f"CAST(CASE WHEN {wc} = 0 THEN {ff(0.0)} ELSE {d} END AS DOUBLE) AS density",
        f"CAST(CASE WHEN {wc} = 0 THEN {ff(0.0)} ELSE {score} END AS DOUBLE) AS density_score",
        f"CASE WHEN {wc} = 0 THEN false ELSE {d} > {ff(5.0)} END AS is_stuffed",
    ]


def words_count(x: str = "raw_text") -> str:
    return f"CAST(len({extract_all(x, P.NON_SPACE_RUN)}) AS BIGINT)"


def feature_ctes(an: str, kw: str, key: str, order: list[str]) -> str:
    """CTEs ``tk10`` (top-10 ranked), ``top`` (packed lists), ``tot`` (totals, over-used)."""
    o = ", ".join(order)
    share = f"({f32('k.frequency')} / {f32('greatest(w.word_count, 1)')} * {ff(100.0)})"
    return (
        f"tk10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {o}) AS top_rank "
        f"FROM {kw}) WHERE top_rank <= 10), "
        f"top AS (SELECT {key}, list(word ORDER BY top_rank) AS top10, list_slice(list(word ORDER BY top_rank), 1, 5) AS top5, "
        f"list_slice(list(word ORDER BY top_rank), 1, 3) AS top3 FROM tk10 GROUP BY {key}), "
        f"wc AS (SELECT {key}, {words_count()} AS word_count FROM {an}), "
        f"tot AS (SELECT k.{key}, CAST(sum(k.frequency) AS BIGINT) AS total_keyword_freq, "
        f"coalesce(list(k.word ORDER BY {', '.join('k.' + c for c in order)}) FILTER (WHERE w.word_count > 0 AND {share} > {ff(2.0)}), []) AS over_used "
        f"FROM {kw} k JOIN wc w ON w.{key} = k.{key} GROUP BY k.{key})"
    )


def score_expr(c: str, s: str, d: str, k: str) -> str:
    seo = f"CAST(floor({c} * 40 / 100) AS BIGINT)"
    senti = f"CAST(greatest(floor(({f32(s)} + {ff(1.0)}) / {ff(2.0)} * {ff(20.0)}), 0) AS BIGINT)"
    dens = f"CAST(greatest(floor({f32(d)} * {ff(20.0)}), 0) AS BIGINT)"
    content = f"CASE WHEN {k} >= 10 THEN 20 ELSE {k} * 2 END"
    return f"CAST(least({seo} + {senti} + {dens} + {content}, 100) AS BIGINT)"


def ml_ctes(an: str, kw: str, key: str, order: list[str]) -> str:
    """CTE ``ml``: the wide per-key row."""
    return (
        f"{sentiment_ctes(an, key)}, {feature_ctes(an, kw, key, order)}, "
        f"ml0 AS (SELECT a.{key}, a.completeness_score, a.keyword_count, {words_count('a.raw_text')} AS word_count, "
        "s.sentiment_score, s.sentiment_label, s.sentiment_confidence, s.power_words, s.emotional_triggers, s.negative_words, "
        "coalesce(t.total_keyword_freq, 0) AS total_keyword_freq, t.over_used, tp.top3 "
        f"FROM {an} a LEFT JOIN sen s ON s.{key} = a.{key} LEFT JOIN tot t ON t.{key} = a.{key} LEFT JOIN top tp ON tp.{key} = a.{key}), "
        f"ml1 AS (SELECT *, {', '.join(density_exprs('word_count', 'total_keyword_freq'))} FROM ml0), "
        f"ml AS (SELECT {key}, sentiment_score, sentiment_label, sentiment_confidence, power_words, emotional_triggers, negative_words, "
        "word_count, CAST(total_keyword_freq AS BIGINT) AS total_keyword_freq, density, density_score, is_stuffed, "
        f"CASE WHEN word_count > 0 AND density < 1.0 THEN coalesce(top3, []) ELSE [] END AS recommended_additions, "
        "coalesce(over_used, []) AS over_used, keyword_count, completeness_score, "
        f"{score_expr('completeness_score', 'sentiment_score', 'density_score', 'keyword_count')} AS optimization_score FROM ml1)"
    )


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def suggestion_ctes(key: str, year: int = 2026) -> str:
    """CTEs ``ts`` (title suggestions) and ``ds`` (description suggestions); need CTE ``top``."""
    from sitelens.operators.content import DESCRIPTION_TEMPLATES, TITLE_TEMPLATES

    def fill(tpl: str, slots: dict[str, str]) -> str:
        parts = tpl.replace("{year}", str(year)).split("{")
        out = [q(parts[0])]
        for p in parts[1:]:
            slot, rest = p.split("}", 1)
            out += [slots[slot], q(rest)]
        return "concat(" + ", ".join(out) + ")"

    k0, k1 = "top3[1]", "top3[2]"
    tslots = {"0": cap(k0), "1": f"coalesce({cap(k1)}, 'Business')"}
    tsel = " UNION ALL ".join(
        f"SELECT {key}, {fill(t, tslots)} AS text, CAST({s!r} AS DOUBLE) AS score, {q(why)} AS reasoning FROM top WHERE len(top3) > 0"
        for t, s, why in TITLE_TEMPLATES
    )
    d0, d1, d2 = "top5[1]", "coalesce(top5[2], top5[1])", "coalesce(top5[3], 'proven')"
    dsel = []
    for i, (t, s, trig, cta) in enumerate(DESCRIPTION_TEMPLATES):
        slots = {"0": d0, "1": cap(d1) if i == 2 else d1, "2": d2}
        trig_s = "[" + ", ".join(q(x) for x in trig) + "]"
        dsel.append(
            f"SELECT {key}, {fill(t, slots)} AS text, CAST({s!r} AS DOUBLE) AS score, {trig_s} AS emotional_triggers, "
            f"{'true' if cta else 'false'} AS cta_included FROM top WHERE len(top5) > 0"
        )
    return (
        f"ts0 AS ({tsel}), "
        f"ts AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC) AS INTEGER) AS suggestion_rank, "
        "text, score, reasoning FROM ts0 WHERE strlen(text) <= 60), "
        f"ds0 AS ({' UNION ALL '.join(dsel)}), "
        f"ds AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC) AS INTEGER) AS suggestion_rank, "
        "text, score, emotional_triggers, cta_included FROM ds0 WHERE strlen(text) <= 160)"
    )


def advice_ctes(an: str, key: str) -> str:
    """CTEs ``trd`` (schema trends), ``trr`` (trend advice), ``aur`` (audit rules), ``rec`` (ranked)."""
    from sitelens.operators.score import PRIORITY_RANK
    from sitelens.operators.trends import TREND_ADVICE

    adv = values([(i, *a) for i, a in enumerate(TREND_ADVICE)], ["seq", "schema_type", "category", "priority", "message", "action"])
    rules = [
        ("NOT has_title", 10, "Title", "Critical", "'Missing title tag'", "Add a descriptive title tag (50-60 characters)"),
        ("has_title AND strlen(title) < 30", 11, "Title", "Medium", "'Title too short'", "Expand title to 50-60 characters for better CTR"),
        ("has_title AND strlen(title) > 60", 12, "Title", "Medium", "'Title too long'", "Shorten title to 60 characters to avoid truncation"),
        ("NOT has_description", 13, "Description", "Critical", "'Missing meta description'", "Add a compelling meta description (150-160 characters)"),
        ("NOT has_schema", 14, "Schema", "High", "'Missing Schema.org structured data'", "Add JSON-LD schema for rich snippets in search results"),
        ("NOT has_og_tags", 15, "Social", "High", "'Missing Open Graph tags'", "Add OG tags for better social media sharing"),
        ("NOT has_twitter_cards", 16, "Social", "Medium", "'Missing Twitter Cards'", "Add Twitter Card meta tags for better Twitter previews"),
        ("h1_count = 0", 17, "Technical", "High", "'Missing H1 heading'", "Add exactly one H1 heading per page"),
        ("h1_count > 1", 18, "Technical", "Medium", "'Multiple H1 headings (' || CAST(h1_count AS VARCHAR) || ')'", "Use only one H1 heading per page"),
        ("img_without_alt > 0", 19, "Technical", "Medium", "CAST(img_without_alt AS VARCHAR) || ' images missing alt text'", "Add descriptive alt text to all images"),
    ]
    aur = " UNION ALL ".join(
        f"SELECT {key}, {seq} AS seq, {q(cat)} AS category, {q(pr)} AS priority, {msg} AS message, {q(act)} AS action "
        f"FROM {an} WHERE {cond}"
        for cond, seq, cat, pr, msg, act in rules
    )
    prio = "CASE priority " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in PRIORITY_RANK.items()) + " END"
    return (
        f"trd AS (SELECT a.{key}, t.trend_ord, t.schema_type, t.trend_score, t.has_rich_snippets, t.description, "
        f"'Add ' || t.schema_type || ' schema to your page' AS action FROM {an} a JOIN {trends_table()} t USING (business_type)), "
        f"trr AS (SELECT t.{key}, v.seq, v.category, v.priority, v.message, v.action FROM trd t JOIN {adv} v USING (schema_type)), "
        f"aur AS ({aur}), "
        f"rec AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {prio} DESC, seq) AS INTEGER) AS rec_rank, "
        "category, priority, message, action FROM (SELECT * FROM trr UNION ALL SELECT * FROM aur))"
    )


def page_ml_with(rich: bool = True) -> str:
    """WITH-prefix defining ``pa``/``kw`` plus page-grain ``ml``, ``ts``/``ds`` and advice CTEs."""
    return (
        f"WITH {analysis_ctes(rich)}, {ml_ctes('pa', 'kw', 'page_id', ['rank'])}, {suggestion_ctes('page_id')}, "
        f"{advice_ctes('pa', 'page_id')}"
    )


def site_ml_with(rich: bool = True) -> str:
    return (
        f"WITH {analysis_ctes(rich)}, {site_analysis_ctes()}, {ml_ctes('sa', 'sk', 'site', ['first_page_id', 'first_rank'])}, "
        f"{suggestion_ctes('site')}, {advice_ctes('sa', 'site')}"
    )


def flat(cols: list[str], arrays: list[str]) -> str:
    """Select list with array columns joined by ', ' (what the Spark twins do)."""
    return ", ".join(f"array_to_string({c}, ', ') AS {c}" if c in arrays else c for c in cols)


# --- generation and injection --------------------------------------------------------


def config_cte(src: str = "base") -> str:
    from sitelens.sources.config import DEFAULT_LOCALE

    n = "length(site)"
    return (
        f"cfg AS (SELECT site, site AS site_name, 'https://' || site AS site_url, "
        f"CASE WHEN {n} % 2 = 0 THEN 'https://' || site || '/og.png' END AS default_image, "
        f"CASE WHEN {n} % 3 = 0 THEN 'acme' WHEN {n} % 3 = 1 THEN '@acme' END AS twitter_handle, "
        f"CASE WHEN {n} % 4 = 0 THEN '1234567890' END AS facebook_app_id, "
        f"CASE WHEN {n} % 5 < 2 THEN 'info@' || site END AS contact_email, "
        f"CASE WHEN {n} % 5 = 0 THEN '+1-555-0100' END AS phone, "
        f"CASE WHEN {n} % 3 = 0 THEN {{'street': '1 Main St', 'city': 'Springfield', 'state': 'IL', 'postal_code': '62701', "
        "'country': 'US'} END AS address, "
        f"CASE WHEN {n} % 11 = 0 THEN 'Official ' || site || ' home page with everything you need in one place' END AS title_override, "
        f"CASE WHEN {n} % 13 = 0 THEN 'All about ' || site || ': <news> & \"notes\" for readers' END AS description_override, "
        f"CASE WHEN {n} % 4 = 1 THEN ['seo', 'seo', 'web'] WHEN {n} % 4 = 2 THEN ['web', 'seo', 'web'] ELSE []::VARCHAR[] END AS extra_keywords, "
        f"CASE WHEN {n} % 7 = 0 THEN 'fr_FR' ELSE {q(DEFAULT_LOCALE)} END AS locale, "
        f"{n} % 6 <> 0 AS generate_canonical, 160 AS max_description_length, 60 AS max_title_length "
        f"FROM (SELECT DISTINCT site FROM {src}))"
    )


def trunc(x: str, n: str) -> str:
    cut = f"left({x}, {n})"
    backed = f"CASE WHEN instr({cut}, ' ') > 0 THEN regexp_replace({cut}, ' [^ ]*$', '') ELSE {cut} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN strlen({x}) <= {n} THEN {x} ELSE {backed} || '...' END)"


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def generation_ctes(an: str, key: str, exprs_only: bool = False):
    """CTEs ``gi`` (generation input) and ``gen`` (the four blocks); need ``top`` and ``cfg``.

    With ``exprs_only`` the column expressions over ``gi`` are returned by name instead.
    """
    from sitelens.operators.generate import CHARSET_LINE, CONTEXT, ROBOTS_LINE, VIEWPORT_LINE

    top3, top5 = "list_slice(top10, 1, 3)", "list_slice(top10, 1, 5)"
    title = trunc(
        f"coalesce(title_override, CASE WHEN title <> '' THEN title END, CASE WHEN len({top3}) > 0 THEN "
        f"array_to_string(list_transform({top3}, lambda k: {cap('k')}), ' - ') || ' | ' || site_name ELSE site_name END)",
        "max_title_length",
    )
    desc = trunc(
        f"coalesce(description_override, CASE WHEN description <> '' THEN description END, content_summary, "
        f"site_name || ' offers ' || array_to_string({top5}, ', ') || '. Professional solutions for your needs.')",
        "max_description_length",
    )
    kwl = "list_concat(coalesce(top10, []::VARCHAR[]), coalesce(extra_keywords, []::VARCHAR[]))"
    kws = f"array_to_string(list_filter({kwl}, lambda x, i: i = 1 OR x <> {kwl}[i - 1]), ', ')"
    meta = (
        f"concat_ws(chr(10), '    <title>' || {html_escape(title)} || '</title>', "
        f"CASE WHEN NOT has_description THEN '    <meta name=\"description\" content=\"' || {html_escape(desc)} || '\">' END, "
        f"CASE WHEN {kws} <> '' THEN '    <meta name=\"keywords\" content=\"' || {html_escape(kws)} || '\">' END, "
        f"CASE WHEN generate_canonical AND NOT has_canonical THEN '    <link rel=\"canonical\" href=\"' || {html_escape('site_url')} || '\">' END, "
        f"CASE WHEN NOT has_viewport THEN {q(VIEWPORT_LINE)} END, CASE WHEN NOT has_charset THEN {q(CHARSET_LINE)} END, {q(ROBOTS_LINE)})"
    )
    s_title = "coalesce(title_override, title, site_name)"
    s_desc = f"coalesce(description_override, description, content_summary, site_name || ' - ' || array_to_string({top5}, ', '))"
    ogt = "CASE business_type WHEN 'Blog' THEN 'article' WHEN 'Ecommerce' THEN 'product' WHEN 'Restaurant' THEN 'restaurant' ELSE 'website' END"
    og = (
        "CASE WHEN has_og_tags THEN '' ELSE concat_ws(chr(10), "
        f"'    <meta property=\"og:type\" content=\"' || {ogt} || '\">', "
        f"'    <meta property=\"og:title\" content=\"' || {html_escape(s_title)} || '\">', "
        f"'    <meta property=\"og:description\" content=\"' || {html_escape(trunc(s_desc, '200'))} || '\">', "
        f"'    <meta property=\"og:url\" content=\"' || {html_escape('site_url')} || '\">', "
        f"'    <meta property=\"og:site_name\" content=\"' || {html_escape('site_name')} || '\">', "
        "'    <meta property=\"og:locale\" content=\"' || locale || '\">', "
        f"CASE WHEN default_image IS NOT NULL THEN '    <meta property=\"og:image\" content=\"' || {html_escape('default_image')} || '\">' END, "
        "CASE WHEN default_image IS NOT NULL THEN '    <meta property=\"og:image:width\" content=\"1200\">' END, "
        "CASE WHEN default_image IS NOT NULL THEN '    <meta property=\"og:image:height\" content=\"630\">' END, "
        f"CASE WHEN facebook_app_id IS NOT NULL THEN '    <meta property=\"fb:app_id\" content=\"' || {html_escape('facebook_app_id')} || '\">' END) END"
    )
    handle = "CASE WHEN starts_with(twitter_handle, '@') THEN twitter_handle ELSE '@' || twitter_handle END"
    tw = (
        "CASE WHEN has_twitter_cards THEN '' ELSE concat_ws(chr(10), "
        "'    <meta name=\"twitter:card\" content=\"' || CASE WHEN default_image IS NOT NULL THEN 'summary_large_image' ELSE 'summary' END || '\">', "
        f"'    <meta name=\"twitter:title\" content=\"' || {html_escape(trunc(s_title, '70'))} || '\">', "
        f"'    <meta name=\"twitter:description\" content=\"' || {html_escape(trunc(s_desc, '200'))} || '\">', "
        f"CASE WHEN twitter_handle IS NOT NULL THEN '    <meta name=\"twitter:site\" content=\"' || {html_escape(handle)} || '\">' END, "
        f"CASE WHEN twitter_handle IS NOT NULL THEN '    <meta name=\"twitter:creator\" content=\"' || {html_escape(handle)} || '\">' END, "
        f"CASE WHEN default_image IS NOT NULL THEN '    <meta name=\"twitter:image\" content=\"' || {html_escape('default_image')} || '\">' END, "
        f"CASE WHEN default_image IS NOT NULL THEN '    <meta name=\"twitter:image:alt\" content=\"' || {html_escape(s_title)} || '\">' END) END"
    )
    ctx = f'"@context":"{CONTEXT}"'
    addr = (
        "CASE WHEN address IS NOT NULL THEN '{\"@type\":\"PostalAddress\",\"addressCountry\":' || "
        f"{js('address.country')} || ',\"addressLocality\":' || {js('address.city')} || ',\"addressRegion\":' || {js('address.state')} || "
        f"',\"postalCode\":' || {js('address.postal_code')} || ',\"streetAddress\":' || {js('address.street')} || '}}' END"
    )
    org = (
        f"'{{{ctx},\"@type\":' || {js('schema_type')} || coalesce(',\"address\":' || ({addr}), '') || "
        f"coalesce(',\"contactPoint\":{{\"@type\":\"ContactPoint\",\"contactType\":\"customer service\",\"telephone\":' || {js('phone')} || '}}', '') || "
        f"coalesce(',\"description\":' || {js('coalesce(description_override, description, content_summary)')}, '') || "
        f"coalesce(',\"email\":' || {js('contact_email')}, '') || coalesce(',\"image\":' || {js('default_image')}, '') || "
        f"coalesce(',\"logo\":{{\"@type\":\"ImageObject\",\"url\":' || {js('default_image')} || '}}', '') || "
        f"',\"name\":' || {js('site_name')} || ',\"sameAs\":[]' || coalesce(',\"telephone\":' || {js('phone')}, '') || "
        f"',\"url\":' || {js('site_url')} || '}}'"
    )
    website = (
        f"'{{{ctx},\"@type\":\"WebSite\",\"name\":' || {js('site_name')} || ',\"potentialAction\":{{\"@type\":\"SearchAction\","
        "\"query-input\":\"required name=search_term_string\",\"target\":{\"@type\":\"EntryPoint\",\"urlTemplate\":' || "
        f"{js(chr(39) + '' + chr(39) + ' || site_url || ' + q('/search?q={search_term_string}'))} || '}}}},\"url\":' || {js('site_url')} || '}}'"
    )
    crumb = (
        f"'{{{ctx},\"@type\":\"BreadcrumbList\",\"itemListElement\":[{{\"@type\":\"ListItem\",\"item\":' || {js('site_url')} || "
        "',\"name\":\"Home\",\"position\":1}]}'"
    )
    services = f"list_transform({top5}, lambda k: {cap('k')})"
    service = (
        f"'{{{ctx},\"@type\":\"ProfessionalService\",\"areaServed\":{{\"@type\":\"Country\",\"name\":\"United States\"}},"
        "\"hasOfferCatalog\":{\"@type\":\"OfferCatalog\",\"itemListElement\":[' || "
        f"array_to_string(list_transform({services}, lambda s: '{{\"@type\":\"Offer\",\"itemOffered\":{{\"@type\":\"Service\",\"name\":' || {js('s')} || '}}}}'), ',') || "
        f"'],\"name\":\"Services\"}},\"name\":' || {js('site_name')} || ',\"serviceType\":[' || "
        f"array_to_string(list_transform({services}, lambda s: {js('s')}), ',') || '],\"url\":' || {js('site_url')} || '}}'"
    )
    saas = (
        f"'{{{ctx},\"@type\":\"SoftwareApplication\",\"applicationCategory\":\"BusinessApplication\",\"name\":' || {js('site_name')} || "
        "',\"offers\":{\"@type\":\"Offer\",\"price\":\"0\",\"priceCurrency\":\"USD\"},\"operatingSystem\":\"Web\",\"url\":' || "
        f"{js('site_url')} || '}}'"
    )
    local = (
        f"'{{{ctx},\"@type\":' || CASE WHEN business_type = 'Restaurant' THEN '\"Restaurant\"' ELSE '\"LocalBusiness\"' END || "
        f"coalesce(',\"address\":' || ({addr}), '') || ',\"name\":' || {js('site_name')} || "
        f"coalesce(',\"telephone\":' || {js('phone')}, '') || ',\"url\":' || {js('site_url')} || '}}'"
    )
    blog = f"'{{{ctx},\"@type\":\"Blog\",\"blogPost\":[],\"name\":' || {js('site_name')} || ',\"url\":' || {js('site_url')} || '}}'"
    business = (
        f"CASE WHEN business_type IN ('Service', 'Technology') THEN {service} WHEN business_type = 'SaaS' THEN {saas} "
        f"WHEN business_type IN ('LocalBusiness', 'Restaurant') THEN {local} WHEN business_type = 'Blog' THEN {blog} END"
    )
    low = "lower(coalesce(raw_text, ''))"
    faq = (
        f"CASE WHEN raw_text IS NOT NULL AND (contains({low}, 'faq') OR contains({low}, 'frequently asked') OR contains({low}, 'questions')) "
        f"THEN '{{{ctx},\"@type\":\"FAQPage\",\"mainEntity\":[]}}' END"
    )
    graph = (
        f"replace('{{{ctx},\"@graph\":[' || array_to_string(list_filter([{org}, {website}, {crumb}, {business}, {faq}], "
        "lambda x: x IS NOT NULL), ',') || ']}', '</', '<\\/')"
    )
    schema = f"CASE WHEN has_schema THEN '' ELSE '    <script type=\"application/ld+json\">' || chr(10) || '    ' || {graph} || chr(10) || '    </script>' END"
    nl = "chr(10)"
    if exprs_only:
        return dict(
            generate_title=title, generate_description=desc, generate_keywords=kws, og_type=ogt,
            organization_schema=org, website_schema=website, breadcrumb_schema=crumb,
            business_schema=business, faq_schema=faq, json_ld_graph=graph,
        )
    return (
        f"gi AS (SELECT a.*, coalesce(tp.top10, []::VARCHAR[]) AS top10, cfg.* EXCLUDE (site) FROM {an} a "
        f"LEFT JOIN top tp ON tp.{key} = a.{key} LEFT JOIN cfg ON cfg.site = a.site), "
        f"gen0 AS (SELECT {key}, {meta} AS meta_tags, {og} AS open_graph, {tw} AS twitter_cards, {schema} AS schema_org FROM gi), "
        f"gen AS (SELECT *, '<!-- SEO Meta Tags -->' || {nl} || meta_tags || {nl} || {nl} || '<!-- Open Graph -->' || {nl} || open_graph || "
        f"{nl} || {nl} || '<!-- Twitter Cards -->' || {nl} || twitter_cards || {nl} || {nl} || '<!-- Schema.org -->' || {nl} || schema_org AS combined, "
        "(meta_tags = '' AND open_graph = '' AND twitter_cards = '' AND schema_org = '') AS is_empty FROM gen0)"
    )


def inject_expr(h: str, meta: str, og: str, tw: str, schema: str) -> str:
    stripped = (
        f"CASE WHEN {rlike(h, P.STRIP_TITLE_PRESENT)} THEN regexp_extract({h}, {q(P.STRIP_TITLE)}, 1) || "
        f"regexp_extract({h}, {q(P.STRIP_TITLE)}, 2) ELSE {h} END"
    )

    def part(x: str, g: int) -> str:
        return (
            f"CASE WHEN {rlike(x, P.HEAD_END_PRESENT)} THEN regexp_extract({x}, {q(P.HEAD_POINT)}, {g}) "
            f"WHEN {rlike(x, P.BODY_PRESENT)} THEN regexp_extract({x}, {q(P.BODY_POINT)}, {g}) END"
        )

    wrap = lambda b: f"CASE WHEN {b} <> '' THEN chr(10) || {b} || chr(10) ELSE '' END"
    has = f"({rlike(h, P.HEAD_END_PRESENT)} OR {rlike(h, P.BODY_PRESENT)})"
    body = f"{part(stripped, 1)} || chr(10) || {meta} || chr(10) || {wrap(og)} || {wrap(tw)} || {wrap(schema)} || {part(stripped, 2)}"
    return f"CASE WHEN {has} THEN {body} ELSE {h} END", f"CASE WHEN {has} THEN 'ok' ELSE 'no_injection_point' END"


def page_gen_with(rich: bool = True) -> str:
    return f"{page_ml_with(rich)}, {config_cte()}, {generation_ctes('pa', 'page_id')}"


def page_injected(rich: bool = True) -> str:
    html, status = inject_expr("s.html", "g.meta_tags", "g.open_graph", "g.twitter_cards", "g.schema_org")
    return f"{page_gen_with(rich)} SELECT g.page_id, {html} AS html, {status} AS status FROM gen g JOIN src s USING (page_id)"


def gen_expr_query(name: str, rich: bool = True) -> str:
    e = generation_ctes("pa", "page_id", exprs_only=True)[name]
    return f"{page_gen_with(rich)} SELECT page_id, {e} AS {name} FROM gi"


def page_pieces(rich: bool = True) -> str:
    """CTE prefix with ``src`` + ``gen`` joined as ``pj`` (page_id, html, blocks)."""
    return f"{page_gen_with(rich)}, pj AS (SELECT g.*, s.html FROM gen g JOIN src s USING (page_id))"


def injection_point_q(rich: bool = True) -> str:
    before = (
        f"CASE WHEN {rlike('html', P.HEAD_END_PRESENT)} THEN regexp_extract(html, {q(P.HEAD_POINT)}, 1) "
        f"WHEN {rlike('html', P.BODY_PRESENT)} THEN regexp_extract(html, {q(P.BODY_POINT)}, 1) END"
    )
    return f"WITH {base_ctes(rich)} SELECT page_id, CAST(length({before}) AS INTEGER) AS injection_point FROM src"


def strip_title_q(rich: bool = True) -> str:
    e = (
        f"CASE WHEN {rlike('html', P.STRIP_TITLE_PRESENT)} THEN regexp_extract(html, {q(P.STRIP_TITLE)}, 1) || "
        f"regexp_extract(html, {q(P.STRIP_TITLE)}, 2) ELSE html END"
    )
    return f"WITH {base_ctes(rich)} SELECT page_id, {e} AS html FROM src"


def inject_meta_q(rich: bool = True) -> str:
    html, _ = inject_expr("html", "meta_tags", "''", "''", "''")
    return f"{page_pieces(rich)} SELECT page_id, {html} AS html FROM pj"


def audit_lift(rich: bool = True) -> str:
    html, status = inject_expr("s.html", "g.meta_tags", "g.open_graph", "g.twitter_cards", "g.schema_org")
    after = f"{page_gen_with(rich)}, inj AS (SELECT g.page_id, {html} AS html FROM gen g JOIN src s USING (page_id))"
    b2 = base_ctes(src_sql="SELECT i.page_id, s.url, i.html FROM inj i JOIN src s USING (page_id)", sfx="_a")
    return (
        f"{after}, {b2} SELECT b.page_id, {completeness('b.')} AS completeness_before, {completeness('a.')} AS completeness_after, "
        "b.has_description AS has_description_before, a.has_description AS has_description_after, "
        "b.has_og_tags AS has_og_tags_before, a.has_og_tags AS has_og_tags_after, "
        "b.has_twitter_cards AS has_twitter_cards_before, a.has_twitter_cards AS has_twitter_cards_after, "
        "b.has_schema AS has_schema_before, a.has_schema AS has_schema_after "
        "FROM base b JOIN base_a a USING (page_id)"
    )


# --- files, frameworks, reports ----------------------------------------------------------


def files_ctes(src: str = "src") -> str:
    from sitelens.fixtures import _MARKER_SETS
    from sitelens.sources.files import INJECTION_TARGETS, NEXT_MARKERS, PACKAGE_JSON, VITE_MARKERS

    mk = values([(m, p, c) for m, fs in _MARKER_SETS.items() for p, c in fs], ["m", "path", "content"])
    tg = values(INJECTION_TARGETS, ["framework", "injection_target"])
    pkg = f"path = {q(PACKAGE_JSON)}"
    return (
        f"sites AS (SELECT DISTINCT {site_key('url')} AS site FROM {src}), "
        f"files AS (SELECT {site_key('url')} AS site, regexp_replace({url_path('url')}, '^/', '') AS path, '' AS content FROM {src} "
        f"UNION ALL SELECT s.site, m.path, m.content FROM sites s JOIN {mk} m ON m.m = length(s.site) % 8), "
        f"fwd AS (SELECT site, bool_or(path IN {_in_list(NEXT_MARKERS)}) AS nxt, bool_or(path IN {_in_list(VITE_MARKERS)}) AS vite, "
        f"bool_or({pkg}) AS pkg, bool_or({pkg} AND contains(content, '\"react\"')) AS react, "
        f"bool_or({pkg} AND contains(content, '\"vue\"')) AS vue, bool_or({pkg} AND contains(content, '\"svelte\"')) AS svelte "
        "FROM files GROUP BY site), "
        "fw AS (SELECT site, CASE WHEN nxt THEN 'NextJs' WHEN vite THEN 'Vite' WHEN pkg AND react THEN 'React' "
        "WHEN pkg AND vue THEN 'Vue' WHEN pkg AND svelte THEN 'Svelte' WHEN pkg THEN 'Unknown' ELSE 'VanillaHtml' END AS framework FROM fwd), "
        f"fwt AS (SELECT fw.site, fw.framework, t.injection_target FROM fw LEFT JOIN {tg} t USING (framework))"
    )


def site_files_q() -> str:
    return f"WITH src AS (SELECT page_id, url, html FROM pages), {files_ctes()} SELECT site, path, content FROM files"


def detect_framework_q() -> str:
    return f"WITH src AS (SELECT page_id, url, html FROM pages), {files_ctes()} SELECT * FROM fwt"


def two_dec(x: str) -> str:
    return f"printf('%.2f', round_even({x}, 2))"


def report_ctes(rich: bool = True) -> str:
    from sitelens.operators.reports import PRIORITY_LABELS

    label = "CASE priority " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PRIORITY_LABELS.items()) + " END"
    nl = "chr(10)"
    return (
        f"{site_ml_with(rich)}, {files_ctes()}, "
        f"mp AS (SELECT site, arg_min(page_id, (NOT is_index, page_id)) AS main_page_id FROM (SELECT page_id, {site_key('url')} AS site, "
        f"regexp_matches({url_path('url')}, {q(INDEX_PATH_RE)}) AS is_index FROM src) GROUP BY site), "
        "tk AS (SELECT * FROM (SELECT site, word, frequency, score, is_phrase, row_number() OVER (PARTITION BY site ORDER BY score DESC, "
        "first_page_id, first_rank) AS top_rank FROM sk) WHERE top_rank <= 10), "
        f"kwp AS (SELECT site, string_agg(top_rank || '. ' || word || ' (score: ' || {two_dec('score')} || ')' || {nl}, '' ORDER BY top_rank) AS keywords_md, "
        f"string_agg(word || ' (freq: ' || frequency || ', score: ' || {two_dec('score')} || ')', '; ' ORDER BY top_rank) AS keywords_line "
        "FROM tk GROUP BY site), "
        f"recp AS (SELECT site, string_agg('### ' || {label} || ' - ' || message || {nl} || '**Action**: ' || action || {nl} || {nl}, '' "
        "ORDER BY rec_rank) AS recs_md, string_agg(message, ' | ' ORDER BY rec_rank) AS rec_messages FROM rec GROUP BY site), "
        "trp AS (SELECT site, string_agg(schema_type || ' (score: ' || printf('%.0f', trend_score * 100) || '%)', '; ' ORDER BY n) AS trends_line "
        "FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY trend_ord) AS n FROM trd) WHERE n <= 5 GROUP BY site), "
        "ttp AS (SELECT site, string_agg(text, ' | ' ORDER BY suggestion_rank) AS titles_line FROM ts WHERE suggestion_rank <= 3 GROUP BY site), "
        "rr AS (SELECT sa.*, ml.optimization_score, ml.sentiment_score, ml.sentiment_label, ml.power_words, recp.recs_md, recp.rec_messages, "
        "kwp.keywords_md, kwp.keywords_line, fwt.framework, mp.main_page_id, trp.trends_line, ttp.titles_line FROM sa "
        "LEFT JOIN ml USING (site) LEFT JOIN recp USING (site) LEFT JOIN kwp USING (site) LEFT JOIN fwt USING (site) "
        "LEFT JOIN mp USING (site) LEFT JOIN trp USING (site) LEFT JOIN ttp USING (site))"
    )


def site_report_q(stamp: str, rich: bool = True) -> str:
    from sitelens.operators.reports import AUDIT_ROWS, CHECK, CROSS

    nl = "chr(10)"
    audit = " || ".join(f"'| {lab} | ' || CASE WHEN {flag} THEN {q(CHECK)} ELSE {q(CROSS)} END || ' |' || {nl}" for lab, flag in AUDIT_ROWS)
    md = (
        f"'# SEO Analysis Report' || {nl} || {nl} || {q('Generated: ' + stamp)} || {nl} || {nl} || '## Overview' || {nl} || {nl} || "
        f"'- **Framework**: ' || framework || {nl} || '- **Business Type**: ' || business_type || {nl} || "
        f"'- **HTML Files**: ' || page_count || {nl} || '- **SEO Score**: ' || completeness_score || '/100' || {nl} || "
        f"'- **Optimization Score**: ' || optimization_score || '/100' || {nl} || {nl} || '## SEO Audit' || {nl} || {nl} || "
        f"'| Element | Status |' || {nl} || '|---------|--------|' || {nl} || {audit} || "
        f"{nl} || '## Recommendations' || {nl} || {nl} || coalesce(recs_md, '') || '## Top Keywords' || {nl} || {nl} || coalesce(keywords_md, '')"
    )
    return f"WITH {report_ctes(rich)[5:] if report_ctes(rich).startswith('WITH ') else report_ctes(rich)} SELECT site, {md} AS report_md FROM rr"


def document_q(prefix: str, more: str, rich: bool) -> str:
    """``site, path, value, number`` of the site documents, straight from the tables."""
    import re

    from sitelens.plans.report import DOCUMENT_PATHS, NUMBER_PATHS

    def entry(path: str, column: str) -> str:
        number = re.search(NUMBER_PATHS, path)
        value, num = ("NULL", f"CAST({column} AS DOUBLE)") if number else (f"CAST({column} AS VARCHAR)", "NULL::DOUBLE")
        return f"{{'path': {q(path)}, 'value': {value}, 'number': {num}}}"

    body = report_ctes(rich)
    body = body[5:] if body.startswith("WITH ") else body
    scalars = ", ".join(entry(prefix + p, c) for p, c in DOCUMENT_PATHS.items()) + more
    at = f"{q(prefix + 'merged.keywords[')} || (top_rank - 1) || "
    words = ", ".join(
        f"{{'path': {at}{q('].' + f)}, 'value': {'CAST(' + f + ' AS VARCHAR)' if text else 'NULL'}, "
        f"'number': {'NULL::DOUBLE' if text else 'CAST(' + f + ' AS DOUBLE)'}}}"
        for f, text in (("word", True), ("frequency", False), ("score", False), ("is_phrase", True))
    )
    return (
        f"WITH {body}, dv AS (SELECT site, unnest([{scalars}]) AS v FROM rr UNION ALL SELECT site, unnest([{words}]) AS v FROM tk) "
        "SELECT site, v.path AS path, v.value AS value, v.number AS number FROM dv WHERE v.value IS NOT NULL OR v.number IS NOT NULL"
    )


def analysis_json_q(rich: bool = True) -> str:
    return document_q("", "", rich)


def run_summary_q(output_dir: str, rich: bool = True) -> str:
    more = (
        f", {{'path': 'output_file', 'value': {q(output_dir + '/')} || site || '/index.html', 'number': NULL::DOUBLE}}"
        ", {'path': 'optimization_score', 'value': NULL, 'number': CAST(optimization_score AS DOUBLE)}"
    )
    return document_q("analysis.", more, rich)


def analysis_summary_q(rich: bool = True) -> str:
    from sitelens.operators.reports import SUMMARY_CHECKS

    body = report_ctes(rich)
    body = body[5:] if body.startswith("WITH ") else body
    return (
        f"WITH {body} SELECT site, framework, main_page_id, page_count, business_type, language, "
        f"{two_dec('sentiment_score')} || ' (' || sentiment_label || ')' AS sentiment, "
        f"array_to_string(coalesce(power_words, []::VARCHAR[]), ', ') AS power_words, coalesce(keywords_line, '') AS top_keywords, "
        f"{', '.join(SUMMARY_CHECKS)}, completeness_score AS seo_score, optimization_score, "
        "coalesce(trends_line, '') AS trending_schemas, coalesce(rec_messages, '') AS recommendations, "
        "coalesce(titles_line, '') AS title_suggestions FROM rr"
    )


def site_main_injected_q(rich: bool = True) -> str:
    html, status = inject_expr("s.html", "g.meta_tags", "g.open_graph", "g.twitter_cards", "g.schema_org")
    return (
        f"{site_ml_with(rich)}, {config_cte('sa')}, {generation_ctes('sa', 'site')}, "
        f"mp AS (SELECT site, arg_min(page_id, (NOT is_index, page_id)) AS page_id FROM (SELECT page_id, {site_key('url')} AS site, "
        f"regexp_matches({url_path('url')}, {q(INDEX_PATH_RE)}) AS is_index FROM src) GROUP BY site) "
        f"SELECT g.site, mp.page_id, {html} AS html, {status} AS status FROM gen g JOIN mp USING (site) JOIN src s ON s.page_id = mp.page_id"
    )


def inject_block_q(rich: bool = True) -> str:
    def part(x: str, g: int) -> str:
        return (
            f"CASE WHEN {rlike(x, P.HEAD_END_PRESENT)} THEN regexp_extract({x}, {q(P.HEAD_POINT)}, {g}) "
            f"WHEN {rlike(x, P.BODY_PRESENT)} THEN regexp_extract({x}, {q(P.BODY_POINT)}, {g}) END"
        )

    has = f"({rlike('html', P.HEAD_END_PRESENT)} OR {rlike('html', P.BODY_PRESENT)})"
    e = f"CASE WHEN {has} AND open_graph <> '' THEN {part('html', 1)} || chr(10) || open_graph || chr(10) || {part('html', 2)} ELSE html END"
    return f"{page_pieces(rich)} SELECT page_id, {e} AS html FROM pj"

"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from sitelens.llm.quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality() -> str:
    """The counts, the base check and the rules, from unnested words and lines."""
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    bounds = [f"{r.feature} >= {r.low}" for r in RULES if r.low is not None] + [f"{r.feature} <= {r.high}" for r in RULES if r.high is not None]
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0 END"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
    win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    often AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win),
    covered AS (SELECT r, count(DISTINCT i + j) AS n FROM often, (VALUES (0), (1), (2)) AS v(j) WHERE n > 1 GROUP BY r),
    f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS stops,
        len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•‣●]'))) AS bullets,
        len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS ellipses
        FROM w LEFT JOIN covered USING (r)),
    g AS (SELECT *, {share("word_chars", "n_words")} AS mean_word_chars, {share("n_symbols", "n_words")} AS symbols_per_word,
        {share("stops", "n_words")} AS stop_word_share, {share("n_dup_lines", "n_lines")} AS dup_line_share,
        {share("ellipses", "n_lines")} AS ellipsis_line_share, {share("bullets", "n_lines")} AS bullet_line_share,
        (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        (NOT base_failed AND {" AND ".join(bounds)}) AS kept FROM g
    """


def jaccard() -> str:
    """Shingle sets joined shingle by shingle; classes by transitive closure."""
    shingle = " || ' ' || ".join(f"words[i + {k}]" if k else "words[i]" for k in range(5))
    return f"""
    WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS d, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
    s AS (SELECT DISTINCT d, x FROM (SELECT d, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: {shingle})
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS x FROM w)),
    n AS (SELECT d, count(*) AS n FROM s GROUP BY d),
    p AS (SELECT a.d AS a, b.d AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.d <> b.d GROUP BY a.d, b.d),
    links AS (SELECT a, b FROM p JOIN n x ON x.d = a JOIN n y ON y.d = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (SELECT d AS a, d AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT w.d AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id FROM w LEFT JOIN n ON n.d = w.d JOIN least ON least.a = w.d
    """


def warc() -> str:
    """What the archives must hold, from the pages themselves."""
    return """
    WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS least FROM p),
    t AS (SELECT *, (payload_bytes >= 100 AND least <> page_id) AS again FROM q)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN again THEN least END AS refers_to FROM t
    """


def trie() -> str:
    """Every prefix of every rebuilt conversation, grouped; subtrees by each node's prefixes."""
    bits = ", ".join(["xor(a, b)"] + ["0"] * 8)
    crc = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(unicode(y) AS BIGINT))),
        lambda a, b: list_reduce([{bits}], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"""
    return f"""
    WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT c, turn, r, sha256(strlen(r) || ':' || r || x) AS tok, len(regexp_extract_all(x, '{WORD}')) AS w FROM t),
    own AS (SELECT c, list({{'tok': tok, 'w': w}} ORDER BY turn NULLS FIRST, r, tok) AS l, {crc} % 4 AS h FROM k GROUP BY c),
    built AS (SELECT own.c, list_concat(list_slice(coalesce(b.l, []), 1, own.h), list_slice(own.l, own.h + 1, len(own.l))) AS l
        FROM own LEFT JOIN own b ON b.c = own.c - own.c % 20),
    pre AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM built),
    mem AS (SELECT c, n, d, array_to_string(list_transform(list_slice(l, 1, d), lambda y: y.tok), '') AS key, CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w FROM pre),
    node AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM mem GROUP BY key, d),
    kid AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
    each AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, CASE WHEN kid.n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved FROM node LEFT JOIN kid USING (key)),
    up AS (SELECT left(key, 64 * a) AS key, leaf, saved FROM (SELECT key, leaf, saved, unnest(range(0, d + 1)) AS a FROM each)),
    sub AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY key)
    SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children,
        CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
    FROM each e JOIN sub USING (key) LEFT JOIN each p ON e.d > 0 AND p.key = left(e.key, 64 * (e.d - 1))
    """

"""Small string functions, as Spark Column expressions (JVM side, no UDFs)."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import patterns as P


def named_values() -> dict[str, str]:
    """What the names of the HTML standard (the standard library's table) stand for with their semicolon."""
    return {name[:-1]: value.replace("\u00a0", " ") for name, value in html5.items() if name.endswith(";")}


def bare_values() -> dict[str, str]:
    """The older names, which also count without a semicolon."""
    return {name: value.replace("\u00a0", " ") for name, value in html5.items() if not name.endswith(";")}


def windows_values() -> dict[int, str]:
    """The numeric references that browsers read as Windows-1252."""
    return {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


# HTML escaping of generated attribute values, in this order.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


_CACHE: dict = {}


def _cache():
    """Per-SparkContext memo: Columns are immutable expression trees, so one
    reference or literal object can appear in any number of expressions.
    Building them once saves JVM round trips while plans are assembled."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = id(sc)
    if _CACHE.get("sc") != key:
        _CACHE.clear()
        _CACHE["sc"] = key
    return _CACHE


def col(name: str) -> Column:
    cache = _cache()
    k = ("col", name)
    if k not in cache:
        cache[k] = F.col(name)
    return cache[k]


def lit(value) -> Column:
    try:
        k = ("lit", type(value).__name__, value)
        hash(k)
    except TypeError:
        return F.lit(value)
    cache = _cache()
    if k not in cache:
        cache[k] = F.lit(value)
    return cache[k]


def memo(key, factory) -> Column:
    """Memoized Column for any hashable ``key`` (built by ``factory`` once per SparkContext)."""
    cache = _cache()
    if key not in cache:
        cache[key] = factory()
    return cache[key]


def col_of(c) -> Column:
    return col(c) if isinstance(c, str) else c


def _map(values: dict, name: Column) -> Column:
    return F.try_element_at(F.from_json(lit(json.dumps(values)), "map<string,string>"), name)


def _listed(values: dict, name: Column) -> Column:
    """Looks a seldom asked name up in one string literal, which costs a plan far less than a map of that size."""
    table = lit("\x01" + "".join(f"{k}\x02{v}\x01" for k, v in values.items()))
    key = F.concat(lit("\x01"), name, lit("\x02"))
    value = F.substring_index(F.call_function("substring_index", table, key, lit(-1)), "\x01", 1)
    return F.when(F.contains(table, key), value)


def _named(body: Column) -> Column:
    """The value of a whole name; the 253 names that pages use are asked first."""
    named = named_values()
    common = {name: named[name] for name in [*name2codepoint, "apos"]}
    rare = {name: value for name, value in named.items() if name not in common}
    return F.coalesce(_map(common, body), _listed(rare, body))


def _longest_bare(body: Column) -> Column:
    """A name without semicolon by its longest known prefix, with what follows the prefix."""
    bare = bare_values()
    lengths = sorted({len(name) for name in bare}, reverse=True)
    return F.coalesce(*(F.concat(_listed(bare, F.substring(body, 1, n)), F.substring(body, n + 1, 1 << 30)) for n in lengths))


def _entity(e: Column, attribute: bool) -> Column:
    """What one entity stands for; an unknown name stays as it is."""
    body = F.rtrim(F.substring(e, 2, 1 << 30), lit(";="))
    end = F.substring(e, F.length(body) + 2, lit(1))
    after = F.when(end == lit(";"), lit("")).otherwise(end)
    is_hex, is_code = body.rlike("^#[xX]"), F.startswith(body, lit("#"))
    digits = F.ltrim(F.when(is_hex, F.substring(body, 3, 1 << 30)).otherwise(F.substring(body, 2, 1 << 30)), lit("0"))
    # no code point has more than seven digits
    short = F.when(digits == lit(""), lit("0")).when(F.length(digits) > 7, lit("9999999")).otherwise(digits)
    code = F.when(is_hex, F.conv(short, 16, 10)).otherwise(short).cast("int")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(lit("\ufffd"))
    windows = _map(windows_values(), code.cast("string"))
    whole = F.when(end == lit(";"), _named(body))
    if attribute:
        bare = F.when(end == lit(""), _listed(bare_values(), body))
    else:
        bare = F.concat(_longest_bare(body), end)
    return F.when(is_code, F.concat(F.coalesce(windows, point), after)).otherwise(F.coalesce(whole, bare, e))


def decode_entities(c, attribute: bool = False) -> Column:
    """Named, decimal and hexadecimal entities in one pass, so ``&amp;lt;`` becomes ``&lt;``.

    Names and prefixes are those of the HTML standard: ``&notin;`` is one sign,
    ``&notit;`` is that of ``&not`` with ``it;`` behind it.  In an ``attribute``
    value a name without semicolon counts only if no letter, digit or ``=``
    follows, so links keep their parameters.  A no-break space becomes a space.
    """
    c = col_of(c)
    plain = F.split(c, P.ENTITY)
    values = F.transform(F.regexp_extract_all(c, lit(P.ENTITY), lit(0)), lambda e: _entity(e, attribute))
    joined = F.array_join(F.zip_with(plain, F.concat(values, F.array(lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(c, lit("&")), joined).otherwise(c)


def html_escape(c) -> Column:
    out = col_of(c)
    for ch, ent in ESCAPES:
        out = F.replace(out, lit(ch), lit(ent))
    return out


def trim_ws(c) -> Column:
    """Trim ASCII whitespace at both ends (Spark's trim only removes spaces)."""
    return F.regexp_replace(col_of(c), P.EDGE_WS, "")


def capitalize(c) -> Column:
    """First character upper-cased, the rest unchanged (unlike initcap)."""
    c = col_of(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def truncate_words(c, max_len) -> Column:
    """Keep the text if it fits; else cut, back up to the last space, add '...'.

    The limit counts bytes like the reference; the cut is made on characters so
    a multi-byte character is never split (the reference would panic there).
    """
    c = col_of(c)
    n = F.lit(max_len) if isinstance(max_len, int) else col_of(max_len)
    cut = F.substring(c, 1, n)
    backed = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(c.isNull(), F.lit(None)).when(F.octet_length(c) <= n, c).otherwise(F.concat(backed, F.lit("...")))


def regexp_value(c, pattern: str) -> Column:
    """Concatenate groups 1..3 of an attribute-value pattern (only one participates)."""
    c = col_of(c)
    return F.concat(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3))


def whitespace_words(c) -> Column:
    """Number of whitespace-separated words."""
    t = F.trim(col_of(c), lit(" \t\r\n\f"))
    # split keeps the empty text as one piece
    return F.when(t == lit(""), lit(0)).otherwise(F.size(F.split(t, f"{P.WS}++")))

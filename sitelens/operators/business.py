"""Business type detection and content summary from zone text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import col, lit, trim_ws
from sitelens.operators import dims


def _dispatch() -> dict[str, list[dict]]:
    """For each indicator those that begin it, itself included: where it is the longest match, all of them stand."""
    rows = [{"t": t, "o": o, "i": i} for t, o, i in dims.indicator_rows()]
    return {whole: [r for r in rows if whole.startswith(r["i"])] for whole in sorted({r["i"] for r in rows})}


#: Branches that stand behind one look at the next character.
GROUP = 5


def _one_of(chars) -> str:
    return f"(?=[{''.join(map(re.escape, sorted(chars)))}])"


def _longest(words: list[str]) -> str:
    """A pattern of the longest of the words that begins here, branching at each character.

    Most places of a text begin none, and the engine tries branches in turn: many
    branches stand in groups, each behind the set of its first characters.
    """
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(first) + _longest(rest) for first, rest in tails.items()]
    if len(branches) > GROUP:
        firsts = list(tails)
        runs = range(0, len(firsts), GROUP)
        branches = [f"{_one_of(firsts[n : n + GROUP])}(?:{'|'.join(branches[n : n + GROUP])})" for n in runs]
    end = "?" if "" in words and branches else ""
    return "".join(branches) if len(branches) < 2 and not end else f"(?:{'|'.join(branches)}){end}"


def _may_begin(words: list[str]) -> str:
    """A look at the next three characters that no word fails: three sets, which turn most places of a text away at once."""
    sets = ["".join({w[n] for w in words if len(w) > 2}) for n in range(3)]
    short = [re.escape(w) for w in words if len(w) < 3]
    return f"(?={'|'.join([*short, ''.join('[' + ''.join(map(re.escape, sorted(s))) + ']' for s in sets)])})"


def _found(zone_text: Column) -> Column:
    """The indicators that the text holds: one pass over the text, then a literal map."""
    by_longest = _dispatch()
    words = list(by_longest)
    # looks ahead from every place, so matches may overlap
    longest = F.array_distinct(F.regexp_extract_all(zone_text, lit(f"{_may_begin(words)}(?=({_longest(words)}))"), lit(1)))
    table = F.from_json(lit(json.dumps(by_longest)), "map<string, array<struct<t:string,o:int,i:string>>>")
    return F.array_distinct(F.flatten(F.transform(longest, lambda w: F.element_at(table, w))))


def _scores(zone_text: Column) -> Column:
    """array<struct<business_type, ordinal, score>> of the types with at least one indicator in the text.

    Computed inside the row from the fixed 163 indicators: no join, no group.
    One pass over the text finds which of them it holds; only these are counted.
    """

    def points(x):
        # non-overlapping occurrences, counted by what a global replace removes; indicators are
        # ASCII, and lengths in bytes are known without a pass over the text
        removed = F.octet_length(zone_text) - F.octet_length(F.replace(zone_text, x["i"], lit("")))
        occurrences = (removed / F.octet_length(x["i"])).cast("long")
        return F.struct(x["t"].alias("t"), x["o"].alias("o"), (lit(1) + F.floor((occurrences - 1) / 2)).alias("n"))

    found = F.transform(_found(zone_text), points)

    def per_type(found: Column) -> Column:
        types = F.array_distinct(F.transform(found, lambda h: F.struct(h["t"], h["o"])))
        total = lambda t: F.aggregate(F.filter(found, lambda h: h["o"] == t["o"]), lit(0).cast("long"), lambda n, h: n + h["n"])
        return F.transform(types, lambda t: F.struct(t["t"].alias("business_type"), t["o"].alias("ordinal"), total(t).alias("score")))

    return F.element_at(F.transform(F.array(found), per_type), 1)


def indicator_scores(zones: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, business_type, ordinal, score`` for every type with at least one indicator hit.

    For each indicator found as a substring, add ``1 + (occurrences - 1) div 2``.
    """
    # outer: a plain inline makes Catalyst infer a size() > 0 filter that evaluates the scores and their inputs again
    return zones.select(key, _scores(col("zone_text")).alias("scores")).select(key, F.inline_outer("scores")).where(col("score").isNotNull())


def business_type(zones: DataFrame, key: str = "page_id", carry: list[str] | None = None) -> DataFrame:
    """``key, business_type, business_score, *carry``: the best-scoring type, Unknown if none.

    Ties go to the lowest enum ordinal (deterministic; the reference leaves
    them to hash order).  A projection of each row; ``carry`` columns pass through.
    """
    carry = carry or []
    scored = zones.select(key, _scores(col("zone_text")).alias("scores"), *carry)
    ranked = F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["ordinal"]).alias("first"), s["business_type"].alias("name")))
    best = scored.select(key, F.array_max(ranked).alias("best"), *carry)
    return best.select(
        key,
        F.coalesce("best.name", lit("Unknown")).alias("business_type"),
        F.coalesce("best.score", lit(0)).cast("bigint").alias("business_score"),
        *carry,
    )


def schema_type(df: DataFrame, column: str = "business_type") -> DataFrame:
    """Add ``schema_type`` (schema.org class) by a broadcast join with the 14-row dimension."""
    bt = dims.small(dims.business_types(df.sparkSession).select(col("business_type").alias(column), "schema_type"))
    return df.join(bt, column, "left")


def content_summary(zone_text: Column | str = "zone_text") -> Column:
    """Sentences of 21..199 bytes (split on . ! ?), first three, joined with '. '."""
    z = col(zone_text) if isinstance(zone_text, str) else zone_text
    parts = F.transform(F.split(z, P.SENTENCE_SPLIT, -1), lambda s: trim_ws(s))
    keep = F.filter(parts, lambda s: (F.octet_length(s) > 20) & (F.octet_length(s) < 200))
    return F.array_join(F.slice(keep, 1, 3), ". ")

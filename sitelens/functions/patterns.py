"""Regular expressions shared by the Spark expressions and the DuckDB oracle.

Every pattern stays inside the subset that Java regex (Spark) and RE2 (DuckDB)
read the same way: no look-around, no back-references, explicit whitespace
classes instead of ``\\s``.  Repeated groups are possessive, because Java
recurses once per turn of any other repeated group and a long page would
overflow its stack; ``re2`` spells them for RE2, which never recurses.  Tag names and attribute names are matched
case-insensitively (the HTML parser lower-cases them); attribute *values* are
case-sensitive except for ``type``, ``rel`` and ``http-equiv``.
"""

from __future__ import annotations

import re

WS = r"[ \t\r\n\f]"
# what may precede an attribute name inside a tag
ATTR_SEP = r"[ \t\r\n\f/]"


# what follows inside a tag: a quoted value may hold ">"; a stray quote stands for itself
QUOTED = rf"(?:[^>=]++|={WS}*\"[^\"]*\"|={WS}*'[^']*'|=)*+"
# the rest of a start tag after its name; the plain form serves tags whose quotes do not close
TAG_REST = rf"(?:{ATTR_SEP}(?:{QUOTED}>|[^>]*>)|>)"


def re2(pattern: str) -> str:
    """The pattern with greedy in place of possessive repetition."""
    for end in ")]}":
        pattern = pattern.replace(end + "*+", end + "*").replace(end + "++", end + "+")
    return pattern


def tag(name: str) -> str:
    """One start tag ``<name ...>`` (whole tag)."""
    return rf"<(?i:{name}){TAG_REST}"


def start_of(name: str) -> str:
    """The opening of a start tag, for counting."""
    return rf"<(?i:{name})(?:{ATTR_SEP}|>)"


def _lit(value: str, ci: bool) -> str:
    v = re.escape(value)
    return f"(?i:{v})" if ci else v


def attr_eq(attr: str, value: str, ci: bool = False) -> str:
    """``[attr='value']`` inside one tag string."""
    v = _lit(value, ci)
    return rf"{ATTR_SEP}(?i:{attr}){WS}*={WS}*(?:\"{v}\"|'{v}'|{v}(?:{WS}|>))"


def attr_prefix(attr: str, prefix: str) -> str:
    """``[attr^='prefix']`` inside one tag string."""
    p = _lit(prefix, False)
    return rf"{ATTR_SEP}(?i:{attr}){WS}*={WS}*[\"']?{p}"


def attr_present(attr: str) -> str:
    """``[attr]`` inside one tag string."""
    return rf"{ATTR_SEP}(?i:{attr})(?:{WS}|=|/|>)"


def attr_value(attr: str) -> str:
    """Value of ``attr``: group 1 (double quoted), 2 (single quoted) or 3 (bare)."""
    return rf"{ATTR_SEP}(?i:{attr}){WS}*={WS}*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\r\n\f>\"']+))"


def class_token(token: str) -> str:
    """``.token`` class selector inside one tag string (whitespace-separated list)."""
    t = re.escape(token)
    return (
        rf"{ATTR_SEP}(?i:class){WS}*={WS}*"
        rf"(?:\"(?:[^\"]*{WS})?{t}(?:{WS}[^\"]*)?\"|'(?:[^']*{WS})?{t}(?:{WS}[^']*)?'|{t}(?:{WS}|>))"
    )


def attr_nonempty(attr: str) -> str:
    """``[attr]:not([attr=''])`` inside one tag string."""
    return rf"{ATTR_SEP}(?i:{attr}){WS}*={WS}*(?:\"[^\"]+\"|'[^']+'|[^ \t\r\n\f>\"'][^ \t\r\n\f>]*)"


# --- document cleaning -------------------------------------------------------
# comments, and raw-text elements: keep the opening tag (its attributes are
# audited), drop the body so markup-looking text inside it is not counted.  One
# alternation, so whichever begins first hides the other.
HIDDEN = (
    rf"(?is)(<script{TAG_REST}).*?(</script{WS}*>)|(<style{TAG_REST}).*?(</style{WS}*>)|<!--.*?-->"
)
COMMENT = r"(?s)<!--.*?-->"
COMMENT_MARK = "<!>"  # keeps the text on both sides of a comment apart

# whole-document token stream: one tag, or one run of text; "<" before anything
# but a name, "/", "!" or "?" is text
ANY_TAG = rf"<[a-zA-Z/!?](?:{QUOTED}>|[^>]*>)"
TEXT_RUN = r"(?:[^<]++|<[^a-zA-Z/!?<])++"
TOKEN = rf"{ANY_TAG}|{TEXT_RUN}|<"
# any tags, then one text token of that stream (none at the end)
NEXT_TEXT = rf"(?:{ANY_TAG})*+({TEXT_RUN}|<|\z)"
IS_MARKUP = r"^<[a-zA-Z/!?]"
# the same, with script/style elements kept whole (body is raw text)
RAW_TEXT_TOKEN = (
    rf"(?is)<script{TAG_REST}.*?</script{WS}*>|<style{TAG_REST}.*?</style{WS}*>|{TOKEN}"
)
RAW_TEXT_START = r"(?i)^<(?:script|style)(?:[ \t\r\n\f/>])"
RAW_TEXT_BODY = rf"(?is)^<[a-z]+{TAG_REST}(.*)</[a-z]+[ \t\r\n\f]*>$"

# --- head elements -------------------------------------------------------------
TITLE_PRESENT = rf"(?is)<title{TAG_REST}.*?</title"
TITLE_TEXT = rf"(?is)<title{TAG_REST}(.*?)</title"
META_TAG = tag("meta")
HTML_TAG = tag("html")
LINK_TAG = tag("link")
SCRIPT_TAG = tag("script")
IMG_TAG = tag("img")

BODY_PRESENT = rf"(?i)<body(?:{ATTR_SEP}|>)"
BODY_REST = rf"(?is)<body{TAG_REST}(.*)$"
# "</head" up to a delimiter, so that "</header>" is another tag
HEAD_END_PRESENT = rf"(?i)</head{WS}*>"
HEAD_REST = rf"(?is)</head{WS}*>(.*)$"
TITLE_ELEMENT = rf"(?is)<title{TAG_REST}.*?</title[^>]*>"

NAME_DESCRIPTION = attr_eq("name", "description")
NAME_VIEWPORT = attr_eq("name", "viewport")
PROPERTY_OG = attr_prefix("property", "og:")
NAME_TWITTER = attr_prefix("name", "twitter:")
TYPE_LD_JSON = attr_eq("type", "application/ld+json", ci=True)
REL_CANONICAL = attr_eq("rel", "canonical", ci=True)
HAS_CHARSET = attr_present("charset")
HTTP_EQUIV_CONTENT_TYPE = attr_eq("http-equiv", "Content-Type", ci=True)
HTTP_EQUIV_LANGUAGE = attr_eq("http-equiv", "content-language", ci=True)
CONTENT_PRESENT = attr_present("content")
CONTENT_VALUE = attr_value("content")
LANG_PRESENT = attr_present("lang")
LANG_VALUE = attr_value("lang")
ALT_NONEMPTY = attr_nonempty("alt")
CLASS_CONTENT = class_token("content")

H1_START = start_of("h1")
IMG_START = start_of("img")

# --- words ---------------------------------------------------------------------
WORD = r"[a-zA-Z]+"
# the same words, those of three letters at least
LONG_WORD = r"[a-zA-Z]{3,}"
PHRASE = rf"[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)++"
SENTIMENT_TOKEN = r"[\p{L}\p{N}-]+"
NON_SPACE_RUN = r"[^ \t\r\n\f]+"
SENTENCE_SPLIT = r"[.!?]"
EDGE_WS = rf"^{WS}+|{WS}+$"

# --- injection -----------------------------------------------------------------
# first </head>, else first <body, case-insensitively
HEAD_POINT = rf"(?is)^(.*?)(</head{WS}*>.*)$"
BODY_POINT = rf"(?is)^(.*?)(<body(?:{ATTR_SEP}|>).*)$"
# the reference removes the first lower-case, attribute-less title element
STRIP_TITLE = r"(?s)^(.*?)<title>[^<]*</title>(.*)$"
STRIP_TITLE_PRESENT = r"<title>[^<]*</title>"

# --- entities ----------------------------------------------------------------------
# with the sign that ends it or, in an attribute, forbids it
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31})[;=]?"

# --- zone tokens ---------------------------------------------------------------
OPEN_TAG_NAME = r"^<([a-zA-Z][a-zA-Z0-9]*)"
CLOSE_TAG_NAME = r"^</([a-zA-Z][a-zA-Z0-9]*)"

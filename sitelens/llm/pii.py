"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

One pattern finds candidates, a validator of each kind decides, and a keyed
permutation of that kind's own domain replaces the value.  A permutation maps
equal values to equal pseudonyms in every document and different values to
different ones, and a pseudonym passes the same validator:

* card numbers (13-19 digits, Luhn): the payload digits are permuted and the check digit follows;
* US social security numbers: permuted among the valid area, group and serial numbers;
* IPv4 addresses: permuted among all addresses;
* phone numbers: the ten national digits are permuted, the country code stays; so do those of
  ``+`` numbers of 8 to 15 digits in any grouping, with the country code as assigned;
* national numbers with a leading 0 (``01 42 68 53 00``, ``030/1234567``): all digits after the first two are permuted;
* dates (``2024-05-31``, ``31.05.2024``, ``5.3.1985``, ``05/31/2024``, ``25/12/1985``; slash dates are read
  month-first unless the first number is no month): permuted among the 146,097 days from 1800 to 2199, in their notation;
* e-mail addresses: the letters and digits of the local part are permuted in base 36, lower-cased; the domain
  stays.  Beyond 22 letters and digits the rest becomes a keyed hash of the whole, and so does a local part with
  letters of other alphabets as a whole.

A domain of a * b values is a pair (left, right); each Feistel round adds a
keyed hash of one half to the other, modulo that half's own size, so no value
leaves the domain.  All of it is column expressions: candidates by
``regexp_extract_all``, the text between them by ``split``, the rounds by
``aggregate`` over the matches only.

Defined cases: null text stays null with counts 0; text without candidates is
unchanged; candidates that fail validation stay; repeated rows give equal
rows; an empty table gives no rows; further columns are ignored by
``pseudonymised`` and kept by ``replace_text``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands in for a secret that a deployment passes as ``key``.
DEMO_KEY = "sitelens-demo-key"
ROUNDS = 8
KINDS = ("email", "date", "ip", "phone", "ssn", "card")

NOT_WORD_BEFORE, NOT_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}" + NOT_WORD_AFTER
DATE = r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
PHONE = r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: National numbers with their leading 0: groups of two digits, or an area code and the rest.
NATIONAL = r"(?:0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}(?:[ -]|[ ]?/[ ]?)[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,2})"
#: Assigned country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
INTERNATIONAL = f"\\+(?!(?:{DATE}|{IP}|{SSN})(?!-?[0-9]){NOT_WORD_AFTER})[0-9](?:[ .()/-]{{0,2}}[0-9]){{7,14}}"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})"
NUMBERS = "|".join((DATE, IP, SSN, PHONE, NATIONAL, INTERNATIONAL, CARD))
CANDIDATE = f"{EMAIL}|(?<![\\p{{L}}\\p{{N}}_.])(?<![0-9]-)(?:{NUMBERS})(?!-?[0-9]){NOT_WORD_AFTER}"
CANDIDATE = CANDIDATE.replace("([ -])", "(?:[ -])").replace(r"\1", "[ -]").replace(r"\2", "[ -]")

#: 400 Gregorian years; 146,097 = 189 * 773 days.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773
#: Valid areas 001-899 without 666; groups 01-99 and serials 0001-9999.
SSN_LEFT, SSN_RIGHT = 898, 99 * 9999
LOCAL_CHARS = 22

_POWERS = [10**k for k in range(11)]
_POWERS_36 = [36**k for k in range(12)]


def keyed_number(key: str, kind: Column, turn: Column, half: Column, size: Column) -> Column:
    """A number below ``size`` from the key, the kind, the round and one half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, turn.cast("string"), size.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(key: str, kind: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the keyed permutation of Z_a x Z_b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        to_left = F.struct(F.pmod(s["l"] + keyed_number(key, kind, i, s["r"], a), a).alias("l"), s["r"].alias("r"))
        to_right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + keyed_number(key, kind, i, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, to_left).otherwise(to_right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit not doubled."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", F.lit(0)).otherwise(F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))))
    return F.aggregate(places, F.lit(0), lambda total, d: total + d)


def refill(shape: Column, symbols: Column, where: str) -> Column:
    """``shape`` with its characters of class ``where`` replaced in turn by those of ``symbols``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    put = lambda s, c: F.when(
        c.rlike(where), F.struct(F.concat(s["out"], F.substr(symbols, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _halves(digits: Column, key: str, kind: str, powers: list[int] = _POWERS, base: int = 10) -> Column:
    """A string of ``base`` digits permuted among the strings of its length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    number = lambda s: F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))
    power = lambda k: F.element_at(F.array(*map(F.lit, powers)).cast("array<long>"), k + 1)
    out = feistel(key, F.lit(kind), number(F.substr(digits, F.lit(1), h)), number(F.substr(digits, h + 1, n - h)), power(h), power(n - h))
    string = lambda v, k: F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, "0")
    return _let(out, lambda p: F.concat(F.when(h > 0, string(p["l"], h)).otherwise(F.lit("")), string(p["r"], n - h)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card(x: Column, key: str) -> Column:
    digits = _digits(x)
    payload = _halves(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _let(payload, lambda p: refill(x, F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")), "[0-9]"))


def _phone(x: Column, key: str) -> Column:
    digits = _digits(x)
    code = F.when(x.rlike(f"^{PHONE}$"), F.length(digits) - 10).when(x.startswith("0"), F.lit(2)).otherwise(F.length(F.regexp_extract(digits, COUNTRY, 0)))
    return refill(x, F.concat(F.substr(digits, F.lit(1), code), _halves(F.substr(digits, code + 1, F.length(digits) - code), key, "phone")), "[0-9]")


def _ssn(x: Column, key: str) -> Column:
    digits = _digits(x)
    part = lambda a, n: F.substr(digits, F.lit(a), F.lit(n)).cast("int")
    area = part(1, 3)
    left = area - F.when(area > 666, 2).otherwise(1)
    right = (part(4, 2) - 1) * 9999 + part(6, 4) - 1
    out = feistel(key, F.lit("ssn"), left, right, F.lit(SSN_LEFT).cast("long"), F.lit(SSN_RIGHT).cast("long"))
    show = lambda v, n: F.lpad(v.cast("string"), n, "0")
    area_of = lambda p: p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    return _let(out, lambda p: F.concat_ws("-", show(area_of(p), 3), show(F.floor(p["r"] / 9999) + 1, 2), show(p["r"] % 9999 + 1, 4)))


def _ip(x: Column, key: str) -> Column:
    octets = F.split(x, "\\.")
    pair = lambda i: F.get(octets, i).cast("long") * 256 + F.get(octets, i + 1).cast("long")
    size = F.lit(1 << 16).cast("long")
    both = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return _let(feistel(key, F.lit("ip"), pair(0), pair(2), size, size), lambda p: F.concat_ws(".", both(p["l"]), both(p["r"])))


def _date_format(x: Column) -> Column:
    """iso, dmy or mdy: a slash date is month-first unless its first number is no month."""
    parts = F.split(x, "[-./]")
    day_first = F.contains(x, F.lit(".")) | (F.get(parts, 0).cast("int") > 12)
    return F.when(F.contains(x, F.lit("-")), F.lit("iso")).when(day_first, F.lit("dmy")).otherwise(F.lit("mdy"))


def _as_date(x: Column) -> Column:
    parts, form = F.split(x, "[-./]"), _date_format(x)
    place = lambda iso, dmy, mdy: F.lpad(F.when(form == "iso", F.get(parts, iso)).when(form == "dmy", F.get(parts, dmy)).otherwise(F.get(parts, mdy)), 2, "0")
    year = F.when(form == "iso", F.get(parts, 0)).otherwise(F.get(parts, 2))
    return F.try_to_date(F.concat_ws("-", year, place(1, 1, 0), place(2, 0, 1)), "yyyy-MM-dd")


def _date(x: Column, key: str) -> Column:
    """Another day in the same notation; a date with a number of one digit is written without padding."""
    day = F.date_diff(_as_date(x), F.lit(FIRST_DAY).cast("date"))
    out = feistel(key, F.lit("date"), F.floor(day / DAYS_RIGHT), day % DAYS_RIGHT, F.lit(DAYS_LEFT).cast("long"), F.lit(DAYS_RIGHT).cast("long"))
    there = lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_RIGHT + p["r"]).cast("int"))
    form, mark = _date_format(x), F.regexp_extract(x, "[-./]", 0)
    width = F.when(x.rlike("(^|[-./])[0-9]([-./]|$)"), F.lit(1)).otherwise(F.lit(2))

    def show(d: Column) -> Column:
        number = lambda v: F.when(width == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
        year, month, day = F.lpad(F.year(d).cast("string"), 4, "0"), number(F.month(d)), number(F.day(d))
        return F.when(form == "iso", F.concat_ws("-", year, month, day)).when(form == "dmy", F.concat(day, mark, month, mark, year)).otherwise(F.concat(month, mark, day, mark, year))

    return _let(out, lambda p: _let(there(p), show))


def _email(x: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    plain = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    n = F.length(plain)
    # one character leaves a Feistel network no second half: it moves on along a keyed ring of all
    order = sorted(range(36), key=lambda i: hashlib.sha256(f"{key}|email|1|{i}".encode()).digest())
    symbols = "0123456789abcdefghijklmnopqrstuvwxyz"
    ring = "".join(symbols[i] for i in order)
    single = F.translate(plain, ring, ring[1:] + ring[0])
    head = F.when(n == 1, single).otherwise(_halves(F.substr(plain, F.lit(1), F.least(n, F.lit(LOCAL_CHARS))), key, "email", _POWERS_36, 36))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.when(local.rlike("[^ -~]"), F.lower(local)).otherwise(plain)), 512)
    rest = F.when(n > LOCAL_CHARS, F.substr(digest, F.lit(1), n - LOCAL_CHARS)).otherwise(F.lit(""))
    ascii_local = F.when(n > 0, refill(local, F.concat(head, rest), "[A-Za-z0-9]")).otherwise(local)
    new = F.when(local.rlike("[^ -~]"), F.substr(digest, F.lit(1), F.greatest(F.length(local), F.lit(12)))).otherwise(ascii_local)
    return F.concat(new, F.lit("@"), F.substring_index(x, "@", -1))


def kind_of(x: Column) -> Column:
    """The validated kind of a candidate, or null."""
    digits = _digits(x)
    n = F.length(digits)
    octets_fit = F.forall(F.split(x, "\\."), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]"))
    day = _as_date(x)
    ssn_valid = ~x.rlike("^(000|666|9)") & ~x.rlike("-00-") & ~x.rlike("-0000$")
    return (
        F.when(F.contains(x, F.lit("@")), F.lit("email"))
        .when(x.rlike(f"^{DATE}$"), F.when(F.year(day).between(1800, 2199), F.lit("date")))
        .when(x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets_fit, F.lit("ip")))
        .when(x.rlike(f"^{SSN}$"), F.when(ssn_valid, F.lit("ssn")))
        .when(x.rlike(f"^{PHONE}$") & n.between(10, 13) & x.rlike("[^0-9]"), F.lit("phone"))
        .when(x.startswith("+") & n.between(8, 15), F.lit("phone"))
        .when(x.rlike(f"^{NATIONAL}$") & n.between(9, 12), F.lit("phone"))
        .when(n.between(13, 19) & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$"), F.lit("card"))
    )


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    makers = {"email": _email, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}
    out = None
    for name, make in makers.items():
        out = F.when(kind == name, make(x, key)) if out is None else out.when(kind == name, make(x, key))
    return out.otherwise(x)


def found(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """``docs(text, ...)`` with ``_found`` (value and kind of each candidate) and ``_text`` (with what replaces them)."""
    text = F.col("text")
    some = text.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    out = docs.withColumn("_matches", F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    out = out.withColumn("_found", F.transform("_matches", lambda x: F.struct(x.alias("value"), kind_of(x).alias("kind"))))
    out = out.withColumn("_new", F.transform("_found", lambda m: pseudonym(m["value"], m["kind"], key)))
    joined = F.array_join(F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_new"), i), F.lit("")))), "")
    out = out.withColumn("_gaps", F.when(F.exists("_found", lambda m: m["kind"].isNotNull()), F.split(text, CANDIDATE)))
    return out.withColumn("_text", F.when(F.col("_gaps").isNotNull(), joined).otherwise(text))


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """``doc_id``, the new ``text`` and a count of each kind."""
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    count = lambda kind: F.coalesce(F.size(F.filter("_found", lambda m: m["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", F.col("_text").alias("text"), *map(count, KINDS))


def replace_text(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """The table with its text replaced (and ``n_chars`` renewed); all other columns as they were."""
    rows = found(docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text")), key)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))

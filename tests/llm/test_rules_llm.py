"""Quality rules and PII pseudonyms against plain Python."""

import hashlib
import datetime
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.llm import pii, quality

DOCS = "doc_id long, text string, words string, _text string, kind int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    repeat = len(covered)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed


def texts():
    rnd = random.Random(4)
    vocabulary = ["a", "b", "the", "of", "für", "x#", "<y>", "\n", "\n\n", "\t", "  ", "é"]
    out = [None, "", " \n\t\x0b\x0c\r ", "one", "one two", "a a a", "a a a a", "a b c a b c a", "x\n\nx\n x\nx", "  nbsp words", "w " * 20000]
    return out + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200))) for _ in range(150)]


def test_counts(spark):
    rows = [(i, t, "w", "t", 3) for i, t in enumerate(texts())] + [(None, "a b c", "w", "t", 3), (3, "one", "w", "t", 3)]
    got = quality.quality(spark.createDataFrame(rows, DOCS)).collect()
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert found == sorted((-1 if d is None else d, *counts(t)) for d, t, *_ in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_rules_reject_junk_and_keep_prose(spark):
    rnd = random.Random(5)
    names = [f"{a}{b}" for a in "bdfgklmr" for b in ("ova", "ati", "ux", "ulo", "ish")]
    prose = " ".join(rnd.choice([*names, "the", "of", "and"]) for _ in range(300))
    junk = " ".join(f"{w}$$$" for w in prose.split())
    no_stops = " ".join(rnd.choice(names) for _ in range(300))
    rows = [(1, prose, "", "", 0), (2, junk, "", "", 0), (3, no_stops, "", "", 0), (4, "- " + prose.replace(" the ", "\n- the "), "", "", 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_compiled_table_has_no_user_function(spark):
    df = quality.quality(spark.createDataFrame([(1, "a", "", "", 0)], DOCS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality(empty).collect() == []
    assert pii.pseudonymised(empty).collect() == []


CASES = {
    "mail ann.lee_9@mail8.example.com, end": ("email", "ann.lee_9@mail8.example.com"),
    "ip 42.144.35.254.": ("ip", "42.144.35.254"),
    "card 4041894974608795 x": ("card", "4041894974608795"),
    "card 4041 8949 7460 8795": ("card", "4041 8949 7460 8795"),
    "+1 (487) 555-7209 called": ("phone", "+1 (487) 555-7209"),
    "on 2024-05-31 or": ("date", "2024-05-31"),
    "am 31.05.2024 um": ("date", "31.05.2024"),
    "at 12/31/2024": ("date", "12/31/2024"),
    "ssn 123-45-6789": ("ssn", "123-45-6789"),
}
PLAIN = ["1219538112535716", "666-45-6789", "300.1.1.1", "1.2.3.4.5", "2024-02-30", "13/31/2024", "v1.2.3.4", "0000000000000000", "room 12, 1990", "2.5.", "x@y", "0000-00-00"]


def mask(x):
    return re.sub("[a-z]", "a", re.sub("[0-9]", "9", x))


def luhn(x):
    digits = [int(c) for c in x if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_every_kind_keeps_its_format_and_validity(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(CASES)]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (text, (kind, value)) in enumerate(CASES.items()):
        new = got[i]["text"]
        assert value not in new and got[i][f"n_{kind}"] == 1 and sum(got[i][f"n_{k}"] for k in pii.KINDS) == 1
        before, _, after = text.partition(value)
        assert new.startswith(before) and new.endswith(after)
        put = new[len(before) : len(new) - len(after)]
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in put.split("."))
        elif kind == "email":
            assert put.partition("@")[2] == value.partition("@")[2] and len(put) == len(value)
            assert re.sub("[a-z0-9]", "a", put) == re.sub("[a-z0-9]", "a", value)
        else:
            assert mask(put) == mask(value)
        if kind == "card":
            assert luhn(put)


def test_international_phones(spark):
    values = ["+44 20 7946 0958", "+33 1 42 68 53 00", "+49 30 1234567", "+442079460958", "+44 207 946 0958", "+351 21 1234567", "+49 (0)30/1234567", "+4915112345678"]
    rows = [(i, f"tel {v}, or", "", "", 0) for i, v in enumerate([*values, "+2024-05-31"])]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, DOCS)).collect()}
    new = [got[i]["text"][4:-4] for i in range(len(values))]
    code = {"+44": 3, "+33": 3, "+49": 3, "+35": 4}
    for i, (v, w) in enumerate(zip(values, new, strict=True)):
        assert got[i]["n_phone"] == 1 and w != v and mask(w) == mask(v) and w[: code[v[:3]]] == v[: code[v[:3]]]
    assert len({re.sub("[^0-9]", "", new[i]) for i in (0, 3, 4)}) == 1
    assert got[len(values)]["n_date"] == 1


def test_invalid_candidates_and_null_stay(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate([*PLAIN, None, ""])]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: t for i, t, *_ in rows}


def test_equal_values_stay_linked_across_documents_and_keys_differ(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(["a bob@x.org 10.0.0.1", "10.0.0.1, bob@x.org.", "bob@x.org 2001-01-01 2001-01-02"])]
    df = spark.createDataFrame(rows, DOCS)
    one, two, three = (r["text"] for r in pii.pseudonymised(df).orderBy("doc_id").collect())
    mail, ip = one.split()[1], one.split()[2]
    assert two == f"{ip}, {mail}." and three.split()[0] == mail and three.split()[1] != three.split()[2]
    assert pii.pseudonymised(df, key="another").orderBy("doc_id").first()["text"] != one


@pytest.mark.parametrize("a,b", [(1, 10), (10, 10), (7, 13), (189, 773)])
def test_feistel_is_a_permutation(spark, a, b):
    df = spark.range(a * b).select(F.col("id"), pii.feistel("k", F.lit("t"), F.floor(F.col("id") / b), F.col("id") % b, F.lit(a).cast("long"), F.lit(b).cast("long")).alias("p"))
    image = [r["v"] for r in df.select((F.col("p.l") * b + F.col("p.r")).alias("v")).collect()]
    assert sorted(image) == list(range(a * b))


def test_ssn_stays_valid(spark):
    df = spark.createDataFrame([(i, f"{a:03d}-{b:02d}-{c:04d}", "", "", 0) for i, (a, b, c) in enumerate([(1, 1, 1), (665, 99, 9999), (667, 1, 9999), (899, 50, 1)] + [(k, k % 99 + 1, 7 * k) for k in range(1, 600)])], DOCS)
    got = [r["text"] for r in pii.pseudonymised(df).collect()]
    assert len(set(got)) == df.count()
    for x in got:
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x)


def test_long_text_and_extra_columns(spark):
    text = "w " * 50000 + "10.0.0.1" + " w" * 50000
    df = spark.createDataFrame([(1, text, "keep", "me", 4)], DOCS)
    out = pii.replace_text(df)
    assert out.columns == df.columns
    r = out.first()
    assert (r["words"], r["_text"], r["kind"]) == ("keep", "me", 4) and "10.0.0.1" not in r["text"] and r["text"].startswith("w w")


def test_dates_phones_and_addresses_of_other_countries(spark):
    kinds = {
        "25/12/1985": "date", "5.3.1985": "date", "5/3/1985": "date", "05.03.1985": "date", "1985-03-05": "date", "1985-3-5": "date",
        "01 42 68 53 00": "phone", "06.12.34.56.78": "phone", "030/1234567": "phone", "0221 123456": "phone", "040 - 12 34 56": None,
        "müller@x.de": "email", "иван@x.org": "email", "a@x.org": "email", "b@x.org": "email", "c@x.org": "email",
        "31/31/1985": None, "0/3/1985": None, "01 42 68": None, "0.5.1985": None,
    }
    rows = spark.createDataFrame([(i, f"say {v} now") for i, v in enumerate(kinds)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(rows, "k").collect()}
    out = {v: got[i]["text"][4:-4] for i, v in enumerate(kinds)}
    for i, (v, kind) in enumerate(kinds.items()):
        if kind is None:
            assert out[v] == v, v
            continue
        assert out[v] != v and got[i][f"n_{kind}"] == 1, (v, out[v])
        if kind != "email":
            assert re.sub("[0-9]+", "9", out[v]) == re.sub("[0-9]+", "9", v)
    when = lambda s, *order: datetime.date(*(int(re.split("[-./]", s)[i]) for i in order))
    # one day in four notations stays one day
    assert len({when(out["5.3.1985"], 2, 1, 0), when(out["05.03.1985"], 2, 1, 0), when(out["1985-03-05"], 0, 1, 2), when(out["1985-3-5"], 0, 1, 2)}) == 1
    assert when(out["25/12/1985"], 2, 1, 0) and when(out["5/3/1985"], 2, 0, 1)
    assert out["01 42 68 53 00"].startswith("01 ") and out["030/1234567"].startswith("03")
    assert len({out[f"{c}@x.org"] for c in "abc"}) == 3
    steps = {(ord(out[f"{c}@x.org"][0]) - ord(c)) % 36 for c in "abc"}
    assert len(steps) > 1  # no constant shift
    assert "ü" not in out["müller@x.de"] and out["müller@x.de"].endswith("@x.de") and "ller" not in out["müller@x.de"]


def plain_feistel(key, kind, left, right, a, b):
    """The permutation in plain Python."""
    for turn in range(pii.ROUNDS):
        half, size = (right, a) if turn % 2 == 0 else (left, b)
        number = int(hashlib.sha256(f"{key}|{kind}|{turn}|{size}|{half}".encode()).hexdigest()[:15], 16) % size
        left, right = ((left + number) % a, right) if turn % 2 == 0 else (left, (right + number) % b)
    return left, right


def test_dates_and_addresses_equal_a_plain_version(spark):
    rnd = random.Random(4)
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(rnd.randrange(146097)) for _ in range(60)]
    hosts = [[rnd.randrange(256) for _ in range(4)] for _ in range(60)]
    rows = [(i, f"{d.isoformat()} {'.'.join(map(str, h))}") for i, (d, h) in enumerate(zip(days, hosts, strict=True))]
    got = {r["doc_id"]: r["text"].split() for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (d, h) in enumerate(zip(days, hosts, strict=True)):
        n = (d - datetime.date(1800, 1, 1)).days
        x, y = plain_feistel("k", "date", n // 773, n % 773, 189, 773)
        assert got[i][0] == (datetime.date(1800, 1, 1) + datetime.timedelta(x * 773 + y)).isoformat()
        x, y = plain_feistel("k", "ip", h[0] * 256 + h[1], h[2] * 256 + h[3], 1 << 16, 1 << 16)
        assert got[i][1] == f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"

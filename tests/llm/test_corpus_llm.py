"""Language ID, decontamination and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import decontam, langid
from sitelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, _text string"


def test_letters_gaps_and_binding():
    p = langid.Profiles(256)
    a, b, c, gap = (langid.letter_vector(ord(x), 256).astype(int) for x in "abc ")
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = bind(gap, a, b) + bind(a, b, gap) + bind(b, gap, c) + bind(gap, c, gap)
    for text in ("ab c", " AB--1 c!", "\tab\n\nC"):
        assert p.of(text).astype(int).tolist() == want.tolist()
    assert p.of(None) is None and p.of("") is None and p.of("12 !?") is None


def test_small_cache_gives_the_same_profiles():
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick brown fox", "ünïcödé wörds"]
    large, small = langid.Profiles(64), langid.Profiles(64, cache=20)
    for t in texts:
        assert large.of(t).tolist() == small.of(t).tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda df: sorted(map(tuple, langid.languages(df).collect()))
    assert key(docs) == key(wrong)


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", "de"), (None, "some words here", "en"), (7, "some words here", None), (8, "les mots ici", "fr"), (8, "les mots ici", "fr")]
    df = spark.createDataFrame([(*r, "s", 1, "k", "t") for r in rows], DOCS)
    got = langid.languages(df).collect()
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)) == ["und"] * 3
    assert len(got) == len(rows)
    assert langid.languages(spark.createDataFrame([], DOCS)).collect() == []
    kept = langid.known_language(df)
    assert kept.columns == df.columns and kept.count() == 4
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.languages(unlabelled).collect()} == {"und"}


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hungarian = "A vonat reggel kilenckor indul az állomásról, és délután ér a városba, ahol az utasok leszállnak, majd gyalog mennek tovább a folyó partján. " * 3
    russian = "Поезд отправляется утром и прибывает в город вечером, где пассажиры выходят и идут дальше пешком вдоль реки до старого моста. " * 3
    keys = "xqzj wvkq zzxj qqpt kkdw vvbn jjhg ffdx ppqw mmzx " * 12
    foreign = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate([hungarian, russian, keys])], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select(foreign.columns).unionByName(foreign)
    kept = {r["doc_id"] for r in langid.known_language(every).collect()}
    assert not kept & {r["doc_id"] for r in foreign.collect()}
    letters = {r["doc_id"] for r in langid.languages(every).where("lang_pred <> 'und' AND doc_id < 1000000000").collect()}
    assert len(letters - kept) <= 0.005 * len(letters)


def test_every_labelled_text_is_learned(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("the train leaves in the morning and the people walk on along the river").alias("text"), F.lit("en").alias("lang"))
    may = rows.where(~langid.held_out())
    assert langid.learnable(rows).count() == may.count()
    odd = may.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).desc()).first()["doc_id"]  # what a sample by hash left out
    docs = rows.withColumn("text", F.when(F.col("doc_id") == odd, F.lit("xqzj wvkq zzxj qqpt kkdw vvbn jjhg ffdx ppqw mmzx wqkx zjxv rrtq ggkw")).otherwise(F.col("text")))
    assert langid.known_language(docs).where(F.col("doc_id") == odd).count() == 1


ITEM = "A train leaves Leeds at 9 and runs 120 km in 3 hours before it meets the slow train that Anna boarded in York while Anna had read 120 pages"
OTHER = "Which of the following statements about the old harbour and its many quiet boats is certainly true today"
SHORT = "Why is this so blue"
BENCH = "item_id long, text string, extra string"


def test_exact_reparametrised_and_inconsistent(spark):
    same = f"Before that. {ITEM}. And after"
    changed = "Well. " + ITEM.replace("9", "11").replace("120", "450").replace("3 hours", "5 days").replace("Anna", "Maria").replace("Leeds", "Hull")
    broken = "Well. " + ITEM.replace("120 km", "450 km").replace("Leeds", "Hull")  # 120 means both 450 and 120
    part = " ".join(OTHER.split()[2:16])
    few = " ".join(OTHER.split()[2:10])
    rows = [(1, same), (2, changed), (3, broken), (4, f"words before {part} words after"), (5, few), (6, "clean text of other words entirely and nothing else"), (7, None), (8, ""), (None, OTHER), (9, OTHER.upper()), (1, same), (10, f"it is so. {SHORT}")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "k", "x") for d, t in rows], DOCS)
    bench = spark.createDataFrame([(1, ITEM, "e"), (2, OTHER, "e"), (3, None, "e"), (4, "", "e"), (5, "two words", "e"), (6, SHORT, "e"), (7, "1 2 3 4 5 6 7 8 9", "e")], BENCH)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(docs, bench).collect()}
    assert got[1, 1] == "exact" and got[2, 1] == "reparametrised" and got[4, 2] == "exact" and got[None, 2] == "exact" and got[10, 6] == "exact"
    assert not {k for k in got if k[0] in (5, 6, 7, 8)} and got[3, 1] == "exact"  # 21 words from the conflict on
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {5, 6, 7, 8} and not {r["doc_id"] for r in kept.collect()} & {1, 2, 4, 10, None}


def found_items(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", "x") for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)], BENCH)
    return {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["kind"]) for r in decontam.contaminated(docs, bench).collect()}


def test_runs_step_over_crowded_slots(spark):
    before, after = "nobody could say how the old miller kept count", "because every sack had lost its label last winter"
    item = f"{before} 12 14 19 23 31 40 {after}"
    other = f"{before} 13 15 20 24 32 41 {after}"
    edges = "7 8 9 10 11 birds were seen beside the quiet pond 1 2 3 4 5"
    mixed = f"{before} Anna 3 met 4 Bob 5 saw 6 Cid 7 and 8 Dan {after}"
    gone = f"{before} and then he was just gone {after}"
    docs = [f"so {item} then", other, gone, edges.replace("7 8", "70 80"), mixed, mixed.replace("saw", "hit")]
    got = found_items(spark, docs, [item, edges, mixed])
    assert got[0, 0] == (1, 24, "exact") and got[1, 0] == (0, 24, "reparametrised")
    assert got[3, 1] == (0, 17, "reparametrised") and got[4, 2] == (0, 31, "exact")
    assert got[5, 2][:2] == (16, 15) and not {k for k in got if k[0] == 2}
    # the words between are not held against a run that counts without them
    long = " ".join(f"w{i}" for i in range(20))
    assert found_items(spark, [f"{long} 5 6 9 9 1"], [f"{long} 5 6 8 8 8"])[0, 0] == (0, 22, "exact")


def test_copies_in_any_case_and_of_any_words(spark):
    title = "The Quiet Harbour Of Leeds And Its Many Boats In The Early Morning Light"
    german = "über die ältesten Häuser der großen Straße weiß heute niemand mehr etwas Öffentliches zu sagen"
    numbers, names = "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "Anna Bob Cid Dan Eve Fay Gus Hal Ian Jim Kim Lea Max Ned"
    items = [OTHER, OTHER.upper() + " INDEED", title, numbers, names, german, ITEM]
    docs = [OTHER.upper(), f"{OTHER} indeed", f"so {title}.", f"x {numbers} y", f"of {names}", german.upper(), f"Well. {ITEM.upper()}", "3 1 4 1 6 9 2 6 5 3 5 8 9 7 9"]
    got = found_items(spark, docs, items)
    assert {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)} <= set(got)
    assert all(got[k][2] == "exact" for k in got)
    assert got[0, 0][:2] == (0, 18) and got[3, 3][:2] == (1, 15) and got[6, 6][:2] == (1, 30)
    assert 7 not in {d for d, _ in got}


def brute_stretch(start, end, slots, least):
    spans = [(a, z, [(b, d) for p, b, d in slots if a <= p < z]) for a in range(start, end) for z in range(a + 1, end + 1)]
    longest = lambda good: max(((z - a, -a, all(b == d for b, d in x)) for a, z, x in spans if good(x)), default=(0, 0, False))
    exact, whole = longest(lambda x: all(b == d for b, d in x)), longest(lambda x: len({b for b, _ in x}) == len(set(x)))
    n, a, same = exact if exact[0] >= least and whole[0] < end - start else whole
    return -a, n, same


def test_stretches_of_runs_with_conflicts():
    rnd = random.Random(6)
    for _ in range(400):
        slots = sorted({rnd.randrange(3, 23): None for _ in range(rnd.randint(0, 9))})
        slots = [(p, rnd.randrange(1, 4), rnd.randrange(1, 4)) for p in slots]
        least = rnd.choice([5, 9, 13, 30])
        assert decontam.counting_stretch(3, 23, slots, least) == brute_stretch(3, 23, slots, least), slots


def test_one_changed_number_does_not_hide_a_copy(spark):
    docs = [ITEM.replace("read 120", "read 121"), ITEM.replace("120 km", "450 km"), ITEM.replace("120 km", "450 km").replace("read 120", "read 450")]
    got = found_items(spark, docs, [ITEM])
    assert got[0, 0][1:] == (28, "exact") and got[1, 0][1:] == (21, "exact") and got[2, 0][1:] == (30, "reparametrised")


def test_short_items_are_joined_whole(spark):
    items = ["Why so blue", "yes", "who is Anna Bell?", "two words", "a b c d"]
    docs = ["it is. WHY SO BLUE, they ask, why so blue", "Yes!", "why so", "he asked who is Anna Bell", "two other words", "a b c", None, "x a b c d"]
    got = found_items(spark, docs, items)
    assert got == {(0, 0): (2, 3, "exact"), (1, 1): (0, 1, "exact"), (3, 2): (2, 4, "exact"), (7, 4): (1, 4, "exact")}


def test_common_windows_are_not_joined_with_everything(spark, monkeypatch):
    """Runs through common windows are the same as without the rule for them, and a stock phrase joins nothing."""
    rnd = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "or", "ist", "ule", "ent", "ark")]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    phrase, long = "please answer the following question".split(), some(16)
    items = [" ".join([*phrase, *some(12)]) for _ in range(30)] + [" ".join([*some(4), *long, *some(4)]) for _ in range(20)] + [" ".join(phrase)]
    docs = [" ".join([*some(20), *phrase, *some(20)]) for _ in range(30)] + [f"so {i} then" for i in items[::3]] + [" ".join([*some(9), *long, *some(9)])]
    docs += [i.replace("following", "next") for i in items[::4]]
    plain = found_items(spark, docs, items)
    monkeypatch.setattr(decontam, "COMMON", 5)
    assert found_items(spark, docs, items) == plain
    assert {(d, 50) for d in range(30)} <= set(plain) and {(40 + k, i) for k in range(7) for i in range(30, 50)} <= set(plain)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs[:30])], "doc_id long, text string").withColumn("key", F.col("doc_id"))
    index = decontam.benchmark_windows(spark.createDataFrame([(i, t) for i, t in enumerate(items[:30])], "item_id long, text string"))
    bitmap, bits = decontam.window_bitmap(index)
    assert decontam._document_windows(frame, bitmap, bits, 13).count() == 0


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    assert decontam.contaminated(docs, bench).collect() == []
    some = spark.createDataFrame([(1, OTHER, "en", "s", 1, "k", "x")], DOCS)
    assert decontam.contaminated(some, bench).collect() == [] and decontam.decontaminated(some, bench).count() == 1


def test_planted_passages_in_given_documents(spark):
    """Every document that holds a whole item as text is found, and no other by plain word windows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: " ".join(r["text"].split()) for r in bench.collect()}
    holds = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in " ".join((r["text"] or "").split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert holds and holds <= got


@pytest.fixture(scope="module")
def stages(spark):
    spark.conf.set(corpus_pipeline.PII_KEY, "key of the tests")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SMALL).cache()
        out.append((name, docs, rows))
        docs = rows
    return out


def test_stages_in_order_with_documents_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "packing"]
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    for _, _, rows in stages[:-1]:
        assert rows.columns == columns


def test_stage_decisions(spark, stages):
    from test_duplicates_llm import brute_classes

    by = {name: (before, after) for name, before, after in stages}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = by["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == [d for d, _, label in brute_classes(rows) if d == label]
    before, after = by["decontamination"]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontam.contaminated(before, bench).collect()}
    assert bad and ids(after) == [d for d in ids(before) if d not in bad]
    before, after = by["pii"]
    assert ids(before) == ids(after)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = by["packing"]
    assert ids(after.select("doc_id").distinct()) == ids(before)


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    want = stages[-1][2]
    assert got.count() == want.count()
    total = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.collect()}
    assert total(got) == total(want)

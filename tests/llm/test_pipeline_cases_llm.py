"""The pipeline's stages on nulls, empty texts, repeated rows and an empty table."""

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_on_nulls_repeats_and_empty_tables(spark):
    spark.conf.set(corpus_pipeline.PII_KEY, "key of the tests")
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = given.where("doc_id < 30").collect()
    rows = [tuple(r) for r in odd] + [tuple(odd[3])] * 2
    at = given.columns.index("doc_id"), given.columns.index("text")
    for doc_id, text in ((None, odd[1]["text"]), (9001, None), (9002, ""), (None, None)):
        row = [None] * len(given.columns)
        row[at[0]], row[at[1]] = doc_id, text
        rows.append(tuple(row))
    for docs in (spark.createDataFrame(rows, given.schema), spark.createDataFrame([], given.schema)):
        size = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SMALL).cache()
            if name != "packing":
                assert after.columns == given.columns and after.count() <= size
                size, docs = after.count(), after
            else:
                assert (after.count() > 0) == (size > 0)
        assert (size == 0) == (docs.count() == 0)

"""The training-data pipeline: documents in, packed pieces out.

Each stage works on all rows that its predecessor kept and calls one operator
with its production parameters.  ``run`` writes every stage's rows as Parquet
in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import decontam, langid, packing, pii, setjoin
from sitelens.llm.storage import remove, work_dir

#: The session setting that names the key of the pseudonyms; the same key links the same values across runs.
PII_KEY = "spark.sitelens.pii.key"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without text or letters, or in no such language, go.

    Repeated rows are judged alike; an empty table stays empty.
    """
    return langid.known_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest ``doc_id``.

    Documents without a ``doc_id`` or without words are no one's copies and stay.
    """
    return setjoin.representatives(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows go or stay together;
    an empty table stays empty, and with an empty benchmark all documents stay.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced, under the session's key or a secret of this run's own.

    Null texts stay null; repeated rows give equal rows; an empty table stays empty.
    """
    return pii.replace_text(docs, spark.conf.get(PII_KEY, None) or secrets.token_hex(32))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows over all documents.

    A null text counts as empty; repeated rows are documents of their own; an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Tokenizers, models and set joins are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs

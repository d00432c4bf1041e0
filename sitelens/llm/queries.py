"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import decontam, huffman, langid, neighbours, oracle, packing, periodic, pii, quality, setjoin, suffix, tokencount, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids written as Huffman-coded shards and read back."""
    return huffman.encode_and_read(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table over every document: counts, base check and verdict."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(_table(spark, sf_dir, "documents")).select(*columns)


def op3_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that several documents hold."""
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return setjoin.jaccard_classes(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.languages(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    return pii.pseudonymised(_table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged WARC archives and read back."""
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op9_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full windows."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, a tenth of the documents with a repeated tail."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic.repeated_tail().alias("text"))
    return periodic.run_digests(periodic.periodic_runs(docs))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that groups share their first turns."""
    return trie.prefix_trie(trie.rebuilt_paths(_table(spark, sf_dir, "conversations")))


def op13_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every hundredth embedding."""
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_passages": op3_suffix_passages,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_warc_zip": op8_warc_zip,
    "op9_concat_packing": op9_concat_packing,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_balanced_lists": op13_balanced_lists,
}
ORACLE = {"op2_quality_rules": oracle.quality(), "op4_jaccard_join": oracle.jaccard(), "op8_warc_zip": oracle.warc(), "op12_conversation_trie": oracle.trie()}

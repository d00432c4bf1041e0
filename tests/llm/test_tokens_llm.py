"""Token ids: the word cache, Huffman files, packing and counts against the library on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sitelens.llm import huffman, packing, tokencount
from sitelens.llm.tokens import TextEncoder, default_vocabulary, load_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids long, part string"


def whole_ids(text):
    return load_tokenizer(default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def rows():
    rnd = random.Random(1)
    words = ["the", "Haus", "être,", "x.", "don't", "<|endoftext|>", "42", "ñandú", "áb", "İ.", "ΟΔΟΣ"]
    texts = [None, "", " \n ", "a", "a", "one two. three", "<|endoftext|> <|ENDOFTEXT|>", "x" * 3000]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(12)]
    out = [(i // 2 if i < 4 else i, t, "en", "s", 1, 7, "clash") for i, t in enumerate(texts)]
    return [*out, (None, "no id", None, None, None, None, None), out[5], out[5]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_word_cache_equals_library():
    rnd = random.Random(3)
    alphabet = [*"aAbB.,'!? \n\t\r\x0b\x1c\u0301\u0130\u03a3\u03c3\u00df\u00e9\u00c91\u0968\u65e5<|>", "<|endoftext|>", "'s", "Stra\u00dfe", "fin.", "don't"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for cache in (50, 100_000):  # a cache that is emptied all the time, and one that never is
        ids, offsets = TextEncoder(default_vocabulary(), cache).encode(pa.array([*texts, None]))
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == whole_ids(text)
        assert offsets[-1] == offsets[-2]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 5, 1, 1, 2, 40, 0, 3])
    lengths = huffman.code_lengths(counts, 20)
    assert (lengths > 0).tolist() == (counts > 0).tolist()
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    assert int((counts * lengths).sum()) == 77  # the merges by hand: 2 + 4 + 7 + 12 + 52
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    assert huffman.code_lengths(fibonacci, 20).max() == 11
    limited = huffman.code_lengths(fibonacci, 5)
    assert limited.max() == 5 and sum(2.0 ** -int(x) for x in limited) <= 1.0
    assert huffman.code_lengths(np.array([0, 9]), 20).tolist() == [0, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_block_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000):
        ids = rng.zipf(1.3, n).clip(0, 900).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids))
        table, width = huffman.decode_table(lengths)
        words, marks = huffman.pack_bits(ids, lengths, huffman.canonical_codes(lengths))
        assert huffman.unpack_bits(words, marks, n, table, width).tolist() == ids.tolist()


def test_huffman_files(spark, monkeypatch):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    got = huffman.encode_and_read(df).collect()
    assert len(got) == len(rows())
    expected = sorted(((d is not None, d or 0), crc([*whole_ids(t), 2]), len(whole_ids(t)) + 1) for d, t, *_ in rows())
    start = 0
    found = sorted(got, key=lambda r: r["start"])
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids_crc32"], r["n_tokens"]) for r in got) == expected
    ids = [r["doc_id"] for r in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_huffman_document_over_several_blocks():
    def batches(sizes):
        yield pa.record_batch([pa.array(range(len(sizes))), pa.array([np.arange(n, dtype="<u2").tobytes() for n in sizes], pa.binary())], names=["doc_id", "ids"])

    old, huffman.BLOCK_IDS = huffman.BLOCK_IDS, 10
    try:
        for sizes in ([3, 25, 4], [10, 10], [20], [9, 1, 1], [30, 30], [1, 10, 11]):
            blocks = list(huffman.blocks_of(batches(sizes), "<u2"))
            assert sum(len(ids) for _, _, ids in blocks) == sum(sizes)
            assert all(len(ids) <= 10 for _, _, ids in blocks)
            units = []
            for fresh, segments, _ in blocks:
                if fresh:
                    units.append([])
                units[-1].append(segments)
            for unit in units:  # a unit of several blocks is one document
                assert len(unit) == 1 or {int(s["doc_id"]) for part in unit for s in part} == {int(unit[0][0]["doc_id"])}
    finally:
        huffman.BLOCK_IDS = old


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert huffman.encode_and_read(empty).collect() == []
    assert packing.pack(empty).collect() == []
    assert tokencount.token_counts(empty).collect() == []


def test_packing_pieces_and_sequences(spark):
    df = spark.createDataFrame(rows(), DOCS).repartition(4)
    pieces = packing.pack(df, window=64, with_ids=True)
    pieces = pieces.cache()
    got = pieces.collect()
    by_sequence = {}
    for r in got:
        assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    used = []
    for k in sorted(by_sequence):
        at = 0
        for offset, length in sorted(by_sequence[k]):
            assert offset == at
            at += length
        used.append(at)
    assert all(n == 64 for n in used[:-1]) and sum(used) == sum(len(whole_ids(t)) + 1 for _, t, *_ in rows())
    documents = {}
    for r in got:
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for (_, total), parts in documents.items():
        assert sum(n for _, n in parts) % total == 0
    table = packing.sequences(pieces, 64).orderBy("sequence_id").collect()
    assert [r["used"] for r in table] == used
    assert all(len(r["ids"]) == 64 for r in table[:-1])
    last = len(table[-1]["ids"])
    assert last & (last - 1) == 0 and last >= used[-1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_spliced_counts_equal_whole_counts(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    library = tokencount.LibraryEncoder(path)
    table = [*rows(), (900, "word " * 500 + "z" * 900 + " tail " * 50, None, None, None, None, None)]
    df = spark.createDataFrame(table, DOCS)
    got = tokencount.token_counts(df, path, chunk_chars=150, overlap_chars=40, limit=100).collect()
    count = lambda t: int(library.count(pa.array([t or ""]))[0])
    expected = sorted((-1 if d is None else d, len((t or "").encode()), count(t), count(t) > 100) for d, t, *_ in table)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == expected

"""Packing, counts, files, shards and passages, against brute force and round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reconweave.llm import bpe, kd_shards, packing, substring, token_counts, token_files
from reconweave.llm.bpe import Encoder
from reconweave.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from reconweave.llm.scratch import Scratch

TEXTS = [None, "", " ", "it's they'store ('s  a \n\n b\t", "<|endoftext|> x<|startoftext|>y", "é à b", "don''t 12,345.67 ab12 ñandú's $%^ '' ' a'", "x\r\n y\tz  ", "日本語 テスト。ok", "'s 't 're a'b'c'll", "Same text", "Same text", "word " * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(7, "repeated id", "x", "y")], "doc_id long, text string, length string, part string")


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_ids_equal_the_library(name):
    path = tokenizer_path(name)
    library = Tokenizer.from_file(path)
    column = pa.array([t or "" for t in TEXTS])
    for _ in range(2):  # without and with the cache
        ids, at = Encoder.of(path).encode(column)
        for i, t in enumerate(column.to_pylist()):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


class Asked:
    """A tokenizer that counts how often it is asked for a word."""

    def __init__(self, tokenizer, word):
        self.tokenizer, self.word, self.times = tokenizer, word, 0

    def encode_batch_fast(self, texts, **how):
        self.times += sum(t.count(self.word) for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_a_full_cache_keeps_common_units(name, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 300)
    encoder = Encoder(tokenizer_path(name))
    library, asked = encoder.tokenizer, Asked(encoder.tokenizer, "commonword")
    encoder.tokenizer = asked
    for batch in range(20):
        texts = [f"a commonword (or q{batch}x{k}z) it's <|endoftext|" for k in range(60)] + [f"more <|endoftext|> {batch} commonness"]
        ids, at = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.keys) <= 300
    assert asked.times == 1


def test_units_joined_for_the_library_keep_their_ids():
    units = ["", " a", "'s", "<|endoftext|", "|>", "\n\n", "日本", *(f" x{k}" for k in range(600))]
    for name in (BYTE_BPE, WORD_BPE):
        encoder = Encoder(tokenizer_path(name))
        assert encoder.part is not None
        for got, want in zip(encoder._units(units), encoder.fresh(units), strict=True):
            assert got.tolist() == want.tolist()
        encoder.part = None
        assert encoder._units(units)[0].tolist() == encoder.fresh(units)[0].tolist()


def test_counts(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    got = token_counts.token_counts(docs, spark, tokenizer_path(BYTE_BPE)).collect()
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in [*enumerate(TEXTS), (7, "repeated id")])
    assert sorted(map(tuple, got)) == want
    assert token_counts.token_counts(docs.limit(0), spark, tokenizer_path(BYTE_BPE)).count() == 0


def best_fit_decreasing(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(capacity - x)
    return len(room)


def test_bins_hold_all_and_are_few():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 100, rng.integers(1, 300)).tolist()
        histogram = {k: lengths.count(k) for k in set(lengths)}
        plan = packing.bins(histogram, 100)
        used = {}
        for b, times in plan:
            assert sum(b) <= 100
            for k in b:
                used[k] = used.get(k, 0) + times
        assert used == histogram
        assert sum(t for _, t in plan) <= best_fit_decreasing(lengths, 100)


def test_packing(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    rows = packing.pack_documents(docs, spark, tokenizer_path(WORD_BPE)).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(TEXTS)}
    for r in rows:
        if r["doc_id"] != 7:
            assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) == len(TEXTS) + 1 + len(ids[12]) // 4096
    assert packing.pack_documents(docs.limit(0), spark, tokenizer_path(WORD_BPE)).count() == 0


def test_files_round_trip(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    rows = token_files.round_trip(docs, spark, tokenizer_path(BYTE_BPE)).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted([*enumerate(TEXTS), (7, "repeated id")], key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(map(tuple, rows)) == want
    assert token_files.round_trip(docs.limit(0), spark, tokenizer_path(BYTE_BPE)).count() == 0


def test_one_document_through_the_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    root = Scratch(spark, "test-files").root
    manifest, shared = token_files.write_files(docs, spark, tokenizer_path(BYTE_BPE), root)
    row = manifest.filter("doc_id = 17").first()
    reader = token_files.Reader(f"{root}/{row['file']}", shared.value[0])
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    text = docs.filter("doc_id = 17").first()["text"]
    assert reader.document(17).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert reader.document(10**9) is None and len(shared.value[0]) > 0
    with pytest.raises(ValueError):
        token_files.Reader(f"{root}/{row['file']}", b"another dictionary")


def test_shards_have_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_shards.shard(docs, spark).collect()
    size, slots = {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(size) == set(range(8)) and len(rows) == docs.count()
    assert max(size.values()) - min(size.values()) <= 4 * max(r["size"] for r in rows)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_odd_tables(spark):
    same = spark.createDataFrame([(1, None, None, None)] * 40 + [(2, "x" * 50, "en", "s")] * 3, "doc_id long, text string, lang string, source string")
    rows = kd_shards.shard(same, spark).collect()
    assert len(rows) == 43 and {r["shard"] for r in rows} <= set(range(8))
    assert all(r["size"] == (1 if r["doc_id"] == 1 else 51) for r in rows)
    assert kd_shards.shard(same.limit(0), spark).count() == 0
    by_bytes = kd_shards.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark, target_bytes=100_000)
    assert by_bytes.groupBy("shard").sum("size").agg({"sum(size)": "max"}).first()[0] < 200_000


def test_shared_passages_are_cut(spark):
    words = lambda k, n: " ".join(f"{k}q{i}" for i in range(n))
    passage = words("p", 70)
    rows = [(1, f"{words('a', 40)} {passage} {words('b', 40)}"), (2, f"{words('c', 25)} {passage} {words('d', 33)}\nlast line"), (3, passage.upper()), (4, words("e", 200)), (5, None), (6, ""), (7, "short\nlines\nonly"), (8, f"{words('f', 50)} {words('f', 50)}")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "c") for i, t in rows], "doc_id long, text string, n_chars long, hash string")
    got = substring.repeats(docs, spark).collect()
    assert {r["doc_id"] for r in got} == {2, 3} and 1 in {r["first_doc_id"] for r in got} <= {1, 2}
    out = {r["doc_id"]: r for r in substring.without_repeats(docs, spark).collect()}
    assert out[1]["text"] == rows[0][1] and out[4]["text"] == rows[3][1] and out[8]["text"] == rows[7][1]
    assert passage not in out[2]["text"] and out[2]["text"].endswith("last line") and out[2]["n_chars"] == len(out[2]["text"])
    assert set(out) >= {1, 2, 4, 5, 6, 7, 8} and out[5]["text"] is None
    assert substring.repeats(docs.limit(0), spark).count() == 0


def test_bands_reach_their_recall():
    assert 1 - 0.2**substring.SINGLE >= substring.RECALL
    assert 1 - (1 - 0.8**substring.ROWS) ** substring.BANDS >= substring.RECALL > 1 - (1 - 0.8**substring.ROWS) ** (substring.BANDS - 1)

import re

import pyarrow as pa
import pytest

from reconweave.llm.components import components
from reconweave.llm import minhash
from reconweave.llm.minhash import keep_one, near_duplicates
from reconweave.llm.scratch import Scratch


def shingle_sets(rows, size):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def brute_force(rows, size, percent):
    """The least doc_id of what each row is linked with."""
    sets, up = shingle_sets(rows, size), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and find(i) != find(j) and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least[find(i)] for i in range(len(rows))]


def corpus():
    base = [f"word{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "ONE two"), (7, " ".join(base)), (8, " ".join(base)), (9, " ".join(base).upper())]
    for k in range(40):  # edits that drift away from the base
        words = list(base)
        for j in range(k % 20):
            words[(7 * j + k) % 60] = f"new{k}x{j}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, " ".join(f"w{k}y{i}" for i in range(30))) for k in range(10)]
    rows.append((300, "long " * 30_000 + "end"))
    rows.append((301, "long " * 30_001 + "end"))
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, rep string, bands string").repartition(5)
    got = {r["doc_id"]: r for r in near_duplicates(docs, spark, shingle=size).collect()}
    want = dict(zip((i for i, _ in rows), brute_force(rows, size, 80), strict=True))
    sizes = dict(zip((i for i, _ in rows), map(len, shingle_sets(rows, size)), strict=True))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_one_class_larger_than_a_block(spark):
    base = [f"t{i}" for i in range(50)]
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs, spark).filter("component_id = 0").count() == 900


def test_rows_of_one_id_follow_their_texts(spark):
    a, b = ([f"{m}{i}" for i in range(50)] for m in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (8, None), (8, ""), (8, "alone"), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs, spark).collect())
    assert got == sorted((i, c) for (i, _), c in zip(rows, brute_force(rows, 5, 80), strict=True))
    kept = sorted(tuple(r) for r in keep_one(docs.union(docs), spark).filter("length(text) > 0").collect())
    assert kept == sorted([(5, " ".join(a)), (5, " ".join(b)), (8, "alone")])


def test_many_repeated_rows(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(3, " ".join(words))] * 5000 + [(4, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, spark).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(3, 3, 5000), (4, 3, 1)]
    assert [r["doc_id"] for r in keep_one(docs, spark).collect()] == [3]


def test_large_classes_of_several_parts(spark, monkeypatch):
    """Blocks of eight: members of a class that only some others are like."""
    import numpy as np

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rng, rows = np.random.default_rng(3), []
    base = [f"t{i}" for i in range(60)]
    for k in range(240):
        words = list(base)
        for j in rng.choice(60, rng.integers(0, 3), replace=False):
            words[j] = f"n{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, spark, percent=80).collect()}
    want = dict(zip(range(240), brute_force(rows, 5, 80), strict=True))
    assert len(set(want.values())) > 1 and got == want


def test_parts_of_a_large_class_meet(spark):
    """All pairs of different parts are in some unit, and none of the largest part."""
    found = spark.createDataFrame([(k, 1, 10) for k in range(2000)], "rep long, class long, n long")
    large = spark.createDataFrame([(1, 2000, 6)], "class long, n_members long, k int")
    label = spark.createDataFrame([(k, 0 if k < 1200 else 1200 + k % 5) for k in range(1998)], "rep long, component long")
    units, part = {}, {k: 0 if k < 1200 else 1200 + k % 5 if k < 1998 else k for k in range(2000)}
    for r in minhash._apart(found, large, label).collect():
        units.setdefault((r["kind"], r["p"], r["q"]), []).append((r["rep"], r["side"]))
    met = {(min(a, b), max(a, b)) for rows in units.values() for a, x in rows for b, y in rows if x + y < 2 and part[a] != part[b]}
    assert met == {(a, b) for a in range(2000) for b in range(a + 1, 2000) if part[a] != part[b]}


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), spark).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(twice, spark).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}}
    assert components(df.limit(0), Scratch(spark, "test"), "c").count() == 0


def test_runs_of_rows_over_several_batches():
    rows = [(1, 0)] * 2 + [(2, 0)] * 9 + [(2, 1)] + [(3, 1)] * 4
    for size in (1, 2, 3, 5, 16):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.int64()), pa.array([r[1] for r in p], pa.int64())], names=["a", "b"]) for p in [*parts[:2], [], *parts[2:]]]
        assert [t.num_rows for t in minhash.groups(iter(batches), ["a", "b"])] == [2, 9, 1, 4]

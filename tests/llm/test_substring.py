"""Repeated passages against all pairs and planted passages."""

import numpy as np
import pyarrow as pa

from reconweave.llm import substring
from reconweave.llm.words import texts, word_sets


def linked(names, links):
    """The least name of each one's component."""
    up = {n: n for n in names}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        up[b] = a
    return {n: top(n) for n in names}


def paragraphs_of(rows):
    """One row of _features for each paragraph of the texts."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0 for _ in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "th", "text"])
    text = {r["hash"]: r["text"] for b in substring._written([batch]) for r in b.to_pylist()}
    bands = {r["hash"]: r["bands"] for w in substring._written([batch]) for b in substring._banded([w]) for r in b.to_pylist()}
    return [r | {"text": text[r["hash"]], "bands": bands[r["hash"]]} for b in substring._features([batch]) for r in b.to_pylist()]


def test_members_of_a_bucket_meet_each_other(spark, monkeypatch):
    """Paragraphs of one phrase share buckets, but only some are alike."""
    monkeypatch.setattr(substring, "PASSAGE_WORDS", 0)
    rng = np.random.default_rng(5)
    phrase = " ".join(f"p{i}" for i in range(24))
    rows = []
    for k in range(400):
        rows.append((2 * k, " ".join(f"a{x}" for x in rng.integers(0, 10**6, 20)) + f" {phrase} " + " ".join(f"b{x}" for x in rng.integers(0, 10**6, 20))))
        near = rows[-1][1].split()
        near[3], near[-4] = f"c{k}", f"d{k}"
        rows.append((2 * k + 1, " ".join(near)))
    found = paragraphs_of(rows)
    text = {r["hash"]: r["text"] for r in found}
    buckets = {}
    for r in found:
        for b in r["bands"]:
            buckets.setdefault(b, set()).add(r["hash"])
    names = sorted(text)
    values, at = word_sets(texts(pa.array([text[n] for n in names])), substring.SHINGLE)
    sets = {n: set(values[at[i] : at[i + 1]].tolist()) for i, n in enumerate(names)}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= substring.PERCENT * len(sets[a] | sets[b])
    every = [(a, b) for m in buckets.values() for a in m for b in m if a < b and like(a, b)]
    star = [(min(m), b) for m in buckets.values() for b in m if b > min(m) and like(min(m), b)]
    want = linked(names, every)
    assert want != linked(names, star)
    docs = {}  # the documents of each component
    for r in found:
        docs.setdefault(want[r["hash"]], set()).add(r["doc_id"])
    want = {(r["doc_id"], want[r["hash"]], min(docs[want[r["hash"]]])) for r in found if r["doc_id"] != min(docs[want[r["hash"]]])}
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()
    assert {(r["doc_id"], r["component_id"], r["first_doc_id"]) for r in got} == want


def test_a_planted_passage_goes_whole(spark):
    """51 words, in one line and in lines of six words, and a longer run of one word."""
    for seed in range(2):
        rng = np.random.default_rng(seed)
        words = lambda mark, n: [f"{mark}{x}" for x in rng.integers(0, 10**6, n)]
        passage = words("p", 51)
        lines = "\n".join(" ".join(passage[k : k + 6]) for k in range(0, 51, 6))
        one, same, other = " ".join(passage), " ".join(["same"] * 150), " ".join(words("q", 51))
        rows = [(1, f"{' '.join(words('a', 40))}\n{one}\n{' '.join(words('b', 40))}"), (2, f"{' '.join(words('c', 37))} {one} {' '.join(words('d', 45))}")]
        rows += [(3, f"{' '.join(words('e', 9))}\n{lines}\n{' '.join(words('f', 3))}"), (4, one), (5, lines)]
        rows += [(6, f"{' '.join(words('g', 12))} {other} {same} {' '.join(words('h', 12))}"), (7, f"{' '.join(words('i', 12))} {other} {same} {' '.join(words('j', 12))}")]
        got = {r["doc_id"]: r["text"] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
        assert got[1] == rows[0][1] and set(got) == {1, 2, 3, 6, 7}
        assert got[6] == rows[5][1]
        for k, marks in ((2, "cd"), (3, "ef"), (7, "ij")):
            own = [w for w in rows[k - 1][1].split() if w[0] in marks]
            left = got[k].split()
            assert set(left) <= set(own) and len(own) - len(left) <= 5  # a like paragraph may have a few words more


def test_paragraphs_cover_every_word():
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, n))) for k, n in enumerate([1, 2, 4, 5, 9, 10, 11, 25, 400, 3000])] + [(20, "same " * 300), (21, ""), (22, "a\n\nb c")]
    found = paragraphs_of(rows)
    for k, text in rows:
        own = [r for r in found if r["doc_id"] == k]
        assert " ".join(" ".join(r["text"].split()) for r in own) == " ".join(text.split())
        assert [r["word"] for r in own] == [sum(q["n_words"] for q in own[:i]) for i in range(len(own))]
        assert all(r["n_words"] >= substring.LEAST_WORDS for r in own) or len(own) == 1


def test_recall_of_edited_paragraphs(spark, monkeypatch):
    """Links found, against all pairs by exact Jaccard similarity."""
    monkeypatch.setattr(substring, "PASSAGE_WORDS", 0)
    rng, rows = np.random.default_rng(11), []
    for k in range(60):
        base = [f"x{v}" for v in rng.integers(0, 10**6, 400)]
        rows.append((2 * k, " ".join(base)))
        edited = list(base)
        for r in paragraphs_of(rows[-1:]):
            edited[r["word"] + 1] = f"e{r['word']}k{k}"
        rows.append((2 * k + 1, " ".join(edited)))
    found = paragraphs_of(rows)
    names = sorted({r["hash"] for r in found})
    text = {r["hash"]: r["text"] for r in found}
    sets = {n: set(word_sets(texts(pa.array([text[n]])), substring.SHINGLE)[0].tolist()) for n in names}
    by = {}
    for r in found:
        by.setdefault(r["doc_id"] // 2, {}).setdefault(r["doc_id"], set()).add(r["hash"])
    near = {(a, b) for both in by.values() for a in both[min(both)] for b in both[max(both)] if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(near) > 100
    got = {(r["doc_id"], r["component_id"]) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    of = {r["hash"]: r["doc_id"] for r in found}
    caught = sum((max(of[a], of[b]), min(a, b)) in got for a, b in near)
    assert caught >= 0.99 * len(near)


def test_phrases_stay_and_short_copies_go(spark):
    """A phrase of under PASSAGE_WORDS words is no passage; a short document that is a copy goes."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    phrase, lines = words(20), "\n".join(words(20) for _ in range(10))
    rows = [(1, f"{words(50)} {phrase} {words(50)}"), (2, f"{words(50)} {phrase} {words(50)}"), (3, "thank you"), (4, "Thank you"), (5, lines), (6, lines.replace("\n", "\n\n")), (7, None), (8, "")]
    out = {r["doc_id"]: r["text"] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    assert set(out) == {1, 2, 3, 5, 7, 8} and out[2] == rows[1][1]


def test_rows_of_one_id_are_cut_by_their_own_text(spark):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    passage, other = words(60), words(200)
    rows = [(1, f"{words(30)} {passage}", "a"), (2, f"{words(30)} {passage} {words(30)}", "b"), (2, other, "c"), (2, other, "d")]
    out = [r for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, word string"), spark).collect() if r["doc_id"] == 2]
    assert sorted(r["word"] for r in out) == ["b", "c", "d"]
    assert all(r["text"] == other for r in out if r["word"] != "b") and len([r for r in out if r["word"] == "b"][0]["text"].split()) <= 60

"""Toxicity: the decoder against all paths, and scores on small fixtures."""

import itertools
import random

import numpy as np
import pyarrow as pa

from reconweave.llm import toxicity as T

WORDS = "the river runs past a quiet mill where people gather on market days to trade bread and talk about weather".split()
BAD = ["idiot", "scoundrel"]


def corpus(n=240):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(30)]
        if i % 3 == 0:
            for w in BAD:
                words[rng.randrange(30)] = w
        docs.append((i, " ".join(words) + f" tail{i}"))
        labels.append((i, 0, int(i % 3 == 0)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, score double, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def readings(raw, i=0):
    """All (letters, cost) of the lattice from i on, step by step."""
    if i == len(raw):
        yield "", 0.0
        return
    end = i
    while end < len(raw) and raw[end] == raw[i]:
        end += 1
    kind = T._class(raw[i])
    steps = {(i + 1, raw[i], 0.0)}
    if kind not in (0, 27) and end - i > 1:
        steps.add((end, raw[i], T.RUN))
        if end - i > 2:
            steps.add((end, raw[i] * 2, T.RUN))
    for c in T.LOOK_ALIKE.get(raw[i], ""):
        steps |= {(i + 1, c, T.SIGN)} | ({(end, c, T.SIGN + T.RUN)} if end - i > 1 else set())
    if kind == 0 and raw[i] not in T.LOOK_ALIKE and 0 < i < len(raw) - 1:
        steps.add((i + 1, "", T.GAP))
    for to, letters, cost in steps:
        for rest, more in readings(raw, to):
            yield letters + rest, cost + more


def test_decoder_finds_the_best_of_all_readings():
    rng = np.random.default_rng(2)
    log_p = np.log(rng.dirichlet(np.ones(29) * 0.3, (29, 29, 29)) + 1e-9).astype(np.float32)
    decoder = T.Decoder(log_p)

    def cost(letters):
        c = [0, 0, 0, *(T._class(x) for x in letters), 0]
        return -sum(float(log_p[tuple(c[k : k + 4])]) for k in range(len(c) - 3))

    for raw in ["1d10t", "sstu", "a.b-c", "$$o0", "i d i", "x", "*b*", "éé1", "aaa", *("".join(p) for p in itertools.product("a1.", repeat=4))]:
        best = min(c + cost(letters) for letters, c in readings(raw))
        got = decoder.restore(raw)
        assert min(c for letters, c in readings(raw) if letters == got) + cost(got) <= best + 1e-3, raw
    assert decoder.restore("") == ""


def test_restored_scored_and_held_out(spark):
    docs, labels = frames(spark)
    model = T.train(docs, labels, spark)
    odd = [
        (1, "people gather on 1d10t days to trade sc0undre1 bread"), (2, "the i d i o t and the s.c.o.u.n.d.r.e.l"), (3, "an idiooot scoundrrrrel here"), (4, "the river runs past a quiet mill"), (5, None), (6, ""), (7, "12 34 !!"),
        (8, "the river " * 40_000 + "1diot sc0undrel"), (8, "the quiet mill"), (9, "IDIOT, Scoundrel!"), (None, "market days"), (10, "z" * 50_000),
    ]
    got = T.score(spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, predicted int"), model, spark)
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = [(r["doc_id"], r["predicted"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 0), (8, 1), (8, 0), (9, 1), (None, 0), (10, 0)], key=str)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.collect())
    restored = {r["doc_id"]: r["restored"] for r in T.restore(spark.createDataFrame(odd[:3] + odd[4:6], "doc_id long, text string"), model.log_p, spark).collect()}
    assert "idiot" in restored[1] and "idiot" in restored[2] and "scoundrel" in restored[3] and restored[5] is None and restored[6] == ""


def test_labels_that_teach_nothing(spark):
    docs, labels = frames(spark)
    shares = [r["score"] for r in T.score(docs.limit(3), T.train(docs, labels.filter("toxic = 0"), spark), spark).collect()]
    assert len(shares) == 3 and max(shares) == min(shares) < 0.05
    assert [r["score"] for r in T.score(docs.limit(1), T.train(docs.limit(0), labels, spark), spark).collect()] == [0.5]
    assert T.score(docs.limit(0), T.train(docs, labels.limit(0), spark), spark).collect() == []
    odd = spark.createDataFrame([(0, 1, 0), (3, 1, None), (None, 0, 1), (6, 1, 7)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels.unionByName(odd), spark)  # one id has both labels
    assert T.score(docs.filter("doc_id % 3 = 0"), model, spark).filter("predicted = 0").count() == 0
    held = docs.filter(T.held_out()).select("doc_id")
    flipped = labels.join(held, "doc_id").selectExpr("doc_id", "quality", "1 - toxic as toxic").unionByName(labels.join(held, "doc_id", "left_anti"))
    a, b = (sorted(map(tuple, T.score(docs, T.train(docs, y, spark), spark).collect())) for y in (labels, flipped))
    assert a == b  # labels held out change nothing


def test_near_copies_count_once(spark):
    docs, labels = frames(spark)
    copies = spark.createDataFrame([(1000 + i, "scandinavian crockery with an idiot and a scoundrel " * 8 + f"end{i}", 1.0, "x") for i in range(60)], docs.schema)
    every = docs.unionByName(copies)
    model = T.train(every, labels.unionByName(copies.selectExpr("doc_id", "1 quality", "1 toxic")), spark)
    got = T.score(spark.createDataFrame([(1, "scandinavian crockery on market days"), (2, "an idiot and a scoundrel")], "doc_id long, text string"), model, spark)
    assert {r["doc_id"]: r["predicted"] for r in got.collect()} == {1: 0, 2: 1}


def test_entries_of_restored_words():
    log_p = np.full((29,) * 4, np.log(1 / 29), np.float32)
    reader = T.Reader(log_p)
    doc, word, value = reader.entries(pa.array(["plain words", "", "...", "plain words, a"]))
    assert set(value[doc == 0]) < set(value[doc == 3]) and set(doc) == {0, 3}
    assert len(reader.entries(pa.array([""]))[0]) == 0

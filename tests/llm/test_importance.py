"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from reconweave.llm import importance


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def brute(docs, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for text in (d[1] for d in docs):
        for f in features(text)[0]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text)[0]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * float(sum(s) + buckets) / ((s[k] + 1) * float(sum(t) + buckets)))) for k in range(buckets)]
    out = []
    for i, text in docs:
        f, n = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = [r for r in out if r[0] is not None and r[5] >= least]
    for k, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0], -r[2], r[1]))[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def cases():
    rng = random.Random(3)
    words = ["the", "The", "naïve", "x" * 200, "Ünder", "a1", "9", "中文", "é", "zebra-crossing", "it's", "b" * 48, "c" * 49]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(400)]
    docs += [(None, "null id " * 30), (500, None), (501, ""), (502, " .,-"), (503, "one"), (7, docs[7][1]), (7, "other text " * 15), (504, "long " * 60_000 + "tail"), (505, "y" * 100_000)]
    docs += [(600 + i, "the same copy of a text " * 5) for i in range(200)]
    return docs, ["the naïve zebra", None, "", "a1 9 中文 " * 3, "x" * 200 + " the"]


def test_trie_states_are_crcs():
    docs, _ = cases()
    texts = [t for _, t in docs]
    trie = importance.grow(pa.array(texts[:420], pa.string()).fill_null(""))
    want = {}
    for t in texts[:420]:
        for f in features(t)[0]:
            want[zlib.crc32(f.encode())] = want.get(zlib.crc32(f.encode()), 0) + 1
    got = {}
    for state, n in [*zip(trie.word_state.tolist(), trie.word_count.tolist()), *zip(trie.pair_state.tolist(), trie.pair_count.tolist())]:
        got[state] = got.get(state, 0) + n
    assert got == want


def test_resample_equals_brute_force(spark):
    docs, target = cases()
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in docs], "doc_id long, text string, rank string, score int, n_words int").repartition(7)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    for percent in (25, 100):
        got = importance.resample(df, goal, spark, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, percent)
    assert all(r["rank"] is None for r in importance.resample(df, goal, spark, percent=0).collect())


def test_empty_tables(spark):
    docs, target = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert importance.resample(df.limit(0), goal, spark).collect() == []
    assert sorted((tuple(r) for r in importance.resample(df, goal.limit(0), spark).collect()), key=repr) == brute(docs, [])

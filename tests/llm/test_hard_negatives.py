"""Hard negatives against brute force."""

import math

import numpy as np

from reconweave.llm import hard_negatives


def brute(rows, positives=5, negatives=10):
    fine = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for k, (i, q, y) in enumerate(fine):
        if i % 100:
            continue
        others = [(sum(a * b for a, b in zip(q, r[1])), r[0], r[2]) for j, r in enumerate(fine) if j != k and len(r[1]) == len(q)]
        others.sort(key=lambda r: (-r[0], r[1]))
        for p in [r for r in others if r[2] == y][:positives]:
            far = [r for r in others if r[2] != y and 30 * p[0] <= 100 * r[0] <= 90 * p[0]][:negatives]
            out += [(i, p[1], n + 1, r[1], p[0], r[0]) for n, r in enumerate(far)]
    return sorted(out)


def cases(n=900, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (10, 8))
    rows = [(i, (centres[i % 10] + rng.normal(0, 0.2, 8)).tolist(), int(i % 10)) for i in range(n)]
    rows += [(i, centres[3].tolist(), int(i % 4)) for i in range(n, n + 150)]  # copies: ties
    rows += [(100, rows[100][1], 0), (200, [0.0] * 8, 2), (300, [-x for x in rows[300][1]], 3)]  # repeated ids
    rows += [(-100, rows[5][1], 5), (2000, None, 1), (2100, [1.0, None] + [0.0] * 6, 1), (2200, [math.nan] * 8, 1), (2300, [math.inf] * 8, 1), (2400, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(3000 + i, [1.0, float(i)], i % 2) for i in range(12)] + [(4000, [2.0] * 5, 1), (4100, [], 1), (4101, [], 2)]  # other lengths
    rows += [(5000 + i, [1e6 * (i + 1), 1e6, 3.0], i % 3) for i in range(9)]  # products beyond 2**53
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank int, score string")


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = cases()
    want = brute(rows)
    assert len(want) > 100
    got = hard_negatives.mine(frame(spark, rows).repartition(5), spark)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 64)  # many parts and rounds
    monkeypatch.setattr(hard_negatives, "ROUND_VALUES", 60)
    assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows[:400] + rows[-30:]), spark).collect()) == brute(rows[:400] + rows[-30:])


def test_empty_tables(spark):
    rows = cases()
    assert hard_negatives.mine(frame(spark, rows).limit(0), spark).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), spark).collect() == []  # no anchor
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1), (2, [1.0], 2)]), spark).collect() == []  # no positive


def test_tree_bounds_and_pruning():
    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(0, 100, (2000, 6)) + 400 * rng.integers(-1, 2, (2000, 1)))
    order, nodes = hard_negatives.ball_tree(q, np.zeros(2000, np.int64))
    assert sorted(order) == list(range(2000)) and sorted(nodes["end"][nodes["inner"] == 0] - nodes["start"][nodes["inner"] == 0])[-1] <= hard_negatives.LEAF_ROWS
    a = rng.normal(0, 100, 6)
    for s, e, r, c in zip(nodes["start"], nodes["end"], nodes["radius"], nodes["centre"]):
        p, reach = q[order[s:e]] @ a, np.linalg.norm(a) * r + 1e-6
        assert p.max() <= c @ a + reach and p.min() >= c @ a - reach

"""Hard-negative mining by ball-tree branch and bound.

Vectors are dealt evenly into parts; each part is a ball tree, built once and written.
A ball of centre c and radius r bounds the inner product of a with all of its rows on
both sides: a.c - |a| r and a.c + |a| r.  A search goes down the tree with all
questions that are still open and drops a question at a node whose bounds lie outside
its score window or strictly beneath its current k-th best.

Anchors are searched in rounds of bounded bytes: the round's vectors are broadcast and
every part answers with its k best.  About the square root of the parts go first; what
they find is the floor from which the other parts start, so those send few rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch

#: Rows of a part and of a leaf; components of a part; components of the anchors of a round.
PART_ROWS, LEAF_ROWS, PART_VALUES, ROUND_VALUES = 8192, 128, 2_000_000, 1_000_000
#: Anchors that go down a tree together.
TOGETHER = 512
_IN_PART = 1 << 20  # rows of a part, at most, in the row numbers


def ball_tree(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the rows in the leaves, and the nodes: each child's rows are half of its parent's."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1)]
    while todo:
        a, b, parent = todo.pop()
        own = x[order[a:b]]
        centre = own.mean(axis=0)
        radius = math.sqrt(float(((own - centre) ** 2).sum(axis=1).max()))
        of = labels[order[a:b]]
        nodes.append([a, b, parent, 0, radius, of.min(), of.max(), centre])
        if b - a > LEAF_ROWS:
            first = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
            last = own[((own - first) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (last - first), half)]
            todo += [(a, a + half, len(nodes) - 1), (a + half, b, len(nodes) - 1)]
            nodes[-1][3] = 1
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return order, dict(zip(("start", "end", "parent", "inner", "radius", "least", "most", "centre"), columns, strict=True))


def _pack(part: int, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> tuple:
    order, nodes = ball_tree(q, labels)
    whole = np.clip(q[order], -(2.0**62), 2.0**62).astype(np.int64)
    small = whole.astype(np.int32)
    out = io.BytesIO()
    np.savez(out, ids=ids[order], labels=labels[order], q=small if np.array_equal(small, whole) else whole, **nodes)
    return part, q.shape[1], int(np.count_nonzero(ids % 100 == 0)), out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of the rows of a partition, by the vectors' length."""
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 24, 0
    held: dict[int, list] = {}

    def emit(dim: int) -> pa.RecordBatch:
        nonlocal made
        ids, labels, q = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
        made += 1
        return pa.RecordBatch.from_pylist([dict(zip(("part", "dim", "anchors", "tree"), _pack(base + made, ids, labels, q), strict=True))], schema=pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("anchors", pa.int64()), ("tree", pa.binary())]))

    for batch in batches:
        column = batch.column("embedding")
        size = np.diff(column.offsets.to_numpy()).astype(np.int64)
        x = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null component is not a number
        at = np.concatenate([[0], np.cumsum(size)])
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        fine = odd[at[1:]] == odd[at[:-1]]
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
        for dim in np.unique(size[fine]).tolist():
            rows = np.flatnonzero(fine & (size == dim))
            most = max(1, min(PART_ROWS, PART_VALUES // max(dim, 1)))
            q = x[at[rows][:, None] + np.arange(dim)]
            for k in range(0, len(rows), most):
                held.setdefault(dim, []).append((ids[rows[k : k + most]], labels[rows[k : k + most]], q[k : k + most]))
                if sum(len(h[0]) for h in held[dim]) >= most:
                    yield emit(dim)
    for dim in list(held):
        yield emit(dim)


@dataclass
class Asks:
    """The questions of a round: `windows` for each anchor, in the anchors' order."""

    rid: np.ndarray
    anchor_id: np.ndarray
    label: np.ndarray
    dim: np.ndarray
    vectors: list[np.ndarray]
    same: bool
    k: int
    windows: int
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray


class _Best:
    """The k best rows of each question so far, and each question's k-th score."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.kth = k, floor.copy()
        self.rows = np.zeros((4, 0), np.int64)  # question, score, vec_id, row
        self.new: list[np.ndarray] = []

    def offer(self, found: np.ndarray) -> None:
        if found.shape[1]:
            self.new.append(found)
            if sum(x.shape[1] for x in self.new) * 2 >= self.rows.shape[1]:
                self.settle()

    def settle(self) -> None:
        if self.new:
            every = np.concatenate([self.rows, *self.new], axis=1)
            self.new = []
            every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
            first = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1]]))
            place = np.arange(every.shape[1]) - np.repeat(first, np.diff(np.append(first, every.shape[1])))
            self.rows = every[:, place < self.k]
            full = every[:, place == self.k - 1]
            self.kth[full[0]] = np.maximum(self.kth[full[0]], full[1])


def _inner(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number inner products: floats where they are exact, else 64-bit integers."""
    if rows.size and vectors.size and float(np.abs(rows).max()) * float(np.abs(vectors).max()) * rows.shape[1] >= 2.0**53:
        return rows.astype(np.int64) @ vectors.T
    return (rows.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)


def search(tree: dict[str, np.ndarray], part: int, asks: Asks, mine: np.ndarray, best: _Best) -> None:
    """Offers `best` what the part has for the anchors `mine`; questions count from 0 in the order of mine."""
    vectors = np.stack([asks.vectors[i] for i in mine])
    w = asks.windows
    of = np.repeat(np.arange(len(mine)), w)
    low, high = (x[mine].ravel() for x in (asks.low, asks.high))
    label, rid = asks.label[mine], asks.rid[mine]
    v = vectors.astype(np.float64)
    length = np.sqrt((v**2).sum(axis=1))
    middle = v @ tree["centre"].T
    reach = length[:, None] * tree["radius"]
    slack = 1e-9 * (length[:, None] * np.sqrt((tree["centre"] ** 2).sum(axis=1)) + reach) + 0.01
    up, down = middle + reach + slack, middle - reach - slack
    able = (tree["least"] <= label[:, None]) & (label[:, None] <= tree["most"]) if asks.same else (tree["least"] != label[:, None]) | (tree["most"] != label[:, None])
    children: dict[int, list[int]] = {}
    for node, parent in enumerate(tree["parent"].tolist()):
        children.setdefault(parent, []).append(node)
    todo = [(0, np.arange(len(of)))]
    while todo:
        node, open_ = todo.pop()
        a = of[open_]
        open_ = open_[able[a, node] & (up[a, node] >= np.maximum(low[open_], best.kth[open_])) & (down[a, node] <= high[open_])]
        if not len(open_):
            continue
        a = of[open_]
        if tree["inner"][node]:
            todo += [(c, open_) for c in sorted(children[node], key=lambda c: up[a, c].sum())]  # the likelier child is taken first
            continue
        rows = np.arange(tree["start"][node], tree["end"][node])
        each, back = np.unique(a, return_inverse=True)
        score = _inner(tree["q"][rows], vectors[each])[:, back]
        own = tree["labels"][rows][:, None]
        hit = (score >= np.maximum(low[open_], best.kth[open_])) & (score <= high[open_]) & ((own == label[a]) if asks.same else (own != label[a]))
        i, j = np.nonzero(hit)
        row = part * _IN_PART + rows[i]
        other = row != rid[a[j]]
        i, j, row = i[other], j[other], row[other]
        best.offer(np.stack([open_[j], score[i, j], tree["ids"][rows[i]], row]))
    best.settle()


def _answers(asks) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asks = asks.value
        best: dict[tuple[int, int], tuple[np.ndarray, _Best]] = {}
        for batch in batches:
            for part, dim, blob in zip(batch.column("part").to_pylist(), batch.column("dim").to_pylist(), batch.column("tree"), strict=True):
                tree, alike = _unpack(blob.as_py()), np.flatnonzero(a.dim == dim)
                for k in range(0, len(alike), TOGETHER):
                    mine = alike[k : k + TOGETHER]
                    if (dim, k) not in best:
                        best[dim, k] = (mine, _Best(a.k, a.floor[mine].ravel()))
                    search(tree, part, a, mine, best[dim, k][1])
        for mine, found in best.values():
            q, score, vec_id, row = found.rows
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mine[q // a.windows], q % a.windows, score, vec_id, row)], names=["ask", "window", "score", "vec_id", "row"])

    return run


_FOUND = "ask long, window long, score long, vec_id long, row long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_of(parts: DataFrame, stride: int, asks: Asks, scratch: Scratch, name: str) -> DataFrame:
    """The k best rows of every question over all parts; the first parts set the others' floor."""
    spark = scratch.spark
    if not (asks.low <= asks.high).any():
        return spark.createDataFrame([], f"{_FOUND}, rank int")

    def over(some: DataFrame) -> DataFrame:
        return some.select("part", "dim", "tree").mapInArrow(_answers(spark.sparkContext.broadcast(asks)), _FOUND)  # ROUND_VALUES components and one part's anchors at most

    # the part number mixes partition and place, so a hash of it deals the first parts over all files
    first = F.pmod(F.xxhash64("part"), F.lit(stride)) == 0
    found = scratch.write(_ranked(over(parts.filter(first)), asks.k), f"{name}-first")
    if stride > 1:
        last = found.filter(F.col("rank") == asks.k).select("ask", "window", "score").toPandas()
        asks.floor[last["ask"], last["window"]] = last["score"]
        found = _ranked(over(parts.filter(~first)).unionByName(found.drop("rank")), asks.k)
    return found


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("tree"), strict=True):
            tree = _unpack(blob.as_py())
            on = np.flatnonzero(tree["ids"] % 100 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(part * _IN_PART + on), pa.array(tree["ids"][on]), pa.array(tree["labels"][on]), pa.array([x.astype(np.int64).tobytes() for x in tree["q"][on]], pa.binary())], names=["rid", "anchor_id", "label", "vector"])


def _rounds(sizes: list[tuple[int, int, int]]) -> Iterator[list[int]]:
    """Parts whose anchors are searched together, from (part, dim, anchors)."""
    parts, values = [], 0
    for part, dim, n in sizes:
        if parts and values + n * max(dim, 1) > ROUND_VALUES:
            yield parts
            parts, values = [], 0
        parts.append(part)
        values += n * max(dim, 1)
    if parts:
        yield parts


def mine(vectors: DataFrame, spark: SparkSession, *, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored.
    Rows with a null vec_id, label or vector, or a null or non-finite component, take
    no part.  Where vec_id is divisible by 7 the label first becomes (label + 1) % 10.
    Anchors are rows whose vec_id is divisible by 100; a row's score is the inner
    product of floor(256 x) with the anchor's.  An anchor's positives are its best
    other rows of its label; a positive's negatives are the best rows of other labels
    with 30 * positive_score <= 100 * negative_score <= 90 * positive_score.  Ties go
    to the smaller vec_id.  Rows that repeat are rows of their own: a copy of the
    anchor is another row, and a repeated anchor has rows of its own in the result.
    Vectors meet those of their own length only.  Scores are exact within 64 bits.  A
    positive without a negative, an anchor without a positive and an empty table give
    no rows.
    """
    scratch = Scratch(spark, "hard-negatives")
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null")
    count = max(1, math.ceil(vectors.count() / PART_ROWS))
    parts = scratch.write(rows.repartition(count).mapInArrow(_parts, "part long, dim int, anchors long, tree binary"), "parts")
    stride = max(1, math.isqrt(count))

    sizes = [tuple(r) for r in parts.filter("anchors > 0").select("part", "dim", "anchors").orderBy("dim", "part").collect()]  # a row for each part
    for n, some in enumerate(_rounds(sizes)):
        got = parts.filter(F.col("part").isin(some)).select("part", "tree").mapInArrow(_anchors, "rid long, anchor_id long, label long, vector binary").toPandas()
        vectors_ = [np.frombuffer(x, np.int64) for x in got["vector"]]
        shape = (len(got), 1)
        lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        asks = Asks(got["rid"].to_numpy(), got["anchor_id"].to_numpy(), got["label"].to_numpy(), np.array([len(x) for x in vectors_]), vectors_, True, positives, 1, np.full(shape, lowest), np.full(shape, highest), np.full(shape, lowest))
        near = _best_of(parts, stride, asks, scratch, f"near-{n}").select("ask", "rank", "vec_id", "score").toPandas()  # `positives` rows for each anchor of the round

        shape = (len(got), positives)
        low, high = np.ones(shape, np.int64), np.zeros(shape, np.int64)
        positive_id, positive_score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        near = near.astype(np.int64)
        at, score = (near["ask"].to_numpy(), near["rank"].to_numpy() - 1), near["score"].to_numpy()
        positive_id[at], positive_score[at] = near["vec_id"], score
        low[at], high[at] = [-((-30 * int(s)) // 100) for s in score], [90 * int(s) // 100 for s in score]
        asks.same, asks.k, asks.windows, asks.low, asks.high, asks.floor = False, negatives, positives, low, high, np.full(shape, lowest)
        found = _best_of(parts, stride, asks, scratch, f"far-{n}")
        pairs = spark.createDataFrame(pa.table({"ask": at[0], "window": at[1], "anchor_id": asks.anchor_id[at[0]], "positive_id": positive_id[at], "positive_score": score}))
        out = found.join(F.broadcast(pairs), ["ask", "window"])  # as many rows as `near`
        scratch.write(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"mined/{n}")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(scratch.path("mined")) if sizes else spark.createDataFrame([], schema)

"""Packing of token pieces into sequences by minimum bin slack.

Only the histogram of piece lengths (at most `capacity` rows) is packed on the
driver.  Each bin takes the longest piece that is left and then, by a bitset
subset-sum over the lengths that are left, the fullest feasible combination; a
combination is taken as often as its lengths allow, so each round uses up a
length.  The plan (which ranks of a length go to which bins) is bounded by the
number of lengths, and Spark gives every piece its rank and so its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.llm.bpe import Encoder
from reconweave.llm.scratch import Scratch
from reconweave.llm.words import slices, texts


def _fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths left with the largest sum up to room."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, times = min(left[length], room // length), 1
        while copies:
            times = min(times, copies)
            new = (reach | (reach << (length * times))) & mask
            if new != reach:
                steps.append((length, times, reach))
                reach = new
            copies -= times
            times *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + times
            total -= length * times
    return out


def bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; number of such bins) for all pieces."""
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        take = _fullest(rest, capacity - longest)
        take[longest] = take.get(longest, 0) + 1
        times = min(left[k] // n for k, n in take.items())
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append(([k for k in sorted(take, reverse=True) for _ in range(take[k])], times))
    return out


def places(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks: key (length << 40 | first rank), first sequence, offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for k in lengths:
            rank = used.get(k, 0)
            rows.append(((k << 40) | rank, sequence, offset))
            used[k] = rank + times
            offset += k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                ids, at = encoder.encode(column.slice(a, b - a))
                ids = np.insert(ids, at[1:], end_id).astype("<u4", copy=False)
                at = at + np.arange(len(at))
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                first = at[:-1][doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * i : 4 * (i + m)]) for i, m in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(table: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str]) -> Callable:
    key, sequence, offset = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (batch.column("length").to_numpy() << 40) | batch.column("_rank").to_numpy()
            k = np.searchsorted(key, own, "right") - 1
            made = [pa.array(sequence[k] + own - key[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """pieces (a written table; length and more columns) with sequence_id and offset.

    Pieces of one length are ranked in two steps, within hash buckets of the row and
    over the buckets' counts, so that a length which a third of all pieces have is
    not one task.
    """
    names = pieces.columns
    plan = bins({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    if not plan:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    parts = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*names)))
    ranked = within.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_rank").mapInArrow(_place(places(plan), names), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, spark: SparkSession, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A document is the ids of its text (null: empty) and end_id; one longer than
    capacity is cut into pieces of capacity ids and a rest.  Other columns are
    ignored, repeated rows are documents of their own, an empty table gives none.
    """
    s = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return pack(s.write(made, "pieces"), s, capacity)

"""Shards of near-equal bytes by a k-d tree over metadata.

A node that must become k shards is split along its widest dimension at the
weighted median (or the weight share that k asks for) of its rows.  All nodes of
one level are split together: histograms of the node's weight over 10 bits of the
coordinate at a time, refined within the bin that holds the median, find it without
sorting.  Ties of a coordinate go on by a hash of the text and of the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch

BITS, ROUNDS = 10, 3
WIDTH = 1 << (BITS * ROUNDS)


@dataclass
class Node:
    name: int
    shards: int
    bytes: int
    dimension: int | None = None


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus one for the end of the document."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def coordinates() -> list[Column]:
    """Metadata dimensions, each from 0 to WIDTH - 1: log size, language, host."""
    log = F.floor(F.log2(F.col("size")) * (WIDTH / 48))
    return [F.least(log, F.lit(WIDTH - 1)).cast("long")] + [F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(WIDTH)) for c in ("lang", "source")]


def _picked(nodes: list[Node], values: dict[int, Column], default: Column) -> Column:
    out = default
    for n in nodes:
        out = F.when(F.col("node") == n.name, values[n.name]).otherwise(out)
    return out


def _cuts(rows: DataFrame, nodes: list[Node], key: Column, share: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each node, the value of key that holds byte `share`, and the bytes before it."""
    found = {n.name: (0, 0) for n in nodes}
    for k in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - k)
        high = F.shiftright(key, shift + BITS)
        inside = _picked(nodes, {n.name: high == found[n.name][0] for n in nodes}, F.lit(False))
        bins = rows.filter(inside).groupBy("node", F.shiftright(key, shift).alias("bin")).agg(F.sum("size").alias("w")).collect()  # 2**BITS a node
        for n in nodes:
            prefix, before = found[n.name]
            own = sorted((r["bin"], r["w"]) for r in bins if r["node"] == n.name)
            at = own[-1][0]
            for b, w in own:
                if before + w > share[n.name]:
                    at = b
                    break
                before += w
            else:
                before -= own[-1][1]
            found[n.name] = (at, before)
    return found


def assign(docs: DataFrame, spark: SparkSession, *, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """docs' doc_id with size, text_crc32 and shard.

    shards, or else as many as leaves of target_bytes take.  A leaf's bytes differ
    from its share by less than its largest rows.
    """
    s = Scratch(spark, "kd-shards")
    meta = docs.select("doc_id", "lang", "source", size_of().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    dims = coordinates()
    own = meta.select("doc_id", "size", "text_crc32", *(c.alias(f"x{i}") for i, c in enumerate(dims)))
    own = own.withColumn("t0", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(WIDTH))).withColumn("t1", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(WIDTH)))
    rows = s.write(own.withColumn("node", F.lit(0)), "level-0")
    names = [f"x{i}" for i in range(len(dims))]
    total = rows.agg(F.sum("size")).first()[0] or 0
    k = shards or max(1, -(-total // target_bytes))
    live, leaves, last, level = [Node(0, k, total)], [], 0, 0
    while any(n.shards > 1 for n in live) and total:
        split = [n for n in live if n.shards > 1]
        leaves += [n for n in live if n.shards == 1]
        level += 1
        spread = {r["node"]: [r[f"hi{i}"] - r[f"lo{i}"] for i in range(len(names))] for r in rows.groupBy("node").agg(*(e for i, c in enumerate(names) for e in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")))).collect()}
        for n in split:
            width = spread.get(n.name, [0] * len(names))
            n.dimension = max(range(len(names)), key=lambda i: (width[i], -i))
        present = [n for n in split if n.name in spread]
        share = {n.name: n.bytes * (n.shards // 2) // n.shards for n in present}
        at = _picked(split, {n.name: F.col(names[n.dimension]) for n in split}, F.lit(0))
        # The weighted median of the coordinate, then of its two tie-breaks among the rows at it.
        cut: dict[int, list[int]] = {n.name: [] for n in present}
        left = {n.name: 0 for n in present}
        among = rows
        for key in (at, F.col("t0"), F.col("t1")):
            found = _cuts(among, present, key, {m: share[m] - left[m] for m in share})
            for m, (value, before) in found.items():
                cut[m].append(value)
                left[m] += before
            among = among.filter(_picked(present, {m: key == found[m][0] for m in found}, F.lit(False)))
        below = {}
        for n in present:
            a, b, c = cut[n.name]
            x = F.col(names[n.dimension])
            below[n.name] = (x < a) | ((x == a) & ((F.col("t0") < b) | ((F.col("t0") == b) & (F.col("t1") < c))))
        moved, ahead = {}, []
        for n in split:
            low, high = Node(last + 1, n.shards // 2, left.get(n.name, 0)), Node(last + 2, n.shards - n.shards // 2, n.bytes - left.get(n.name, 0))
            last += 2
            ahead += [low, high]
            if n.name in below:
                moved[n.name] = F.when(below[n.name], F.lit(low.name)).otherwise(F.lit(high.name))
        rows = s.write(rows.withColumn("node", _picked(present, moved, F.col("node"))), f"level-{level}")
        s.drop(f"level-{level - 1}")
        live = ahead
    order = {n.name: i for i, n in enumerate([*leaves, *live])}
    shard = F.lit(0)
    for name, i in order.items():
        shard = F.when(F.col("node") == name, F.lit(i)).otherwise(shard)
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))


def with_slots(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """rows with slot: gapless from 0 in each shard, in the order of hash buckets and doc_id.

    Rows are numbered within (shard, bucket) and the buckets' counts are summed, so
    no task holds a shard.
    """
    s = Scratch(spark, "kd-slots")
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = s.write(rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(parts)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")))
    out = within.join(F.broadcast(before), ["shard", "_b"])  # shards x parts rows
    return out.withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_b", "_in", "_before")


def shard(docs: DataFrame, spark: SparkSession, *, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    docs: doc_id, text, lang, source; nulls of the metadata are values of their own,
    a null text has size 1.  law is `bytes`: shards have near-equal bytes, so a group
    of equal rows may span shards; grown_shard is null.  Repeated rows are rows of
    their own; an empty table gives none.
    """
    rows = with_slots(assign(docs, spark, shards=shards, target_bytes=target_bytes), spark)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch


#: Parts that the neighbours of one node are dealt to when they meet its least one.
SALT = 16


def _to_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with m of u's row in least; a node with many neighbours is SALT keys."""
    parts = F.array(*(F.lit(k) for k in range(SALT)))
    dealt = rows.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    return dealt.join(least.withColumn("_s", F.explode(parts)), ["u", "_s"]).drop("_s")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _to_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _to_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component: its least node.

    edges: two columns of longs, u and v.  Loops and repeated edges are allowed;
    no edges give no rows.  Every round is a written table, so lineage stays
    short and a lost executor costs a round at most.
    """
    state, before = scratch.write(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-0"), None
    for k in range(1, most_rounds + 1):
        state = scratch.write(_small_star(_large_star(state)), f"{name}-{k}")
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{k - 1}")
        if now == before or not now["n"]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

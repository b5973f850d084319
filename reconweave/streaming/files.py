"""Files as they arrive: what each is, whether its content was seen before, and what a period has.

A stream of files keeps one small state for each client and content: the first file
that had it.  Every later one is named with it, in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "client string, period string, slot string, file string, hash string, first_file string"


def named(files: DataFrame, path: str = "path") -> DataFrame:
    """client, period, slot, file, hash of files below .../client/period/slot/file; hash of content where there is such a column."""
    parts = F.split(F.regexp_replace(F.col(path), r"^[a-zA-Z0-9]+:/*", "/"), "/")
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    own = F.sha2(F.col("content"), 256) if "content" in files.columns else F.col("hash")
    return files.select(at(4).alias("client"), at(3).alias("period"), at(2).alias("slot"), at(1).alias("file"), own.alias("hash"))


def _remembered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first: Any = state.get[0] if state.exists else None
    for f in frames:
        f = f.sort_values(["period", "slot", "file"], kind="stable")
        seen = []
        for place in f["period"].fillna("") + "/" + f["slot"].fillna("") + "/" + f["file"].fillna(""):
            seen.append(first)
            first = first or place
        yield f.assign(first_file=seen)[["client", "period", "slot", "file", "hash", "first_file"]]
    state.update((first,))


def with_uploads_seen(files: DataFrame) -> DataFrame:
    """files (of named(), a stream) with first_file: the place of the first file of the client with the same content, null if it is the first.

    Of files with one content in one batch the least by period, slot and name is the first.
    """
    return files.groupBy("client", "hash").applyInPandasWithState(_remembered, _OUT, "first string", "append", GroupStateTimeout.NoTimeout)


def note_uploads(batch: DataFrame, n: int, root: str) -> None:
    """Batch n of a stream of files with first_file, as with_uploads_seen() gives it, below root/seen; firsts that are new below root/first.

    For many files of one content, or many contents: rows meet the firsts of earlier
    batches in a join.  A batch that is tried again reads only those and writes the same place.
    """
    spark, text = batch.sparkSession, lambda c: F.coalesce(F.col(c), F.lit(""))
    at = F.concat_ws("/", text("period"), text("slot"), text("file"))
    own = Window.partitionBy("client", "hash").orderBy(*(F.asc_nulls_last(c) for c in ("period", "slot", "file")))
    rows = batch.select("client", "period", "slot", "file", "hash").withColumns({"_at": at, "_n": F.row_number().over(own), "_own": F.first(at).over(own)})
    old = [f"{root}/first/batch={k}" for k in range(n)]
    if old:
        known = spark.read.schema("_client string, _hash string, _first string").parquet(*old)
        rows = rows.join(known, F.col("client").eqNullSafe(F.col("_client")) & F.col("hash").eqNullSafe(F.col("_hash")), "left").drop("_client", "_hash")
    else:
        rows = rows.withColumn("_first", F.lit(None).cast("string"))
    out = rows.withColumn("first_file", F.coalesce("_first", F.when(F.col("_n") > 1, F.col("_own"))))
    out.drop("_at", "_n", "_own", "_first").write.mode("overwrite").parquet(f"{root}/seen/batch={n}")
    new = rows.filter("_n = 1 and _first is null").select(F.col("client").alias("_client"), F.col("hash").alias("_hash"), F.col("_at").alias("_first"))
    new.write.mode("overwrite").parquet(f"{root}/first/batch={n}")


def availability(files: DataFrame, slots: list[str]) -> DataFrame:
    """client, period, slot, files, present: what each client and period has of each slot."""
    have = files.groupBy("client", "period", "slot").agg(F.count_distinct("file").alias("files"))
    every = files.select("client", "period").distinct().select("client", "period", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    out = every.join(have, ["client", "period", "slot"], "left")
    return out.withColumn("files", F.coalesce("files", F.lit(0))).withColumn("present", F.col("files") > 0)


def periods(files: DataFrame, runs: DataFrame) -> DataFrame:
    """client, period, on_disk, has_run: of files and of runs, either or both."""
    a = files.select("client", "period").distinct().withColumn("on_disk", F.lit(True))
    b = runs.select("client", "period").distinct().withColumn("has_run", F.lit(True))
    return a.join(b, ["client", "period"], "full").na.fill(False, ["on_disk", "has_run"])


def chosen(files: DataFrame, slot: str, has_columns: Column) -> DataFrame:
    """client, period, file: the first file by name of a slot whose header has the columns that a run asks for."""
    return files.filter((F.col("slot") == slot) & has_columns).groupBy("client", "period").agg(F.min("file").alias("file"))

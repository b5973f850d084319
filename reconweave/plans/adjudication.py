"""Disagreements with a baseline as a workbook for a partner to decide, and the counts that stand after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.sources import sink

# What may be decided of a disagreement.
DECISIONS = ("engine correct", "baseline correct", "both defensible", "unresolved")
SHEET = "Disagreements"


def export(disagreements: DataFrame, uri: str) -> None:
    """Writes the disagreements (fingerprint, engine_class, baseline_class, ...) as workbooks with an empty column adjudication."""
    sink.register(disagreements.sparkSession)
    text = disagreements.select(*(F.col(c).cast("string").alias(c) for c in disagreements.columns), F.lit(None).cast("string").alias("adjudication"))
    text.write.format(sink.NAME).option("path", uri).option("sheet", SHEET).mode("append").save()


def decisions(edited: DataFrame) -> DataFrame:
    """fingerprint, adjudication (lower case, empty if undecided) of edited rows; another word than DECISIONS raises when it is read."""
    if "adjudication" not in edited.columns:
        raise ValueError("the edited file has no column adjudication")
    said = F.lower(F.trim(F.coalesce("adjudication", F.lit(""))))
    known = F.when(said.isin("", *DECISIONS), said).otherwise(F.raise_error(F.concat(F.lit("no such adjudication: "), said)))
    return edited.select("fingerprint", known.alias("adjudication"))


def adjudicated(disagreements: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: adjudicated, unadjudicated, unadjudicated_share, fp_after, fn_after, both_defensible.

    A false positive is a match of the engine that the baseline does not have, a false
    negative the reverse; where the engine was found correct or both defensible it no
    longer counts.  Of several decisions on one fingerprint the last by name counts.
    """
    last = decided.groupBy("fingerprint").agg(F.max("adjudication").alias("adjudication"))
    rows = disagreements.join(last, "fingerprint", "left").withColumn("adjudication", F.coalesce("adjudication", F.lit("")))
    stands = ~F.col("adjudication").isin("engine correct", "both defensible")
    ours, theirs = F.col("engine_class") == "Matched", F.col("baseline_class") == "Matched"
    count = lambda c: F.count_if(c)
    out = rows.agg(
        count(F.col("adjudication") != "").alias("adjudicated"), count(F.col("adjudication") == "").alias("unadjudicated"), F.count(F.lit(1)).alias("_n"),
        count(ours & ~theirs & stands).alias("fp_after"), count(theirs & ~ours & stands).alias("fn_after"), count(F.col("adjudication") == "both defensible").alias("both_defensible"),
    )
    share = F.when(F.col("_n") > 0, F.round(F.col("unadjudicated") / F.col("_n"), 6)).otherwise(0.0)
    return out.withColumn("unadjudicated_share", share).drop("_n")


def confusion_values(aligned: DataFrame) -> DataFrame:
    """baseline_class, engine_class, pairs, value with margins (Total); aligned: also value, of the engine's side else the baseline's."""
    out = aligned.cube("baseline_class", "engine_class").agg(F.count(F.lit(1)).alias("pairs"), F.sum("value").alias("value"))
    return out.na.fill("Total", ["baseline_class", "engine_class"])

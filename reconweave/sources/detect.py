"""Which slot a file belongs to, and which of its columns is which field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.functions.similarity import token_sort_ratio
from reconweave.sources.canonical import ALIASES

# Tokens that speak for a slot, and how much; names count threefold.
SLOT_TOKENS = [
    ("tally", "tally", 2), ("tally", "purchase register", 2), ("tally", "voucher", 1),
    ("gstr2b", "gstr2b", 2), ("gstr2b", "2b", 1), ("gstr2b", "itc availability", 2),
    ("ims", "ims", 2), ("ims", "ims action", 2),
    ("form26as", "26as", 2), ("form26as", "form 26as", 2),
    ("tds", "tds", 2), ("tds", "challan", 1), ("tds", "deductee", 2),
    ("bank", "bank", 2), ("bank", "withdrawal", 2), ("bank", "utr", 1),
    ("vendor_ledger", "ledger", 2), ("opening_balances", "opening", 2), ("loan_sheet", "loan", 2), ("salary", "salary", 2), ("credit_notes", "credit note", 2),
]


def slots(files: DataFrame) -> DataFrame:
    """file, slot: the slot with the highest score; null without one or on a tie.

    files: file, name, headers (array of strings).  The rule table is the fixed list above.
    """
    rules = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(t).alias("token"), F.lit(w).alias("w")) for s, t, w in SLOT_TOKENS))
    name = F.regexp_replace(F.lower("name"), "[_.-]", " ")
    each = files.withColumn("_n", name).withColumn("_h", F.lower(F.concat_ws(" | ", "headers"))).select("file", "_n", "_h", F.explode(rules).alias("r"))
    hit = each.withColumn("points", F.when(F.col("_n").contains(F.col("r.token")), 3 * F.col("r.w")).otherwise(0) + F.when(F.col("_h").contains(F.col("r.token")), F.col("r.w")).otherwise(0))
    sums = hit.groupBy("file", F.col("r.slot").alias("slot")).agg(F.sum("points").alias("points"))
    best = sums.withColumn("top", F.max("points").over(Window.partitionBy("file"))).filter("points = top")
    one = best.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("slot"), F.max("top").alias("points"))
    return one.select("file", F.when((F.col("n") == 1) & (F.col("points") > 0), F.col("slot")).alias("slot"), "points")


def column_candidates(spark: SparkSession, headers: list[str], *, best: int = 3, floor: float = 40.0) -> DataFrame:
    """field, header, score, rank: the best headers of each canonical field by token similarity of its aliases."""
    pairs = spark.createDataFrame([(f, a, h, i) for f, aliases in ALIASES.items() for a in aliases for i, h in enumerate(headers)], "field string, alias string, header string, place int")
    scored = pairs.withColumn("score", token_sort_ratio(F.lower("alias"), F.lower("header"))).groupBy("field", "header", "place").agg(F.max("score").alias("score")).filter(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("score"), "place"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= best).drop("place")


def layout_similarity(a: dict[str, list[str]], b: dict[str, list[str]]) -> float:
    """Half the share of common sheet names, half the mean Jaccard of the columns of common sheets."""
    names = set(a) & set(b)
    sheets = len(names) / len(set(a) | set(b)) if a or b else 1.0
    columns = [len(set(a[n]) & set(b[n])) / len(set(a[n]) | set(b[n])) if a[n] or b[n] else 1.0 for n in names]
    return 0.5 * sheets + 0.5 * (sum(columns) / len(columns) if columns else 0.0)

"""Reports of runs: one run, a client's period over all kinds of run, and the strip that checks the sums.

A report is rows of one shape: level (period, kind, bucket or party) and what it is of,
so one pass with grouping sets makes the reports of all clients and periods at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How runs of withheld tax name what is missing.
TDS_BUCKETS = {"Not in Books": "Missing", "Not in Portal": "Late Deposit"}
_KEY = ["client", "period"]


def bucket(kind: Column, classification: Column) -> Column:
    """The name that a report shows a class by."""
    names = F.create_map(*[F.lit(x) for kv in TDS_BUCKETS.items() for x in kv])
    return F.when(kind == "TDS", F.coalesce(names[classification], classification)).otherwise(classification)


def latest_runs(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The last run of each client, period and kind, of those up to a day; runs: client, period, kind, run_id, run_at."""
    some = runs if as_of is None else runs.filter(F.to_date("run_at") <= as_of)
    return some.groupBy(*_KEY, "kind").agg(F.max("run_id").alias("run_id"))


def report(items: DataFrame, runs: DataFrame) -> DataFrame:
    """level, client, period, kind, bucket, party, results, matched, exceptions, exceptions_value, value, gap, match_rate.

    items: client, period, kind, run_id, classification, party, value, deducted,
    deposited; runs: the runs that are reported, as latest_runs() gives them.  Levels:
    period (all kinds), kind (one run), bucket (of a run), party (exceptions over all
    kinds; parties without a name have no row).  gap: deducted less deposited tax, of
    runs of withheld tax.  match_rate, in per cent: of the run, and of a period that of
    GST where there is such a run, else that of TDS.
    """
    rows = items.join(runs.select("run_id"), "run_id", "left_semi")
    rows = rows.withColumn("bucket", bucket(F.col("kind"), F.col("classification"))).withColumn("party", F.nullif(F.trim(F.coalesce("party", F.lit(""))), F.lit("")))
    matched = F.col("classification") == "Matched"
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    tds = F.col("kind") == "TDS"
    k = [F.col(c) for c in _KEY]
    sums = rows.groupingSets([k, [*k, F.col("kind")], [*k, F.col("kind"), F.col("bucket")], [*k, F.col("party")]], *k, F.col("kind"), F.col("bucket"), F.col("party")).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("results"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("exceptions"), money(F.when(~matched, F.col("value"))).alias("exceptions_value"), money("value").alias("value"),
        F.sum(F.when(tds, F.col("deducted") - F.col("deposited"))).cast("decimal(38,2)").alias("gap"),
        F.count_if(F.col("kind") == "GST").alias("_gst"), F.count_if(matched & (F.col("kind") == "GST")).alias("_gst_matched"), F.count_if(tds).alias("_tds"), F.count_if(matched & tds).alias("_tds_matched"),
    )
    level = F.when(F.col("_g") == 7, "period").when(F.col("_g") == 3, "kind").when(F.col("_g") == 1, "bucket").otherwise("party")
    rate = lambda a, b: F.round(F.col(a) / F.col(b) * 100, 1)
    best = F.when(F.col("_gst") > 0, rate("_gst_matched", "_gst")).when(F.col("_tds") > 0, rate("_tds_matched", "_tds")).otherwise(rate("matched", "results"))
    out = sums.withColumn("level", level).filter((F.col("level") != "party") | (F.col("party").isNotNull() & (F.col("exceptions") > 0)))
    out = out.withColumn("match_rate", F.when(F.col("level") == "period", best).when(F.col("level") == "kind", rate("matched", "results")))
    only = lambda c: F.when(F.col("level").isin("period", "kind", "bucket"), F.col(c)).alias(c)
    return out.select("level", *_KEY, "kind", "bucket", "party", only("results"), only("matched"), "exceptions", "exceptions_value", only("value"), only("gap"), "match_rate")


def periods(runs: DataFrame) -> DataFrame:
    """client, period, kinds, place: what can be reported; calendar periods first, newest first, then by client."""
    out = runs.groupBy(*_KEY).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    order = [F.desc(F.col("period").rlike(r"^\d{4}-\d{2}$")), F.desc("period"), F.desc("client")]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each client and period


def integrity(reported: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """client, period, kind, records, counts_tie, values_tie, classified, result: a recount of each run's records against its buckets."""
    own = items.join(runs.select("run_id"), "run_id", "left_semi").groupBy(*_KEY, "kind")
    recount = own.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("value"), F.lit(0)).alias("_v"), F.count("classification").alias("_c"))
    stated = reported.filter("level = 'bucket'").groupBy(*_KEY, "kind").agg(F.sum("results").alias("_n"), F.sum("value").alias("_w"))
    out = recount.join(stated, [*_KEY, "kind"], "left")
    ties = {"counts_tie": F.coalesce(F.col("records") == F.col("_n"), F.lit(False)), "values_tie": F.coalesce(F.abs(F.col("_v") - F.col("_w")) < 0.05, F.lit(False)), "classified": F.col("records") == F.col("_c")}
    out = out.withColumns(ties).withColumn("result", F.when(F.col("counts_tie") & F.col("values_tie") & F.col("classified"), "PASS").otherwise("FAIL"))
    return out.select(*_KEY, "kind", "records", *ties, "result")

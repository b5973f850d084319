"""Queries of the period reports over runs of invoices and of withheld tax, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.plans import adjudication, reports, verify
from reconweave.plans.oracles import _ALIGNED, RUN
from reconweave.plans.queries import _aligned, _run, query
from reconweave.sources import derive, paste, sink
from reconweave.stages import Stages
from reconweave.streaming import files

TWINS: dict[str, str] = {}

# Withheld tax, books against portal by challan line, in SQL that Spark and DuckDB share.
_TDS_ITEMS = f"""
SELECT b.deductee_name AS party, b.deposit_date AS day, b.tax_deducted AS value, b.tax_deducted AS deducted, b.tax_deposited AS deposited,
  CASE WHEN p.pid IS NULL THEN 'Not in Portal' WHEN p.tax_deducted = b.tax_deducted THEN 'Matched' ELSE 'Amount Difference' END AS classification
FROM ({derive.TDS_BOOKS}) b LEFT JOIN ({derive.TDS_PORTAL}) p ON b.bid = p.pid"""
# Runs: an early one of every third supplier's items, and a late one of all; clients are four groups of suppliers.
_CLIENT = "'client ' || CAST(CAST(right(party, 6) AS INTEGER) % 4 AS STRING)"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all runs of both kinds: two runs of each client and month."""
    one = lambda f: F.coalesce(F.col(f"books.{f}"), F.col(f"portal.{f}"))
    zero = F.lit(0).cast("decimal(18,2)")
    gst = _run(spark, sf).select(one("party_name").alias("party"), one("invoice_date").alias("day"), one("invoice_value").alias("value"), zero.alias("deducted"), zero.alias("deposited"), "classification", F.lit("GST").alias("kind"))
    tds = derive.frame(spark, sf, _TDS_ITEMS).withColumn("kind", F.lit("TDS"))
    rows = gst.unionByName(tds).withColumn("client", F.expr(_CLIENT)).withColumn("period", F.date_format("day", "yyyy-MM"))
    early = F.col("party").substr(-6, 6).cast("int") % 3 == 0
    run = F.explode(F.when(early, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("nth")
    rows = rows.select("*", run)
    ident = F.concat_ws("/", "client", "period", "kind", "nth")
    return rows.select("client", "period", "kind", ident.alias("run_id"), F.when(F.col("nth") == 1, F.lit("2026-01-10")).otherwise("2026-02-10").cast("timestamp").alias("run_at"), "classification", "party", "value", "deducted", "deposited")


_ITEMS = f"""
SELECT *, {_CLIENT} AS client, strftime(day, '%Y-%m') AS period FROM (
  SELECT coalesce(b_party_name, p_party_name) AS party, coalesce(b_invoice_date, p_invoice_date) AS day, coalesce(b_invoice_value, p_invoice_value) AS value, 0 AS deducted, 0 AS deposited, classification, 'GST' AS kind FROM ({RUN}) r
  UNION ALL SELECT party, day, value, deducted, deposited, classification, 'TDS' FROM ({_TDS_ITEMS}) t) u"""


@query
def period_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of every client and month over its latest runs: period, kinds, buckets, and parties merged over kinds."""
    items = Stages(spark, "reports")(_items(spark, sf))
    runs = items.select("client", "period", "kind", "run_id", "run_at").distinct()
    return reports.report(items, reports.latest_runs(runs))


_SUM = "coalesce(sum({}), 0)"
TWINS["period_reports"] = f"""
WITH i AS MATERIALIZED (SELECT *, CASE WHEN kind = 'TDS' AND classification = 'Not in Portal' THEN 'Late Deposit' WHEN kind = 'TDS' AND classification = 'Not in Books' THEN 'Missing' ELSE classification END AS bucket, classification = 'Matched' AS m FROM ({_ITEMS}) x),
g AS (SELECT client, period, kind, bucket, party, grouping(kind) AS gk, grouping(bucket) AS gb, grouping(party) AS gp, count(*) AS n, count(*) FILTER (m) AS k, {_SUM.format('value')} AS v, coalesce(sum(value) FILTER (NOT m), 0) AS ev,
    sum(deducted - deposited) FILTER (kind = 'TDS') AS gap, count(*) FILTER (kind = 'GST') AS gn, count(*) FILTER (kind = 'GST' AND m) AS gm, count(*) FILTER (kind = 'TDS') AS tn, count(*) FILTER (kind = 'TDS' AND m) AS tm
  FROM i GROUP BY GROUPING SETS ((client, period), (client, period, kind), (client, period, kind, bucket), (client, period, party)))
SELECT CASE WHEN gp = 0 THEN 'party' WHEN gb = 0 THEN 'bucket' WHEN gk = 0 THEN 'kind' ELSE 'period' END AS level, client, period, kind, bucket, party, CASE WHEN gp = 1 THEN n END AS results, CASE WHEN gp = 1 THEN k END AS matched,
  n - k AS exceptions, ev AS exceptions_value, CASE WHEN gp = 1 THEN v END AS value, CASE WHEN gp = 1 THEN gap END AS gap,
  CASE WHEN gp = 1 AND gb = 1 AND gk = 1 THEN CASE WHEN gn > 0 THEN round(gm / gn * 100, 1) ELSE round(tm / tn * 100, 1) END WHEN gp = 1 AND gb = 1 THEN round(k / n * 100, 1) END AS match_rate
FROM g WHERE gp = 1 OR n > k"""


@query
def reports_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Results of each kind as of a day before the late runs, with the strip that checks them."""
    items = Stages(spark, "reports")(_items(spark, sf))
    runs = reports.latest_runs(items.select("client", "period", "kind", "run_id", "run_at").distinct(), F.lit("2026-01-31").cast("date"))
    reported = reports.report(items, runs)
    kinds = reported.filter("level = 'kind'").select("client", "period", "kind", "results", "matched", "exceptions_value", "match_rate")
    return kinds.join(reports.integrity(reported, items, runs), ["client", "period", "kind"])


TWINS["reports_as_of"] = f"""
SELECT client, period, kind, count(*) AS results, count(*) FILTER (classification = 'Matched') AS matched, coalesce(sum(value) FILTER (classification <> 'Matched'), 0) AS exceptions_value,
  round(count(*) FILTER (classification = 'Matched') / count(*) * 100, 1) AS match_rate, count(*) AS records, true AS counts_tie, true AS values_tie, true AS classified, 'PASS' AS result
FROM ({_ITEMS}) i WHERE CAST(right(party, 6) AS INTEGER) % 3 = 0 GROUP BY client, period, kind"""


@query
def report_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Clients and periods that can be reported, in the order of the screen."""
    items = Stages(spark, "reports")(_items(spark, sf).select("client", "period", "kind").distinct())
    return reports.periods(items).withColumn("kinds", F.array_join("kinds", ","))


TWINS["report_periods"] = f"""
SELECT client, period, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, row_number() OVER (ORDER BY period DESC, client DESC) AS place FROM ({_ITEMS}) i GROUP BY client, period"""


# --- decisions on disagreements --------------------------------------------


def _disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return verify.disagreements(_aligned(spark, sf)).select(F.col("id").cast("string").alias("fingerprint"), "engine_class", "baseline_class", "cause")


@query
def adjudicated_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Disagreements written as workbooks, decided in them, read back, and what then stands."""
    stages = Stages(spark, "adjudication")
    found = stages(_disagreements(spark, sf))
    uri = f"{stages.root}/disagreements"
    adjudication.export(found, uri)
    n = F.col("fingerprint").cast("long") % 7
    edited = sink.read(spark, uri).withColumn("adjudication", F.when(n == 1, "Engine Correct").when(n == 2, "baseline correct").when(n == 3, "both defensible").when(n == 4, "unresolved"))
    return adjudication.adjudicated(found, adjudication.decisions(edited))


TWINS["adjudicated_metrics"] = f"""
WITH d AS (SELECT *, id % 7 AS n FROM ({_ALIGNED}) a WHERE engine_class <> baseline_class)
SELECT count(*) FILTER (n BETWEEN 1 AND 4) AS adjudicated, count(*) FILTER (n NOT BETWEEN 1 AND 4) AS unadjudicated, round(count(*) FILTER (n NOT BETWEEN 1 AND 4) / count(*), 6) AS unadjudicated_share,
  count(*) FILTER (engine_class = 'Matched' AND n NOT IN (1, 3)) AS fp_after, count(*) FILTER (baseline_class = 'Matched' AND n NOT IN (1, 3)) AS fn_after, count(*) FILTER (n = 3) AS both_defensible FROM d"""


@query
def confusion_values(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rupees of each pair of classes, with margins."""
    value = F.abs(F.coalesce("books.invoice_value", "portal.invoice_value"))
    rows = _run(spark, sf).select(F.coalesce("bid", "pid").alias("id"), value.alias("value"))
    return adjudication.confusion_values(_aligned(spark, sf).join(rows, "id"))


TWINS["confusion_values"] = f"""
SELECT coalesce(a.baseline_class, 'Total') AS baseline_class, coalesce(a.engine_class, 'Total') AS engine_class, count(*) AS pairs, sum(v.value) AS value
FROM ({_ALIGNED}) a JOIN (SELECT coalesce(bid, pid) AS id, abs(coalesce(b_invoice_value, p_invoice_value)) AS value FROM ({RUN}) r) v ON a.id = v.id GROUP BY CUBE (a.baseline_class, a.engine_class)"""

# --- arrivals --------------------------------------------------------------

# Orders as uploaded files in three batches; equal content of one client is an upload that was seen.
_UPLOADS = """
SELECT 'client ' || CAST(o_custkey % 10 AS STRING) AS client, substr(CAST(o_orderdate AS STRING), 1, 7) AS period, 'slot ' || CAST(o_orderkey % 4 AS STRING) AS slot, 'order-' || CAST(o_orderkey AS STRING) || '.csv' AS file,
  'content ' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 5 AS STRING) AS hash, o_orderkey % 3 AS batch FROM orders"""


@query
def file_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads as a stream over three batches: each file, and the first one of its client with the same content."""
    stages = Stages(spark, "uploads")
    uploads = stages(derive.frame(spark, sf, _UPLOADS))
    kind = ", ".join(f"{c} string" for c in ("client", "period", "slot", "file", "hash"))
    for n in range(3):
        uploads.filter(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{stages.root}/in")
        stream = spark.readStream.schema(kind).parquet(f"{stages.root}/in").writeStream.foreachBatch(lambda batch, k: files.note_uploads(batch, k, stages.root))
        stream.option("checkpointLocation", f"{stages.root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{stages.root}/seen").drop("batch")


TWINS["file_arrivals"] = f"""
SELECT client, period, slot, file, hash, CASE WHEN row_number() OVER w > 1 THEN first_value(period || '/' || slot || '/' || file) OVER w END AS first_file
FROM ({_UPLOADS}) u WINDOW w AS (PARTITION BY client, hash ORDER BY batch, period, slot, file)"""


@query
def source_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Which slots each client has files for in each period."""
    return files.availability(derive.frame(spark, sf, _UPLOADS), [f"slot {k}" for k in range(5)])


TWINS["source_availability"] = f"""
WITH u AS ({_UPLOADS}), p AS (SELECT DISTINCT client, period FROM u), s AS (SELECT 'slot ' || CAST(k AS STRING) AS slot FROM range(5) t(k))
SELECT p.client, p.period, s.slot, count(DISTINCT file) AS files, count(DISTINCT file) > 0 AS present FROM p CROSS JOIN s LEFT JOIN u ON u.client = p.client AND u.period = p.period AND u.slot = s.slot GROUP BY ALL"""


# --- pasted rows -----------------------------------------------------------

_STYLE = "p_partkey // 100 % 3"


@query
def bulk_paste(spark: SparkSession, sf: str) -> DataFrame:
    """Parts pasted a hundred at a time with tabs, with commas and quoted names, or with semicolons; some lines lack a name."""
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("paste_id", F.expr("p_partkey div 100"))
    style, key = F.col("paste_id") % 3, F.col("p_partkey").cast("string")
    line = F.when(style == 0, F.concat_ws("\t", key, "p_name", "p_type")).when(style == 1, F.concat(key, F.lit(', "'), "p_name", F.lit(', ltd", '), "p_type")).otherwise(F.concat_ws(" ; ", key, "p_name", "p_type"))
    line = F.when(F.col("p_partkey") % 13 == 0, F.concat(key, F.when(style == 0, "\t").when(style == 1, ",").otherwise(";"))).when(F.col("p_partkey") % 17 == 0, F.concat(line, F.lit("\n  \n"))).otherwise(line)
    pastes = p.groupBy("paste_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))  # a hundred lines each
    return paste.parse(pastes).select("paste_id", "code", "name", "type")


TWINS["bulk_paste"] = f"""
SELECT p_partkey // 100 AS paste_id, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN {_STYLE} = 1 THEN p_name || ', ltd' ELSE p_name END AS name, p_type AS type FROM part WHERE p_partkey % 13 <> 0"""

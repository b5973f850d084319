"""Queries of review lists, displays, integrity checks and practice records, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.config import Config
from reconweave.functions import display, keys
from reconweave.operators import classify, review
from reconweave.plans import analytics
from reconweave.plans.oracles import RUN, _ALIGNED
from reconweave.plans.queries import _aligned, _run, query
from reconweave.sources import derive
from reconweave.stages import Stages

CONFIG = Config()
TWINS: dict[str, str] = {}


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Results as review items; every third one is reviewed."""
    one = lambda f: F.coalesce(F.col(f"portal.{f}"), F.col(f"books.{f}"))
    ident = F.coalesce("bid", "pid")
    run = _run(spark, sf)
    return run.select(
        ident.alias("id"), F.col("classification").alias("bucket"), (ident % 3 == 1).alias("reviewed"), one("party_name").alias("party"), one("party_name").alias("supplier_key"),
        one("gstin").alias("gstin"), one("invoice_number").alias("reference"), one("invoice_date").alias("date"), "confidence_band", F.abs("difference").alias("difference"),
    )


_ITEMS = f"""SELECT coalesce(bid, pid) AS id, classification AS bucket, coalesce(bid, pid) % 3 = 1 AS reviewed, coalesce(p_party_name, b_party_name) AS party, coalesce(p_gstin, b_gstin) AS gstin,
  coalesce(p_invoice_number, b_invoice_number) AS reference, confidence_band, abs(difference) AS difference FROM ({RUN}) r"""


@query
def review_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Unreviewed exceptions by supplier, with subtotals."""
    return review.groups(review.listing(_items(spark, sf), state="unreviewed"), "supplier_key")


TWINS["review_groups"] = f"SELECT party AS name, count(*) AS items, sum(difference) AS subtotal FROM ({_ITEMS}) i WHERE bucket <> 'Matched' AND NOT reviewed GROUP BY party"

_FILTERS = {
    "default": ({}, "bucket <> 'Matched'"),
    "matched": ({"view": "matched"}, "bucket = 'Matched'"),
    "chip": ({"bucket": "Matched"}, "bucket = 'Matched'"),
    "not_in_books": ({"view": "not_in_books"}, "bucket = 'Not in Books'"),
    "reviewed": ({"view": "reviewed"}, "reviewed"),
    "active": ({"active": True}, "bucket <> 'Matched' AND NOT reviewed"),
    "low": ({"confidence_band": "Low"}, "bucket <> 'Matched' AND confidence_band = 'Low'"),
    "search": ({"search": " SUPPLIER 00001 "}, "bucket <> 'Matched' AND contains(lower(party || ' ' || gstin || ' ' || reference), 'supplier 00001')"),
}


@query
def review_filters(spark: SparkSession, sf: str) -> DataFrame:
    """How many items each setting of the filters shows."""
    return review.listing_counts(_items(spark, sf), {k: asked for k, (asked, _) in _FILTERS.items()})


TWINS["review_filters"] = f"WITH i AS MATERIALIZED ({_ITEMS}) " + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS items FROM i WHERE {w}" for k, (_, w) in _FILTERS.items())


@query
def review_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 items of each order: a page of the list."""
    items, out = Stages(spark, "review-order")(review.listing(_items(spark, sf))), None  # read once for each order
    for key in ("difference", "supplier", "confidence", "review_state"):
        one = analytics.page(items, review.order(key), 1).select(F.lit(key).alias("sort_key"), "id", "bucket", "difference")
        out = one if out is None else out.unionByName(one)
    return out


_ORDERS = {"difference": "difference DESC, party", "supplier": "lower(party), difference DESC", "confidence": "CASE confidence_band WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, difference DESC", "review_state": "reviewed, difference DESC"}
TWINS["review_order"] = f"WITH i AS MATERIALIZED (SELECT * FROM ({_ITEMS}) x WHERE bucket <> 'Matched') " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort_key, id, bucket, difference FROM i ORDER BY {o}, id LIMIT 25) t{n}" for n, (k, o) in enumerate(_ORDERS.items()))


@query
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as work: open items of some age with their priority's rank, and whether they may go in a batch."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    priority = F.element_at(F.array(*map(F.lit, ("escalated", "high", "normal", "low", "other"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    items = o.select(F.col("o_orderkey").alias("id"), priority.alias("priority"), F.datediff(F.lit("1998-08-01").cast("date"), F.to_date("o_orderdate")).alias("age_days"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), (F.col("o_totalprice") > 200000).alias("gated"))
    out = review.work_queue(items, least_age=100).withColumn("rank", review.rank_of(F.col("priority"), review.PRIORITIES, 9))
    return out.groupBy("rank", review.batch_exclusion(F.col("gated")).alias("alone")).agg(F.count(F.lit(1)).alias("items"), F.max("age_days").alias("oldest"))


TWINS["work_queue"] = """
SELECT CASE WHEN CAST(left(o_orderpriority, 1) AS INTEGER) < 5 THEN CAST(left(o_orderpriority, 1) AS INTEGER) - 1 ELSE 9 END AS rank,
  CASE WHEN o_totalprice > 200000 THEN 'Materiality-gated — individual review required' END AS alone, count(*) AS items, max(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01')) AS oldest
FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') >= 100 GROUP BY ALL"""


@query
def headline_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """The headline against a recount of the rows and of the causes."""
    run = classify.cause(_run(spark, sf), CONFIG.gst.tolerance, CONFIG.materiality["GST"])
    tax = F.struct(F.coalesce("portal.total_tax", "books.total_tax").alias("total_tax"))
    run = Stages(spark, "headline")(run.select("classification", "cause", "itc_at_risk", tax.alias("books"), tax.alias("portal")))  # planned once, read three times
    return review.headline_integrity(run, analytics.kpis(run))


TWINS["headline_integrity"] = f"SELECT sum(itc_at_risk) AS headline, sum(itc_at_risk) FILTER (classification <> 'Matched') AS recount, count(*) FILTER (classification <> 'Matched') AS exception_count, sum(itc_at_risk) FILTER (classification <> 'Matched') AS cause_sum, sum(itc_at_risk) = sum(itc_at_risk) FILTER (classification <> 'Matched') AS ties FROM ({RUN}) r"


@query
def recon_of_recon(spark: SparkSession, sf: str) -> DataFrame:
    return review.recon_of_recon(_run(spark, sf))


_VALUE = "coalesce(nullif(b_invoice_value, 0), p_invoice_value, 0)"
TWINS["recon_of_recon"] = f"""
SELECT *, matched + unmatched + excluded = ingested AS ties_out FROM (SELECT sum(CASE WHEN classification = 'Matched' THEN {_VALUE} ELSE 0 END) AS matched, sum(CASE WHEN classification LIKE 'Not in %' THEN {_VALUE} ELSE 0 END) AS unmatched,
  sum(CASE WHEN classification = 'Amount Difference' THEN {_VALUE} ELSE 0 END) AS excluded, sum({_VALUE}) AS ingested FROM ({RUN}) r) q"""


@query
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a screen shows them."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d, value = F.to_date("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)")
    gap = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(-25).cast("decimal(18,2)")
    return o.select(
        "o_orderkey", display.display_date(d).alias("shown_date"), display.display_period(F.date_format(d, "yyyy-MM")).alias("shown_period"), display.western_money(value).alias("money"), display.signed_money(gap).alias("gap"),
        display.confidence_label(F.lit("High"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(97.9))).alias("label"), display.label_words(F.concat(F.lit("Order-No. "), F.col("o_orderpriority"))).alias("words"), display.client_key(F.concat(F.lit("M/s. "), F.col("o_orderpriority"))).alias("client"),
        display.review_age(F.when(F.col("o_orderkey") % 4 > 0, d), F.lit("1998-08-01").cast("date")).alias("age"),
    )


TWINS["display_values"] = """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%d %b %Y') AS shown_date, strftime(CAST(o_orderdate AS DATE), '%b %Y') AS shown_period, '₹' || format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))) AS money,
  CASE o_orderkey % 3 WHEN 0 THEN '—' WHEN 1 THEN '+₹7.00' ELSE '−₹25.00' END AS gap, CASE WHEN o_orderkey % 2 = 0 THEN 'High — 97%' ELSE 'High' END AS label,
  trim(regexp_replace('order no ' || lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS words, 'ms' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS client,
  CASE WHEN o_orderkey % 4 = 0 THEN 'seed' WHEN (1998 - year(CAST(o_orderdate AS DATE))) * 12 + 8 - month(CAST(o_orderdate AS DATE)) >= 6 THEN 'stale' ELSE 'reviewed' END AS age
FROM orders"""


@query
def percent_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of paired invoices in per cent of the portal's value."""
    run = _run(spark, sf).filter("bid is not null and pid is not null")
    gap = display.percent_gap(F.col("books"), F.col("portal"), ("invoice_value", "taxable_value"))
    return run.select("bid", gap.alias("x")).select("bid", "x.field", "x.gap")


TWINS["percent_gaps"] = f"SELECT bid, 'invoice_value' AS field, round((CAST(b_invoice_value AS DOUBLE) - CAST(p_invoice_value AS DOUBLE)) / abs(CAST(p_invoice_value AS DOUBLE)) * 100, 2) AS gap FROM ({RUN}) r WHERE bid IS NOT NULL AND pid IS NOT NULL"


@query
def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields differ between the two sides of a line, with an example."""
    old, new = derive.books(spark, sf).withColumnRenamed("bid", "id"), derive.portal(spark, sf).withColumnRenamed("pid", "id")
    out = review.changed_fields(old, new, "id", ["invoice_number", "document_type", "taxable_value", "igst"])
    return out.groupBy("field").agg(F.count(F.lit(1)).alias("changes"), F.min("old_value").alias("least_old"), F.max("new_value").alias("greatest_new"))


TWINS["changed_fields"] = f"""
WITH e AS (SELECT unnest(['invoice_number', 'document_type', 'taxable_value', 'igst']) AS field, unnest([b.invoice_number, b.document_type, CAST(b.taxable_value AS VARCHAR), CAST(b.igst AS VARCHAR)]) AS a, unnest([p.invoice_number, p.document_type, CAST(p.taxable_value AS VARCHAR), CAST(p.igst AS VARCHAR)]) AS b
  FROM ({derive.BOOKS}) b JOIN ({derive.PORTAL}) p ON b.bid = p.pid)
SELECT field, count(*) AS changes, min(a) AS least_old, max(b) AS greatest_new FROM e WHERE a IS DISTINCT FROM b GROUP BY field"""


@query
def rule_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of rules, one for each customer, with the value as kept or why it is refused."""
    rules = spark.createDataFrame([("materiality", "number"), ("strict", "boolean"), ("from", "date"), ("note", "text")], "rule_key string, value_type string")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    edits = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("edit_id"), pick("materiality", "strict", "from", "note", "unknown").alias("rule_key"), pick("firm", "client", "other").alias("scope"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey")).alias("client_id"), pick(" 12 ", "YES", "2024-02-30", "2024-02-29", "text", "0", "1.5").alias("value"), F.when(F.col("c_custkey") % 11 > 0, "why").alias("reason"),
    )
    return review.edited(rules, edits).select("edit_id", "rule_key", "canonical", "refused")


TWINS["rule_edits"] = """
WITH e AS (SELECT c_custkey AS edit_id, ['materiality', 'strict', 'from', 'note', 'unknown'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS rule_key, ['firm', 'client', 'other'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS scope, c_custkey % 4 > 0 AS client,
  trim([' 12 ', 'YES', '2024-02-30', '2024-02-29', 'text', '0', '1.5'][CAST(c_custkey % 7 + 1 AS INTEGER)]) AS v, c_custkey % 11 > 0 AS why FROM customer),
k AS (SELECT *, CASE rule_key WHEN 'materiality' THEN CASE v WHEN '12' THEN '12.0' WHEN '0' THEN '0.0' WHEN '1.5' THEN '1.5' END WHEN 'strict' THEN CASE v WHEN 'YES' THEN 'true' WHEN '0' THEN 'false' END WHEN 'from' THEN CASE v WHEN '2024-02-29' THEN v END ELSE v END AS canonical FROM e)
SELECT edit_id, rule_key, canonical, CASE WHEN scope = 'other' THEN 'scope' WHEN scope = 'client' AND NOT client THEN 'client missing' WHEN scope = 'firm' AND client THEN 'client given' WHEN NOT why THEN 'reason' WHEN rule_key = 'unknown' THEN 'rule' WHEN canonical IS NULL THEN 'value' END AS refused FROM k"""


@query
def sync_health(spark: SparkSession, sf: str) -> DataFrame:
    """The newest status of each user's sources, events as checks."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    source = F.element_at(F.array(*map(F.lit, ("tally", "gst_portal", "traces"))), (F.col("event_id") % 3 + 1).cast("int"))
    events = e.select(F.col("user_id").alias("client_id"), source.alias("source"), F.when(F.col("value") < 50, "failed").otherwise("ok").alias("status"), F.col("ts").alias("checked_at"), "event_id")
    return review.sync_health(events, e.select(F.col("user_id").alias("client_id")).distinct())


TWINS["sync_health"] = """
WITH e AS (SELECT user_id AS client_id, ['tally', 'gst_portal', 'traces'][CAST(event_id % 3 + 1 AS INTEGER)] AS source, CASE WHEN value < 50 THEN 'failed' ELSE 'ok' END AS status, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT c.client_id, s.source, coalesce(e.status, 'not_attempted') AS status, s.source = 'bank' AS is_stub
FROM (SELECT DISTINCT user_id AS client_id FROM events) c CROSS JOIN (VALUES ('tally'), ('gst_portal'), ('traces'), ('bank')) s(source) LEFT JOIN e ON e.client_id = c.client_id AND e.source = s.source AND e.n = 1"""


@query
def type_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the baseline names the same kind of difference."""
    a = _aligned(spark, sf)
    a = a.withColumn("baseline_type", F.when(F.col("id") % 7 == 1, "Tax Split Mismatch").otherwise(F.col("engine_type")))
    return review.type_accuracy(a)


_TYPED = f"SELECT difference_type AS e, CASE WHEN id % 7 = 1 THEN 'Tax Split Mismatch' ELSE difference_type END AS b FROM ({_ALIGNED}) a WHERE engine_class <> 'Matched' AND baseline_class <> 'Matched' AND difference_type IS NOT NULL"
TWINS["type_accuracy"] = f"""
WITH t AS ({_TYPED}), l AS (SELECT 'all' AS label, e, b FROM t UNION ALL SELECT k, e, b FROM t JOIN (VALUES ('Tax Split Mismatch'), ('Short Deduction'), ('Timing Difference')) v(k) ON e = k OR b = k)
SELECT label, count(*) AS pairs, count(*) FILTER (e = b) AS agreed, round(count(*) FILTER (e = b) / count(*), 4) AS rate FROM l GROUP BY label"""


@query
def default_assignees(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's first supplier of the best role."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    role = F.element_at(F.array(*map(F.lit, ("Partner", "Manager", "Article-Trainee", "Senior Accountant"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return review.default_assignee(s.select(F.col("s_nationkey").alias("client_id"), F.col("s_suppkey").alias("place"), role.alias("role"), F.col("s_name").alias("name")))


TWINS["default_assignees"] = "SELECT s_nationkey AS client_id, arg_min(s_name, (3 - s_suppkey % 4) * 1000000000 + s_suppkey) AS assignee FROM supplier GROUP BY s_nationkey"


@query
def journal_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as journal entries: sums of their debit and credit legs."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    side = F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit")
    legs = l.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.collect_list(F.struct(side.alias("side"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))).alias("legs"))
    return review.leg_totals(legs)


TWINS["journal_totals"] = "SELECT l_orderkey AS entry_id, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag <> 'R'), 0) AS debit, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'), 0) AS credit FROM lineitem GROUP BY l_orderkey"


@query
def derived_tax(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that give a rate or an amount of tax, with the half that they lack."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("decimal(18,2)").alias("taxable_value"), (F.max("l_tax") * 100).cast("int").alias("r"))
    odd = F.col("l_orderkey") % 2 == 1
    rows = l.select("l_orderkey", "l_linenumber", "taxable_value", F.lit(None).cast("double").alias("total_tax"), F.when(odd, F.col("taxable_value").cast("double") * F.col("r") / 100).alias("cgst"), F.when(~odd, F.col("r").cast("double")).alias("cgst_rate"), F.lit(0.0).alias("igst"), F.lit(0.0).alias("igst_rate"), F.lit(None).cast("double").alias("sgst"), F.col("r").cast("double").alias("sgst_rate"))
    out = review.derived_tax(rows.withColumn("taxable_value", F.col("taxable_value").cast("double")))
    return out.select("l_orderkey", "l_linenumber", F.round("cgst", 4).alias("cgst"), F.round("cgst_rate", 4).alias("cgst_rate"), F.round("total_tax", 4).alias("total_tax"), review.at_slab(F.col("cgst_rate")).alias("at_slab"))


TWINS["derived_tax"] = """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS DOUBLE) AS t, CAST(floor(max(l_tax) * 100) AS INTEGER) AS r FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(t * r / 100, 4) AS cgst, CAST(r AS DOUBLE) AS cgst_rate, round(t * r / 100 + t * r / 100, 4) AS total_tax, r IN (0, 5) AS at_slab FROM l"""


@query
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """How often each note's narration cites a credit note."""
    n = derive.frame(spark, sf, derive.NOTES_BOOKS)
    return n.groupBy(keys.citation_count(F.col("narration")).alias("citations")).agg(F.count(F.lit(1)).alias("notes"))


TWINS["citations"] = f"SELECT CASE WHEN narration LIKE 'being%' THEN 0 ELSE 1 END AS citations, count(*) AS notes FROM ({derive.NOTES_BOOKS}) n GROUP BY 1"


@query
def repeated_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names that more than one part has."""
    return review.repeated(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name")), "name")


TWINS["repeated_names"] = "SELECT p_name AS name, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1"

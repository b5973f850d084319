"""The registered queries of the reconciliation operators over the derived frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.config import Config
from reconweave.functions import dates, keys
from reconweave.functions.predicates import in_window, proximity, within
from reconweave.operators import assign, blocking, classify, gst, guards, notes, other, rules, state, tds
from reconweave.plans import analytics, reasons, verify
from reconweave.sources import declarative, derive, detect, extract
from reconweave.stages import Stages
from reconweave.streaming import arrivals

CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _run(spark: SparkSession, sf: str) -> DataFrame:
    return gst.exact_run(derive.books(spark, sf), derive.portal(spark, sf), CONFIG.gst)


def _fingerprinted(run: DataFrame) -> DataFrame:
    return state.with_fingerprint(run, state.gst_fingerprint(F.col("books"), F.col("portal")), [F.col("bid").asc_nulls_last(), F.col("pid").asc_nulls_last()])


# --- keys and GST passes ---------------------------------------------------


@query
def gst_exact_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many invoices, and how much tax, each classification has."""
    tax = F.coalesce(F.col("portal.total_tax"), F.col("books.total_tax"))
    return _run(spark, sf).groupBy("classification").agg(F.count(F.lit(1)).alias("results"), F.sum(tax).alias("tax"))


@query
def gst_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every result of the exact run with verdict, score and value at risk."""
    return _run(spark, sf).drop("books", "portal")


@query
def gst_key_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    p = gst.keyed(derive.portal(spark, sf), CONFIG.gst)
    return p.select("pid", "invoice_number", "norm", "core", "fy", keys.fingerprint_key(F.col("invoice_number")).alias("print_key"), keys.valid_gstin(F.col("gstin")).alias("valid"), keys.malformed_gstin(F.col("gstin")).alias("malformed"))


@query
def gst_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return gst.duplicate_keys(derive.books(spark, sf), CONFIG.gst)


@query
def gst_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return gst.collisions(derive.books(spark, sf), derive.portal(spark, sf), CONFIG.gst)


@query
def gst_variant_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of equal core and near amount whose keys differ."""
    b = gst.sided(gst.keyed(derive.books(spark, sf), CONFIG.gst), "b_", "bid")
    p = gst.sided(gst.keyed(derive.portal(spark, sf), CONFIG.gst).withColumn("norm", F.concat(F.lit("P"), "norm")), "p_", "pid")
    met = b.join(p, (F.col("b_gstin") == F.col("p_gstin")) & (F.col("b_core") == F.col("p_core")))
    met = met.filter(within(F.col("b_invoice_value"), F.col("p_invoice_value"), CONFIG.gst.tolerance))
    return met.select("bid", "pid", "b_core")


@query
def gst_amount_date_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of one GSTIN with near amount and date, by buckets."""
    b = derive.books(spark, sf).select("bid", "gstin", F.col("invoice_value").alias("b_value"), F.col("invoice_date").alias("b_date"))
    p = derive.portal(spark, sf).select("pid", "gstin", F.col("invoice_value").alias("p_value"), F.col("invoice_date").alias("p_date"))
    t = CONFIG.gst.tolerance
    met = blocking.band_join(b, p, "b_value", "p_value", t, ["gstin"]).filter(within(F.col("b_value"), F.col("p_value"), t) & in_window(F.col("b_date"), F.col("p_date"), t.days))
    return met.select("bid", "pid")


@query
def gst_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """Which amendment takes the place of which original."""
    p = derive.portal(spark, sf).select("pid", "gstin", "invoice_number", F.lit("Invoice").alias("document_type"))
    a = p.filter("pid % 10 = 1").select((F.col("pid") + 5_000_000_000_000_000).alias("pid"), "gstin", "invoice_number", F.lit("Amendment").alias("document_type"))
    return gst.supersede(p.filter("pid % 7 <> 1").unionByName(a)).select("pid", "superseded", "amends")


@query
def gst_value_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    return run.groupBy("classification", "difference_type").agg(F.count(F.lit(1)).alias("results"), F.sum("difference").alias("difference"), F.sum("itc_at_risk").alias("itc_at_risk"), F.sum("gross_value").alias("gross_value"))


@query
def gst_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprinted(_run(spark, sf)).select("bid", "pid", "fingerprint")


@query
def gst_cross_period(spark: SparkSession, sf: str) -> DataFrame:
    return gst.adjacent_pairs(derive.books(spark, sf), derive.portal(spark, sf), CONFIG.gst)


@query
def gst_full_match(spark: SparkSession, sf: str) -> DataFrame:
    """All passes in order with one-to-one assignment, ambiguity and residuals."""
    return gst.match(derive.books(spark, sf), derive.portal(spark, sf), CONFIG.gst, Stages(spark, "gst"))


@query
def gst_document_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Portal words mapped to document types and their pools."""
    word = F.element_at(F.array(*(F.lit(x) for x in ("R", "SEZ", "DE", "CDN", "ISD", "IMPG", "weird", "reverse charge"))), (F.col("pid") % 8 + 1).cast("int"))
    value = F.when(F.col("pid") % 3 == 0, -F.col("invoice_value")).otherwise(F.col("invoice_value"))
    kinds = derive.portal(spark, sf).select(gst.document_type(word, value).alias("document_type"), value.alias("value"))
    return kinds.groupBy("document_type", gst.pool(F.col("document_type")).alias("pool")).agg(F.count(F.lit(1)).alias("documents"), F.sum("value").alias("value"))


@query
def gst_field_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field differs, and materially, over the matched pairs."""
    both = _run(spark, sf).filter("bid is not null and pid is not null")
    each = classify.fields_compared(both, ("gstin", "document_type", "taxable_value", "total_tax", "invoice_value"), CONFIG.gst.tolerance)
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("differs").cast("int")).alias("differing"), F.sum(F.col("material").cast("int")).alias("material"))


# --- TDS -------------------------------------------------------------------


def _tds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derive.frame(spark, sf, derive.TDS_BOOKS), derive.frame(spark, sf, derive.TDS_PORTAL)


@query
def tds_quarters(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("deposit_date")
    b = _tds(spark, sf)[0].groupBy("section", dates.fiscal_quarter(d).alias("quarter"), dates.financial_year(d).alias("fy"))
    return b.agg(F.count(F.lit(1)).alias("rows"), F.sum("tax_deducted").alias("tax"))


@query
def tds_challan_pass(spark: SparkSession, sf: str) -> DataFrame:
    return tds.challan_pairs(*_tds(spark, sf), CONFIG.tds).select("bid", "pid", "classification", "difference_type")


@query
def tds_aggregated_pass(spark: SparkSession, sf: str) -> DataFrame:
    out = tds.group_pairs(*_tds(spark, sf), CONFIG.tds)
    return out.select("pan", "section", "quarter", "books_tax", "portal_tax", "books_rows", "portal_rows", "books_first", "portal_first")


@query
def tds_section_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = tds.validate_sections(_tds(spark, sf)[0], tds.section_table(spark), CONFIG.tds)
    return out.groupBy("check_name", "difference_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("bid").alias("books_rows"))


@query
def tds_threshold_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """Payees over the annual limit without tax; every third payee is one whose tax was never deducted."""
    untaxed = F.substring("pan", 6, 4).cast("int") % 3 == 1
    b = _tds(spark, sf)[0].withColumn("tax_deducted", F.when(untaxed, 0).otherwise(F.col("tax_deducted")).cast("decimal(18,2)"))
    return tds.annual_breaches(b, tds.section_table(spark))


@query
def tds_rate_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The rate in force on each row's date, sections by alias."""
    rates = spark.createDataFrame([("194C", "1990-01-01", "1997-12-31", 1.0), ("194C", "1998-01-01", None, 2.0), ("194J", "1996-04-01", None, 10.0), ("194H", "1990-01-01", "1999-12-31", 5.0)], "section string, f string, t string, rate double")
    rates = rates.select("section", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"), "rate")
    aliases = spark.createDataFrame([("194A", "194J")], "alias string, section string")
    out = rules.rate_as_of(_tds(spark, sf)[0], rates, aliases)
    return out.groupBy("section", "canonical", "rate").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_paid_credited").alias("paid"))


@query
def tds_chain(spark: SparkSession, sf: str) -> DataFrame:
    """States of the six steps over all books rows."""
    b, p = _tds(spark, sf)
    seen = p.select(F.col("pid").alias("bid"), "pid")
    r = b.join(seen, "bid", "left").select("bid", "pid", "section", F.col("tax_deducted").alias("deducted"), F.col("tax_deposited").alias("deposited"), F.col("pid").isNotNull().alias("has_portal"), F.when(F.col("pid").isNull(), "Not in Portal").otherwise("Matched").alias("classification"), F.when(F.col("bid") % 10 == 3, "Rate Mismatch").alias("difference_type"))
    return tds.chain(r).groupBy("step", "stage", "state").agg(F.count(F.lit(1)).alias("rows"))


@query
def tds_full_match(spark: SparkSession, sf: str) -> DataFrame:
    return tds.match_deductor(*_tds(spark, sf), CONFIG.tds, Stages(spark, "tds"))


@query
def tds_deductee_match(spark: SparkSession, sf: str) -> DataFrame:
    """The deductee's passes; portal dates moved so that some fall in the next quarter."""
    b, p = _tds(spark, sf)
    late = p.withColumn("deposit_date", F.when(F.col("pid") % 5 == 2, F.add_months("deposit_date", 3)).otherwise(F.col("deposit_date")))
    return tds.match_deductee(b, late, CONFIG.tds, Stages(spark, "deductee"))


@query
def tds_run(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run: matches and section checks together, by kind."""
    out = tds.run(*_tds(spark, sf), tds.section_table(spark), CONFIG.tds, Stages(spark, "tds-run"), deductee=True)
    return out.groupBy("pass_name", "classification", "difference_type", "check_name").agg(F.count(F.lit(1)).alias("rows"))


# --- notes and other sources -------------------------------------------------


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes.prepare(derive.frame(spark, sf, derive.NOTES_BOOKS))


@query
def note_reference_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).select("nid", "note_reference", "note_key", "note_kind")


@query
def note_summary(spark: SparkSession, sf: str) -> DataFrame:
    return notes.summary(_notes(spark, sf))


@query
def note_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of equal reference and GSTIN inside the date guard."""
    b = _notes(spark, sf)
    p = b.filter("nid % 13 <> 0").withColumn("note_date", F.date_add("note_date", 4))
    pairs = assign.ordinal(b.withColumnRenamed("nid", "bid"), p.withColumnRenamed("nid", "pid"), ["gstin", "note_key"])
    return pairs.join(b.select(F.col("nid").alias("bid"), "note_kind"), "bid")


@query
def note_full_match(spark: SparkSession, sf: str) -> DataFrame:
    b = _notes(spark, sf)
    p = b.filter("nid % 13 <> 0").withColumn("note_date", F.date_add("note_date", 4)).withColumn("gstin", F.when(F.col("nid") % 17 == 0, "").otherwise(F.col("gstin")))
    return notes.match(b, p, CONFIG.notes, CONFIG.gst.tolerance, Stages(spark, "notes"))


def _other(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derive.frame(spark, sf, derive.OTHER_BOOKS), derive.frame(spark, sf, derive.OTHER_PORTAL)


@query
def other_reference_pass(spark: SparkSession, sf: str) -> DataFrame:
    return other.reference_pairs(*_other(spark, sf), CONFIG.other).select("bid", "pid", "books_amount", "portal_amount")


@query
def other_amount_date_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of near amount and date among rows without a reference."""
    b, p = _other(spark, sf)
    b = b.filter("reference = ''").select("bid", F.col("amount").alias("b_amount"), F.col("date").alias("b_date"))
    p = p.filter("reference = ''").select("pid", F.col("amount").alias("p_amount"), F.col("date").alias("p_date"))
    t = CONFIG.other.tolerance
    return blocking.band_join(b, p, "b_amount", "p_amount", t, dates=("b_date", "p_date")).filter(within(F.col("b_amount"), F.col("p_amount"), t) & in_window(F.col("b_date"), F.col("p_date"), t.days)).select("bid", "pid")


@query
def other_full_match(spark: SparkSession, sf: str) -> DataFrame:
    return other.match(*_other(spark, sf), CONFIG.other, Stages(spark, "other"))


# --- guards ------------------------------------------------------------------


def _loose(spark: SparkSession, sf: str) -> DataFrame:
    """Books with some wrong invoice values, heads, GSTINs and dates."""
    b, i = derive.books(spark, sf), F.col("bid")
    return b.withColumns(
        {
            "invoice_value": F.when(i % 12 == 1, F.col("invoice_value") + 5).otherwise(F.col("invoice_value")).cast("decimal(18,2)"),
            "sgst": F.when(i % 14 == 1, F.col("sgst") + 1).otherwise(F.col("sgst")).cast("decimal(18,2)"),
            "gstin": F.when(i % 15 == 1, F.concat("gstin", F.lit("9"))).otherwise(F.col("gstin")),
        }
    )


@query
def guard_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Arithmetic, mirror, GSTIN and period checks of one source in one pass."""
    return guards.verdicts(_loose(spark, sf), guards.gst_checks(CONFIG.guards, "1996-05"), CONFIG.guards, escalate=("tax_arithmetic", "mirror"))


@query
def guard_tax_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return _loose(spark, sf).filter(guards.arithmetic_fails(CONFIG.guards)).select("bid", "invoice_value")


@query
def guard_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return _loose(spark, sf).filter(guards.mirror_fails("cgst", "sgst", CONFIG.guards)).select("bid", "cgst", "sgst")


@query
def guard_implied_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose tax is not 4 per cent of the taxable value."""
    return _loose(spark, sf).filter(guards.implied_rate_fails("total_tax", "taxable_value", 4.0, CONFIG.guards)).groupBy("gstin").agg(F.count(F.lit(1)).alias("rows"))


@query
def guard_row_accounting(spark: SparkSession, sf: str) -> DataFrame:
    out = {"blank": F.col("bid") % 10 == 1, "total_row": F.col("invoice_value") > 90_000, "negative": F.col("bid") % 6 == 1}
    return guards.row_accounting(_loose(spark, sf), out)


@query
def guard_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return guards.duplicates(derive.books(spark, sf), ["gstin", "invoice_number"], "bid")


@query
def guard_control_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed sums of each supplier against the stated ones, of which some are wrong or lacking."""
    b = derive.books(spark, sf)
    stated = b.groupBy("gstin").agg(F.sum("invoice_value").alias("stated")).filter(~F.col("gstin").endswith("7")).withColumn("stated", F.when(F.col("gstin").endswith("3"), F.col("stated") + 2).otherwise(F.col("stated")))
    return guards.control_totals(b, stated, ["gstin"], "invoice_value", CONFIG.guards)


@query
def guard_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    return guards.required_fields(_tds(spark, sf)[0], ["pan", "section", "challan_number", "tax_deducted"])


@query
def guard_structural_issues(spark: SparkSession, sf: str) -> DataFrame:
    return guards.structural_issues(_loose(spark, sf), "bid")


@query
def document_key_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each document: sums, the first line's party, and the number of lines."""
    b = derive.books(spark, sf).withColumn("document", F.element_at(F.split("invoice_number", "/"), -1))
    return b.groupBy("gstin", "document").agg(F.sum("taxable_value").alias("taxable_value"), F.sum("total_tax").alias("total_tax"), F.sum("invoice_value").alias("invoice_value"), F.min_by("invoice_number", "bid").alias("first_line"), F.count(F.lit(1)).alias("lines"))


# --- state and analytics -------------------------------------------------------


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.run_summary(_run(spark, sf))


def _two_runs(spark: SparkSession, sf: str) -> DataFrame:
    b, p = derive.books(spark, sf), derive.portal(spark, sf)
    later = gst.exact_run(b.filter("bid % 23 <> 0"), p.filter("pid % 29 <> 0"), CONFIG.gst)
    return state.diff(_fingerprinted(gst.exact_run(b, p, CONFIG.gst)), _fingerprinted(later))


@query
def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _two_runs(spark, sf).filter("status <> 'same'")


@query
def run_movement(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.movement(_two_runs(spark, sf))


@query
def review_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews carried onto a run, and which of them are stale."""
    run = _fingerprinted(_run(spark, sf))
    key = F.coalesce("bid", "pid")
    events = run.filter(key % 3 == 1).select("fingerprint", F.lit(1).alias("at"), key.alias("event_id"), F.lit(False).alias("cleared"), F.when(key % 2 == 1, "Matched").otherwise(F.col("classification")).alias("reviewed_classification"), F.col("difference_type").alias("reviewed_type"), F.col("confidence_band").alias("reviewed_band"))
    cleared = events.filter("event_id % 5 = 1").withColumn("at", F.lit(2)).withColumn("cleared", F.lit(True))
    out = state.with_review(run, events.unionByName(cleared))
    return out.groupBy("classification", "reviewed", "stale").agg(F.count(F.lit(1)).alias("results"))


@query
def override_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Field corrections: the newest of each field wins, a null one clears."""
    run = _fingerprinted(_run(spark, sf)).select("fingerprint", "bid", F.col("books.party_name").alias("party_name"), F.col("books.document_type").alias("document_type")).filter("bid is not null")
    events = run.filter("bid % 4 = 1").select("fingerprint", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(at).alias("at")) for f, v, at in (("party_name", "Corrected", 1), ("document_type", "SEZ", 1), ("document_type", None, 2))))).alias("e"), F.col("bid").alias("event_id")).select("fingerprint", "e.*", "event_id")
    out = state.with_overrides(run, events, ["party_name", "document_type"])
    return out.groupBy("party_name", "document_type", "overridden").agg(F.count(F.lit(1)).alias("results"))


@query
def review_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.kpis(_run(spark, sf))


@query
def review_causes(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.by_cause(classify.cause(_run(spark, sf), CONFIG.gst.tolerance, CONFIG.materiality["GST"]))


@query
def supplier_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.suppliers(_run(spark, sf))


@query
def supplier_top8(spark: SparkSession, sf: str) -> DataFrame:
    """The report's eight suppliers with the most tax at risk."""
    return analytics.top_suppliers(_run(spark, sf), 8)


@query
def eligible_credit(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.eligible_credit(_run(spark, sf), F.coalesce(F.col("bid") % 9 == 1, F.lit(False)), F.coalesce(F.col("portal.document_type") == "SEZ", F.lit(False)))


@query
def exceptions_priority(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.exceptions(_run(spark, sf), CONFIG.materiality["GST"])
    return out.groupBy("classification", "priority", "recommendation", "confidence_pct").agg(F.count(F.lit(1)).alias("exceptions"), F.sum("value").alias("value"))


@query
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as work items: counts by priority and age escalation on a given day."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("created"), F.col("o_orderpriority").alias("priority"))
    return analytics.queue(o, F.lit("1998-08-01").cast("date"), 365).groupBy("priority", "age_escalated").agg(F.count(F.lit(1)).alias("items"), F.max("age_days").alias("oldest"))


@query
def filing_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Due dates of each obligation in each month that has orders."""
    obligations = spark.createDataFrame([("GSTR-1", 11, 1), ("GSTR-3B", 20, 1), ("TDS", 31, 1)], "obligation string, due_day int, months_after int")
    periods = spark.read.parquet(f"{sf}/orders.parquet").select(dates.period(F.col("o_orderdate")).alias("period")).distinct()
    return analytics.calendar(obligations, periods, F.lit("1998-08-01").cast("date")).select("obligation", "period", F.date_format("due", "yyyy-MM-dd").alias("due"), "days_until")


@query
def period_trend(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    own = run.groupBy(F.coalesce(F.col("books.party_name"), F.col("portal.party_name")).alias("client"), dates.period(F.coalesce(F.col("books.invoice_date"), F.col("portal.invoice_date"))).alias("period"))
    return analytics.trend(own.agg(F.sum(F.when(F.col("classification") == "Matched", 1).otherwise(0)).alias("matched"), F.count(F.lit(1)).alias("results")))


@query
def sync_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failures in a row at the newest end of each user's log."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").alias("at"), "event_id", (F.col("value") < 50).alias("failed"))
    return analytics.failure_runs(e, ["user_id"])


@query
def rule_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Client overrides over firm values, newest first, with suppliers as clients."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("client_id"))
    firm = [("materiality", "firm", None, "10000", "2024-04-01", 1), ("materiality", "firm", None, "12000", "2025-04-01", 2), ("window", "firm", None, "5", "2024-04-01", 3)]
    firm = spark.createDataFrame(firm, "rule_key string, scope string, client_id long, value string, f string, version_id long")
    own = s.filter("client_id % 4 = 1").select(F.lit("window").alias("rule_key"), F.lit("client").alias("scope"), "client_id", F.col("client_id").cast("string").alias("value"), F.lit("2024-05-01").alias("f"), (F.col("client_id") + 100).alias("version_id"))
    versions = firm.unionByName(own).withColumn("effective_from", F.to_date("f")).drop("f")
    return rules.resolve(versions, s)


@query
def indian_money_format(spark: SparkSession, sf: str) -> DataFrame:
    b = derive.books(spark, sf)
    amount = (F.col("taxable_value") * F.element_at(F.array(F.lit(1), F.lit(-1), F.lit(1000)), (F.col("bid") % 3 + 1).cast("int"))).cast("decimal(18,2)")
    return b.select("bid", amount.alias("amount"), keys.money_indian(amount).alias("shown"))


@query
def tax_rate_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Rate texts parsed to labels and rates."""
    text = F.element_at(F.array(F.lit("10% professional, 2% technical"), F.lit("5%"), F.lit("1% individual / 2% company, 7% company")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("text", text)
    return p.select("p_partkey", F.explode(rules.parse_rates("text")).alias("label", "rate"))


# --- verification ------------------------------------------------------------


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    """The exact run with a baseline class that differs here and there."""
    run = _run(spark, sf)
    i = F.coalesce("bid", "pid")
    baseline = F.when(i % 20 == 1, "Matched").when(i % 20 == 2, "Amount Difference").when(i % 20 == 3, "Not in Portal").otherwise(F.col("classification"))
    return run.select(i.alias("id"), F.col("classification").alias("engine_class"), baseline.alias("baseline_class"), F.col("difference_type").alias("engine_type"), "confidence_score", F.concat(F.lit("pass "), F.coalesce("difference_type", F.lit("duplicate"))).alias("reason"))


@query
def verify_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return verify.confusion(_aligned(spark, sf))


@query
def verify_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return verify.precision_recall(_aligned(spark, sf))


@query
def verify_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return verify.calibration(_aligned(spark, sf))


@query
def verify_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = gst.keyed(derive.books(spark, sf), CONFIG.gst).withColumnRenamed("bid", "eid")
    b = gst.keyed(derive.portal(spark, sf), CONFIG.gst).withColumnRenamed("pid", "lid")
    return verify.coverage(e, b, verify.align_by_key(e, b, ["gstin", "norm"]), CONFIG.coverage_floor)


@query
def verify_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return verify.disagreements(_aligned(spark, sf)).groupBy("engine_class", "baseline_class", "cause").agg(F.count(F.lit(1)).alias("pairs"))


@query
def verify_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """The share of agreeing pairs of each class against a threshold."""
    metrics = verify.precision_recall(_aligned(spark, sf)).select(F.concat(F.lit("recall "), "class").alias("metric"), F.col("recall").alias("value"))
    limits = spark.createDataFrame([("recall Matched", 0.95), ("recall Not in Books", 0.5), ("recall Amount Difference", None)], "metric string, threshold double")
    return verify.criteria(metrics, limits)


@query
def verify_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Three tiers of alignment of books with the portal, one to one."""
    shape = lambda f, i: gst.keyed(f, CONFIG.gst).select(i, "gstin", "norm", F.col("invoice_value").alias("amount"), F.col("invoice_date").alias("date"), F.col("party_name").alias("party"))
    e = shape(derive.books(spark, sf), F.col("bid").alias("eid"))
    return verify.align(e, shape(derive.portal(spark, sf), F.col("pid").alias("lid")), CONFIG.gst.tolerance, Stages(spark, "align"))


@query
def amount_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the exact pass by the tenth of their proximity."""
    both = _run(spark, sf).filter("bid is not null and pid is not null")
    tenth = F.floor(proximity(F.col("books.invoice_value"), F.col("portal.invoice_value"), CONFIG.gst.tolerance) * 10).cast("int")
    return both.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("pairs"))


# --- documents and streams ---------------------------------------------------


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Books as the text of invoices; every other one says Bill No. and gives its rate."""
    b, say = derive.books(spark, sf), F.lit
    even = F.col("bid") % 2 == 0
    number = F.concat(F.when(even, " Invoice No: ").otherwise(" Bill No. "), F.col("invoice_number"))
    taxes = F.concat(say(" Taxable Value: Rs. "), F.col("taxable_value").cast("string"), F.when(even, " CGST @ 9% : ").otherwise(" CGST "), F.col("cgst").cast("string"), say(" SGST "), F.when(even, "@ 9%").otherwise(F.col("sgst").cast("string")))
    text = F.concat(say("GSTIN: "), "gstin", number, say(" Date: "), F.date_format("invoice_date", "dd/MM/yyyy"), taxes, say(" Grand Total "), F.col("invoice_value").cast("string"), say(" Place of Supply: Delhi (07)"))
    return extract.extract(b.withColumn("text", text), "bid", "text")


@query
def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled fields of rendered invoices by state."""
    out = _rendered(spark, sf)
    return out.groupBy("field", "state", "reviewable").agg(F.count(F.lit(1)).alias("documents"), F.max("value").alias("greatest"))


@query
def document_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered invoices whose number and GSTIN stand on more than one document."""
    return extract.uploaded_again(_rendered(spark, sf), "bid")


@query
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return arrivals.replay(spark, sf)


@query
def result_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of reasons that results get, numbers shown as #."""
    run = _run(spark, sf).withColumn("pass_name", F.when(F.col("confidence_score") >= 98, "exact").otherwise("variant"))
    text = F.regexp_replace(reasons.reason(CONFIG.gst), "[0-9][0-9,./-]*", "#")
    return run.groupBy("classification", "difference_type", text.alias("reason")).agg(F.count(F.lit(1)).alias("results"))


@query
def review_narrative(spark: SparkSession, sf: str) -> DataFrame:
    return reasons.narrative(analytics.kpis(_run(spark, sf)))


@query
def narrative_check(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of two texts that no aggregate backs."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("decimal(18,2)").alias("number"))
    texts = spark.read.parquet(f"{sf}/region.parquet").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string"), F.lit(" has 1,234.50 and 24 of 25")).alias("text"))
    return reasons.unknown_numbers(texts, n).select("text", "raw")


@query
def slot_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Files by name and header tokens, one for each part."""
    pick = lambda items, m: F.element_at(F.array(*(F.lit(x) for x in items)), (F.col("p_partkey") % m + 1).cast("int"))
    names = pick(("purchase_register_tally.csv", "GSTR2B_aug.xlsx", "form26as.csv", "bank_statement.csv", "misc.csv", "ledger loan.csv"), 6)
    heads = F.split(pick(("gstin;voucher no", "utr;withdrawal", "itc availability;gstin", "a;b"), 4), ";")
    files = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("file"), names.alias("name"), heads.alias("headers"))
    return detect.slots(files)


@query
def declarative_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Books written as text, parsed back by rules, by supplier."""
    b = derive.books(spark, sf)
    raw = b.select(F.col("gstin").alias("GSTIN/UIN"), F.when(F.col("bid") % 9 == 1, "").otherwise(F.col("invoice_number")).alias("Bill No"), F.date_format("invoice_date", "dd-MM-yyyy").alias("Date"), F.concat(F.lit("₹ "), F.format_number("taxable_value", 2)).alias("Taxable"), F.col("cgst").cast("string").alias("CGST"), F.col("sgst").cast("string").alias("SGST"))
    rule = declarative.Rule
    sheet = declarative.Sheet({"gstin": rule("direct", ("GSTIN/UIN",), "upper"), "number": rule("direct", ("Bill No",)), "date": rule("direct", ("Date",), "date"), "taxable": rule("direct", ("Taxable",), "money"), "state_tax": rule("aggregate", ("CGST", "SGST")), "cess": rule("unavailable")}, identity=("number",))
    return declarative.parse(raw, sheet).groupBy("gstin").agg(F.count(F.lit(1)).alias("rows"), F.sum("taxable").alias("taxable"), F.sum("state_tax").alias("state_tax"), F.count("cess").alias("cess"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_date"))

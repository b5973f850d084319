"""Plain-language reasons of results, and summaries whose every number is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.config import Gst
from reconweave.functions.keys import money_indian
from reconweave.operators.classify import tax_total, zero

# What each cause is, and what to do about it.
NEXT_STEPS = {
    "missing_in_books": "Book the document or reject it on the portal.",
    "missing_in_portal": "Ask the supplier to file it.",
    "value_difference": "Compare the document with both sides.",
    "document_type_mismatch": "Correct the document type.",
    "timing_difference": "Wait for the other period.",
    "rounding_only": "Accept the rounding.",
    "below_materiality": "Accept or review in a batch.",
    "likely_ingestion_gap": "Export the books again with their tax columns.",
}


def reason(c: Gst) -> Column:
    """A sentence for a result with books, portal, classification, difference_type and pass_name."""
    b, p, cls, kind = F.col("books"), F.col("portal"), F.col("classification"), F.col("difference_type")
    number = F.coalesce(b["invoice_number"], p["invoice_number"], F.lit("without a number"))
    how = (
        F.when(F.col("pass_name") == "exact", "GSTIN and invoice number agree")
        .when(F.col("pass_name") == "variant", "GSTIN and the numeric part of the number agree")
        .when(F.col("pass_name") == "amount_date", "GSTIN, amount and date agree")
        .when(F.col("pass_name") == "fuzzy", "party, amount and date agree")
        .when(F.col("pass_name") == "cross_period", "found in an adjacent period")
    )
    gap = lambda f: F.concat(F.lit(f" ({f.replace('_', ' ')}: books "), money_indian(zero(b[f])), F.lit(", portal "), money_indian(zero(p[f])), F.lit(")"))
    tax = F.concat(F.lit(" (tax: books "), money_indian(tax_total(b)), F.lit(", portal "), money_indian(tax_total(p)), F.lit(")"))
    days = F.datediff(p["invoice_date"], b["invoice_date"])
    dates = F.when((kind == "Unexplained") & (days != 0), F.concat(F.lit("dates differ by "), F.abs(days).cast("string"), F.lit(" days")))
    detail = (
        F.when(cls == "Matched", "taxable value and all tax heads agree")
        .when(kind == "Taxable Value Difference", F.concat(kind, gap("taxable_value")))
        .when(kind.isin("Tax Amount Difference", "Tax Split Mismatch", "Rate Mismatch"), F.concat(kind, tax))
        .when(kind == "Document Type Mismatch", F.concat(kind, F.lit(" (books "), b["document_type"], F.lit(", portal "), p["document_type"], F.lit(")")))
        .otherwise(F.concat(F.coalesce(kind, F.lit("difference")), gap("invoice_value")))
    )
    paired = F.concat_ws(": ", F.concat(F.lit("Invoice "), number), F.concat_ws("; ", how, detail, dates))
    lone = F.when(cls == "Not in Books", F.concat(F.lit("Invoice "), number, F.lit(" is on the portal but not in the books"))).otherwise(F.concat(F.lit("Invoice "), number, F.lit(" is in the books but not on the portal"), F.when(kind == "Duplicate in Books", "; the books have its number more than once").otherwise("")))
    return F.concat(F.when(cls.isin("Not in Books", "Not in Portal"), lone).otherwise(paired), F.lit("."))


def next_step(cause: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NEXT_STEPS.items() for x in kv])[cause]


def narrative(kpis: DataFrame) -> DataFrame:
    """One sentence on the one row of analytics.kpis()."""
    share = F.round(F.col("matched").cast("double") * 100 / F.col("results"), 1)
    text = F.concat(F.col("matched").cast("string"), F.lit(" of "), F.col("results").cast("string"), F.lit(" documents ("), share.cast("string"), F.lit("%) agree; "), money_indian(F.col("at_stake")), F.lit(" of tax is at stake in "), F.col("open_results").cast("string"), F.lit(" open ones."))
    return kpis.select(text.alias("text"))


def unknown_numbers(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Numbers in texts (text) that are none of allowed (number); a narrative with any is not shown."""
    found = texts.select("text", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0)).alias("raw"))
    found = found.withColumn("number", F.regexp_replace("raw", ",", "").try_cast("decimal(18,2)"))
    return found.join(allowed.select(F.col("number").cast("decimal(18,2)").alias("number")).distinct(), "number", "left_anti")

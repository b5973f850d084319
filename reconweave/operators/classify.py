"""Verdicts of paired records as Columns over structs `books` and `portal`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.config import Gst, Tolerance
from reconweave.functions.predicates import gap, is_rounding, rates_differ, within

HEADS = ("cgst", "sgst", "igst", "cess")
BASES = ("taxable_value", "total_tax", "invoice_value")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("decimal(18,2)"))


def tax_total(record: Column) -> Column:
    return sum((zero(record[h]) for h in HEADS[1:]), zero(record[HEADS[0]])).cast("decimal(18,2)")


_PARTS = (*HEADS, *BASES)


def sides(pairs: DataFrame) -> DataFrame:
    """pairs with every amount of both records as a plain column, and the tax sums.

    Expressions name them instead of the record fields, which keeps plans small.
    """
    flat = pairs.withColumns({f"_{s[0]}_{k}": zero(F.col(s)[k]) for s in ("books", "portal") for k in _PARTS})
    return flat.withColumns({f"_{s}_tax": sum((F.col(f"_{s}_{h}") for h in HEADS[1:]), F.col(f"_{s}_{HEADS[0]}")).cast("decimal(18,2)") for s in "bp"})


def plain(pairs: DataFrame) -> DataFrame:
    return pairs.drop(*(f"_{s}_{k}" for s in "bp" for k in (*_PARTS, "tax")))


def _b(k: str) -> Column:
    return F.col(f"_b_{k}")


def _p(k: str) -> Column:
    return F.col(f"_p_{k}")


def split_differs(share: float) -> Column:
    """Whether some head's share of the tax differs by more than `share`."""
    x, y = F.col("_x"), F.col("_y")
    out = F.lit(False)
    for h in HEADS:
        out = out | (F.abs(_b(h).cast("double") * y - _p(h).cast("double") * x) > share * x * y)
    return (x > 0) & (y > 0) & out


def compare(pairs: DataFrame, c: Gst) -> DataFrame:
    """pairs (books, portal) with classification and difference_type: null, the one issue, or Unexplained."""
    t, heads, rounding = c.tolerance, F.lit(True), F.lit(False)
    for h in HEADS:
        heads = heads & within(_b(h), _p(h), t)
    for h in (*HEADS, "taxable_value"):
        rounding = rounding | (~within(_b(h), _p(h), t) & is_rounding(_b(h), _p(h), t))
    out = sides(pairs).withColumns({"_x": F.col("_b_tax").cast("double"), "_y": F.col("_p_tax").cast("double")})
    out = out.withColumns(
        {
            "_tv": within(_b("taxable_value"), _p("taxable_value"), t),
            "_total": within(F.col("_b_tax"), F.col("_p_tax"), t),
            "_rates": rates_differ(F.col("_b_tax"), _b("taxable_value"), F.col("_p_tax"), _p("taxable_value"), c.rate_gap),
            "_split": ~heads & split_differs(c.share_gap),
            "_type": ~F.col("books.document_type").eqNullSafe(F.col("portal.document_type")),
            "_rounding": rounding,
        }
    )
    found = F.array(
        F.when(~F.col("_tv"), "Taxable Value Difference"),
        F.when(~F.col("_total") & F.col("_rates") & F.col("_tv"), "Tax Amount Difference"),
        F.when(F.col("_split"), "Tax Split Mismatch"),
        F.when(F.col("_type"), "Document Type Mismatch"),
    )
    out = out.withColumn("_issues", F.array_compact(found))
    kind = F.when(F.size("_issues") > 1, "Unexplained").when(F.size("_issues") == 1, F.col("_issues")[0]).when(F.col("_rates"), "Rate Mismatch").when(F.col("_rounding"), "Rounding")
    out = plain(out.withColumn("difference_type", kind)).drop("_x", "_y", "_tv", "_total", "_rates", "_split", "_type", "_rounding", "_issues")
    return out.withColumn("classification", F.when(F.col("difference_type").isNull(), "Matched").otherwise("Amount Difference"))


def value_at_risk(results: DataFrame) -> DataFrame:
    """difference, itc_at_risk and gross_value of each result.

    The difference is portal less books on the basis that the type names, else on
    that of the largest gap, the first one on ties.
    """
    cls, kind = F.col("classification"), F.col("difference_type")
    out = sides(results).withColumns({f"_g{i}": F.abs(_b(k) - _p(k)) for i, k in enumerate(BASES)})
    largest = F.when((F.col("_g0") >= F.col("_g1")) & (F.col("_g0") >= F.col("_g2")), BASES[0]).when(F.col("_g1") >= F.col("_g2"), BASES[1]).otherwise(BASES[2])
    basis = F.when(kind.isin("Tax Amount Difference", "Tax Split Mismatch", "Rate Mismatch"), "total_tax").when(kind == "Taxable Value Difference", "taxable_value").otherwise(largest)
    out = out.withColumn("_basis", basis)
    signed = F.lit(None).cast("decimal(18,2)")
    for k in BASES:
        signed = F.when(F.col("_basis") == k, _p(k) - _b(k)).otherwise(signed)
    nought = F.lit(0).cast("decimal(18,2)")
    out = out.withColumns(
        {
            "difference": F.when(cls == "Amount Difference", signed).otherwise(nought).cast("decimal(18,2)"),
            "itc_at_risk": F.when(cls == "Not in Books", F.col("_p_tax")).when(cls == "Not in Portal", F.col("_b_tax")).when(cls == "Amount Difference", F.abs(F.col("_p_tax") - F.col("_b_tax"))).otherwise(nought).cast("decimal(18,2)"),
            "gross_value": F.when(cls == "Not in Books", _p("invoice_value")).when(cls == "Not in Portal", _b("invoice_value")).otherwise(nought).cast("decimal(18,2)"),
        }
    )
    return plain(out).drop("_g0", "_g1", "_g2", "_basis")


def cause(results: DataFrame, t: Tolerance, materiality: float, recon: str = "GST") -> DataFrame:
    """results (with difference) and the display cause of each."""
    b, p, cls, kind = F.col("books"), F.col("portal"), F.col("classification"), F.col("difference_type")
    bare = (zero(b["taxable_value"]) == 0) & (tax_total(b) == 0) & (gap(zero(b["invoice_value"]), zero(p["invoice_value"])) <= F.lit(t.absolute)) if recon == "GST" else F.lit(False)
    size = F.abs(F.col("difference"))
    return results.withColumn(
        "cause",
        F.when(cls == "Not in Books", "missing_in_books")
        .when(cls == "Not in Portal", "missing_in_portal")
        .when(kind == "Document Type Mismatch", "document_type_mismatch")
        .when(kind == "Timing Difference", "timing_difference")
        .when(bare, "likely_ingestion_gap")
        .when(size <= t.rounding, "rounding_only")
        .when(kind.isNull() & (size < materiality), "below_materiality")
        .otherwise("value_difference"),
    )


def fields_compared(results: DataFrame, fields: tuple[str, ...], t: Tolerance) -> DataFrame:
    """One row for each field that either side fills: field, books_value, portal_value, differs, material."""
    rows = [F.struct(F.lit(k).alias("field"), F.col("books")[k].cast("string").alias("books_value"), F.col("portal")[k].cast("string").alias("portal_value")) for k in fields]
    out = results.select("bid", "pid", F.explode(F.array(*rows)).alias("_f")).select("bid", "pid", "_f.*")
    out = out.filter((F.coalesce(F.trim("books_value"), F.lit("")) != "") | (F.coalesce(F.trim("portal_value"), F.lit("")) != ""))
    a, b = F.col("books_value").try_cast("decimal(18,4)"), F.col("portal_value").try_cast("decimal(18,4)")
    differs = F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(~F.trim("books_value").eqNullSafe(F.trim("portal_value")))
    return out.withColumn("differs", differs).withColumn("material", F.coalesce(F.abs(a - b) > t.absolute, F.col("differs")))

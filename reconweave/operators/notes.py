"""Credit and debit notes: preparation, candidates, matching and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.config import CREDIT_NUMBER, Notes, Tolerance
from reconweave.functions.keys import has_gstin, malformed_gstin, note_key, note_kind, note_reference
from reconweave.functions.predicates import band, in_window, proximity, score, within
from reconweave.operators.assign import ambiguous, serial
from reconweave.operators.blocking import band_join
from reconweave.stages import Stages


def prepare(frame: DataFrame) -> DataFrame:
    """nid, gstin, note_reference, note_key, note_kind, note_date and absolute money.

    frame: nid, gstin, note_type, voucher_number, narration, note_date, taxable_value, total_tax, invoice_value.
    """
    reference = F.coalesce(note_reference(F.col("narration")), F.when(F.col("voucher_number").rlike(CREDIT_NUMBER), F.col("voucher_number")))
    money = {c: F.abs(c) for c in ("taxable_value", "total_tax", "invoice_value")}
    kind = note_kind(F.col("note_type"), F.col("voucher_number"), F.col("narration"), F.col("invoice_value"))
    return frame.withColumn("note_kind", kind).withColumns(money).withColumn("note_reference", reference).withColumn("note_key", F.nullif(note_key(F.col("note_reference")), F.lit("")))


def gstins_agree(a: Column, b: Column) -> Column:
    """Equal, or one of them missing; two missing ones do not agree."""
    return F.when(has_gstin(a) & has_gstin(b), a == b).otherwise(has_gstin(a) | has_gstin(b))


def _parts(rows: DataFrame, side: str, ident: str, lengths: list[int], whole: bool) -> DataFrame:
    """Every distinct part of some lengths of each row's key, with its GSTIN and id; whole: the key itself is one."""
    key = F.col(f"{side}_note_key")
    of_length = lambda n: F.when(F.length(key) > n - whole, F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substring(key, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.flatten(F.array(*map(of_length, lengths))))
    return rows.select(F.col(f"{side}_gstin").alias("_g"), F.col(ident), F.explode(every).alias("_part"))


def _containing(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of one GSTIN of which one key is inside the other; equal keys are among them.

    The parts of either side's keys, of the lengths that whole keys of the other side
    have, meet those whole keys: nothing meets but what contains, whatever numbering
    scheme a supplier has.  Only ids meet; the rows are joined back.
    """

    def met(outer: DataFrame, inner: DataFrame, sides: str, ids: tuple[str, str]) -> DataFrame:
        whole = inner.filter(F.col(f"{sides[1]}_note_key") != "").select(F.col(f"{sides[1]}_gstin").alias("_g"), F.col(f"{sides[1]}_note_key").alias("_part"), ids[1])
        lengths = sorted(r[0] for r in whole.select(F.length("_part")).distinct().collect())  # a row for each length of a key
        if not lengths:
            return whole.select(F.lit(None).cast("long").alias(ids[0]), ids[1]).limit(0)
        return _parts(outer, sides[0], ids[0], lengths, sides == "bp").join(whole, ["_g", "_part"]).select(*ids)

    known = lambda f, side: f.filter(has_gstin(F.col(f"{side}_gstin")))
    b, p = known(x, "b"), known(y, "p")
    pairs = met(b, p, "bp", ("bid", "pid")).unionByName(met(p, b, "pb", ("pid", "bid")))
    return x.join(pairs, "bid").join(y, "pid")


def match(books: DataFrame, portal: DataFrame, c: Notes, t: Tolerance, stages: Stages) -> DataFrame:
    """bid, pid, pass_name, confidence_score, confidence_band, classification of prepared notes.

    Passes: equal reference; one reference inside the other for one GSTIN; GSTIN with
    window and value.  All keep the date guard; a missing GSTIN also needs the value.
    A pair of a credit and a debit note is a Document Type Mismatch, unless
    c.require_kind is off.
    """
    kept = ("gstin", "note_key", "note_kind", "note_date", "taxable_value", "total_tax", "invoice_value")
    b = stages(books.select(F.col("nid").alias("bid"), *(F.col(k).alias(f"b_{k}") for k in kept)))
    p = stages(portal.select(F.col("nid").alias("pid"), *(F.col(k).alias(f"p_{k}") for k in kept)))
    guard = in_window(F.col("b_note_date"), F.col("p_note_date"), c.guard_days)
    value = within(F.col("b_invoice_value"), F.col("p_invoice_value"), t)
    window = in_window(F.col("b_note_date"), F.col("p_note_date"), c.days)
    both = has_gstin(F.col("b_gstin")) & has_gstin(F.col("p_gstin"))
    fits = guard & gstins_agree(F.col("b_gstin"), F.col("p_gstin")) & (both | value)
    inside = F.col("b_note_key").contains(F.col("p_note_key")) | F.col("p_note_key").contains(F.col("b_note_key"))
    done, near = None, proximity(F.col("b_invoice_value"), F.col("p_invoice_value"), t)
    for name, baseline in (("reference", c.exact), ("containment", c.variant), ("value", c.value)):
        x, y = (b, p) if done is None else (b.join(done, "bid", "left_anti"), p.join(done, "pid", "left_anti"))
        if name == "reference":
            met = x.join(y, F.col("b_note_key") == F.col("p_note_key")).filter(fits)
        elif name == "containment":
            met = _containing(x, y).filter((F.col("b_gstin") == F.col("p_gstin")) & both & guard & inside & (F.col("b_note_key") != F.col("p_note_key")))
        else:
            met = band_join(x.withColumn("_g", F.col("b_gstin")), y.withColumn("_g", F.col("p_gstin")), "b_invoice_value", "p_invoice_value", t, ["_g"]).drop("_g").filter(both & guard & value & window)
        edges = stages(met.select("bid", "pid", near.alias("near")))
        rank = F.round(F.lit(baseline) * F.col("near"), 4)
        got = ambiguous(edges, serial(edges, stages, rank), rank, 5.0).select("bid", "pid", "ambiguous", F.lit(name).alias("pass_name"), F.lit(baseline).alias("points"))
        done = stages(got if done is None else done.unionByName(got))
    out = done.join(b, "bid").join(p, "pid")
    penalty = F.when(F.col("ambiguous"), c.ambiguity_penalty).otherwise(0.0) + F.when(~both, c.missing_gstin_penalty).otherwise(0.0) + F.when(malformed_gstin(F.col("b_gstin")), c.invalid_gstin_penalty).otherwise(0.0)
    points = score(F.col("points") + penalty)
    names = ["bid", "pid", "pass_name", "confidence_score", "confidence_band", "classification", "difference_type"]
    other_kind = F.lit(c.require_kind) & (F.col("b_note_kind") != F.col("p_note_kind"))
    gap = F.when(~within(F.col("b_taxable_value"), F.col("p_taxable_value"), t), "Taxable Value Difference").when(~within(F.col("b_total_tax"), F.col("p_total_tax"), t), "Tax Amount Difference").otherwise("Unexplained")
    out = out.withColumns({"confidence_score": points, "confidence_band": F.when(F.col("ambiguous") | ~both, "Low").otherwise(band(points, 92, 65)), "classification": F.when(value & ~F.coalesce(other_kind, F.lit(False)), "Matched").otherwise("Amount Difference"), "difference_type": F.when(other_kind, "Document Type Mismatch").when(~value, gap)}).select(names)
    rest = {"pass_name": F.lit("residual"), "difference_type": F.lit(None).cast("string"), "confidence_score": F.lit(0.0), "confidence_band": F.lit("Low")}
    only_b = b.join(done, "bid", "left_anti").withColumns(rest | {"pid": F.lit(None).cast("long"), "classification": F.lit("Not in Portal")})
    only_p = p.join(done, "pid", "left_anti").withColumns(rest | {"bid": F.lit(None).cast("long"), "classification": F.lit("Not in Books")})
    return out.unionByName(only_b.select(names)).unionByName(only_p.select(names))


def match_with_adjacent(books: DataFrame, portal: DataFrame, adjacent: DataFrame, c: Notes, t: Tolerance, stages: Stages) -> DataFrame:
    """match(), then the notes left over against an adjacent period's portal notes.

    Those pairs have the cross-period penalty and cross_period; adjacent notes that
    stay unmatched are not emitted.
    """
    own = stages(match(books, portal, c, t, stages).withColumn("cross_period", F.lit(False)))
    rest = books.join(own.filter("pid is null").select(F.col("bid").alias("nid")), "nid", "left_semi")
    late = match(rest, adjacent, c, t, stages).filter("bid is not null and pid is not null")
    points = score(F.col("confidence_score") + c.cross_period_penalty)
    late = stages(late.withColumns({"confidence_score": points, "confidence_band": F.when(F.col("confidence_band") == "Low", "Low").otherwise(band(points, 92, 65)), "cross_period": F.lit(True)}))
    return own.join(late.select("bid"), "bid", "left_anti").unionByName(late)


def near_misses(books: DataFrame, portal: DataFrame, c: Notes, t: Tolerance) -> DataFrame:
    """Pairs of equal reference that are no match, with what forbids each: bid, pid, why."""
    b = books.select(F.col("nid").alias("bid"), "note_key", *(F.col(k).alias(f"b_{k}") for k in ("gstin", "note_date", "invoice_value")))
    p = portal.select(F.col("nid").alias("pid"), "note_key", *(F.col(k).alias(f"p_{k}") for k in ("gstin", "note_date", "invoice_value")))
    both = has_gstin(F.col("b_gstin")) & has_gstin(F.col("p_gstin"))
    why = F.array_compact(
        F.array(
            F.when(~gstins_agree(F.col("b_gstin"), F.col("p_gstin")), "gstin"),
            F.when(~in_window(F.col("b_note_date"), F.col("p_note_date"), c.guard_days), "date"),
            F.when(~both & ~within(F.col("b_invoice_value"), F.col("p_invoice_value"), t), "value"),
        )
    )
    return b.join(p, "note_key").select("bid", "pid", why.alias("why")).filter(F.size("why") > 0)


def summary(notes: DataFrame) -> DataFrame:
    """Count, tax and value for each kind and key state of prepared notes."""
    state = F.when(F.col("note_key").isNull(), "no reference").otherwise("referenced")
    return notes.groupBy("note_kind", state.alias("state")).agg(F.count(F.lit(1)).alias("notes"), F.sum("total_tax").alias("tax"), F.sum("invoice_value").alias("gross"))

"""Invoice matching: books against a portal statement, pass by pass.

Each pass sees only what the passes before left over.  Candidates come from a join,
the choice among them from an assignment, the verdict from expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconweave.config import Gst
from reconweave.functions.dates import period, shifted_period
from reconweave.functions.keys import core_key, fy_only_key, has_gstin, invoice_key, malformed_gstin
from reconweave.functions.predicates import band, in_window, proximity, score, within
from reconweave.functions.similarity import token_sort_ratio
from reconweave.operators import classify
from reconweave.operators.assign import ambiguous, ordinal, serial
from reconweave.operators.blocking import band_join
from reconweave.stages import Stages

FIELDS = ("gstin", "party_name", "invoice_number", "document_type", "invoice_date", "taxable_value", "cgst", "sgst", "igst", "cess", "total_tax", "invoice_value")
# What books numbers say about a document, and portal words for its types.
TYPE_WORDS = {"r": "Invoice", "regular": "Invoice", "invoice": "Invoice", "sez": "SEZ", "de": "Deemed Export", "cdn": "Credit Note", "credit note": "Credit Note", "debit note": "Debit Note", "b2ba": "Amendment", "isd": "ISD", "impg": "Import", "reverse charge": "Reverse Charge"}
NOTE_TYPES = ("Credit Note", "Debit Note")


def document_type(word: Column, value: Column) -> Column:
    """A portal word's type; an unknown word is an invoice or credit note by sign."""
    known = F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv])
    return F.coalesce(known[F.lower(F.trim(word))], F.when(value < 0, "Credit Note").otherwise("Invoice"))


def books_type(number: Column, value: Column) -> Column:
    return F.when(number.rlike(r"(?i)^CN\s*[-/]"), "Credit Note").when(number.rlike(r"(?i)^DN\s*[-/]"), "Debit Note").when(value < 0, "Credit Note").otherwise("Invoice")


def keyed(frame: DataFrame, c: Gst) -> DataFrame:
    """The frame with norm, core and fy keys; a blank key is null and meets nothing."""
    n = F.col("invoice_number")
    return frame.withColumns({"norm": F.nullif(invoice_key(n, c.fy_patterns), F.lit("")), "core": core_key(n, c.fy_patterns), "fy": fy_only_key(n, c.fy_patterns)})


def pool(document: Column, reverse_charge: Column | None = None) -> Column:
    """Which pool a document is matched in."""
    flag = F.coalesce(reverse_charge, F.lit(False)) if reverse_charge is not None else F.lit(False)
    return F.when(document.isin(*NOTE_TYPES), "notes").when(document == "ISD", "isd").when((document == "Reverse Charge") | flag, "reverse_charge").when(document == "Import", "import").otherwise("regular")


def supersede(portal: DataFrame) -> DataFrame:
    """Amendments take the place of the first earlier original of their GSTIN and number.

    portal: pid, gstin, invoice_number, document_type.  Adds amends (pid of the
    original, null if it has none or is none) and superseded (an amendment took it).
    """
    side = portal.select("pid", "gstin", "invoice_number", (F.col("document_type") == "Amendment").alias("is_amendment"))
    key = ["gstin", "invoice_number"]
    pairs = ordinal(side.filter("is_amendment").withColumnRenamed("pid", "aid"), side.filter("not is_amendment"), key, "aid", "pid")
    gone = pairs.select("pid", F.lit(True).alias("superseded"))
    taken = pairs.select(F.col("aid").alias("pid"), F.col("pid").alias("amends"))
    return portal.join(gone, "pid", "left").join(taken, "pid", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def duplicate_keys(books: DataFrame, c: Gst) -> DataFrame:
    """(gstin, norm, copies) of keys that more than one books row has."""
    return keyed(books, c).filter("norm is not null").groupBy("gstin", "norm").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def collisions(books: DataFrame, portal: DataFrame, c: Gst) -> DataFrame:
    """Keys of either side that different raw numbers of one GSTIN share."""
    out = None
    for side, frame in (("books", books), ("portal", portal)):
        for key in ("norm", "core"):
            k = keyed(frame, c).filter(f"{key} is not null").groupBy("gstin", F.col(key).alias("key_value"))
            k = k.agg(F.count_distinct("invoice_number").alias("numbers"), F.min("invoice_number").alias("first_number")).filter("numbers > 1")
            k = k.select(F.lit(side).alias("side"), F.lit(key).alias("key_kind"), "*")
            out = k if out is None else out.unionByName(k)
    return out


def _record(prefix: str) -> Column:
    return F.struct(*(F.col(f"{prefix}{f}").alias(f) for f in FIELDS))


def sided(frame: DataFrame, prefix: str, ident: str) -> DataFrame:
    return frame.select(F.col(ident), *(F.col(c).alias(f"{prefix}{c}") for c in (*FIELDS, "norm", "core", "fy")))


def exact_run(books: DataFrame, portal: DataFrame, c: Gst) -> DataFrame:
    """The exact pass with k-th pairing, residuals, verdicts and value at risk: bid, pid, books, portal, ...

    Both sides are dealt once by (gstin, norm); ranks, copies and pairs all follow
    from that partitioning.  A row without a key has one of its own and stays alone.
    """

    def side(frame: DataFrame, ident: str, mark: str) -> DataFrame:
        known = F.col("gstin").isNotNull() & F.col("norm").isNotNull()
        own = F.concat(F.lit(mark), F.col(ident).cast("string"))
        record = F.struct(*(F.col(f) for f in FIELDS)).alias("record")
        return keyed(frame, c).select(F.lit(mark).alias("side"), F.col(ident).alias("id"), F.when(known, F.col("gstin")).alias("_g"), F.when(known, F.col("norm")).otherwise(own).alias("_n"), "fy", record)

    rows = side(books, "bid", "b").unionByName(side(portal, "pid", "p")).repartition("_g", "_n")
    key = Window.partitionBy("_g", "_n", "side")
    rows = rows.withColumn("_k", F.row_number().over(key.orderBy("id"))).withColumn("copies", F.count(F.lit(1)).over(key))
    of = lambda mark: F.max(F.when(F.col("side") == mark, F.struct("id", "fy", "copies", "record")))
    out = rows.groupBy("_g", "_n", "_k").agg(of("b").alias("b"), of("p").alias("p"))
    both = F.col("bid").isNotNull() & F.col("pid").isNotNull()
    points = F.when(both, F.when(F.col("b.fy") == F.col("p.fy"), c.exact).otherwise(c.variant)).otherwise(0.0)
    out = out.withColumns({"bid": F.col("b.id"), "pid": F.col("p.id")}).withColumn("points", points)
    out = out.select("bid", "pid", F.col("b.record").alias("books"), F.col("p.record").alias("portal"), "points", F.col("b.copies").alias("copies"))
    lone = F.when(F.col("bid").isNull(), "Not in Books").when(F.col("pid").isNull(), "Not in Portal")
    doubled = F.when(F.col("pid").isNull() & (F.col("copies") > 1), "Duplicate in Books")
    out = classify.compare(out, c).withColumns({"classification": F.coalesce(lone, F.col("classification")), "difference_type": F.when(both, F.col("difference_type")).otherwise(doubled)})
    out = classify.value_at_risk(out.drop("copies"))
    penalty = F.when(malformed_gstin(F.coalesce(F.col("books.gstin"), F.col("portal.gstin"))), c.invalid_gstin_penalty).otherwise(0.0)
    out = out.withColumn("confidence_score", F.when(F.col("points") > 0, score(F.col("points") + penalty)).otherwise(0.0)).drop("points")
    return out.withColumn("confidence_band", band(F.col("confidence_score"), c.high, c.medium))


def _unique_core(frame: DataFrame, prefix: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(f"{prefix}gstin", f"{prefix}core")) == 1


def match(books: DataFrame, portal: DataFrame, c: Gst, stages: Stages, adjacent: DataFrame | None = None) -> DataFrame:
    """All passes: bid, pid, pass_name, confidence_score, confidence_band, ambiguous, classification, difference_type.

    Passes: exact key (or a core that is unique on both sides), core with amount,
    amount with date, fuzzy party over all GSTINs, adjacent period.  Residuals follow.
    """
    t = c.tolerance
    b = stages(sided(keyed(books, c), "b_", "bid").withColumn("b_unique", F.lit(None).cast("boolean")))
    p = stages(sided(keyed(portal, c), "p_", "pid").withColumn("p_unique", F.lit(None).cast("boolean")))
    same = F.col("b_gstin") == F.col("p_gstin")
    if not c.blank_gstin_matches:
        same = same & has_gstin(F.col("b_gstin"))
    near = proximity(F.col("b_invoice_value"), F.col("p_invoice_value"), t)
    amounts = within(F.col("b_invoice_value"), F.col("p_invoice_value"), t)
    dates = in_window(F.col("b_invoice_date"), F.col("p_invoice_date"), t.days)
    done = None

    def exact(x: DataFrame, y: DataFrame) -> DataFrame:
        keys = x.join(y, same & (F.col("b_norm") == F.col("p_norm"))).withColumn("points", F.when(F.col("b_fy") == F.col("p_fy"), c.exact).otherwise(c.variant))
        u, v = (f.filter(F.col(f"{k}core").isNotNull()).withColumn("_one", _unique_core(f, k)).filter("_one").drop("_one") for f, k in ((x, "b_"), (y, "p_")))
        cores = u.join(v, same & (F.col("b_core") == F.col("p_core")) & ~F.col("b_norm").eqNullSafe(F.col("p_norm"))).withColumn("points", F.lit(c.variant))
        return keys.unionByName(cores)

    def variant(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, same & (F.col("b_core") == F.col("p_core")) & amounts).withColumn("points", F.lit(c.variant))

    def amount_date(x: DataFrame, y: DataFrame) -> DataFrame:
        met = band_join(x.withColumn("_g", F.col("b_gstin")), y.withColumn("_g", F.col("p_gstin")), "b_invoice_value", "p_invoice_value", t, ["_g"]).drop("_g")
        return met.filter(same & amounts & dates).withColumn("points", F.lit(c.amount_date))

    def fuzzy(x: DataFrame, y: DataFrame) -> DataFrame:
        met = band_join(x, y, "b_invoice_value", "p_invoice_value", t, dates=("b_invoice_date", "p_invoice_date")).filter(amounts & dates)
        known = has_gstin(F.col("b_gstin")) & has_gstin(F.col("p_gstin"))
        twin = (F.abs(F.col("b_invoice_value") - F.col("p_invoice_value")) <= 0.005) & (F.col("b_invoice_date") == F.col("p_invoice_date"))
        short, long = F.least(F.length("b_party_name"), F.length("p_party_name")), F.length("b_party_name") + F.length("p_party_name")
        met = met.filter((known | twin) & (200 * short >= c.fuzzy_without_gstin * long))
        met = met.withColumn("_ratio", token_sort_ratio(F.lower("b_party_name"), F.lower("p_party_name")))
        return met.filter(F.col("_ratio") >= F.when(known, c.fuzzy).otherwise(c.fuzzy_without_gstin)).drop("_ratio").withColumn("points", F.lit(c.fuzzy_baseline))

    for name, candidates in (("exact", exact), ("variant", variant), ("amount_date", amount_date), ("fuzzy", fuzzy)):
        x, y = (b, p) if done is None else (b.join(done, "bid", "left_anti"), p.join(done, "pid", "left_anti"))
        edges = stages(candidates(x, y).select("bid", "pid", "points", near.alias("near")).groupBy("bid", "pid").agg(F.max("points").alias("points"), F.max("near").alias("near")))
        rank = F.round(F.col("points") * F.col("near"), 4)
        got = stages(ambiguous(edges, serial(edges, stages, rank), rank, c.ambiguity_margin).withColumn("pass_name", F.lit(name)))
        got = got.select("bid", "pid", "pass_name", "points", "ambiguous")
        done = got if done is None else stages(done.unionByName(got))
    out = done.join(b, "bid").join(p, "pid")
    if adjacent is not None:
        out = out.unionByName(_cross_period(b.join(done, "bid", "left_anti"), adjacent, c, stages, same, amounts, near))
    invalid = F.when(malformed_gstin(F.col("b_gstin")) | malformed_gstin(F.col("p_gstin")), c.invalid_gstin_penalty).otherwise(0.0)
    crossed = F.when(F.col("pass_name") == "cross_period", c.cross_period_penalty).otherwise(0.0)
    out = out.withColumn("confidence_score", score(F.col("points") + F.when(F.col("ambiguous"), c.ambiguity_penalty).otherwise(0.0) + invalid + crossed))
    out = out.withColumn("confidence_band", F.when(F.col("ambiguous"), "Low").otherwise(band(F.col("confidence_score"), c.high, c.medium)))
    out = classify.compare(out.select("bid", "pid", "pass_name", "confidence_score", "confidence_band", "ambiguous", _record("b_").alias("books"), _record("p_").alias("portal")), c)
    out = stages(out.withColumn("difference_type", F.when((F.col("pass_name") == "cross_period") & F.col("difference_type").isNull(), "Timing Difference").otherwise(F.col("difference_type"))).drop("books", "portal"))
    copies = duplicate_keys(books, c).select(F.col("gstin").alias("b_gstin"), F.col("norm").alias("b_norm"), "copies")
    blank = {"pass_name": F.lit("residual"), "confidence_score": F.lit(0.0), "confidence_band": F.lit("Low"), "ambiguous": F.lit(False)}
    only_b = b.join(out.select("bid"), "bid", "left_anti").join(copies, ["b_gstin", "b_norm"], "left").withColumns(blank | {"pid": F.lit(None).cast("long"), "classification": F.lit("Not in Portal"), "difference_type": F.when(F.col("copies") > 1, "Duplicate in Books")})
    only_p = p.join(out.filter("pass_name <> 'cross_period'").select("pid"), "pid", "left_anti").withColumns(blank | {"bid": F.lit(None).cast("long"), "classification": F.lit("Not in Books"), "difference_type": F.lit(None).cast("string")})
    names = ["bid", "pid", "pass_name", "confidence_score", "confidence_band", "ambiguous", "classification", "difference_type"]
    return out.select(names).unionByName(only_b.select(names)).unionByName(only_p.select(names))


def match_pools(books: DataFrame, portal: DataFrame, c: Gst, stages: Stages) -> DataFrame:
    """match() of each pool of portal documents in turn, with the pool of every result.

    Notes and ISD rows match no invoice.  A books row that one pool matched is gone
    for the next; unmatched books rows are emitted once, with the last pool.
    """
    b = stages(books.filter(~books_type(F.col("invoice_number"), F.col("invoice_value")).isin(*NOTE_TYPES)))
    p = stages(portal.withColumn("_pool", pool(F.col("document_type"))))
    out, order = None, ("regular", "reverse_charge", "import")
    for name in order:
        got = stages(match(b, p.filter(F.col("_pool") == name).drop("_pool"), c, stages).withColumn("pool", F.lit(name)))
        b = b.join(got.filter("bid is not null and pid is not null").select("bid"), "bid", "left_anti")
        got = got if name == order[-1] else got.filter("pid is not null")
        out = got if out is None else out.unionByName(got)
    return out


def _cross_period(rest: DataFrame, adjacent: DataFrame, c: Gst, stages: Stages, same: Column, amounts: Column, near: Column) -> DataFrame:
    """Leftover books rows against the next or previous period's portal rows."""
    q = stages(sided(keyed(adjacent, c), "p_", "pid").withColumn("p_unique", F.lit(None).cast("boolean")))
    by_key = rest.join(q, same & (F.col("b_norm") == F.col("p_norm"))).withColumn("tier", F.lit(1))
    by_core = rest.join(q, same & (F.col("b_core") == F.col("p_core")) & amounts).withColumn("tier", F.lit(2))
    by_amount = band_join(rest.withColumn("_g", F.col("b_gstin")), q.withColumn("_g", F.col("p_gstin")), "b_invoice_value", "p_invoice_value", c.tolerance, ["_g"]).drop("_g").filter(same & amounts).withColumn("tier", F.lit(3))
    edges = by_key.unionByName(by_core).unionByName(by_amount).groupBy("bid", "pid").agg(F.min("tier").alias("tier"), F.max(near).alias("near"))
    rank = F.round(F.lit(c.cross_period) * F.col("near"), 4)
    edges = stages(edges)
    got = ambiguous(edges, serial(edges, stages, rank), rank, c.ambiguity_margin).withColumn("pass_name", F.lit("cross_period")).withColumn("points", F.lit(c.cross_period))
    return got.select("bid", "pid", "pass_name", "points", "ambiguous").join(rest, "bid").join(q, "pid")


def adjacent_pairs(books: DataFrame, portal: DataFrame, c: Gst) -> DataFrame:
    """Exact-key pairs whose periods are one month apart: bid, pid, books_period, portal_period."""
    key = ["gstin", "norm"]

    def side(frame: DataFrame, ident: str, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(ident))
        return keyed(frame, c).select(*key, ident, period(F.col("invoice_date")).alias(name)).dropna(subset=key).withColumn("_k", nth)

    both = side(books, "bid", "books_period").join(side(portal, "pid", "portal_period"), [*key, "_k"]).select("pid", "bid", "books_period", "portal_period")
    return both.filter(F.col("portal_period").isin(shifted_period(F.col("books_period"), 1), shifted_period(F.col("books_period"), -1)))

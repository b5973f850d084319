"""Lists that reviewers work through, and checks that a run's figures hold together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.functions.display import typed_value
from reconweave.operators.rules import latest

# Views of the review list, ranks of bands and priorities, sources and roles in order.
VIEWS = {"amount_difference": "Amount Difference", "not_in_books": "Not in Books", "not_in_portal": "Not in Portal"}
BANDS = ("High", "Medium", "Low")
PRIORITIES = ("escalated", "high", "normal", "low")
SOURCES = ("tally", "gst_portal", "traces", "bank")
UPLOADED = ("tally", "gst_portal", "traces")
ROLES = ("Senior Accountant", "Article-Trainee", "Manager")
KEY_TYPES = ("Tax Split Mismatch", "Short Deduction", "Timing Difference")


def rank_of(value: Column, order: tuple[str, ...], other: int) -> Column:
    """The place of a value in an order; `other` if it has none."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1, F.lit(other)).cast("int")


def has(**equals: object) -> Column:
    """Whether a row has all the given values; None asks for nothing."""
    return reduce(Column.__and__, (F.col(k) == v for k, v in equals.items() if v is not None), F.lit(True))


def only(rows: DataFrame, **equals: object) -> DataFrame:
    """The rows with all the given values; None asks for nothing."""
    return rows.filter(has(**equals)) if any(v is not None for v in equals.values()) else rows


def shown(*, view: str | None = None, bucket: str | None = None, state: str | None = None, active: bool = False, search: str | None = None, **equals: object) -> Column:
    """Whether a review list with these settings shows an item; see listing()."""
    matched = F.col("bucket") == "Matched"
    if view == "matched":
        out = matched
    elif view == "reviewed":
        out = F.col("reviewed")
    elif view in VIEWS:
        out = F.col("bucket") == VIEWS[view]
    elif view or bucket != "Matched":
        out = ~matched
    else:
        out = F.lit(True)
    if state == "reviewed":
        out = out & F.col("reviewed")
    if state == "unreviewed" or active:
        out = out & ~F.col("reviewed")
    if search and search.strip():
        text = F.lower(F.concat_ws(" ", "party", "gstin", "reference"))
        out = out & text.contains(search.strip().lower())
    return out & has(bucket=bucket, **equals)


def listing(items: DataFrame, **asked: object) -> DataFrame:
    """Items of a review list: bucket, reviewed, party, gstin, reference and more.

    Matched items show only in the views matched and reviewed, or where bucket asks
    for them.  state: reviewed or unreviewed; equal values of cause, cause_group,
    confidence_band, supplier_key; search: a text in party, GSTIN or reference.
    """
    return items.filter(shown(**asked))


def listing_counts(items: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """filter, items: how many items each of several settings shows, in one pass."""
    counts = items.agg(*(F.count_if(F.coalesce(shown(**asked), F.lit(False))).alias(k) for k, asked in settings.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("filter"), F.col(k).alias("items")) for k in settings))).alias("x")).select("x.*")


def order(key: str, ident: str = "id") -> list[Column]:
    """Sort columns of a review list; ident settles what is left equal."""
    down = F.desc("difference")
    keys = {
        "difference": [down, F.asc("party")],
        "supplier": [F.lower("supplier_key").asc(), down],
        "date": [F.coalesce(F.col("date").cast("string"), F.lit("")).asc(), down],
        "confidence": [rank_of(F.col("confidence_band"), BANDS, 3).asc(), down],
        "review_state": [F.asc("reviewed"), down],
    }
    return [*keys[key], F.asc(ident)]


def groups(items: DataFrame, by: str) -> DataFrame:
    """name, items and subtotal of each group, the largest subtotal to be shown first."""
    return items.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("items"), F.sum("difference").alias("subtotal"))


def queue_order() -> list[Column]:
    return [rank_of(F.coalesce("priority", F.lit("normal")), PRIORITIES, 9).asc(), F.coalesce("age_days", F.lit(0)).desc()]


def work_queue(items: DataFrame, *, status: str | None = "open", least_age: int | None = None, **equals: object) -> DataFrame:
    """Items with a status (None: any), of at least some age, and with all the given values."""
    out = only(items, status=status, **equals)
    return out if least_age is None else out.filter(F.coalesce("age_days", F.lit(0)) >= least_age)


def batch_exclusion(gated: Column) -> Column:
    """Why an item is reviewed alone; null if it may go in a batch."""
    return F.when(gated, "Materiality-gated — individual review required")


def headline_integrity(results: DataFrame, headline: DataFrame) -> DataFrame:
    """One row: headline, recount, cause_sum, exception_count, ties (within 0.05).

    results: classification, cause, itc_at_risk, a written table, as it is read twice;
    headline: one row with at_stake.
    """
    open_ = F.col("classification") != "Matched"
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    recount = results.filter(open_).agg(money("itc_at_risk").alias("recount"), F.count(F.lit(1)).alias("exception_count"))
    causes = results.filter(open_).groupBy("cause").agg(F.sum("itc_at_risk").alias("tax")).agg(money("tax").alias("cause_sum"))
    one = F.lit(1).alias("_one")
    out = headline.select(one, F.coalesce("at_stake", F.lit(0)).cast("decimal(38,2)").alias("headline")).join(recount.select(one, "*"), "_one").join(causes.select(one, "*"), "_one").drop("_one")  # one row each
    return out.withColumn("ties", (F.abs(F.col("headline") - F.col("recount")) < 0.05) & (F.abs(F.col("recount") - F.col("cause_sum")) < 0.05))


def ties_out(parts: list[Column], total: Column) -> Column:
    """Whether parts sum to the total at two decimals; null if one is missing."""
    return F.round(sum(parts[1:], parts[0]), 2) == F.round(total, 2)


def recon_of_recon(results: DataFrame, field: str = "invoice_value") -> DataFrame:
    """One row: matched, unmatched, excluded and ingested sums of the books' value, else the portal's, and ties_out."""
    value = F.coalesce(F.nullif(F.col(f"books.{field}"), F.lit(0)), F.col(f"portal.{field}"), F.lit(0))
    lone = F.col("classification").isin("Not in Books", "Not in Portal")
    matched = F.col("classification") == "Matched"
    total = lambda when: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("decimal(38,2)")
    out = results.agg(total(matched).alias("matched"), total(lone).alias("unmatched"), total(~matched & ~lone).alias("excluded"), total(F.lit(True)).alias("ingested"))
    return out.withColumn("ties_out", ties_out([F.col("matched"), F.col("unmatched"), F.col("excluded")], F.col("ingested")))


def control_result(control_count: Column, control_amount: Column, count: Column, amount: Column) -> Column:
    """match if what was entered by hand equals what was read, amounts at two decimals; null parts are not compared."""
    off = lambda a, b: F.coalesce(F.round(a, 2) != F.round(b, 2), F.lit(False))
    return F.when(off(control_count, count) | off(control_amount, amount), "mismatch").otherwise("match")


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value: an entry for each field that differs; null equals null."""
    both = old.select(key, F.struct(*fields).alias("_a")).join(new.select(key, F.struct(*fields).alias("_b")), key)
    rows = [F.struct(F.lit(f).alias("field"), F.col("_a")[f].cast("string").alias("old_value"), F.col("_b")[f].cast("string").alias("new_value")) for f in fields]
    each = both.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")
    return each.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def edited(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with canonical (the value as kept) and refused: null, or why no version is added.

    rules: rule_key, value_type; edits: rule_key, scope, client_id, value, reason.
    Versions are added, never changed; rules is a small table.
    """
    out = edits.join(F.broadcast(rules.select("rule_key", "value_type")), "rule_key", "left").withColumn("canonical", typed_value(F.col("value"), F.col("value_type")))
    client = F.col("client_id").isNotNull()
    why = (
        F.when(~F.col("scope").isin("firm", "client"), "scope")
        .when((F.col("scope") == "client") & ~client, "client missing")
        .when((F.col("scope") == "firm") & client, "client given")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason")
        .when(F.col("value_type").isNull(), "rule")
        .when(F.col("canonical").isNull(), "value")
    )
    return out.withColumn("refused", why)


def sync_health(events: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, source, status, is_stub: the newest status of each source, not_attempted if there is none.

    events: client_id, source, status, checked_at, event_id.
    """
    all_ = clients.select("client_id", F.explode(F.array(*map(F.lit, SOURCES))).alias("source"))
    newest = latest(events, ["client_id", "source"], ["checked_at", "event_id"]).select("client_id", "source", "status")
    out = all_.join(newest, ["client_id", "source"], "left")
    return out.select("client_id", "source", F.coalesce("status", F.lit("not_attempted")).alias("status"), (~F.col("source").isin(*UPLOADED)).alias("is_stub"))


def default_assignee(team: DataFrame) -> DataFrame:
    """client_id, assignee: the first member of the best role, else the first of all.

    team: client_id, place (order in the team), role, name.
    """
    rank = F.struct(rank_of(F.col("role"), ROLES, len(ROLES)), "place")
    return team.groupBy("client_id").agg(F.min_by("name", rank).alias("assignee"))


def with_assignments(items: DataFrame, assignments: DataFrame) -> DataFrame:
    """items with the newest assignee and status of (source_module, item_ref), open where there is none."""
    newest = latest(assignments, ["source_module", "item_ref"], ["at"]).select("source_module", "item_ref", F.col("assignee").alias("_a"), F.col("status").alias("_s"))
    out = items.join(newest, ["source_module", "item_ref"], "left")
    return out.withColumn("assignee", F.col("_a")).withColumn("status", F.coalesce("_s", F.lit("open"))).drop("_a", "_s")


def runs_of(results: DataFrame, runs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """fingerprint, run_id of every run that holds a fingerprint."""
    return results.join(fingerprints, "fingerprint", "left_semi").join(runs.select("run_id"), "run_id", "left_semi").select("fingerprint", "run_id").distinct()


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """name, copies of names that more than one row has."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def open_clients(clients: DataFrame, work: DataFrame) -> DataFrame:
    """The clients with open work."""
    return clients.join(work.filter("status = 'open'").select("client_id"), "client_id", "left_semi")


def leg_totals(entries: DataFrame) -> DataFrame:
    """entry_id, debit, credit over legs (side, amount); entries without legs sum to 0."""

    def total(side: str) -> Column:
        own = F.transform("legs", lambda x: F.when(x["side"] == side, x["amount"]).otherwise(0).cast("decimal(18,2)"))
        return F.aggregate(own, F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x).cast("decimal(18,2)")).alias(side)

    return entries.select("entry_id", total("debit"), total("credit"))


def slices(rows: DataFrame) -> DataFrame:
    """Chart rows (name, value) that have a name and a value above 0."""
    return rows.filter((F.coalesce(F.trim("name"), F.lit("")) != "") & (F.col("value") > 0))


def derived_tax(rows: DataFrame, heads: tuple[str, ...] = ("cgst", "sgst", "igst")) -> DataFrame:
    """rows with the missing half of each (amount, rate) pair, and then a missing total, from the others.

    rows: taxable_value, total_tax and, for each head, its amount and <head>_rate.
    """
    taxable = F.col("taxable_value")
    both = {}
    for h in heads:
        both[h] = F.coalesce(F.col(h), taxable * F.col(f"{h}_rate") / 100)
        both[f"{h}_rate"] = F.coalesce(F.col(f"{h}_rate"), F.try_divide(F.col(h), taxable) * 100)
    out = rows.withColumns(both)
    return out.withColumn("total_tax", F.coalesce("total_tax", sum((F.col(h) for h in heads[1:]), F.col(heads[0]))))


def at_slab(rate: Column, slabs: tuple[float, ...] = (0.0, 5.0, 12.0, 18.0, 28.0), room: float = 0.5) -> Column:
    """Whether a rate is within `room` of a slab."""
    return reduce(Column.__or__, [F.abs(rate - s) < room for s in slabs])


def type_accuracy(aligned: DataFrame) -> DataFrame:
    """label, pairs, agreed, rate of pairs that both sides call a difference and name its type.

    Labels: all, and each key type that either side names.
    """
    some = aligned.filter("engine_class <> 'Matched' and baseline_class <> 'Matched' and engine_type is not null and baseline_type is not null")
    labels = F.array(F.lit("all"), *(F.when((F.col("engine_type") == k) | (F.col("baseline_type") == k), k) for k in KEY_TYPES))
    out = some.select(F.explode(F.array_compact(labels)).alias("label"), (F.col("engine_type") == F.col("baseline_type")).cast("int").alias("same"))
    out = out.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.sum("same").alias("agreed"))
    return out.withColumn("rate", F.round(F.col("agreed").cast("double") / F.col("pairs"), 4))


def cause_values(disagreements: DataFrame) -> DataFrame:
    """Pairs, engine value and baseline value of each cause."""
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    return disagreements.groupBy("cause").agg(F.count(F.lit(1)).alias("pairs"), money("engine_value").alias("engine_value"), money("baseline_value").alias("baseline_value"))


def band_accuracy(aligned: DataFrame) -> DataFrame:
    """Agreement in each confidence band."""
    same = (F.col("engine_class") == F.col("baseline_class")).cast("int")
    out = aligned.groupBy("confidence_band").agg(F.count(F.lit(1)).alias("pairs"), F.sum(same).alias("agreed"))
    return out.withColumn("accuracy", F.round(F.col("agreed").cast("double") / F.col("pairs"), 4))

"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconweave.functions.keys import money_indian

ABSENT = "—"


def western_money(c: Column) -> Column:
    """₹ with groups of three digits and two decimals."""
    return F.concat(F.lit("₹"), F.format_number(c.cast("decimal(18,2)"), 2))


def signed_money(c: Column) -> Column:
    """A difference with its sign; a dash for none."""
    amount = c.cast("decimal(18,2)")
    return F.when(amount > 0, F.concat(F.lit("+"), money_indian(amount))).when(amount < 0, F.concat(F.lit("−"), money_indian(F.abs(amount)))).otherwise(ABSENT)


def display_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd MMM yyyy"), F.lit(ABSENT))


def display_period(period: Column) -> Column:
    """`2026-08` as `Aug 2026`; other texts as they are, a dash for none."""
    month = F.try_to_timestamp(F.concat(F.when(period.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), period), F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(month, "MMM yyyy"), F.nullif(period, F.lit("")), F.lit(ABSENT))


def confidence_label(band: Column, points: Column) -> Column:
    """`High — 98%`, without the score where there is none."""
    name = F.coalesce(F.nullif(band, F.lit("")), F.lit("Match"))
    return F.when(points.isNull(), name).otherwise(F.concat(name, F.lit(" — "), F.floor(points).cast("string"), F.lit("%")))


def label_words(text: Column) -> Column:
    """A label in lower case, all that is no letter or digit as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def client_key(name: Column) -> Column:
    """A client's name as compared: lower-cased letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def percent_gap(books: Column, portal: Column, fields: tuple[str, ...]) -> Column:
    """(field, gap): per cent of the portal's amount, for the first field that both have and the portal has not as 0."""
    out = F.lit(None).cast("struct<field: string, gap: double>")
    for f in reversed(fields):
        a, b = books[f].cast("double"), portal[f].cast("double")
        out = F.when(a.isNotNull() & b.isNotNull() & (b != 0), F.struct(F.lit(f).alias("field"), F.round((a - b) / F.abs(b) * 100, 2).alias("gap"))).otherwise(out)
    return out


def record_fields(record: Column, fields: list[str]) -> Column:
    """(label, value) of each field that has a value and no leading underscore."""
    rows = [F.struct(F.lit(f).alias("label"), record[f].cast("string").alias("value")) for f in fields if not f.startswith("_")]
    return F.filter(F.array(*rows), lambda x: F.trim(x["value"]) != "")


def typed_value(value: Column, kind: Column) -> Column:
    """A rule's value in the form it is kept: number, boolean, date or text; null if it is none of its kind."""
    v = F.trim(value)
    low = F.lower(v)
    logical = F.when(low.isin("true", "1", "yes", "on"), "true").when(low.isin("false", "0", "no", "off"), "false")
    return F.when(kind == "number", v.try_cast("double").cast("string")).when(kind == "boolean", logical).when(kind == "date", F.when(v.try_cast("date").isNotNull(), v)).otherwise(v)


def review_age(reviewed: Column, now: Column, stale_after: int = 6) -> Column:
    """seed if never reviewed, stale after so many calendar months, else reviewed."""
    months = (F.year(now) - F.year(reviewed)) * 12 + F.month(now) - F.month(reviewed)
    return F.when(reviewed.isNull(), "seed").when(months >= stale_after, "stale").otherwise("reviewed")

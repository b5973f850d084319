"""Sheets parsed by rules that are data: field -> direct, derived, aggregate or unavailable."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.functions.dates import parse_date
from reconweave.functions.keys import clean, number
from reconweave.operators.guards import row_accounting


@dataclass(frozen=True)
class Rule:
    """How one field is made.

    kind: direct (columns[0], transformed), aggregate (sum of columns), constant, or
    unavailable.  transform: text, upper, date, money, yes_no, strip_period, month_year.
    """

    kind: str
    columns: tuple[str, ...] = ()
    transform: str = "text"
    value: str | None = None


@dataclass(frozen=True)
class Sheet:
    rules: dict[str, Rule]
    expected: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    total_marker: str = "total"
    notes: tuple[str, ...] = field(default=("Credit Note", "Debit Note"))


def _column(rule: Rule) -> Column:
    if rule.kind == "unavailable":
        return F.lit(None).cast("string")
    if rule.kind == "constant":
        return F.lit(rule.value)
    if rule.kind == "aggregate":
        return reduce(lambda a, b: a + b, (F.coalesce(number(F.col(f"`{c}`")), F.lit(0)) for c in rule.columns)).cast("decimal(18,2)")
    text = clean(F.col(f"`{rule.columns[0]}`"))
    return {
        "text": text,
        "upper": F.upper(text),
        "date": parse_date(text, ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy")),
        "money": number(text),
        "yes_no": F.lower(text).isin("y", "yes", "true", "1"),
        "strip_period": F.regexp_replace(text, r"\.+$", ""),
        "month_year": F.date_format(F.coalesce(F.try_to_timestamp(text, F.lit("MMM-yy")), F.try_to_timestamp(text, F.lit("MMMM yyyy"))), "yyyy-MM"),
    }[rule.transform]


def excluded(raw: DataFrame, sheet: Sheet) -> dict[str, Column]:
    """Why a row is left out: blank, total, or without its identity."""
    cells = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns if c != "row_no"]
    blank = reduce(lambda a, b: a & b, (c == "" for c in cells))
    total = reduce(lambda a, b: a | b, (F.lower(c).startswith(sheet.total_marker) for c in cells[:3]))
    out = {"blank": blank, "total": total}
    if sheet.identity:
        out["no_identity"] = reduce(lambda a, b: a & b, (clean(_column(sheet.rules[f]).cast("string")).isNull() for f in sheet.identity))
    return out


def parse(raw: DataFrame, sheet: Sheet) -> DataFrame:
    """The rows of a sheet by its rules; excluded rows go."""
    keep = reduce(lambda a, b: a & ~b, excluded(raw, sheet).values(), F.lit(True))
    return raw.filter(keep).select(*(_column(r).alias(f) for f, r in sheet.rules.items()))


def accounting(raw: DataFrame, sheet: Sheet) -> DataFrame:
    return row_accounting(raw, excluded(raw, sheet))


def best_sheet(columns: list[str], sheets: dict[str, Sheet]) -> str | None:
    """The sheet whose expected columns overlap most; None without any."""
    have = {" ".join(c.lower().split()) for c in columns}
    found = {k: len(have & {" ".join(c.lower().split()) for c in s.expected}) for k, s in sheets.items()}
    best = max(found, key=found.get, default=None)
    return best if best is not None and found[best] else None


def baseline(raw: DataFrame, *, verdict: str, identity: str, verdicts: dict[str, str], heading: str = "^(section|part) ") -> DataFrame:
    """A manual baseline with baseline_verdict; rows without identity or verdict, totals and headings go.

    A verdict that the map lacks raises when the rows are read.
    """
    who, said = clean(F.col(f"`{identity}`")), clean(F.col(f"`{verdict}`"))
    rows = raw.filter(who.isNotNull() & said.isNotNull() & ~F.lower(who).startswith("total") & ~F.lower(who).rlike(heading))
    known = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in (kv[0].lower(), kv[1])])[F.lower(said)]
    return rows.withColumn("baseline_verdict", F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no such verdict: "), said))))

"""Rows pasted as text, and periods that a file states of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconweave.functions.dates import period_of_text, valid_period

#: What may part fields, in the order in which ties are settled.
MARKS = ("\t", ",", ";", "|")


def marks(lines: DataFrame) -> DataFrame:
    """paste_id, mark: what parts the fields of each paste: the mark that parts most of its lines.

    lines: paste_id, line.  A paste without any mark has a comma.
    """
    votes = lines.groupBy("paste_id").agg(*(F.count_if(F.contains("line", F.lit(m))).alias(f"n{k}") for k, m in enumerate(MARKS)))
    most = F.greatest(*(F.col(f"n{k}") for k in range(len(MARKS))))
    best = F.lit(",")
    for k, m in reversed(list(enumerate(MARKS))):
        best = F.when((F.col(f"n{k}") == most) & (most > 0), m).otherwise(best)
    return votes.select("paste_id", best.alias("mark"))


def parse(pastes: DataFrame, fields: tuple[str, ...] = ("code", "name", "type")) -> DataFrame:
    """paste_id, line_no and the fields, trimmed, of each line of pastes (paste_id, text) with its first two fields.

    Fields may be quoted.  Blank lines and lines without code or name are left out, and
    missing fields at the end are empty.  Null and empty texts give no rows.
    """
    lines = pastes.select("paste_id", F.posexplode(F.split(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    lines = lines.filter(F.trim("line") != "").join(marks(lines), "paste_id")
    kind = ", ".join(f"{f} string" for f in fields)
    row = F.coalesce(*(F.when(F.col("mark") == m, F.from_csv("line", F.lit(kind), {"sep": m, "ignoreLeadingWhiteSpace": "true"})) for m in MARKS))
    text = lambda f: F.coalesce(F.trim(F.col("_r")[f]), F.lit(""))
    out = lines.withColumn("_r", row).select("paste_id", "line_no", *(text(f).alias(f) for f in fields))
    return out.filter((F.col(fields[0]) != "") & (F.col(fields[1]) != ""))


def period_of_metadata(start: Column, end: Column, stated: Column) -> Column:
    """The period that a file states: by its first day, else its last day, else its return period."""
    own = F.trim(stated)
    return F.coalesce(period_of_text(start), period_of_text(end), F.when(valid_period(own), own), period_of_text(own))

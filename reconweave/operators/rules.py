"""Effective-dated rules: resolution with client overrides, and as-of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve(versions: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, rule_key, value, scope: the client's newest override, else the firm's newest value.

    versions: rule_key, scope (firm or client), client_id, value, effective_from, version_id.
    """
    firm = latest(versions.filter("scope = 'firm'"), ["rule_key"], ["effective_from", "version_id"]).select("rule_key", F.col("value").alias("firm_value"))
    own = latest(versions.filter("scope = 'client'"), ["rule_key", "client_id"], ["effective_from", "version_id"]).select("rule_key", "client_id", F.col("value").alias("own_value"))
    out = clients.select("client_id").crossJoin(F.broadcast(firm)).join(own, ["client_id", "rule_key"], "left")  # firm: a row for each rule
    return out.select("client_id", "rule_key", F.coalesce("own_value", "firm_value").alias("value"), F.when(F.col("own_value").isNotNull(), "client").otherwise("firm").alias("scope"))


def rate_as_of(rows: DataFrame, rates: DataFrame, aliases: DataFrame, *, section: str = "section", date: str = "deposit_date", ident: str = "bid") -> DataFrame:
    """rows with the canonical section and the rate in force on their date; none in force gives nulls.

    rates: section, effective_from, effective_to (null: open), rate; aliases: alias,
    section.  Both are small tables of the law.  The latest start wins.
    """
    named = rows.join(F.broadcast(aliases.select(F.col("alias").alias(section), F.col("section").alias("_s"))), section, "left").withColumn("canonical", F.coalesce("_s", section)).drop("_s")
    r = rates.select(F.col("section").alias("canonical"), "effective_from", "effective_to", "rate")
    held = named.join(F.broadcast(r), "canonical").filter((F.col("effective_from") <= F.col(date)) & (F.col("effective_to").isNull() | (F.col(date) <= F.col("effective_to"))))
    best = held.groupBy(ident).agg(F.max_by("rate", "effective_from").alias("rate"), F.max("effective_from").alias("effective_from"))
    return named.join(best, ident, "left")


def parse_rates(text: str) -> F.Column:
    """A map of label to rate out of `10% professional, 2% technical`; the first of a label wins."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%\s*([A-Za-z _/-]*)"), 2), lambda x: F.coalesce(F.nullif(F.lower(F.trim(x)), F.lit("")), F.lit("default")))
    rates = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%\s*([A-Za-z _/-]*)"), 1)
    pairs = F.arrays_zip(labels.alias("label"), rates.alias("rate"))
    first = F.filter(pairs, lambda x, i: F.array_position(labels, x["label"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["label"], x["rate"].cast("double"))))

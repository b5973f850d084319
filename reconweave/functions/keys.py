"""Document keys and text clean-up as Columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconweave.config import CREDIT_NUMBER, NOTE_CITATIONS, NOTE_PERIODS, NOTE_REFERENCE, NOTE_SEPARATORS, NOTE_TRAILING

# Texts that mean "missing" and the two structural patterns.
MISSING = ("", "NAN", "NONE", "NAT", "NULL", "0", "0.0")
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z][A-Z][0-9A-Z]$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"


def clean(c: Column) -> Column:
    """Trimmed text; what spreadsheets write for a missing value becomes null."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin("", "NAN", "NONE", "NAT", "NULL"), t)


def first_of(*columns: Column) -> Column:
    return F.coalesce(*(clean(c.cast("string")) for c in columns))


def strip_fy(number: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), patterns, number)


def compact(number: Column) -> Column:
    """Upper case without white space, slashes, dashes, underscores and dots."""
    return F.upper(F.regexp_replace(number, r"[\s/\\\-_.]", ""))


def unpad(number: Column) -> Column:
    """Every run of digits without its leading zeros."""
    return F.regexp_replace(number, r"(?<![0-9])0+(?=[0-9])", "")


def invoice_key(number: Column, patterns: Iterable[str]) -> Column:
    return unpad(compact(strip_fy(F.coalesce(number, F.lit("")), patterns)))


def core_key(number: Column, patterns: Iterable[str]) -> Column:
    """The last run of digits, unpadded; null where there is none."""
    runs = F.regexp_extract_all(strip_fy(F.coalesce(number, F.lit("")), patterns), F.lit("([0-9]+)"), 1)
    return F.when(F.size(runs) > 0, F.regexp_replace(F.element_at(runs, -1), "^0+(?=[0-9])", ""))


def fy_only_key(number: Column, patterns: Iterable[str]) -> Column:
    return compact(strip_fy(F.coalesce(number, F.lit("")), patterns))


def fingerprint_key(number: Column) -> Column:
    """The key of fingerprints: fewer separators, and years kept."""
    return unpad(F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), r"[\s/\\\-]", "")))


def label(c: Column) -> Column:
    """A header as compared: lower case, one space for white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def has_gstin(c: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(c, F.lit("")))).isin(*MISSING)


def valid_gstin(c: Column) -> Column:
    return F.coalesce((F.length(c) == 15) & c.rlike(GSTIN), F.lit(False))


def malformed_gstin(c: Column) -> Column:
    return has_gstin(c) & (F.length(F.trim(c)) != 15)


def gstin_check_character(first14: Column) -> Column:
    """Mod-36 check character with weights 1 and 2."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    products = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: (F.instr(F.lit(alphabet), F.substring(first14, i, F.lit(1))) - 1) * (2 - i % 2))
    total = F.aggregate(products, F.lit(0), lambda s, x: s + F.floor(x / 36).cast("int") + x % 36)
    return F.substring(F.lit(alphabet), (36 - total % 36) % 36 + 1, F.lit(1))


def note_key(reference: Column) -> Column:
    """A note's reference as compared: a year span goes only from its end."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(reference, F.lit("")))), NOTE_TRAILING, "")
    for p in NOTE_PERIODS:
        t = F.regexp_replace(t, p, "")
    return unpad(F.regexp_replace(t, NOTE_SEPARATORS, ""))


def _citations(text: Column) -> Column:
    """Places where a text cites a credit note, one for each citation pattern that it has."""
    return F.filter(F.array(*(F.regexp_instr(text, F.lit(p)) for p in NOTE_CITATIONS)), lambda i: i > 0)


def citation_count(narration: Column) -> Column:
    """How often a text cites a credit note."""
    return F.regexp_count(F.coalesce(narration, F.lit("")), F.lit("|".join(f"(?:{p})" for p in NOTE_CITATIONS)))


def note_reference(narration: Column) -> Column:
    """The first token with a digit after the first citation; null without a citation."""
    text = F.coalesce(narration, F.lit(""))
    at = F.array_min(_citations(text))
    rest = F.substring(text, at, F.length(text))
    for p in NOTE_CITATIONS:
        rest = F.regexp_replace(rest, f"^(?:{p})", "")
    token = F.regexp_extract(rest, NOTE_REFERENCE, 1)
    return F.when(at.isNotNull() & (token != ""), F.regexp_replace(token, NOTE_TRAILING, ""))


def note_kind(explicit: Column, number: Column, narration: Column, value: Column) -> Column:
    """credit or debit: a word, a citation, the number's mark, the sign; else debit."""
    word, text = F.lower(F.coalesce(explicit, F.lit(""))), F.coalesce(narration, F.lit(""))
    cited = F.size(_citations(text)) > 0
    credit = word.contains("credit") | cited | F.coalesce(number.rlike(CREDIT_NUMBER), F.lit(False))
    return F.when(credit, "credit").when(word.contains("debit"), "debit").when(F.coalesce(value < 0, F.lit(False)), "credit").otherwise("debit")


def money_indian(c: Column) -> Column:
    """₹ with the Indian grouping of digits (3, then 2 and 2) and two decimals."""
    text = F.abs(c).cast("decimal(18,2)").cast("string")
    whole, cents = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    tail = F.substring(whole, F.greatest(F.length(whole) - 2, F.lit(1)), F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=[0-9])(?=(?:[0-9]{2})+$)", ",")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), F.when(F.length(head) > 0, F.concat(grouped, F.lit(","))).otherwise(""), tail, F.lit("."), cents)


def number(c: Column) -> Column:
    """A tolerant decimal: commas, currency and per-cent signs do not count; null if none."""
    return F.regexp_replace(c.cast("string"), r"[,₹$%\s]", "").try_cast("decimal(18,2)")

import pytest
from pyspark.sql import functions as F

from reconweave.config import Config, overlay
from reconweave.functions import dates, keys
from reconweave.functions.similarity import indel_ratio, set_ratio, sorted_ratio
from reconweave.operators import rules

FY = Config().gst.fy_patterns


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_invoice_keys(spark):
    numbers = ["T11439/26-27", "JSIT-03499/26-27", "PD/26-27/3386", "2915", "RL/2915/26-27", "MF/26-27/1913", None, "ABC"]
    assert values(spark, numbers, keys.invoice_key(F.col("x"), FY)) == ["T11439", "JSIT3499", "PD3386", "2915", "RL2915", "MF1913", "", "ABC"]
    assert values(spark, numbers, keys.core_key(F.col("x"), FY)) == ["11439", "3499", "3386", "2915", "2915", "1913", None, None]
    assert values(spark, ["b-007/1", None], keys.fingerprint_key(F.col("x"))) == ["B71", ""]


def test_note_references(spark):
    texts = ["CREDIT NOTE NO.  CD-12/04-2025", "CREDIT NOTE NO. SRI-312/25-26", "CREDIT NOTE NO. 50", "Credit Note No CD-197/04-2025", "CREDIT NOTE NO. CN/193/25-26", "rate difference", None, "credit note DATED"]
    got = values(spark, texts, keys.note_reference(F.col("x")))
    assert got == ["CD-12/04-2025", "SRI-312/25-26", "50", "CD-197/04-2025", "CN/193/25-26", None, None, None]
    assert values(spark, got, keys.note_key(F.col("x"))) == ["CD12042025", "SRI312", "50", "CD197042025", "CN193", "", "", ""]


def test_gstin(spark):
    good = "27ABCDE1234F1Z5"
    assert values(spark, [good, "27ABCDE1234F1Z", "", None, "27abcde1234F1Z5"], keys.valid_gstin(F.col("x"))) == [True, False, False, False, False]
    assert values(spark, [good, "27AB", "", "nan", None], keys.malformed_gstin(F.col("x"))) == [False, True, False, False, False]
    assert values(spark, ["27AAPFU0939F1Z"], keys.gstin_check_character(F.col("x"))) == ["V"]


def test_money(spark):
    assert values(spark, ["12345678.5", "-999", "1000", "0.1", "100000"], keys.money_indian(F.col("x").cast("decimal(18,2)"))) == ["₹1,23,45,678.50", "-₹999.00", "₹1,000.00", "₹0.10", "₹1,00,000.00"]
    assert [None if x is None else float(x) for x in values(spark, ["₹ 1,234.50", "12%", "abc", None], keys.number(F.col("x")))] == [1234.5, 12.0, None, None]


def test_fiscal_dates(spark):
    d = F.to_date("x")
    assert values(spark, ["2026-04-01", "2026-03-31", "2025-12-01"], dates.fiscal_quarter(d)) == ["Q1-2026", "Q4-2025", "Q3-2025"]
    assert values(spark, ["2026-04-01", "2026-03-31", "1999-12-01"], dates.financial_year(d)) == ["2026-27", "2025-26", "1999-00"]
    assert values(spark, ["2026-01", "2025-12"], dates.shifted_period(F.col("x"), 1)) == ["2026-02", "2026-01"]
    assert values(spark, ["books_2026-08.csv", "gstr 082026", "Aug-26.xlsx", "202607", "none"], dates.period_of_text(F.col("x"))) == ["2026-08", "2026-08", "2026-08", "2026-07", None]
    df = spark.createDataFrame([("13/01/2026",), ("02/03/2026",)], "x string")
    assert dates.best_format(df, "x") == "dd/MM/yyyy" and dates.day_first(df, "x") is True
    assert [str(x) for x in values(spark, ["2026-01"], dates.due_date(F.col("x"), F.lit(31), F.lit(1)))] == ["None"]


def test_ratios():
    assert round(sorted_ratio("om fashion", "om fashion hub"), 1) == 83.3
    assert sorted_ratio("b a", "a b") == 100.0 and sorted_ratio(None, "a") == 0.0
    assert set_ratio("a b c", "c b") == 100.0 and set_ratio("", "a") == 0.0
    assert indel_ratio("abcd", "acbd") == 75.0


def test_rate_texts(spark):
    assert values(spark, ["10% professional, 2% technical", "5%"], rules.parse_rates("x")) == [{"professional": 10.0, "technical": 2.0}, {"default": 5.0}]


def test_config():
    assert overlay(Config(), {"gst": {"fuzzy": 70}}).gst.fuzzy == 70
    with pytest.raises(KeyError):
        overlay(Config(), {"gst": {"fuzy": 70}})

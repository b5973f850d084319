"""Review lists, overlays and small reports."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from reconweave.functions import display
from reconweave.operators import review
from reconweave.plans import review_queries


def test_lists_and_their_counts(spark):
    rows = [(1, "Matched", True, "A", "g", "r1", "High", 0), (2, "Not in Books", False, "Beta", "g", "r2", "Low", 5), (3, "Amount Difference", True, "beta two", "g", None, "Low", 9), (4, "Not in Portal", False, None, None, None, None, 1)]
    items = spark.createDataFrame(rows, "id int, bucket string, reviewed boolean, party string, gstin string, reference string, confidence_band string, difference int")
    settings = {"all": {}, "matched": {"view": "matched"}, "reviewed": {"view": "reviewed"}, "active": {"active": True}, "low": {"confidence_band": "Low"}, "search": {"search": " BETA "}, "books": {"view": "not_in_books"}, "chip": {"bucket": "Matched"}}
    want = {"all": 3, "matched": 1, "reviewed": 2, "active": 2, "low": 2, "search": 2, "books": 1, "chip": 1}
    assert {r["filter"]: r["items"] for r in review.listing_counts(items, settings).collect()} == want
    assert {k: review.listing(items, **asked).count() for k, asked in settings.items()} == want
    assert {r["items"] for r in review.listing_counts(items.limit(0), settings).collect()} == {0}


def test_queue_order_and_overlays(spark):
    items = spark.createDataFrame([("m", "1", "low", 3), ("m", "2", "escalated", None), ("m", "3", None, 9), ("m", "4", "high", 1), ("m", "5", "other", 99)], "source_module string, item_ref string, priority string, age_days int")
    assert [r["item_ref"] for r in items.orderBy(*review.queue_order()).collect()] == ["2", "4", "3", "1", "5"]
    at = lambda d: dt.datetime(2026, 1, d)
    given = spark.createDataFrame([("m", "1", "ann", "open", at(1)), ("m", "1", "bob", "done", at(2)), ("x", "2", "eve", "done", at(3))], "source_module string, item_ref string, assignee string, status string, at timestamp")
    got = {r["item_ref"]: (r["assignee"], r["status"]) for r in review.with_assignments(items, given).collect()}
    assert got["1"] == ("bob", "done") and got["2"] == (None, "open") and len(got) == 5
    work = spark.createDataFrame([(1, "open"), (1, "open"), (2, "done")], "client_id int, status string")
    assert [r["client_id"] for r in review.open_clients(spark.createDataFrame([(1,), (2,), (3,)], "client_id int"), work).collect()] == [1]


def test_runs_of_a_fingerprint_and_control_results(spark):
    results = spark.createDataFrame([("f", "r1"), ("f", "r1"), ("f", "r2"), ("g", "r1"), ("f", "gone")], "fingerprint string, run_id string")
    runs, prints = spark.createDataFrame([("r1",), ("r2",)], "run_id string"), spark.createDataFrame([("f",)], "fingerprint string")
    assert sorted(r["run_id"] for r in review.runs_of(results, runs, prints).collect()) == ["r1", "r2"]
    rows = spark.createDataFrame([(3, 10.004, 3, 10.0), (3, 10.01, 3, 10.0), (4, 10.0, 3, 10.0), (None, None, 3, 10.0)], "a int, x double, b int, y double")
    assert [r[0] for r in rows.select(review.control_result(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == ["match", "mismatch", "mismatch", "match"]


def test_slices_causes_and_bands(spark):
    chart = spark.createDataFrame([("a", 1.0), ("", 2.0), (None, 2.0), ("b", 0.0), ("c", -1.0), ("d", None)], "name string, value double")
    assert [r["name"] for r in review.slices(chart).collect()] == ["a"]
    d = spark.createDataFrame([("rate", 5, None), ("rate", 7, 2), ("timing", None, None)], "cause string, engine_value int, baseline_value int")
    assert {r["cause"]: (r["pairs"], r["engine_value"], r["baseline_value"]) for r in review.cause_values(d).collect()} == {"rate": (2, Decimal("12.00"), Decimal("2.00")), "timing": (1, Decimal("0.00"), Decimal("0.00"))}
    a = spark.createDataFrame([("High", "M", "M"), ("High", "M", "N"), ("Low", "N", "N")], "confidence_band string, engine_class string, baseline_class string")
    assert {r["confidence_band"]: r["accuracy"] for r in review.band_accuracy(a).collect()} == {"High": 0.5, "Low": 1.0}
    record = spark.createDataFrame([(("x", None, 3, "h"),)], "r struct<a:string,b:string,c:int,_d:string>").select(display.record_fields(F.col("r"), ["a", "b", "c", "_d"]).alias("f")).first()["f"]
    assert [(x["label"], x["value"]) for x in record] == [("a", "x"), ("c", "3")]


def test_headline_ties(spark):
    rows = spark.createDataFrame([("Matched", None, 5), ("Not in Books", "missing", 7), ("Amount Difference", None, 3)], "classification string, cause string, itc_at_risk int")
    got = review.headline_integrity(rows, spark.createDataFrame([(10,)], "at_stake int")).first()
    assert (got["headline"], got["recount"], got["exception_count"], got["cause_sum"], got["ties"]) == (10, 10, 2, 10, True)
    assert not review.headline_integrity(rows, spark.createDataFrame([(15,)], "at_stake int")).first()["ties"]
    empty = review.headline_integrity(rows.limit(0), spark.createDataFrame([(None,)], "at_stake int")).first()
    assert empty["recount"] == 0 and empty["ties"]


def test_type_accuracy_runs_once(spark):
    plan = review_queries.type_accuracy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

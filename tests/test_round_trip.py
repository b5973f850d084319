"""The workbook sink, decisions that come back, alignment of withheld tax, arrivals of files."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reconweave.config import Tolerance
from reconweave.plans import adjudication, reports, verify
from reconweave.sources import paste, sink
from reconweave.stages import Stages
from reconweave.streaming import files

ROWS = [(f"f{i}", ("Matched", "Not in Books", "Amount Difference")[i % 3], ("Not in Portal", "Matched", "Matched")[i % 3], i) for i in range(60)]


def test_written_edited_and_read_back(spark, tmp_path):
    d = spark.createDataFrame(ROWS, "fingerprint string, engine_class string, baseline_class string, value int").repartition(3)
    uri = f"file://{tmp_path}/out"
    adjudication.export(d, uri)
    back = sink.read(spark, uri)
    assert back.columns == [*d.columns, "adjudication"] and back.count() == 60 and len(sink.committed(uri)) == 3
    assert {r["fingerprint"]: r["engine_class"] for r in back.collect()} == {r[0]: r[1] for r in ROWS}
    word = F.when(F.col("value").cast("int") < 20, "Engine correct ").when(F.col("value").cast("int") < 30, "both defensible").when(F.col("value").cast("int") < 40, "baseline correct")
    got = adjudication.adjudicated(d, adjudication.decisions(back.withColumn("adjudication", word))).first()
    fp = sum(r[3] >= 30 for r in ROWS if r[1] == "Matched")
    fn = sum(r[3] >= 30 for r in ROWS if r[2] == "Matched" and r[1] != "Matched")
    assert got.asDict() == {"adjudicated": 40, "unadjudicated": 20, "fp_after": fp, "fn_after": fn, "both_defensible": 10, "unadjudicated_share": 0.333333}
    none = adjudication.adjudicated(d.limit(0), adjudication.decisions(back)).first()
    assert none["adjudicated"] == none["unadjudicated"] == 0 and none["unadjudicated_share"] == 0.0
    with pytest.raises(ValueError):
        adjudication.decisions(d)
    with pytest.raises(PySparkException, match="no such adjudication"):
        adjudication.decisions(back.withColumn("adjudication", F.lit("perhaps"))).collect()


def test_parts_without_a_commit_do_not_count(spark, tmp_path):
    sink.register(spark)
    uri = f"file://{tmp_path}/out"
    d = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(25)], "k int, v string").coalesce(1)
    d.write.format(sink.NAME).option("path", uri).option("rows", 10).mode("append").save()
    assert len(sink.committed(uri)) == 3
    (tmp_path / "out" / "part-lost.xlsx").write_bytes((tmp_path / "out" / sink.committed(uri)[0]).read_bytes())
    assert sorted(int(r["k"]) for r in sink.read(spark, uri).collect()) == list(range(25))
    d.limit(2).write.format(sink.NAME).option("path", uri).mode("overwrite").save()
    assert sink.read(spark, uri).count() == 2
    with pytest.raises(PySparkException):
        d.select(F.when(F.col("k") < 30, F.raise_error(F.lit("stop"))).alias("k")).write.format(sink.NAME).option("path", uri).mode("append").save()
    assert sink.read(spark, uri).count() == 2


def test_tds_alignment(spark):
    day = dt.date(2025, 5, 1)
    e = [(1, "AAAPA0001K", "194C", 100, day, "A"), (2, "aaapa0001k", "194C", 900, day, "A"), (3, "AAAPA0002K", "194J", 50, day, "B"), (4, "", "194J", 70, day, "Ramesh Kumar"), (5, "", "", 5000, day, "")]
    b = [(11, "AAAPA0001K", "194C", 5, day, "A"), (12, "AAAPA0001K ", "194C", 6, day, "A"), (13, "AAAPA0002K", "194H", 55, day, "B"), (14, None, "194J", 75, day + dt.timedelta(3), "Kumar Ramesh"), (15, "", "", 5000, day, "")]
    cols = "pan string, section string, tax_deducted int, deposit_date date, deductee_name string"
    make = lambda rows, i: spark.createDataFrame(rows, f"{i} long, {cols}").withColumn("tax_deducted", F.col("tax_deducted").cast("decimal(18,2)"))
    got = {(r["eid"], r["lid"], r["tier"]) for r in verify.align_tds(make(e, "eid"), make(b, "lid"), Tolerance(), Stages(spark, "t")).collect()}
    assert got == {(1, 11, 1), (2, 12, 1), (3, 13, 2), (4, 14, 3), (5, None, None), (None, 15, None)}


def test_uploads_over_three_batches(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/seen"
    batches = [[("/d/acme/2025-04/tally/a.csv", b"1"), ("/d/acme/2025-04/tally/b.csv", b"2"), ("/d/zed/2025-04/tally/a.csv", b"1")], [("/d/acme/2025-05/tally/again.csv", b"1"), ("/d/acme/2025-05/ims/new.csv", b"3")], [("/d/acme/2025-06/tally/third.csv", b"1"), ("/d/acme/2025-06/tally/fourth.csv", b"1")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "path string, content binary").write.mode("append").parquet(src)
        stream = files.with_uploads_seen(files.named(spark.readStream.schema("path string, content binary").parquet(src)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["client"], r["file"]): r["first_file"] for r in spark.read.parquet(out).collect()}
    assert got == {("acme", "a.csv"): None, ("acme", "b.csv"): None, ("zed", "a.csv"): None, ("acme", "again.csv"): "2025-04/tally/a.csv", ("acme", "new.csv"): None, ("acme", "third.csv"): "2025-04/tally/a.csv", ("acme", "fourth.csv"): "2025-04/tally/a.csv"}
    have = files.named(spark.createDataFrame([r for b in batches for r in b], "path string, content binary"))
    slots = {(r["client"], r["period"], r["slot"]): r["files"] for r in files.availability(have, ["tally", "ims"]).collect()}
    assert slots["acme", "2025-04", "tally"] == 2 and slots["acme", "2025-04", "ims"] == 0 and slots["acme", "2025-05", "ims"] == 1
    runs = spark.createDataFrame([("acme", "2025-04"), ("old", "2024-01")], "client string, period string")
    assert {(r["client"], r["period"]): (r["on_disk"], r["has_run"]) for r in files.periods(have, runs).collect()}["old", "2024-01"] == (False, True)
    assert [r["file"] for r in files.chosen(have, "tally", F.col("file") != "a.csv").orderBy("client", "period").collect()] == ["b.csv", "again.csv", "fourth.csv"]


def test_reports_of_small_runs(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [("c", "2026-01", "GST", "g1", at, "Matched", "P", 10, 0, 0), ("c", "2026-01", "GST", "g1", at, "Not in Books", "P", 5, 0, 0), ("c", "2026-01", "TDS", "t1", at, "Not in Portal", "P ", 7, 3, 1), ("c", "2026-01", "TDS", "t1", at, "Not in Portal", None, 2, 0, 0),
            ("c", "2026-01", "GST", "g0", at - dt.timedelta(1), "Not in Books", "Q", 99, 0, 0), ("c", "demo", "TDS", "t2", at, None, "R", 1, 0, 0)]
    items = spark.createDataFrame(rows, "client string, period string, kind string, run_id string, run_at timestamp, classification string, party string, value int, deducted int, deposited int")
    runs = reports.latest_runs(items.select("client", "period", "kind", "run_id", "run_at").distinct())
    got = {(r["level"], r["period"], r["kind"], r["bucket"], r["party"]): r for r in reports.report(items, runs).collect()}
    whole = got["period", "2026-01", None, None, None]
    assert (whole["results"], whole["matched"], whole["exceptions_value"], whole["gap"], whole["match_rate"]) == (4, 1, 14, 2, 50.0)
    assert got["party", "2026-01", None, None, "P"]["exceptions_value"] == 12 and ("party", "2026-01", None, None, None) not in got
    assert got["bucket", "2026-01", "TDS", "Late Deposit", None]["results"] == 2 and got["kind", "2026-01", "TDS", None, None]["match_rate"] == 0.0
    strip = {(r["period"], r["kind"]): r["result"] for r in reports.integrity(reports.report(items, runs), items, runs).collect()}
    assert strip["2026-01", "GST"] == "PASS" and strip["demo", "TDS"] == "FAIL"  # a record without a class
    assert [r["period"] for r in reports.periods(runs).orderBy("place").collect()] == ["2026-01", "demo"]


def test_pasted_rows(spark):
    pastes = [(1, "A1\tCash\tAsset\n\nA2\tBank, main\n\tno code\nA3\t"), (2, 'B1,"Fees, legal",Expense\r\nB2, Rent '), (3, "C1;Sales;Income\nC2;Other;Income"), (4, None), (5, "  "), (6, "only one field")]
    got = sorted((r["paste_id"], r["code"], r["name"], r["type"]) for r in paste.parse(spark.createDataFrame(pastes, "paste_id int, text string")).collect())
    assert got == [(1, "A1", "Cash", "Asset"), (1, "A2", "Bank, main", ""), (2, "B1", "Fees, legal", "Expense"), (2, "B2", "Rent", ""), (3, "C1", "Sales", "Income"), (3, "C2", "Other", "Income")]
    meta = spark.createDataFrame([("2025-04-01", "2025-05-31", None), (None, "2025-05-31", "2025-01"), (None, None, " 2025-06 "), (None, None, "Apr-25"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in meta.select(paste.period_of_metadata(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["2025-04", "2025-05", "2025-06", "2025-04", None]


def test_uploads_of_one_large_content(spark, tmp_path):
    root = f"file://{tmp_path}"
    batch = lambda lo, hi: spark.range(lo, hi).select(F.lit(None).cast("string").alias("client"), F.lit("2025").alias("period"), F.lit("s").alias("slot"), F.format_string("%06d", hi - 1 - F.col("id")).alias("file"), F.lit("h").alias("hash"))
    for n, (lo, hi) in enumerate(((0, 25_000), (25_000, 25_003))):
        for _ in range(2):  # a batch that is tried again
            files.note_uploads(batch(lo, hi), n, root)
    got = spark.read.parquet(f"{root}/seen").groupBy("batch", "first_file").count().collect()
    assert {tuple(r) for r in got} == {(0, None, 1), (0, "2025/s/000000", 24_999), (1, "2025/s/000000", 3)}
    assert spark.read.parquet(f"{root}/first").count() == 1

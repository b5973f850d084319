"""Workbooks packed, read and parsed by formats; portal exports and their control totals."""

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reconweave.config import Guards
from reconweave.plans import source_queries
from reconweave.sources import formats, portal, workbooks
from reconweave.sources.grids import flat_labels
from reconweave.stages import Stages

PARENT = ["GSTIN of supplier", "Trade/Legal name", "Invoice Details", "", "", "", "Supply Attract Reverse Charge", "Taxable Value (₹)", "Tax Amount", "", "", ""]
CHILD = ["", "", "Invoice number", "Invoice type", "Invoice Date", "Invoice Value(₹)", "", "", "Integrated Tax(₹)", "Central Tax(₹)", "State/UT Tax(₹)", "Cess(₹)"]
NOTE = ["", "", "Note number", "Note type", "Note date", "Note Value (₹)", "", "", "Integrated Tax(₹)", "Central Tax(₹)", "State/UT Tax(₹)", "Cess(₹)"]


def line(gstin, number, kind="Regular", date="05/04/2025", value="1,180.00", reverse="No", taxable="1,000.00", igst="180.00", cgst="", sgst="", cess="-"):
    return [gstin, "Maker & <Sons>", number, kind, date, value, reverse, taxable, igst, cgst, sgst, cess]


def grid(spark, sheets, file="a.xlsx"):
    return spark.createDataFrame([(file, s, n, c) for s, rows in sheets.items() for n, c in rows], "file string, sheet string, row_no long, cells array<string>")


def book(extra=()):
    rows = [(4, PARENT), (5, CHILD), (6, line("27aaaaa0000a1z5", "I-1")), (7, line("27AAAAA0000A1Z5", "I-2", reverse="Yes", igst="90", value="bad")), (8, line("", "None")), (9, line("", "I-3", date="2025-13-40")), (10, [""] * 12), *extra]
    notes = [(4, [c.replace("Invoice Details", "Credit note/Debit note details") for c in PARENT]), (5, NOTE), (6, line("27AAAAA0000A1Z5", "", "Credit Note")), (7, line("27AAAAA0000A1Z5", "N-1", "Debit Note "))]
    summary = [(2, ["S.no.", "Heading", "Integrated Tax(₹)", "Central Tax(₹)"]), (3, ["", "All other ITC"]), (4, ["", "B2B - Invoices (Amendment)", "7", "7"]), (5, ["", "B2B - Invoices (IMS)", "540.00", "0"]),
               (6, ["", "Inward Supplies liable for reverse charge"]), (7, ["", "B2B - Invoices", "91.50", "-"])]
    return {"B2B": rows, "B2B-CDNR": notes, "ITC Available": summary, "Cover letter": [(0, ["Dear all"])]}


def test_labels_equal_the_plain_rule(spark):
    cases = [(PARENT, CHILD), (PARENT, NOTE), (["a", "", "", "b"], ["x", "x", "", ""]), (["", ""], ["", "k"]), (["A  b", "nan"], ["", "None"])]
    for parent, child in cases:
        got = spark.createDataFrame([(parent, child)], "p array<string>, c array<string>").select(workbooks.labels(F.col("p"), F.col("c")).alias("x")).first()["x"]
        clean = lambda cells: ["" if c.strip().upper() in ("NAN", "NONE") else c for c in cells]
        assert got == flat_labels(clean(parent), clean(child))


def test_packed_and_read_again(spark):
    sheets = {"B": [(0, ["x & <y>", None, "1"]), (3, ["  spaced "])], "A": [(1, ["", "é ₹"])]}
    back = {(r["sheet"], r["row_no"]): r["cells"] for r in workbooks.unpack(workbooks.pack(grid(spark, sheets))).collect()}
    assert back["B", 0] == ["x & <y>", "", "1"] and back["B", 3] == ["  spaced ", "", ""] and back["A", 1] == ["", "é ₹"]
    many = grid(spark, sheets, "1.xlsx").unionByName(grid(spark, sheets, "2.xlsx"))
    assert workbooks.pack(many).count() == 2 and workbooks.pack(many.limit(0)).count() == 0


def test_export_streams(spark):
    g = workbooks.unpack(workbooks.pack(grid(spark, book())))
    parsed, docs = portal.export(g, "gstr2b")
    inv = sorted((r["invoice_number"], r["gstin"], r["invoice_date"] and str(r["invoice_date"]), r["igst"], r["invoice_value"], r["total_tax"], r["reverse_charge"]) for r in portal.invoices(docs).collect())
    d = Decimal
    assert inv == [("I-1", "27AAAAA0000A1Z5", "2025-04-05", d(180), d(1180), d(180), False), ("I-2", "27AAAAA0000A1Z5", "2025-04-05", d(90), d(0), d(90), True), ("I-3", None, None, d(180), d(1180), d(180), False)]
    assert sorted((r["invoice_number"] or "", r["document_type"], r["row_no"]) for r in portal.notes(docs).collect()) == [("", "Credit Note", 6), ("N-1", "Debit Note", 7)]
    acc = {r["sheet"]: r.asDict() for r in portal.row_accounts(parsed, docs).collect()}
    assert set(acc) == {"B2B", "B2B-CDNR", "ITC Available"}
    assert [acc["B2B"][k] for k in ("rows_read", "blank", "rows_parsed", "notes", "no_identity", "invoices")] == [5, 1, 4, 0, 1, 3]
    assert acc["ITC Available"]["role"] == "summary_ignored" and acc["ITC Available"]["rows_parsed"] == 0
    checks = {(r["section"], r["head"]): (r["parsed"], r["stated"], r["result"]) for r in portal.control_totals(g, parsed, Guards()).collect()}
    assert checks == {("forward", "igst"): (d(540), d(540), "pass"), ("forward", "cgst"): (d(0), d(0), "pass"), ("reverse", "igst"): (d(90), d("91.50"), "hard_stop")}


def test_sheets_without_their_name(spark):
    sheets = book()
    renamed = grid(spark, {"Sheet1": sheets["B2B"], "Sheet2": sheets["B2B"], "B2B-CDNR": sheets["B2B-CDNR"], "Letter": [(4, ["dear"]), (5, ["all"])]})
    got = {r["sheet"]: r["layout"] for r in workbooks.sheets(renamed, formats.GSTR2B).collect()}
    assert got["B2B-CDNR"] == "b2b-cdnr" and "Letter" not in got and len(got) >= 2  # each leftover sheet has a layout of its own, or none
    csv = {r["sheet"]: r["layout"] for r in workbooks.sheets(grid(spark, {"": sheets["B2B-CDNR"]}, "x.csv"), formats.GSTR2B).collect()}
    assert csv == {"": "b2b-cdnr"}


def test_totals_and_two_blocks(spark):
    f = formats.Format("f", {"s": formats.SheetLayout(header=(0,), first_row=1, fields={"invoice_number": ("no",), "cgst": ("c 5%", "c 12%"), "party_name": ("a", "b")}, total=("no", "total"))})
    g = grid(spark, {"S": [(0, ["No", "C 5%", "c 12%", "a", "B", "x"]), (1, ["1", "2.5", "", "", "bee"]), (2, ["2", "1", "3", "ay", "bee"]), (3, ["Grand Total", "3.5", "3"]), (4, ["3", "x", ""])]})
    rows = {r["row_no"]: r for r in workbooks.parse(g, f).collect()}
    assert [rows[n]["cgst"] for n in (1, 2, 4)] == [Decimal("2.50"), Decimal("4.00"), None] and rows[3]["left_out"] == "total"
    assert [rows[n]["party_name"] for n in (1, 2, 4)] == ["bee", "ay", None]
    ims = formats.IMS.sheets["b2b-cn"]
    head = ["GSTIN of supplier", "Credit note number", "Integrated Tax", "Amount declared by taxpayer for ITC reduction :: Integrated Tax", "Status"]
    both = workbooks.parse(grid(spark, {"B2B-CN": [(2, head), (3, ["27AAAAA0000A1Z5", "C1", "10", "4", "Accepted"])]}), formats.IMS).first()
    assert (both["igst"], both["itc_reduction_igst"], both["ims_action_state"]) == (Decimal(10), Decimal(4), "Accepted") and ims.header == (2,)


def test_empty_and_unknown(spark):
    g = grid(spark, book()).limit(0)
    parsed, docs = portal.export(g, "gstr2b")
    assert parsed.count() == docs.count() == portal.control_totals(g, parsed, Guards()).count() == 0
    with pytest.raises(ValueError):
        portal.export(g, "bank")
    assert formats.Format.from_json(formats.GSTR2B.as_json()) == formats.GSTR2B


def test_a_union_of_frames_dealt_by_file_packs_whole_files(spark):
    ids = spark.range(0, 60_000, 1, 4).select(F.concat(F.lit("b"), F.col("id") % 40, F.lit(".xlsx")).alias("file"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text"))  # too wide for one partition
    nth = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    data = ids.select("file", F.lit("Rows").alias("sheet"), nth.cast("long").alias("row_no"), F.array("text").alias("cells"))
    head = ids.groupBy("file").agg(F.max("id").alias("m")).select("file", F.lit("Rows").alias("sheet"), F.lit(0).cast("long").alias("row_no"), F.array(F.concat(F.lit("to "), "m")).alias("cells"))
    packed = workbooks.pack(data.unionByName(head)).select("path").collect()
    assert len(packed) == len(set(packed)) == 40


def test_a_round_trip_leaves_only_the_cells(spark):
    stages = Stages(spark, "t")
    got = source_queries._written(stages(grid(spark, book())), stages)
    rows = got.count()
    assert sorted(p.name for p in Path(stages.root.removeprefix("file://")).iterdir()) == ["1", "3"]
    stages.drop(1)
    assert got.count() == rows > 20

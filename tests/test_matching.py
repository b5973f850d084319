"""Assignment against a sequential loop, and the TDS fixture of seven books rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reconweave.config import Config, Tolerance
from reconweave.functions import similarity
from reconweave.functions.predicates import in_window, within
from reconweave.operators import blocking, gst, notes, other, tds
from reconweave.operators.assign import ambiguous, serial
from reconweave.plans import verify
from reconweave.sources import derive
from reconweave.stages import Stages


def loop(edges):
    """Proposers in order take the best candidate left; also the gap to the runner-up at their turn."""
    taken, out = set(), {}
    for b in sorted({e[0] for e in edges}):
        open_ = sorted(((-r, p) for x, p, r in edges if x == b and p not in taken))
        if open_:
            out[b] = (open_[0][1], -open_[1][0] if len(open_) > 1 else None)
            taken.add(open_[0][1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_serial_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([5, 12, 30])
    edges = [(b, p, rng.choice([80.0, 90.0, 95.0, 98.0])) for b in range(n) for p in range(n) if rng.random() < 0.3]
    df = spark.createDataFrame(edges, "bid long, pid long, points double")
    got = ambiguous(df, serial(df, Stages(spark, "t"), F.col("points")), F.col("points"), 5.0).collect()
    assert {r["bid"]: (r["pid"], r["runner_up"]) for r in got} == loop(edges)


def test_serial_without_edges(spark):
    df = spark.createDataFrame([], "bid long, pid long, points double")
    assert serial(df, Stages(spark, "t"), F.col("points")).count() == 0


def test_band_join_misses_no_pair(spark):
    rng = random.Random(3)
    amounts = [round(rng.choice([1, 50, 1000, 99_999]) * rng.uniform(-1.02, 1.02), 2) for _ in range(150)] + [0.0, 10.0, -10.0]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(amounts)], "bid long, x double").withColumn("x", F.col("x").cast("decimal(18,2)"))
    b = a.select(F.col("bid").alias("pid"), F.col("x").alias("y"))
    t = Tolerance()
    got = blocking.band_join(a, b, "x", "y", t).select("bid", "pid").collect()
    assert len(got) == len(set(map(tuple, got)))
    want = {(i, j) for i, x in enumerate(amounts) for j, y in enumerate(amounts) if abs(x - y) <= 10 or abs(x - y) * 100 <= max(abs(x), abs(y))}
    assert want <= set(map(tuple, got))


def test_gst_passes_keep_every_row_once(spark):
    sf = "/root/testdata/sf0.001"
    b, p = derive.books(spark, sf).limit(400), derive.portal(spark, sf)
    p = p.join(b.select("gstin").distinct(), "gstin", "left_semi").limit(400)
    got = gst.match(b, p, Config().gst, Stages(spark, "t")).collect()
    bids, pids = ([r[c] for r in got if r[c] is not None] for c in ("bid", "pid"))
    assert len(bids) == len(set(bids)) == b.count() and len(pids) == len(set(pids)) == p.count()
    assert all(0 <= r["confidence_score"] <= 100 for r in got)


D = dt.date
BOOKS = [("AAAPA1111A", "194C", "Vendor One", 100000, 2000, D(2025, 4, 10), "CH001"), ("AAAPA2222B", "194J", "Vendor Two", 50000, 5000, D(2025, 4, 12), ""), ("AAAPA3333C", "194H", "Vendor Three", 20000, 1000, D(2025, 4, 5), ""), ("AAAPA3333C", "194H", "Vendor Three", 30000, 1500, D(2025, 4, 20), ""), ("AAAPA4444D", "194C", "Vendor Four", 50000, 1200, D(2025, 4, 8), "CH004"), ("AAAPA5555E", "194C", "Vendor Five", 50000, 700, D(2025, 4, 9), "CH005"), ("AAAPA6666F", "194J", "Vendor Six", 30000, 601, D(2025, 4, 11), "CH006")]
PORTAL = [("AAAPA1111A", "194C", "Vendor One", 100000, 2000, D(2025, 4, 10), "CH001"), ("AAAPA2222B", "194J", "Vendor Two", 50000, 5000, D(2025, 4, 12), ""), ("AAAPA3333C", "194H", "Vendor Three", 50000, 2500, D(2025, 4, 18), ""), ("AAAPA4444D", "194C", "Vendor Four", 50000, 1000, D(2025, 4, 8), "CH004"), ("AAAPA5555E", "194C", "Vendor Five", 50000, 600, D(2025, 4, 9), "CH005"), ("AAAPA6666F", "194J", "Vendor Six", 30000, 600, D(2025, 4, 11), "CH006")]
SCHEMA = "{} long, pan string, section string, deductee_name string, amount_paid_credited decimal(18,2), tax_deducted decimal(18,2), deposit_date date, challan_number string"


def frame(spark, rows, ident):
    from decimal import Decimal

    return spark.createDataFrame([(i, *r[:3], Decimal(r[3]), Decimal(r[4]), *r[5:]) for i, r in enumerate(rows)], SCHEMA.format(ident))


def test_tds_fixture(spark):
    got = {r["bid"]: r for r in tds.match_deductor(frame(spark, BOOKS, "bid"), frame(spark, PORTAL, "pid"), Config().tds, Stages(spark, "t")).collect()}
    assert (got[0]["classification"], got[0]["pass_name"]) == ("Matched", "challan")
    assert got[4]["difference_type"] == "Excess Deduction" and got[5]["difference_type"] == "Rate Mismatch"
    assert (got[1]["pass_name"], got[1]["confidence_score"]) == ("deductee", 78.0)
    assert (got[2]["pass_name"], got[2]["classification"], got[2]["confidence_score"]) == ("aggregated", "Matched", 66.0)
    assert 3 not in got  # a member of the group of row 2


def test_section_checks(spark):
    rows = [("AAAPC1111A", "194C", 50000, 800), ("AAAPC2222B", "194A", 50000, 5300), ("AAAPC3333C", "192", 100000, 0), ("AAAPC4444D", "194ZZZ", 50000, 1000), ("", "194ZZZ", 50000, 1000), ("", "194ZZZ", 50000, 10000), ("AAAPC6666F", "194C", 40000, 0), ("AAAPC7777G", "194A", 45000, 0), ("AAAPC7777G", "194A", 20000, 0), ("INVALID1", "194ZZZ", 50000, 1000)]
    books = frame(spark, [(p, s, "x", a, t, D(2025, 4, 1), "") for p, s, a, t in rows], "bid")
    got = [(r["bid"], r["check_name"], r["difference_type"]) for r in tds.validate_sections(books, tds.section_table(spark), Config().tds).collect()]
    assert sorted(got) == sorted([(0, "rate", "Short Deduction"), (1, "rate", "Excess Deduction"), (4, "missing_pan", "Rate Mismatch"), (9, "missing_pan", "Rate Mismatch"), (6, "rate", "Short Deduction"), (6, "single_threshold", "Short Deduction"), (7, "rate", "Short Deduction"), (8, "rate", "Short Deduction")])
    assert [(r["pan"], r["rows"]) for r in tds.annual_breaches(books, tds.section_table(spark)).collect()] == [("AAAPC7777G", 2)]


def test_alignment_keeps_both_sides(spark):
    rows = [(i, f"G{i % 3}", f"N{i}", 100.0 * i, D(2026, 1, 1 + i), f"Party {i}") for i in range(8)]
    e = spark.createDataFrame(rows, "eid long, gstin string, norm string, amount double, date date, party string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    b = e.withColumnRenamed("eid", "lid").filter("lid <> 2").withColumn("norm", F.when(F.col("lid") == 3, "other").otherwise(F.col("norm")))
    got = verify.align(e, b, Config().gst.tolerance, Stages(spark, "t")).collect()
    assert sorted(r["eid"] for r in got if r["eid"] is not None) == list(range(8))
    assert {r["eid"]: r["tier"] for r in got}[3] == 2 and {r["eid"]: r["lid"] for r in got}[2] is None


def test_notes_of_an_adjacent_period_and_near_misses(spark):
    from decimal import Decimal

    schema = "nid long, gstin string, note_type string, voucher_number string, narration string, note_date date, taxable_value decimal(18,2), total_tax decimal(18,2), invoice_value decimal(18,2)"
    g, h = "27ABCDE0001F1Z1", "27ABCDE0002F1Z2"
    row = lambda i, gstin, text, day, value: (i, gstin, None, None, text, day, Decimal(value), Decimal(0), Decimal(value))
    b = notes.prepare(spark.createDataFrame([row(1, g, "Credit Note No CD-1", D(2026, 1, 5), 100), row(2, g, "Credit Note No CD-2", D(2026, 1, 5), 200), row(3, g, "Credit Note No CD-3", D(2026, 1, 5), 300), row(4, "", "being a return", D(2026, 1, 6), 70)], schema))
    p = notes.prepare(spark.createDataFrame([row(11, g, "Credit Note No CD-1", D(2026, 1, 9), 100), row(13, h, "Credit Note No CD-3", D(2026, 1, 5), 300)], schema))
    q = notes.prepare(spark.createDataFrame([row(22, g, "Credit Note No CD-2", D(2025, 12, 9), 200)], schema))
    c = Config()
    got = {(r["bid"], r["pid"]): r for r in notes.match_with_adjacent(b, p, q, c.notes, c.gst.tolerance, Stages(spark, "t")).collect()}
    assert set(got) == {(1, 11), (2, 22), (3, None), (4, None), (None, 13)}
    assert got[1, 11]["confidence_score"] == 98.0 and got[2, 22]["confidence_score"] == 86.0 and got[2, 22]["cross_period"]
    assert [(r["bid"], r["pid"], r["why"]) for r in notes.near_misses(b, p, c.notes, c.gst.tolerance).collect()] == [(3, 13, ["gstin"])]


def test_pools_use_up_books_rows(spark):
    sf = "/root/testdata/sf0.001"
    b = derive.books(spark, sf).limit(120)
    p = derive.portal(spark, sf).join(b.select("gstin").distinct(), "gstin", "left_semi").limit(150)
    p = p.withColumn("document_type", F.element_at(F.array(*(F.lit(x) for x in ("Invoice", "Reverse Charge", "Import", "ISD", "Credit Note"))), (F.col("pid") % 5 + 1).cast("int")))
    got = gst.match_pools(b, p, Config().gst, Stages(spark, "t")).collect()
    bids = [r["bid"] for r in got if r["bid"] is not None]
    assert sorted(bids) == sorted(set(bids)) and len(bids) == b.count()
    assert sum(r["pid"] is not None for r in got) == p.filter("document_type in ('Invoice', 'Reverse Charge', 'Import')").count()


def test_deductee_rows_of_adjacent_quarters(spark):
    """One row and one group paid in March are credited in April."""
    cols = "pan string, deductee_name string, section string, amount_paid_credited double, tax_deducted decimal(18,2), deposit_date date, challan_number string"
    row = lambda pan, section, tax, day: (pan, "Vendor", section, 0.0, tax, dt.date.fromisoformat(day), "")
    d = Decimal
    b = [row("AAAPB1111X", "194C", d(2000), "2025-03-28"), row("AAAPB2222Y", "194J", d(2000), "2025-03-30"), row("AAAPB2222Y", "194J", d(3000), "2025-03-31")]
    p = [row("AAAPB1111X", "194C", d(2000), "2025-04-05"), row("AAAPB2222Y", "194J", d(5000), "2025-04-10")]
    books, portal = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], f"bid long, {cols}"), spark.createDataFrame([(i, *r) for i, r in enumerate(p)], f"pid long, {cols}")
    got = {r["bid"]: r for r in tds.match_deductee(books, portal, Config().tds, Stages(spark, "t")).collect()}
    assert set(got) == {0, 1} and all(r["difference_type"] == "Timing Difference" and r["classification"] == "Matched" for r in got.values())
    assert got[0]["pass_name"] == "adjacent_quarter" and got[1]["pass_name"] == "adjacent_group" and (got[0]["pid"], got[1]["pid"]) == (0, 1)
    off = Config().tds.__class__(quarter_boundary=False)
    rest = tds.match_deductee(books, portal, off, Stages(spark, "t")).collect()
    assert {r["classification"] for r in rest} == {"Not in Portal", "Not in Books"} or all(r["pass_name"] in ("fuzzy", "residual") for r in rest)


def test_a_credit_note_is_no_debit_note(spark):
    cols = "nid long, gstin string, note_type string, voucher_number string, narration string, note_date date, taxable_value double, total_tax double, invoice_value double"
    side = lambda kind: notes.prepare(spark.createDataFrame([(1, "27ABCDE1234F1Z5", kind, "V1", None, dt.date(2025, 8, 1), 100.0, 18.0, 118.0)], cols).withColumn("narration", F.lit(None).cast("string"))).withColumn("note_key", F.lit("N1"))
    c = Config()
    got = notes.match(side("Credit Note"), side("Debit Note"), c.notes, c.gst.tolerance, Stages(spark, "t")).collect()
    assert [(r["classification"], r["difference_type"]) for r in got] == [("Amount Difference", "Document Type Mismatch")]
    lenient = c.notes.__class__(require_kind=False)
    got = notes.match(side("Credit Note"), side("Debit Note"), lenient, c.gst.tolerance, Stages(spark, "t")).collect()
    assert [(r["classification"], r["difference_type"]) for r in got] == [("Matched", None)]


def test_containment_meets_every_pair_of_one_gstin(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice("AB1") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    b = spark.createDataFrame([(i, "g", k) for i, k in enumerate(keys)], "bid long, b_gstin string, b_note_key string")
    p = spark.createDataFrame([(i, "g", k) for i, k in enumerate(reversed(keys))], "pid long, p_gstin string, p_note_key string")
    met = [(r["bid"], r["pid"]) for r in notes._containing(b, p).collect()]
    want = {(i, j) for i, x in enumerate(keys) for j, y in enumerate(reversed(keys)) if x in y or y in x}
    assert want <= set(met) and len(met) == len(set(met))


def test_containment_of_one_numbering_scheme(spark):
    b = spark.createDataFrame([(i, "27AAAAA0000A1Z5", f"SRICN2025{i:04d}") for i in range(400)], "bid long, b_gstin string, b_note_key string")
    p = spark.createDataFrame([(i, "27AAAAA0000A1Z5", f"SRICNX2025{i:04d}") for i in range(400)] + [(1000, "27AAAAA0000A1Z5", "20250007"), (1001, "", "SRICN20250007")], "pid long, p_gstin string, p_note_key string")
    assert [(r["bid"], r["pid"]) for r in notes._containing(b, p).collect()] == [(7, 1000)]


def test_band_join_by_dates_misses_no_pair(spark):
    rnd = random.Random(5)
    day = lambda: None if rnd.random() < 0.2 else dt.date(2025, 1, 1) + dt.timedelta(rnd.randrange(40))
    left, right = ([(i, Decimal(rnd.randrange(90_000, 110_000)) / 100, day()) for i in range(150)] for _ in "lr")
    a, b = spark.createDataFrame(left, "bid long, x decimal(18,2), d date"), spark.createDataFrame(right, "pid long, y decimal(18,2), e date")
    t = Tolerance(days=5)
    got = blocking.band_join(a, b, "x", "y", t, dates=("d", "e")).filter(within(F.col("x"), F.col("y"), t) & in_window(F.col("d"), F.col("e"), 5)).select("bid", "pid").collect()
    near = lambda x, y: abs(x - y) <= 10 or abs(x - y) * 100 <= max(x, y)
    want = [(i, j) for i, x, d in left for j, y, e in right if near(x, y) and (d is None or e is None or abs((d - e).days) <= 5)]
    assert sorted(map(tuple, got)) == sorted(want)
    # rows of dates that are far apart do not meet at all
    far = blocking.band_join(a.filter("d < '2025-01-05'"), b.filter("e > '2025-02-01'"), "x", "y", t, dates=("d", "e"))
    assert far.isEmpty()


def test_serial_reads_only_what_is_open(spark):
    class Counted(Stages):
        rows = 0

        def __call__(self, df):
            out = super().__call__(df)
            self.rows += out.count()
            return out

    edges = [(i, j, float((i * 7 + j * 13) % 5)) for i in range(40) for j in range(40)]
    stages = Counted(spark, "t")
    got = serial(spark.createDataFrame(edges, "bid long, pid long, points double"), stages, F.col("points")).collect()
    assert sorted((r["bid"], r["pid"]) for r in got) == sorted((i, j) for i, (j, _) in loop(edges).items())
    assert stages.rows < 8000  # 9340 where settled rows are read again in every round


def test_batch_similarity_equals_the_plain_one():
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab é0漢") for _ in range(rnd.randrange(n)))
    a, b = ([word(n) for n in (3, 12, 63, 64, 65, 200) for _ in range(60)] + ["", "x\0", "same"] for _ in "ab")
    assert list(similarity.indel_ratios(a, b)) == [similarity.indel_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert list(similarity.indel_ratios([], [])) == []


def test_other_containment_meets_only_what_contains(spark):
    rows = lambda i, refs: spark.createDataFrame([(k, r, Decimal(a)) for k, (r, a) in enumerate(refs)], f"{i} long, {i[0]}_reference string, {i[0]}_amount decimal(18,2)")
    b = rows("bid", [("REF1", "100"), ("REF12", "100"), ("", "100"), (None, "100"), ("AB", "100"), ("REF12", "9000"), (" XREF7Y ", "105")])
    p = rows("pid", [("NEFT/REF12/X", "101"), ("REF1", "100"), ("none", "100"), ("ABAB", "100"), ("REF7", "100"), ("ZZ", "100")])
    got = other._containing(b, p, Tolerance())
    assert sorted((r["bid"], r["pid"]) for r in got.select("bid", "pid").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (4, 3), (6, 4)]


def test_adjacent_pairs_read_each_side_once(spark):
    sf = "/root/testdata/sf0.001"
    got = gst.adjacent_pairs(derive.books(spark, sf), derive.portal(spark, sf), Config().gst)
    assert got.columns == ["pid", "bid", "books_period", "portal_period"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

"""Versions with conditional commits, and the registry of layouts."""

import threading

import pytest

from reconweave.config import Guards
from reconweave.sources import detect, portal, registry, workbooks
from reconweave.sources.formats import Format, SheetLayout
from reconweave.sources.versions import Versions
from tests.test_workbooks import book, grid

PLAIN = Format("plain", {"register": SheetLayout(header=(0,), first_row=1, fields={"gstin": ("gstin",), "invoice_number": ("bill no",), "taxable_value": ("value",)})})


def plain(spark, file, head=("GSTIN", "Bill No", "Value"), sheet="Register"):
    return grid(spark, {sheet: [(0, list(head)), *((n, ["27AAAAA0000A1Z5", f"B{n}", "100"]) for n in range(1, 6))]}, file)


def test_one_of_two_writers_wins(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t", "k int, v string")
    assert store.latest() == 0 and store.read().count() == 0
    won, barrier = [], threading.Barrier(4)

    def write(k):
        own = Versions(spark, f"file://{tmp_path}/t", "k int, v string")
        rows = spark.createDataFrame([(k, f"writer {k}")], "k int, v string")
        barrier.wait()
        won.append((k, own.commit(rows, 0)))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    first = [k for k, v in won if v == 1]
    assert len(first) == 1 and sum(v is None for _, v in won) == 3
    assert [tuple(r)[:3] for r in store.read().collect()] == [(first[0], f"writer {first[0]}", 1)]
    assert store.commit(spark.createDataFrame([(9, None)], "k int, v string"), 1) == 2
    assert store.commit(spark.createDataFrame([(8, None)], "k int, v string"), 1) is None and store.latest() == 2
    assert store.read(1).count() == 1 and sorted(r["version"] for r in store.read().collect()) == [1, 2]
    began = store.read(1).first()["committed_at"]
    assert store.read(at=began).count() == 1 and store.read(at=began - 1).count() == 0
    with pytest.raises(ValueError):
        store.commit(spark.createDataFrame([(7, None)], "k int, v string"), 5)


def test_known_layouts_are_replayed_and_others_refused(spark, tmp_path):
    store = registry.registry(spark, f"file://{tmp_path}/r")
    spec = plain(spark, "spec.csv")
    assert registry.promote(store, spec, PLAIN, actor="a", required=["gstin", "taxable_value"]) == (1, [])
    assert registry.promote(store, spec, PLAIN, actor="b", base=0) == (None, [])  # came too late
    files = spec.filter("file = 'x'")
    for f in (plain(spark, "same.csv"), plain(spark, "more.csv", ("GSTIN", "Bill No", "Value", "Extra")), plain(spark, "else.csv", ("A", "B", "C"), "Other")):
        files = files.unionByName(f)
    look = lambda v=None, client=None: {r["file"]: r for r in registry.look_up(registry.layouts(files), registry.standing(store.read(v)), client).collect()}
    got = look()
    assert (got["same.csv"]["decision"], got["same.csv"]["name"], got["same.csv"]["version"]) == ("replay", "plain", 1)
    assert (got["more.csv"]["decision"], got["more.csv"]["closest"], got["more.csv"]["similarity"]) == ("refused", "plain", 0.875)
    assert got["else.csv"]["decision"] == "refused" and got["else.csv"]["closest"] is None
    parsed = registry.replay(files, registry.look_up(registry.layouts(files), registry.standing(store.read())))
    assert {(r["name"], r["file"], r["invoice_number"]) for r in parsed.collect()} == {("plain", "same.csv", f"B{n}") for n in range(1, 6)}
    assert registry.replay(files, registry.look_up(registry.layouts(files), registry.standing(store.read(0)))).count() == 0
    assert registry.promote(store, plain(spark, "n.csv", ("GSTIN", "Bill No", "Value", "Extra")), PLAIN, actor="c")[0] == 2
    got = look()
    assert got["same.csv"]["decision"] == "stale" and got["more.csv"]["decision"] == "replay" and look(1)["same.csv"]["decision"] == "replay"
    print_ = got["more.csv"]["fingerprint"]
    assert registry.quarantine(store, print_, actor="d") == 3 and look()["more.csv"]["decision"] == "quarantined" and look(2)["more.csv"]["decision"] == "replay"
    assert look()["same.csv"]["decision"] == "replay"  # the one before is the newest active one again
    own = registry.promote(store, spec, Format("own", PLAIN.sheets), actor="e", client="acme")
    assert own == (4, []) and look(client="acme")["same.csv"]["name"] == "own" and look(client="other")["same.csv"]["name"] == "plain"


def test_what_is_wrong_is_not_promoted(spark, tmp_path):
    store = registry.registry(spark, f"file://{tmp_path}/r")
    version, wrong = registry.promote(store, plain(spark, "s.csv", ("GSTIN", "No", "Value")), PLAIN, actor="a", required=["invoice_number", "cess"])
    assert version is None and wrong == ["invoice_number has no value", "cess has no value"] and store.latest() == 0
    g = grid(spark, book())
    parsed, _ = portal.export(g, "gstr2b")
    version, wrong = registry.promote(store, g, __import__("reconweave.sources.formats", fromlist=["GSTR2B"]).GSTR2B, actor="a", totals=portal.control_totals(g, parsed, Guards()))
    assert version is None and len(wrong) == 1 and "91.50" in wrong[0]
    assert registry.problems(workbooks.parse(g.limit(0), PLAIN), ["gstin"], Guards())[0] == "no rows were parsed"
    missing = registry.missing_labels(registry.layouts(plain(spark, "s.csv", ("GSTIN", "No", "Value"))), PLAIN).collect()
    assert [(r["sheet"], r["missing"]) for r in missing] == [("register", ["bill no"])]


def test_layout_fingerprints(spark):
    a, b, c = (registry.layouts(g).first()["fingerprint"] for g in (plain(spark, "a"), plain(spark, "b"), plain(spark, "c", ("GSTIN", "Value", "Bill No"))))
    assert a == b != c
    both = registry.layouts(workbooks.unpack(workbooks.pack(grid(spark, book())))).first()
    assert "pair:4,5" in [s["locus"] for s in both["sheets"] if s["sheet"].startswith("b2b")]
    assert registry.layouts(plain(spark, "a").limit(0)).count() == 0


def test_tiers_and_trusted_columns(spark):
    t = registry.tiers(spark.createDataFrame([("gstin", "GSTIN No", 95.0, 1), ("gstin", "x", 60.0, 2), ("amount", "amt", 40.0, 1), ("date", None, None, 1)], "field string, header string, score double, rank int"), 85, 50)
    assert [r["status"] for r in t.orderBy("field", "rank").collect()] == ["unavailable_review", "unavailable", "auto", "flagged"]
    got = {(r["field"], r["header"], r["status"], r["from_trusted"]) for r in registry.trusted(t, {"gstin": "GST #"}).collect()}
    assert got == {("gstin", "GST #", "auto", True), ("amount", "amt", "unavailable_review", False), ("date", None, "unavailable", False)}
    assert registry.trusted(t, {}).count() == 4
    assert registry.tiers(detect.column_candidates(spark, ["GSTIN", "Invoice Number"])).filter("status = 'auto'").count() >= 1

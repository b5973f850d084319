from pyspark.sql import functions as F

import corpus_pipeline
from reconweave.llm import decontaminate


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == names
        assert docs.count() <= before, name
        before = docs.count()
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), spark).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, other columns' names, and an empty table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.filter("text is not null and length(text) > 400").orderBy("doc_id").limit(3).collect()
    row = lambda k, text, **other: tuple({**some[0].asDict(), "doc_id": k, "text": text, **other}[c] for c in docs.columns)
    nulls = tuple(10**6 if c == "doc_id" else None for c in docs.columns)
    a, b, c = (x["text"] for x in some)
    rows = [nulls, row(10**6 + 1, ""), row(10**6 + 2, a), row(10**6 + 2, a), row(10**6 + 2, b), row(10**6 + 3, f"{c} " * 400), row(10**6 + 4, "1 2 3")]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({"hash": F.lit("x"), "component": F.lit(1), "bucket": F.lit(2.0), "score": F.lit(None).cast("double"), "lang_pred": F.lit("q"), "sig": F.lit(3)})
    before = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        kept = spark.createDataFrame(after.collect(), after.schema)
        assert kept.columns == odd.columns and kept.count() <= before.count(), name
        assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before.collect()}, name
        assert stage(spark, before.limit(0), sf).count() == 0, name
        before = kept
    ids = {r["doc_id"] for r in before.collect()}
    assert not ids & {10**6, 10**6 + 1, 10**6 + 4}
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert corpus_pipeline.STAGES[-1][1](spark, before.limit(0), sf).count() == 0


def test_run_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    got = {r["doc_id"] for r in rows}
    assert got <= ids and len(got) >= 0.6 * len(ids)
    sums, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == at.get(r["doc_id"], 0) and 0 < r["length"] <= 4096
        at[r["doc_id"]] = r["start"] + r["length"]
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 4096 and len(sums) >= sum(sums.values()) / 4096

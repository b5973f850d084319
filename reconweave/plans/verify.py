"""The engine's verdicts against a manually prepared baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.config import Tolerance
from reconweave.functions.predicates import in_window, within
from reconweave.functions.similarity import token_sort_ratio
from reconweave.operators.assign import ordinal, serial
from reconweave.operators.blocking import band_join
from reconweave.schemas import CLASSES
from reconweave.stages import Stages


def align_by_key(engine: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the first tier: k-th with k-th row of equal keys (eid, lid)."""
    return ordinal(engine, baseline, keys, "eid", "lid")


def align(engine: DataFrame, baseline: DataFrame, t: Tolerance, stages: Stages, fuzzy: int = 80) -> DataFrame:
    """eid, lid, tier of one-to-one pairs; unaligned rows of either side have a null partner.

    engine: eid, gstin, norm, amount, date, party; baseline: the same with lid.
    """
    e = stages(engine.select("eid", *(F.col(c).alias(f"e_{c}") for c in ("gstin", "norm", "amount", "date", "party"))))
    b = stages(baseline.select("lid", *(F.col(c).alias(f"l_{c}") for c in ("gstin", "norm", "amount", "date", "party"))))
    near = within(F.col("e_amount"), F.col("l_amount"), t)
    done = None
    for tier in (1, 2, 3):
        x, y = (e, b) if done is None else (e.join(done, "eid", "left_anti"), b.join(done, "lid", "left_anti"))
        if tier == 1:  # all rows of a key rank alike: the k-th meets the k-th
            keyed = lambda f, k: f.select(f"{k[1]}id", F.col(f"{k[0]}_gstin").alias("_g"), F.col(f"{k[0]}_norm").alias("_n"))
            done = stages(ordinal(keyed(x, "ee"), keyed(y, "ll"), ["_g", "_n"], "eid", "lid").withColumn("tier", F.lit(1)))
            continue
        elif tier == 2:
            met = band_join(x.withColumn("_g", F.col("e_gstin")), y.withColumn("_g", F.col("l_gstin")), "e_amount", "l_amount", t, ["_g"]).filter(near).withColumn("rank", F.lit(0.0))
        else:
            met = band_join(x, y, "e_amount", "l_amount", t, dates=("e_date", "l_date")).filter(near & in_window(F.col("e_date"), F.col("l_date"), t.days))
            met = met.withColumn("rank", token_sort_ratio("e_party", "l_party")).filter(F.col("rank") >= fuzzy)
        edges = stages(met.select("eid", "lid", "rank"))
        got = serial(edges, stages, F.col("rank"), "eid", "lid").select("eid", "lid", F.lit(tier).alias("tier"))
        done = stages(got if done is None else done.unionByName(got))
    only_e = e.join(done, "eid", "left_anti").select("eid", F.lit(None).cast("long").alias("lid"), F.lit(None).cast("int").alias("tier"))
    only_b = b.join(done, "lid", "left_anti").select(F.lit(None).cast("long").alias("eid"), "lid", F.lit(None).cast("int").alias("tier"))
    return done.unionByName(only_e).unionByName(only_b)


def align_tds(engine: DataFrame, baseline: DataFrame, t: Tolerance, stages: Stages, fuzzy: int = 80) -> DataFrame:
    """eid, lid, tier for rows of withheld tax: PAN and section; PAN and tax within tolerance; name, tax and date.

    engine: eid, pan, section, tax_deducted, deposit_date, deductee_name; baseline: the
    same with lid.  The second tier asks for no section.  A blank PAN, section or name
    meets nothing in its tier.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))

    def shape(f: DataFrame, i: str) -> DataFrame:
        return f.select(i, text(F.upper("pan")).alias("gstin"), text(F.col("section")).alias("norm"), F.col("tax_deducted").alias("amount"), F.col("deposit_date").alias("date"), text(F.col("deductee_name")).alias("party"))

    return align(shape(engine, "eid"), shape(baseline, "lid"), t, stages, fuzzy)


def confusion(aligned: DataFrame) -> DataFrame:
    """baseline_class, engine_class, pairs with margins (Total)."""
    out = aligned.cube("baseline_class", "engine_class").agg(F.count(F.lit(1)).alias("pairs"))
    return out.na.fill("Total", ["baseline_class", "engine_class"])


def precision_recall(aligned: DataFrame) -> DataFrame:
    """For each class: tp, fp, fn, precision, recall (4 decimals; null without a base)."""
    each = None
    for c in CLASSES:
        e, b = F.col("engine_class") == c, F.col("baseline_class") == c
        row = F.struct(F.lit(c).alias("class"), F.sum(F.when(e & b, 1).otherwise(0)).alias("tp"), F.sum(F.when(e & ~b, 1).otherwise(0)).alias("fp"), F.sum(F.when(~e & b, 1).otherwise(0)).alias("fn"))
        each = [*(each or []), row.alias(f"c{len(each or [])}")]
    out = aligned.agg(*each).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(CLASSES))))).alias("c")).select("c.*")
    ratio = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), (F.col(x) + F.col(y)).cast("double")), 4)
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def calibration(aligned: DataFrame) -> DataFrame:
    """Agreement in each decile of the score; the last one is closed at 100."""
    decile = F.least(F.floor(F.col("confidence_score") / 10), F.lit(9)).cast("int")
    agree = F.when(F.col("engine_class") == F.col("baseline_class"), 1).otherwise(0)
    out = aligned.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(agree).alias("agreed"))
    return out.withColumn("accuracy", F.round(F.col("agreed").cast("double") / F.col("pairs"), 4))


def coverage(engine_rows: DataFrame, baseline_rows: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """engine_rows, baseline_rows, aligned, coverage and whether it reaches the floor."""
    n = F.count(F.lit(1))
    out = engine_rows.agg(n.alias("engine_rows")).crossJoin(baseline_rows.agg(n.alias("baseline_rows"))).crossJoin(pairs.agg(n.alias("aligned")))  # one row each
    out = out.withColumn("coverage", F.round(F.col("aligned").cast("double") / F.greatest("engine_rows", "baseline_rows"), 4))
    return out.withColumn("enough", F.col("coverage") >= floor)


def disagreements(aligned: DataFrame) -> DataFrame:
    """Pairs with different classes and a cause read off the engine's reason."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    cause = F.when(reason.contains("duplicate"), "duplicate").when(reason.contains("rate"), "rate").when(reason.contains("timing") | reason.contains("period"), "timing").when(reason.contains("ambigu"), "ambiguous").otherwise("unexplained")
    return aligned.filter("engine_class <> baseline_class").withColumn("cause", cause)


def criteria(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, value, threshold, result: PASS, FAIL, or NOT YET ASSESSABLE without a threshold."""
    out = thresholds.join(metrics, "metric", "left")
    return out.withColumn("result", F.when(F.col("threshold").isNull() | F.col("value").isNull(), "NOT YET ASSESSABLE").when(F.col("value") >= F.col("threshold"), "PASS").otherwise("FAIL"))

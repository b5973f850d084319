"""Runs as append-only tables: results below a path, and a manifest that publishes them."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, client string, period string, recon_type string, run_at timestamp, config string, path string"


def write_run(results: DataFrame, root: str, *, client: str, period: str, recon_type: str, config: dict) -> str:
    """Writes the results, then a manifest row; a run without its row does not exist."""
    spark, run_id = results.sparkSession, uuid.uuid4().hex
    path = f"{root}/results/{run_id}"
    results.write.partitionBy("classification").parquet(path)
    row = [(run_id, client, period, recon_type, datetime.now(timezone.utc), json.dumps(config, default=str), path)]
    spark.createDataFrame(row, MANIFEST).write.mode("append").parquet(f"{root}/runs")
    return run_id


def list_runs(spark: SparkSession, root: str, *, client: str | None = None, period: str | None = None, recon_type: str | None = None) -> DataFrame:
    """Published runs, newest first."""
    runs = spark.read.schema(MANIFEST).parquet(f"{root}/runs")
    for c, v in (("client", client), ("period", period), ("recon_type", recon_type)):
        runs = runs.filter(F.col(c) == v) if v is not None else runs
    return runs.orderBy(F.desc("run_at"), "run_id")


def read_run(spark: SparkSession, root: str, run_id: str, *, classification: str | None = None, difference_type: str | None = None, band: str | None = None, least_score: float | None = None) -> DataFrame:
    """A run's results; the filters reach the Parquet partitions and row groups."""
    path = list_runs(spark, root).filter(F.col("run_id") == run_id).select("path").first()["path"]
    out = spark.read.parquet(path)
    for c, v in (("classification", classification), ("difference_type", difference_type), ("confidence_band", band)):
        out = out.filter(F.col(c) == v) if v is not None else out
    return out.filter(F.col("confidence_score") >= least_score) if least_score is not None else out


def flat(results: DataFrame) -> DataFrame:
    """results with both records as prefixed columns."""
    own = [c for c in results.columns if c not in ("books", "portal")]
    parts = [F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("books", "portal") for f in results.schema[side].dataType.fieldNames()]
    return results.select(*own, *parts)


def export_csv(results: DataFrame, path: str) -> None:
    """One folder of CSV files for each classification."""
    flat(results).write.partitionBy("classification").option("header", True).csv(path)

"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Writes a step's rows below spark.checkpoint.dir and reads them back.

    Plans stay short in iterations, and a lost executor costs one step.  Where the
    setting is absent and Spark runs on one machine a temporary folder stands in; on
    a cluster that is an error.  drop() frees a step that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: int) -> None:
        """Deletes steps by their number (n after the call that wrote them)."""
        for k in steps:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

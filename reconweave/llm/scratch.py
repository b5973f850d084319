"""Written tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch: texts are long, and a task holds a batch on either side several times over.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps batches that go to Python small, where the session has Spark's own default for them.

    For jobs of many stages: a worker of one stage still holds memory when the next begins.
    """
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


class Scratch:
    """A folder of Parquet tables below spark.checkpoint.dir.

    Where that setting is absent and Spark runs on one machine (tests) a temporary
    folder stands in for it; on a cluster that is an error.  Tables that a returned
    DataFrame reads must stay; drop() removes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        """Drops all tables, when nothing reads them any more."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

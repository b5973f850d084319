"""A Spark data source that writes rows as xlsx workbooks, with a commit.

    register(spark)
    df.write.format("reconweave_xlsx").option("path", uri).option("sheet", "Results").mode("append").save()

Each task writes its rows to workbooks of ROWS rows at most, under names of its own; the
commit writes the list of the parts of all tasks that succeeded, and only listed parts
are read, so a task that is tried again or lost leaves nothing that counts.  Files go
through pyarrow's file systems, which the uri's scheme must name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from reconweave.sources.grids import read_grids
from reconweave.sources.workbooks import workbook

NAME = "reconweave_xlsx"
#: Data rows of a part.
ROWS = 100_000


@dataclass
class Parts(WriterCommitMessage):
    files: list[str]
    rows: int


def _fs(uri: str) -> tuple[Any, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


class XlsxWriter(DataSourceWriter):
    def __init__(self, schema: StructType, uri: str, sheet: str, rows: int, overwrite: bool):
        self.names, self.uri, self.sheet, self.rows, self.overwrite = schema.fieldNames(), uri.rstrip("/"), sheet, rows, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Parts:
        fs, root = _fs(self.uri)
        fs.create_dir(root, recursive=True)
        files, total, held = [], 0, []

        def flush() -> None:
            name = f"part-{self.job}-{uuid.uuid4().hex}.xlsx"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(workbook({self.sheet: [(0, self.names), *enumerate(held, 1)]}))
            files.append(name)

        for row in iterator:
            held.append([None if v is None else str(v) for v in row])
            total += 1
            if len(held) == self.rows:
                flush()
                held = []
        if held:
            flush()
        return Parts(files, total)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, root = _fs(self.uri)
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m]
        listed = {"parts": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done), "overwrite": self.overwrite, "columns": self.names}
        with fs.open_output_stream(f"{root}/_pending-{self.job}") as out:
            out.write(json.dumps(listed).encode())
        fs.move(f"{root}/_pending-{self.job}", f"{root}/_committed-{self.job}.json")

    def abort(self, messages: list[Parts | None]) -> None:
        fs, root = _fs(self.uri)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f}")


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, self.options["path"], self.options.get("sheet", "Sheet1"), int(self.options.get("rows", ROWS)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def committed(uri: str) -> list[str]:
    """Names of the parts that commits list; a commit that overwrites alone counts where there is one of several."""
    import pyarrow.fs

    fs, root = _fs(uri.rstrip("/"))
    found = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.base_name.startswith("_committed-")]
    lists = []
    for info in sorted(found, key=lambda i: i.mtime_ns or 0):
        with fs.open_input_stream(info.path) as f:
            one = json.loads(f.read())
        lists = [one] if one["overwrite"] else [*lists, one]
    return [p for one in lists for p in one["parts"]]


def read(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of all committed parts as text columns, by their header, which all parts share."""
    parts = committed(uri)
    grid = read_grids(spark, uri.rstrip("/") + "/*.xlsx")
    grid = grid.join(F.broadcast(spark.createDataFrame([(p,) for p in parts], "_part string")), F.substring_index("file", "/", -1) == F.col("_part")).drop("_part")  # a name for each part
    names = grid.filter("row_no = 0").select("cells").first()
    if names is None:
        return spark.createDataFrame([], StructType([]))
    return grid.filter("row_no > 0").select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names["cells"])))

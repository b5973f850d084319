"""Known layouts of source files: fingerprints, look-up, replay of stored mappings, and promotion of new ones.

A layout is all sheets of a file with the place and labels of their header; files of one
layout have one fingerprint.  Formats are kept as numbered versions (see versions): a
new one takes the place of the last one of its name and client, and one may be
quarantined.  A file is parsed only by the format of exactly its fingerprint; a near
one is named for a person to look at, never used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.config import Guards
from reconweave.functions.keys import label
from reconweave.sources import workbooks
from reconweave.sources.formats import Format
from reconweave.sources.grids import header_pairs, header_rows
from reconweave.sources.versions import Versions

#: Similarity below which no known layout is named as the closest.
SIMILAR = 0.55
_SHEETS = "array<struct<sheet:string,locus:string,labels:array<string>,title_rows:bigint,total:boolean>>"
SCHEMA = f"name string, client string, fingerprint string, action string, format string, sheets {_SHEETS}, actor string"


def registry(spark: SparkSession, root: str) -> Versions:
    """Entries: action is active or quarantined; a null client is the whole firm."""
    return Versions(spark, root, SCHEMA)


def layouts(grid: DataFrame) -> DataFrame:
    """file, fingerprint, sheets: the layout of each file.

    A sheet's header is its first merged pair of rows, else its best row; total: its
    last row names a total.  The fingerprint hashes names, places, labels and shape,
    sheets by name.
    """
    key = ["file", "sheet"]
    one = header_rows(grid).select(*key, "header_row", "labels")
    pair = header_pairs(grid).select(*key, F.col("header_row").alias("_row"), "parent", "child")
    last = grid.groupBy(*key).agg(F.max_by("cells", "row_no").alias("_last"))
    each = last.join(one, key, "left").join(pair, key, "left")
    none = F.array().cast("array<string>")
    flat = F.when(F.col("child").isNotNull(), workbooks.labels(F.col("parent"), F.col("child"))).otherwise(workbooks.labels(F.coalesce("labels", none)))
    row = F.coalesce("_row", "header_row", F.lit(0)).cast("long")
    locus = F.when(F.col("child").isNotNull(), F.format_string("pair:%d,%d", row, row + 1)).otherwise(F.format_string("single:%d", row))
    sheet = F.struct(label(F.col("sheet")).alias("sheet"), locus.alias("locus"), flat.alias("labels"), row.alias("title_rows"), F.contains(F.lower(F.array_join("_last", " ")), F.lit("total")).alias("total"))
    files = each.groupBy("file").agg(F.sort_array(F.collect_list(sheet)).alias("sheets"))
    return files.select("file", F.sha2(F.to_json("sheets"), 256).alias("fingerprint"), "sheets")


def standing(entries: DataFrame) -> DataFrame:
    """entries with status: active, superseded or quarantined, as the last entry of each fingerprint says.

    entries: what Versions.read gives, of any version or time.  Of the active ones of a
    name and client the newest stays active.
    """
    own = Window.partitionBy("name", "client", "fingerprint").orderBy(F.desc("version"))
    last = entries.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    newest = F.max(F.when(F.col("action") == "active", F.col("version"))).over(Window.partitionBy("name", "client"))
    status = F.when(F.col("action") != "active", "quarantined").when(F.col("version") == newest, "active").otherwise("superseded")
    return last.withColumn("status", status)


def look_up(files: DataFrame, known: DataFrame, client: str | None = None) -> DataFrame:
    """file, fingerprint, decision, name, format, version, closest, similarity for each file.

    files: of layouts(); known: of standing().  decision: replay (an active format has
    the file's fingerprint; the client's own before the firm's, then the newest),
    quarantined (only such an entry has it), stale (superseded only) or refused; then
    closest names the active format of the greatest similarity from SIMILAR on: half the
    share of common sheets, half the mean share of common labels in those.  Only
    different layouts meet, those that share a sheet's name.
    """
    usable = known.filter(F.col("client").isNull() | F.col("client").eqNullSafe(F.lit(client)))
    order = F.struct((F.col("status") == "active").cast("int"), (F.col("status") == "quarantined").cast("int"), F.col("client").isNotNull(), "version")
    exact = usable.groupBy("fingerprint").agg(F.max_by(F.struct("name", "format", "version", "status"), order).alias("x"))
    unknown = files.select("fingerprint", "sheets").dropDuplicates(["fingerprint"]).join(exact.select("fingerprint"), "fingerprint", "left_anti")
    mine = unknown.select("fingerprint", F.size("sheets").alias("_m"), F.explode("sheets").alias("a")).select("fingerprint", "_m", F.col("a.sheet").alias("sheet"), F.col("a.labels").alias("la"))
    active = usable.filter("status = 'active'").select(F.col("name").alias("_name"), F.col("version").alias("_version"), F.size("sheets").alias("_k"), F.explode("sheets").alias("b"))
    theirs = active.select("_name", "_version", "_k", F.col("b.sheet").alias("sheet"), F.col("b.labels").alias("lb"))
    union = F.size(F.array_union("la", "lb"))
    share = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("la", "lb")) / union)
    met = mine.join(theirs, "sheet").groupBy("fingerprint", "_name", "_version", "_m", "_k").agg(F.count(F.lit(1)).alias("_n"), F.avg(share).alias("_j"))
    met = met.withColumn("similarity", F.round(0.5 * F.col("_n") / (F.col("_m") + F.col("_k") - F.col("_n")) + 0.5 * F.col("_j"), 6)).filter(F.col("similarity") >= SIMILAR)
    near = met.groupBy("fingerprint").agg(F.max_by(F.struct(F.col("_name").alias("closest"), "similarity"), F.struct("similarity", "_version")).alias("y"))
    out = files.select("file", "fingerprint").join(exact, "fingerprint", "left").join(near, "fingerprint", "left")
    status = F.col("x.status")
    decision = F.when(status == "active", "replay").when(status == "quarantined", "quarantined").when(status == "superseded", "stale").otherwise("refused")
    replay = lambda c: F.when(status == "active", F.col(f"x.{c}")).alias(c)
    return out.select("file", "fingerprint", decision.alias("decision"), replay("name"), replay("format"), replay("version"), "y.closest", "y.similarity")


def missing_labels(files: DataFrame, f: Format) -> DataFrame:
    """file, sheet, missing: labels that the format needs and the file's sheet of that name lacks; a mapping with some is stale."""
    needed = {k: sorted({c for cols in s.fields.values() for c in cols}) for k, s in f.sheets.items() if s.role == "line_items"}
    each = files.select("file", F.explode("sheets").alias("s")).filter(F.col("s.sheet").isin(*needed))
    want = F.create_map(*[x for k, v in needed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return each.select("file", "s.sheet", F.array_except(want[F.col("s.sheet")], "s.labels").alias("missing")).filter(F.size("missing") > 0)


def replay(grid: DataFrame, found: DataFrame) -> DataFrame:
    """The files that look_up() found a format for, parsed by it in one pass over their rows; the others are read by nothing.

    Rows have the name of their format, and the fields of all formats.
    """
    used = found.filter("decision = 'replay'")
    rows = used.select("name", "format").distinct().collect()  # a row for each known format
    formats = {r["format"]: (r["name"], Format.from_json(r["format"])) for r in rows}
    known = [known_sheets(grid, used.filter(F.col("format") == text), f).withColumn("_name", F.lit(name)) for text, (name, f) in formats.items()]
    if not known:
        return workbooks.parse(grid.limit(0), Format("none", {})).withColumn("name", F.lit(None).cast("string"))
    every = reduce(DataFrame.unionByName, known)
    parsed = workbooks.read_rows(grid, every.drop("_name"), [f for _, f in formats.values()])
    return parsed.join(every.select("file", "sheet", F.col("_name").alias("name")), ["file", "sheet"])


def known_sheets(grid: DataFrame, files: DataFrame, f: Format) -> DataFrame:
    """workbooks.sheets() of some files by a format."""
    return workbooks.sheets(grid.join(files.select("file"), "file", "left_semi"), f)


def problems(parsed: DataFrame, required: list[str], c: Guards, totals: DataFrame | None = None) -> list[str]:
    """Why a parse is not fit to be promoted: no rows, rows lost, a required field without a value, a total that does not agree."""
    acc = workbooks.accounting(parsed).agg(F.sum("rows_parsed").alias("n"), F.sum(F.col("rows_read") - F.col("blank") - F.col("total") - F.col("rows_parsed")).alias("lost")).first()
    out = [] if acc["n"] else ["no rows were parsed"]
    if acc["lost"]:
        out.append(f"{acc['lost']} rows are not accounted for")
    rows = workbooks.line_items(parsed)
    filled = rows.agg(*(F.count(f).alias(f) for f in required if f in rows.columns)).first() if required else {}
    out += [f"{f} has no value" for f in required if f not in rows.columns or not filled[f]]
    if totals is not None:
        out += [f"{r['file']}: parsed {r['head']} {r['parsed']} against a stated {r['stated']}" for r in totals.filter("result = 'hard_stop'").orderBy("file", "section", "head").limit(5).collect()]
    return out


def promote(store: Versions, grid: DataFrame, f: Format, *, actor: str, client: str | None = None, required: list[str] = (), totals: DataFrame | None = None, base: int | None = None) -> tuple[int | None, list[str]]:
    """(version, problems): parses the specimens by the format, and only if nothing is wrong makes it active for their layouts.

    base: the version that was looked at; None in place of a version says that another
    writer came first, and the caller looks again.
    """
    wrong = problems(workbooks.parse(grid, f), list(required), Guards(), totals)
    if wrong:
        return None, wrong
    rows = layouts(grid).dropDuplicates(["fingerprint"]).select(F.lit(f.name).alias("name"), F.lit(client).alias("client"), "fingerprint", F.lit("active").alias("action"), F.lit(f.as_json()).alias("format"), "sheets", F.lit(actor).alias("actor"))
    return store.commit(rows, store.latest() if base is None else base), []


def quarantine(store: Versions, fingerprint: str, *, actor: str) -> int | None:
    """Makes the entries of a fingerprint unusable, in a new version."""
    base = store.latest()
    rows = standing(store.read(base)).filter(F.col("fingerprint") == fingerprint)
    return store.commit(rows.withColumn("action", F.lit("quarantined")).withColumn("actor", F.lit(actor)), base)


def tiers(candidates: DataFrame, auto: float = 90.0, manual: float = 70.0) -> DataFrame:
    """candidates (field, header, score, ...) with status: auto, flagged, unavailable_review, or unavailable without a score."""
    s = F.col("score")
    return candidates.withColumn("status", F.when(s.isNull(), "unavailable").when(s >= auto, "auto").when(s >= manual, "flagged").otherwise("unavailable_review"))


def trusted(tiered: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """tiered with the columns of a confirmed mapping in place of what was inferred for its fields, as rules without a score."""
    spark = tiered.sparkSession
    rest = tiered.filter(~F.col("field").isin(*columns)) if columns else tiered
    own = spark.createDataFrame([(k, v, "auto", True) for k, v in columns.items()], "field string, header string, status string, from_trusted boolean")
    return rest.withColumn("from_trusted", F.lit(False)).unionByName(own, allowMissingColumns=True)

"""Quality rules with cross-document line frequency.

Lines are lower-cased, trimmed and their runs of digits and of white space made
equal; a 64-bit hash stands for each.  For every host (source) the documents that
hold a line are counted.  A line that more than HOST_PERCENT of the host's documents
hold, and more than MIN_DOCS of them, is removed; a document of which too little is left
is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch
from reconweave.llm.words import buffers, counts_in, slices, span_hashes, spans, texts, mix, _SHINGLE

#: A line may be in so large a part of a host's documents, and always in MIN_DOCS of them: fewer are no sign of a template.
HOST_PERCENT, MIN_DOCS = 10, 5
#: Per cent of a document's word characters that must stay when frequent lines go.
LEFT_PERCENT = 30
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each item, how many items of its document have its value; and whether it is the first."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    run = np.cumsum(new) - 1
    n = np.bincount(run)
    out, first = np.empty(len(d), np.int64), np.empty(len(d), bool)
    out[order], first[order] = n[run], new  # lexsort is stable: the first of a run is the earliest
    return out, first


def measures(column: pa.StringArray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = buffers(column)
    n = len(column)
    starts, ends = spans(data, offsets)
    at = counts_in(offsets, starts)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # first bytes of code points
    chars = np.bincount(doc, points[ends] - points[starts], n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": words, "word_chars": chars, "n_symbols": np.diff(symbols[offsets])}

    lines, stops = spans(data, offsets, _LINE)
    has = np.searchsorted(starts, lines) < np.searchsorted(starts, stops)
    lines, stops = lines[has], stops[has]
    of = np.searchsorted(offsets, lines, "right") - 1
    again = ~_repeats(of, span_hashes(data, lines, stops, lower=False))[1] if len(lines) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(of[again], minlength=n)

    covered = np.zeros(len(starts), bool)
    if len(starts) > 2:
        h = span_hashes(data, starts, ends, lower=False)
        window = mix(h[:-2] * _SHINGLE[0] + h[1:-1] * _SHINGLE[1] + h[2:] * _SHINGLE[2])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        if len(inside):
            twice = inside[_repeats(doc[inside], window[inside])[0] > 1]
            for k in range(3):
                covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def line_hashes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, word characters) of each line with a word, normalised.

    A line's hash is that of its lower-cased words in turn, digits counting as 0.
    """
    folded = pc.replace_substring_regex(column, "[0-9]+", "0")
    data, offsets = buffers(folded)
    starts, ends = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = span_hashes(data, starts, ends)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    doc = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    total = np.add.reduceat(mix(h + place.astype(np.uint64) * _SHINGLE[5]), first)
    data, offsets = buffers(column)  # the same words, with their own digits
    starts, ends = spans(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return doc[first], total, np.add.reduceat(points[ends] - points[starts], first)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            part = column.slice(a, b - a)
            m = measures(part)
            doc, line, chars = line_hashes(part)
            at = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.view(np.int64))) for x in (line, chars)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("source").slice(a, b - a), *(pa.array(x) for x in m.values()), *lists], names=["doc_id", "source", *m, "lines", "chars"])


def line_quality(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and removed_chars for each row of docs.

    docs: doc_id, text, source; other columns are ignored.  A null text has no
    words and fails; a null source is a host like any other.  A line counts once
    for a row however often it is in it.  Repeated rows are documents of their own;
    an empty table gives none.
    """
    s = Scratch(spark, "line-quality")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, chars array<long>"
    f = docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(_features, schema)
    f = s.write(f.withColumn("host", F.coalesce(F.xxhash64("source"), F.lit(0))).withColumn("row", F.monotonically_increasing_id()), "features")
    hosts = f.groupBy("host").agg(F.greatest(F.lit(MIN_DOCS), F.floor(F.count(F.lit(1)) * HOST_PERCENT / 100)).alias("most"))
    held = f.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MIN_DOCS)
    frequent = held.join(hosts, "host").filter("n > most").select("host", "line")
    each = f.select("row", "host", F.explode(F.arrays_zip("lines", "chars")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.chars").alias("chars"))
    removed = each.join(frequent, ["host", "line"]).groupBy("row").agg(F.sum("chars").alias("removed_chars"))
    out = f.drop("lines", "chars", "host").join(removed, "row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = 100 * (F.col("word_chars") - F.col("removed_chars")) >= LEFT_PERCENT * F.col("word_chars")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")

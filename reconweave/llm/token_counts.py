"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a broadcast table of the most frequent units (stretches that the
tokenizer's pre-tokenizer never joins) with their token counts, made from a
bounded sample.  Tier two is the cache of each worker, which asks the tokenizers
library for units it has not met.  No unit is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.bpe import Encoder, unit_spans, whole_texts
from reconweave.llm.words import _SPACE, buffers, slices, span_hashes, texts

#: The frequent units come from about this many rows, and this many are kept.
SAMPLE_ROWS, FREQUENT_UNITS = 4000, 65_536


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows, chosen by a hash of doc_id; all of a smaller table."""
    n = docs.count()
    if n <= rows:
        return docs
    span = 1 << 30
    return docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(span)) < rows * span // n).limit(2 * rows)


def frequent_units(docs: DataFrame, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token counts of the most frequent units of a sample."""
    encoder = Encoder.of(tokenizer)
    column = texts(pa.array([r["text"] for r in sample(docs, SAMPLE_ROWS).select("text").collect()], pa.string()))
    keys, sizes = [], []
    for a, b in slices(column):
        data, offsets = buffers(column.slice(a, b - a))
        if len(data):
            starts, ends = unit_spans(data, offsets)
            starts = starts + _SPACE[data[starts]] if encoder.fold else starts
            place = encoder.known(data, starts, ends)
            sizes.append(encoder.size[place])
            keys.append(span_hashes(data, starts, ends, lower=encoder.fold))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    unit, one, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
    top = np.sort(np.argsort(-n, kind="stable")[:FREQUENT_UNITS])
    return unit[top], np.concatenate(sizes)[one[top]].astype(np.int32)


class Lookup:
    """Both tiers: the broadcast table, then what this worker has met."""

    def __init__(self, tokenizer: str, frequent: tuple[np.ndarray, np.ndarray]):
        self.encoder, (self.keys, self.sizes) = Encoder.of(tokenizer), frequent

    def counts(self, column: pa.StringArray) -> np.ndarray:
        """Tokens of each text."""
        odd = whole_texts(column, self.encoder.specials)
        out = np.zeros(len(column), np.int64)
        if odd.any():
            out[odd] = self.encoder.fresh(column.filter(pa.array(odd)).to_pylist())[1]
            column = pc.if_else(pa.array(odd), "", column)
        data, offsets = buffers(column)
        if not len(data):
            return out
        starts, ends = unit_spans(data, offsets)
        own = starts + _SPACE[data[starts]] if self.encoder.fold else starts
        hashes = span_hashes(data, own, ends, lower=self.encoder.fold)
        n = np.zeros(len(starts), np.int64)
        miss = np.ones(len(starts), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            n[hit], miss = self.sizes[at[hit]], ~hit
        if miss.any():
            place = self.encoder.known(data, starts[miss], ends[miss])
            n[miss] = self.encoder.size[place]
        total = np.concatenate([[0], np.cumsum(n)])
        return out + np.diff(total[np.searchsorted(starts, offsets)])


def _count(tokenizer: str, frequent, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(tokenizer, frequent.value)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                part = column.slice(a, b - a)
                n = lookup.counts(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pc.binary_length(part).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return run


def token_counts(docs: DataFrame, spark: SparkSession, tokenizer: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    As the tokenizers library counts whole texts without added special tokens;
    a null text counts as empty.  Other columns are ignored, repeated rows each get
    a row, an empty table gives none.
    """
    frequent = spark.sparkContext.broadcast(frequent_units(docs, tokenizer))  # 12 bytes x FREQUENT_UNITS at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(tokenizer, frequent, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

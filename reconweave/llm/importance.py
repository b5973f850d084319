"""Importance resampling towards a target distribution, over word tries.

The features of a text are its runs of one and two words, hashed by CRC-32 into
buckets.  A task keeps a trie of the words of the stretch of texts in its hands:
below the root a node for each word, below that a node for each word that follows
it.  A node holds how often its path occurs and the CRC state of the path's bytes,
which a child continues, so a feature is hashed once for all its occurrences.
Tasks send bucket totals only.  To score, a trie gets the gain of its bucket at
each node, and every text is walked along its paths.

The draw is by Gumbel noise from a hash of the id, and ranks come from a histogram
of scores, which are whole numbers of a bounded range: no task sorts all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch
from reconweave.llm.words import buffers, counts_in, slices, span_hashes, spans, texts

#: Bytes that part words, once A-Z are lower-cased.
_BREAKS = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BREAKS[_a : _b + 1] = True
#: Bytes of text that share a trie; words up to SHORT bytes are hashed together.
STRETCH, SHORT = 2_000_000, 48
#: Scores that share a block of the histogram.
BLOCK = 1024


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[n][k][b]: what byte k, of value b, of a CRC becomes when n more bytes follow."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _CRC[out[n] & np.uint32(255)]
    return out


_SHIFT = _shift_tables()


@dataclass
class Trie:
    """Words (nodes of level one), pairs (nodes of level two), and every token's path."""

    words: int
    word_count: np.ndarray
    word_state: np.ndarray
    pair_count: np.ndarray
    pair_state: np.ndarray
    node: np.ndarray  # the word's node at each token
    pair: np.ndarray  # the pair's node at each token that another of its text follows
    at: np.ndarray  # n + 1 offsets of the texts in the tokens
    leads: np.ndarray  # the tokens that another of their text follows


def grow(column: pa.StringArray) -> Trie:
    """The trie of the texts, with counts, CRC states and paths."""
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets, _BREAKS)
    at = counts_in(offsets, starts)
    _, first, node, count = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    size = ends[first] - starts[first]
    lower = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    state = np.full(len(first), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    longest = int(min(SHORT, size.max(initial=0)))
    for k in range(longest):
        on = order[: np.searchsorted(-size[order], -k, "left")]  # words of more than k bytes
        state[on] = _CRC[(state[on] ^ lower[starts[first[on]] + k]) & np.uint32(255)] ^ (state[on] >> np.uint32(8))
    word_state = state ^ np.uint32(0xFFFFFFFF)
    long = {int(i): lower[starts[first[i]] : ends[first[i]]].tobytes() for i in np.flatnonzero(size > SHORT)}
    for i, word in long.items():
        word_state[i] = zlib.crc32(word)
    spaced = ~(_CRC[(~word_state ^ np.uint32(0x20)) & np.uint32(255)] ^ (~word_state >> np.uint32(8)))  # the word and a space

    text = np.repeat(np.arange(len(column)), np.diff(at))
    leads = np.flatnonzero(text[:-1] == text[1:]) if len(text) > 1 else np.zeros(0, np.int64)
    n = len(first)
    key, pair, pair_count = np.unique(node[leads] * n + node[leads + 1], return_inverse=True, return_counts=True)
    parent, child = key // max(n, 1), key % max(n, 1)
    crc = spaced[parent]
    pair_state = _moved(size[child], crc)
    pair_state ^= word_state[child]
    for j in np.flatnonzero(np.isin(child, list(long))) if long else ():
        pair_state[j] = zlib.crc32(long[int(child[j])], int(crc[j]))
    return Trie(n, count, word_state, pair_count, pair_state, node, pair, at, leads)


def _moved(size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC states after `size` more zero bytes, of which SHORT at most count."""
    n = np.minimum(size, SHORT)
    out = _SHIFT[n, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _totals(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column, STRETCH):
                trie = grow(column.slice(a, b - a))
                np.add.at(total, trie.word_state % buckets, trie.word_count)
                np.add.at(total, trie.pair_state % buckets, trie.pair_count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; `buckets` rows at most come to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(_totals(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to every count."""
    n, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * all_source / ((float(source[k]) + 1) * all_target))) for k in range(n)], np.int64)


def _weigh(gain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gain.value
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column, STRETCH):
                trie = grow(column.slice(a, b - a))
                words = np.diff(trie.at)
                total = np.zeros(len(trie.node) + 1, np.int64)
                step = g[trie.word_state % len(g)][trie.node]
                step[trie.leads] += g[trie.pair_state % len(g)][trie.pair]
                np.cumsum(step, out=total[1:])
                n = words + np.maximum(words - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words), pa.array(n), pa.array(np.diff(total[trie.at]) // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"]
                )

    return run


def resample(docs: DataFrame, target: DataFrame, spark: SparkSession, *, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text).

    target: rows with a text.  weight is the floored mean gain of the text's
    features; score adds noise that the id alone decides; rank numbers the
    floor(percent * N / 100) rows drawn of the N with least_words words, null for
    the others.  Null and empty texts have no features and weight 0.  A row without
    an id has no score, is not among the N and is not drawn.  Rows that repeat an id
    are drawn one by one, as their weights and lengths order them.  Empty tables give
    no rows, or gains from the other table alone.  Other columns are ignored.
    """
    scratch = Scratch(spark, "importance")
    gain = spark.sparkContext.broadcast(gains(bucket_totals(docs, buckets), bucket_totals(target, buckets)))  # 8 bytes x buckets
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_weigh(gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False)) & F.col("doc_id").isNotNull()
    scored = scratch.write(scored.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("able", able), "scored")

    heights = scored.filter("able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    blocks = sorted(((r["block"], r["n"]) for r in heights.groupBy("block").agg(F.sum("n").alias("n")).collect()), reverse=True)  # bounded by the range of scores
    most = percent * sum(n for _, n in blocks) // 100
    above, seen = [], 0
    for block, n in blocks:
        if seen >= most:
            break
        above.append((block, seen))
        seen += n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not above:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    least = above[-1][0] * BLOCK
    before = F.create_map(*[F.lit(x) for pair in above for x in pair])
    inner = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = heights.filter(F.col("score") >= least).select("score", (before[F.col("block")] + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before"))
    ties = Window.partitionBy("score").orderBy("doc_id", F.desc("weight"), "n_features")
    top = F.col("able") & (F.col("score") >= least)
    drawn = scored.filter(top).join(places, "score").withColumn("rank", F.col("before") + F.row_number().over(ties))
    drawn = drawn.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).cast("long").alias("rank"))
    rest = scored.filter(~F.coalesce(top, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)

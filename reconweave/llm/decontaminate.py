"""Benchmark passages in documents: SimHash windows, Hamming index, exact check.

An item's fingerprint is the SimHash (BITS bits) of its five-word shingles, each
weighted by how often the item has it times how few items do.  For every item length
a window of as many words slides over each document; sums over windows come from
prefix sums.  Windows without any shingle of the benchmark have similarity zero with
all items and are passed over.  The other windows' fingerprints are looked up among
the items of their length in a multi-index of BLOCKS blocks, each of which also holds
the values within NEAR bits: of up to RADIUS differing bits, at most NEAR fall in some
block, so no fingerprint within RADIUS is missed.  Candidates are verified by the
exact weighted Jaccard similarity of the shingles.  An item of fewer than SHINGLE
words is one shingle of its own length, which is as similar as asked only to itself: all
runs of so many words of a document are looked up among such items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reconweave.llm.words import buffers, counts_in, mix, shingles, slices, span_hashes, spans, texts

SHINGLE, THRESHOLD = 5, 0.8
#: At a weighted similarity of 0.8 fingerprints differ in 19.5 of 128 bits (deviation 4.1): RADIUS finds 99 %.
BITS, RADIUS = 128, 29
BLOCKS, NEAR = 10, 2
assert RADIUS < BLOCKS * (NEAR + 1)
#: Items whose index (about 8 kB each) is broadcast at once; more items take another step over the documents.
ITEMS_A_PASS = 20_000
#: Windows whose bits are held at once.
WINDOWS = 4096
_CUTS = [(int(x[0]), int(x[-1]) + 1) for x in np.array_split(np.arange(BITS), BLOCKS)]
_FLIPS = [np.array([sum(1 << i for i in c) for k in range(NEAR + 1) for c in combinations(range(b - a), k)], np.int64) for a, b in _CUTS]
#: Bytes that part words: white space and ASCII punctuation.
_BREAKS = np.zeros(256, bool)
_BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True


def signs(value: np.ndarray) -> np.ndarray:
    """BITS columns of 1 and -1 for each shingle hash."""
    words = np.stack([value, mix(value ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)
    return np.unpackbits(words.view(np.uint8).reshape(len(value), BITS // 8), axis=1).astype(np.int8) * 2 - 1


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def _blocks(bits: np.ndarray) -> list[np.ndarray]:
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in _CUTS]


def _text_shingles(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts in their words, and of each word the shingle that begins there (0: none)."""
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets, _BREAKS)
    words, at = span_hashes(data, starts, ends), counts_in(offsets, starts)
    _, value = shingles(words, at, SHINGLE)
    n = np.diff(at)
    out = np.zeros(len(words), np.uint64)
    k = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))  # shingles of each text
    out[np.repeat(at[:-1], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] = value
    return at, out


@dataclass
class Items:
    ids: list[int]
    lengths: np.ndarray  # distinct, in words
    bags: list[dict[int, int]]  # shingle hash -> weight
    keys: np.ndarray  # sorted shingle hashes
    weights: np.ndarray  # of one occurrence of each
    rare: int  # of a shingle that no item has
    prints: np.ndarray
    index: list[tuple[np.ndarray, np.ndarray]]  # of each block: length and value, items
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length below SHINGLE: sorted hashes of whole items, items

    def weigh(self, value: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        return np.where(self.keys[at] == value, self.weights[at], self.rare)


def prepare(rows: list[tuple[int, str | None]], frequency: tuple[np.ndarray, np.ndarray, int] | None = None) -> Items:
    """The index of some items; frequency: shingle_counts() of all items, and how many they are."""
    at, value = _text_shingles(texts(pa.array([x[1] for x in rows], pa.string())))
    keep = np.flatnonzero(value)
    owner = np.searchsorted(at, keep, "right") - 1
    keys, n, total = frequency or (*shingle_counts(rows), len(rows))
    weights = np.rint(16 * (1 + np.log(max(total, 1) / np.maximum(n, 1)))).astype(np.int32)
    items = Items([x[0] for x in rows], np.unique(np.diff(at)[np.diff(at) > 0]), [{} for _ in rows], keys, weights, int(np.rint(16 * (1 + np.log(max(total, 1))))), np.zeros((0, 2), np.uint64), [], _short_items(rows))
    if not len(keep):
        return items
    own = items.weigh(value[keep])
    for i, x, w in zip(owner.tolist(), value[keep].tolist(), own.tolist(), strict=True):
        items.bags[i][x] = items.bags[i].get(x, 0) + w
    total_bits = np.zeros((len(rows), BITS), np.int32)
    np.add.at(total_bits, owner, signs(value[keep]) * own[:, None])
    bits = total_bits > 0
    items.prints = _packed(bits)
    some = np.flatnonzero(np.diff(at))
    length = np.searchsorted(items.lengths, np.diff(at)[some]) << 13
    for values, flips in zip(_blocks(bits[some]), _FLIPS, strict=True):
        key = (length[:, None] | (values[:, None] ^ flips)).ravel().astype(np.int32)
        order = np.argsort(key, kind="stable")
        items.index.append((key[order], np.repeat(some, len(flips))[order].astype(np.int32)))
    return items


def _short_items(rows: list[tuple[int, str | None]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    column = texts(pa.array([x[1] for x in rows], pa.string()))
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets, _BREAKS)
    words, at = span_hashes(data, starts, ends), counts_in(offsets, starts)
    out = {}
    for n in range(1, SHINGLE):
        own = np.flatnonzero(np.diff(at) == n)
        if len(own):
            item, value = shingles(words, at, n)
            one = np.isin(item, own)
            order = np.argsort(value[one], kind="stable")
            out[n] = (value[one][order], item[one][order])
    return out


def short_hits(items: Items, column: pa.StringArray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, words) of each run of words that is a whole item of fewer than SHINGLE words."""
    if not items.short:
        return
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets, _BREAKS)
    words, at = span_hashes(data, starts, ends), counts_in(offsets, starts)
    for n, (keys, which) in items.short.items():
        some = np.flatnonzero(np.diff(at) >= n)
        if not len(some):
            continue
        doc, value = shingles(words, at, n)
        long = np.isin(doc, some)
        doc, value = doc[long], value[long]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
        for k in np.flatnonzero(high > low).tolist():
            for e in range(low[k], high[k]):
                yield int(doc[k]), int(which[e]), int(place[k]), n


def shingle_counts(rows: list[tuple[int, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of the items, and in how many items each is."""
    at, value = _text_shingles(texts(pa.array([x[1] for x in rows], pa.string())))
    keep = np.flatnonzero(value)
    owner = np.searchsorted(at, keep, "right") - 1
    pairs = np.unique(np.stack([owner, value[keep].view(np.int64)], axis=1), axis=0)
    return np.unique(pairs[:, 1].view(np.uint64), return_counts=True) if len(pairs) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard: common weight to weight of either."""
    common = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def windows(items: Items, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, shingles and length number of each window with a shingle of the benchmark.

    A text of fewer words than a length is one window of it.
    """
    none = np.zeros(0, np.int64)
    if not len(value) or not len(items.keys):
        return none, none, none
    place = np.minimum(np.searchsorted(items.keys, value), len(items.keys) - 1)
    hit = (items.keys[place] == value) & (value != 0)
    if not hit.any():
        return none, none, none
    hits = np.concatenate([[0], np.cumsum(hit)])
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(value))  # words to the end of the text
    touched = np.flatnonzero(hits[at[1:]] > hits[at[:-1]])
    n, out = np.diff(at)[touched], []
    for k, length in enumerate(items.lengths.tolist()):
        m = max(1, length - SHINGLE + 1)
        if length >= SHINGLE and m <= len(value):
            first = np.flatnonzero((hits[m:] > hits[:-m]) & (left[: len(value) - m + 1] >= length))
            out.append((first, np.full(len(first), m), np.full(len(first), k)))
        whole = touched[(n < length) & (n >= SHINGLE)] if length >= SHINGLE else touched[n == length]
        out.append((at[whole], np.maximum(1, np.diff(at)[whole] - SHINGLE + 1), np.full(len(whole), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near(items: Items, bits: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of all pairs of one length number within RADIUS differing bits, and these."""
    found = []
    for values, (keys, which) in zip(_blocks(bits), items.index, strict=True):
        key = ((length << 13) | values).astype(np.int32)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        n = high - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.stack([np.repeat(np.arange(len(key)), n), which[entry]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    differ = np.bitwise_count(_packed(bits)[pairs[:, 0]] ^ items.prints[pairs[:, 1]]).sum(axis=1)
    return pairs[differ <= RADIUS], differ[differ <= RADIUS]


def candidates(items: Items, value: np.ndarray, first: np.ndarray, size: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, item, differing bits) of all pairs of one length within RADIUS."""
    needed = np.zeros(len(value) + 1, np.int32)
    np.add.at(needed, first, 1)
    np.add.at(needed, first + size, -1)
    rows = np.flatnonzero(np.cumsum(needed[:-1]) > 0)
    place = np.zeros(len(value), np.int64)
    place[rows] = np.arange(len(rows))
    total = np.zeros((len(rows) + 1, BITS), np.int32)
    np.cumsum(signs(value[rows]) * items.weigh(value[rows])[:, None], axis=0, out=total[1:], dtype=np.int32)
    for a in range(0, len(first), WINDOWS):
        own = slice(a, a + WINDOWS)
        begin = place[first[own]]
        pairs, differ = near(items, total[begin + size[own]] - total[begin] > 0, length[own])
        for (w, i), d in zip(pairs.tolist(), differ.tolist(), strict=True):
            yield a + w, i, d


def hits(items: Items, column: pa.StringArray) -> dict[tuple[int, int], tuple]:
    """(text, item) -> similarity, less the first word, words and differing bits of its best window."""
    at, value = _text_shingles(column)
    first, size, length = windows(items, at, value)
    best: dict[tuple[int, int], tuple] = {}
    if len(first):
        for w, i, differ in candidates(items, value, first, size, length):
            a, m = int(first[w]), int(size[w])
            bag: dict[int, int] = {}
            own = value[a : a + m]
            for x, y in zip(own.tolist(), items.weigh(own).tolist(), strict=True):
                bag[x] = bag.get(x, 0) + y
            like = similarity(bag, items.bags[i])
            if like >= THRESHOLD:
                doc = int(np.searchsorted(at, a, "right")) - 1
                words = min(m + SHINGLE - 1, int(at[doc + 1]) - a)
                row = (like, -(a - int(at[doc])), words, differ)
                best[doc, i] = max(best.get((doc, i), row), row)
    for doc, i, place, n in short_hits(items, column):
        row = (1.0, -place, n, 0)
        best[doc, i] = max(best.get((doc, i), row), row)
    return best


def _search(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            column, ids = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(column):
                best = hits(items, column.slice(a, b - a))
                if best:
                    rows = [(ids[a + d], items.ids[i], -r[1], r[2], r[3], r[0]) for (d, i), r in sorted(best.items())]
                    kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

    return run


def _without(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keep = texts(batch.column("text")), np.ones(batch.num_rows, bool)
            for a, b in slices(column):
                for doc, _ in hits(shared.value, column.slice(a, b - a)):
                    keep[a + doc] = False
            yield batch.filter(pa.array(keep))

    return run


def _indexes(benchmark: DataFrame, spark: SparkSession) -> list:
    """Broadcast indexes of ITEMS_A_PASS items each; weights are of the whole benchmark."""
    rows = [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").toLocalIterator()]
    frequency = (*shingle_counts(rows), len(rows))
    return [spark.sparkContext.broadcast(prepare(rows[a : a + ITEMS_A_PASS], frequency)) for a in range(0, max(len(rows), 1), ITEMS_A_PASS)]


def contaminated(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, item_id and the best window (start_word, n_words, hamming, similarity) of each hit.

    docs: doc_id, text; benchmark: item_id, text, a query set that the driver can hold.
    Words are lower-cased runs between white space and ASCII punctuation.  Null and
    wordless texts and items hit nothing.  An item of fewer than five words hits
    wherever its words stand in a row.  Repeated rows each give their hits;
    equal items are all named; of equally good windows the first counts.  Other columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start_word long, n_words long, hamming int, similarity double"
    parts = [docs.select("doc_id", "text").mapInArrow(_search(x), schema) for x in _indexes(benchmark, spark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of docs whose own text has no benchmark passage; one step over docs, columns as they are."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for index in _indexes(benchmark, spark):
        docs = docs.mapInArrow(_without(index), kinds)
    return docs

"""Columnar text primitives shared by the corpus operators.

Everything works on the byte buffer of an Arrow string column: words are byte
spans, word hashes are 64-bit and come from prefix sums, so no Python string is
made per word.  A "word" is a run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SHINGLE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at once, and so the length of the tables of powers.
CHUNK = 1 << 16
_FOLDED = _BYTE[_LOWER]


def _powers_of(base: np.uint64) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers_of(_BASE), _powers_of(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """The column as one plain string array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them."""
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.StringArray, most_bytes: int = 512_000, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded bytes; a longer text is a range of its own."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, len(column))
        yield at, to
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word.  breaks: a table of bytes that part words."""
    word = ~(_SPACE if breaks is None else breaks)[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(word))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _long_hash(data: np.ndarray, table: np.ndarray) -> np.uint64:
    """The sum of one span of more than CHUNK bytes, piece by piece."""
    total = 0
    for a in range(0, len(data), CHUNK):
        piece = data[a : a + CHUNK]
        total += int(np.sum(table[piece] * _UP[: len(piece)], dtype=np.uint64)) * pow(int(_BASE), a, 2**64)
    return np.uint64(total % 2**64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; lower: A-Z count as a-z.

    The spans ascend and do not overlap.  Sums run over CHUNK bytes at a time, so
    the work arrays stay small however long the buffer is.
    """
    out, table, i = np.empty(len(starts), np.uint64), _FOLDED if lower else _BYTE, 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + CHUNK, "right"))
        if j <= i:
            out[i] = _long_hash(data[base : ends[i]], table)
            i += 1
            continue
        n = int(ends[j - 1]) - base
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[base : base + n]] * _UP[:n], out=total[1:])
        first = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[first]) * _DOWN[first]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def counts_in(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """n + 1 offsets of the texts in the list of word starts."""
    return np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of `size` words; a shorter text is one shingle.

    hashes: of words; at: n + 1 offsets of the texts in them.
    """
    n = np.diff(at)
    total = np.zeros(max(0, len(hashes)), np.uint64)
    for k in range(min(size, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * _SHINGLE[k]
    text = np.repeat(np.arange(len(n)), n)
    left = at[1:][text] - np.arange(len(hashes)) if len(hashes) else np.zeros(0, np.int64)
    full = left >= size
    doc, value = text[full], mix(total[full])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([np.sum(hashes[at[i] : at[i + 1]] * _SHINGLE[: n[i]]) for i in short], np.uint64)
        value = np.concatenate([value, mix(whole ^ (n[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def distinct_sets(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit values of each of up to 4096 texts, and n + 1 offsets."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (value >> np.uint64(12)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(52)) if n < 4096 else np.concatenate([np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(52)), [len(key)]])
    return key & np.uint64(2**52 - 1), at


def word_sets(column: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle sets of at most 4096 lower-cased texts: values, offsets."""
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets)
    doc, value = shingles(span_hashes(data, starts, ends), counts_in(offsets, starts), size)
    return distinct_sets(doc, value, len(column))

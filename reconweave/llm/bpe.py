"""Exact BPE ids of whole texts with the tokenizers library and worker caches.

A text is cut into units where the tokenizer's own pre-tokenizer always cuts:
around runs of white space, and between an ASCII letter or digit and ASCII
punctuation (never after an apostrophe, whose contractions join letters).  The
ids of a text are the ids of its units in turn, so the library encodes each
distinct unit once while a worker keeps it, and the rest is array arithmetic.  Texts with a
special string, or with white space outside ASCII, go to the library whole.
Units are known by 64-bit hashes.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reconweave.llm.words import _SPACE, buffers, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept by a worker, about 40 bytes each; beyond, the half met in most batches stays.
CACHE_UNITS = 1_000_000
#: New units that go to the library as one text, parted by a special string.
JOINED = 256
_WHOLE = "[\\x{0}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not _ALNUM[b]]] = True
_PUNCT_AHEAD = _PUNCT.copy()
_PUNCT_AHEAD[ord("'")] = False


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of the texts in one buffer."""
    n = len(data)
    space, alnum = _SPACE[data], _ALNUM[data]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (space[1:] & ~space[:-1]) | (alnum[:-1] & _PUNCT[data[1:]]) | (_PUNCT_AHEAD[data[:-1]] & alnum[1:])
    last = np.zeros(n, bool)  # the last white space before a word of the same text
    last[:-1] = space[:-1] & ~space[1:]
    inner = offsets[1:-1]
    last[inner[inner > 0] - 1] = False
    cut[:n] |= last
    cut[1:] |= last & (data != 0x20)
    cut[offsets] = True
    cut[n] = False
    at = np.flatnonzero(cut)
    return at, np.append(at[1:], n)


def whole_texts(column: pa.StringArray, specials: list[str]) -> np.ndarray:
    """Which texts hold a special string or white space outside ASCII."""
    odd = pc.match_substring_regex(column, _WHOLE)
    for s in specials:
        odd = pc.or_(odd, pc.match_substring(column, s))
    return odd.to_numpy(zero_copy_only=False).astype(bool)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as Python strings."""
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Ids of batches of texts; one per Python worker and tokenizer file.

    fold: the tokenizer drops white space and the case of A-Z, so units that
    differ in those alone share their ids.
    """

    _kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fold = all(self._ids(a) == self._ids(b) for a, b in ((" Az", "az"), ("\nQ", "q"), ("A", "a")))
        self.part, self.part_id = self._parting()
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.met, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parting(self) -> tuple[str | None, int]:
        """A special string that always cuts and takes nothing of its neighbours, and its id."""
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            s = t.content
            plain = t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized)
            if plain and not any(s.startswith(s[k:]) for k in range(1, len(s))):
                return s, i
        return None, -1

    def _thin(self, n: int) -> None:
        """Keeps the n units met in most batches; what was met long ago counts for less."""
        keep = np.sort(np.argpartition(-self.met, n)[:n]) if n < len(self.keys) else np.arange(len(self.keys))
        self.ids, first = self._runs(keep), np.cumsum(self.size[keep], dtype=np.int64) - self.size[keep]
        self.keys, self.first, self.size, self.met = self.keys[keep], first, self.size[keep], self.met[keep] // 2

    def _runs(self, place: np.ndarray) -> np.ndarray:
        """The ids of the units at these places, in turn."""
        n = self.size[place]
        end = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(self.first[place] - end + n, n) + np.arange(n.sum())]

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def fresh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the library, in turn, and the number for each text."""
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As fresh, for texts without a special string: many of them in one call."""
        if self.part is None:
            return self.fresh(units)
        runs, sizes = [], []
        for a in range(0, len(units), JOINED):
            some = units[a : a + JOINED]
            flat = self.fresh([self.part.join([*some, ""])])[0]
            at = np.flatnonzero(flat == self.part_id)
            if len(at) != len(some):
                flat, size = self.fresh(some)
            else:
                flat, size = np.delete(flat, at), np.diff(at, prepend=-1) - 1
            runs.append(flat)
            sizes.append(size)
        return np.concatenate(runs), np.concatenate(sizes)

    def known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each unit in the cache, after what it lacks is encoded; good until the next call."""
        if self.fold:
            starts = starts + _SPACE[data[starts]]
        keys, one, back = np.unique(span_hashes(data, starts, ends, lower=self.fold), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_UNITS:
            self._thin(max(0, min(CACHE_UNITS // 2, CACHE_UNITS - len(keys))))
        at = np.searchsorted(self.keys, keys)
        lack = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        lack[inside] = self.keys[at[inside]] != keys[inside]
        if lack.any():
            ids, size = self._units(strings(data, starts[one[lack]], ends[one[lack]]))
            new = at[lack] + np.arange(len(size))
            old = np.ones(len(self.keys) + len(size), bool)
            old[new] = False
            for name, more in (("keys", keys[lack]), ("first", len(self.ids) + np.cumsum(size) - size), ("size", size), ("met", 0)):
                kept = getattr(self, name)
                both = np.empty(len(old), kept.dtype)
                both[old], both[new] = kept, more
                setattr(self, name, both)
            self.ids = np.concatenate([self.ids, ids])
            at = at + np.cumsum(lack) - lack
        self.met[at] += 1
        return at[back]

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, in turn, and n + 1 offsets."""
        odd = whole_texts(column, self.specials)
        data, offsets = buffers(pc.if_else(pa.array(odd), "", column) if odd.any() else column)
        if len(data):
            starts, ends = unit_spans(data, offsets)
            place = self.known(data, starts, ends)
            ids, total = self._runs(place), np.concatenate([[0], np.cumsum(self.size[place], dtype=np.int64)])
            offsets = total[np.searchsorted(starts, offsets)]
        else:
            ids, offsets = np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        if odd.any():
            flat, size = self.fresh(column.filter(pa.array(odd)).to_pylist())
            whole = dict(zip(np.flatnonzero(odd).tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True))
            runs = [whole[i] if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(column))]
            ids, offsets = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
        return ids, offsets

    def lengths(self, column: pa.StringArray) -> np.ndarray:
        return np.diff(self.encode(column)[1])

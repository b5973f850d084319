"""Language identification of whole, possibly mixed texts.

Training (Spark): counts of hashed character n-grams of words for each language,
over at most ROWS_PER_LANGUAGE labelled rows of a language.  Prediction (Arrow
batches): the script of a word narrows its candidate languages, a naive Bayes
score of its n-grams ranks them, and Viterbi with a switching penalty labels the
words of the text.  Runs of equal labels are the language spans.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconweave.llm.words import _SPACE, mix, slices, texts

#: The bounded sample to learn from: the rows of a language with the least hashes.
ROWS_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Bytes of text that are read at once, and scores (words x languages) that a worker keeps.
SLICE_BYTES, KEPT_SCORES = 256_000, 1_000_000
#: Nats that a change of language costs, and the most that one word can say.
SWITCH, WORD_CAP = 8.0, 12.0
#: A language writes a script if so large a part of its letters is in it.
SCRIPT_SHARE = 0.02

#: First code points of Unicode block ranges and the script of each.
SCRIPT_STARTS = [0x00, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xBA, 0xBB, 0xC0, 0x2C2, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE00, 0xFF21, 0xFF5B, 0x20000, 0x30000]
SCRIPT_OF = ["", "Latin", "", "Latin", "", "Latin", "", "Latin", "", "Latin", "", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Other", "Devanagari", "Other", "Thai", "Other", "Georgian", "Hangul", "Other", "Latin", "Greek", "", "Latin", "Other", "Kana", "Kana", "Other", "Han", "Other", "Hangul", "", "Han", "Latin", "Arabic", "", "Latin", "", "Han", ""]
SCRIPTS = sorted({x for x in SCRIPT_OF if x})
_STARTS = np.array(SCRIPT_STARTS, np.uint32)
_SCRIPT = np.array([SCRIPTS.index(x) if x else -1 for x in SCRIPT_OF])
_OTHER = SCRIPTS.index("Other")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter by its Unicode category."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@dataclass
class Words:
    """The words of some texts as lower-cased code points, each between two blanks."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray  # n + 1 offsets of the texts in the words
    letters: np.ndarray  # in each word
    script: np.ndarray  # of each word: that of its first letter, or -1 if it has none
    span: tuple[np.ndarray, np.ndarray]  # code points of each word in its text


def read_words(column: pa.StringArray) -> Words:
    joined = "\n".join(column.to_pylist()) + "\n"
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) != len(joined):  # a few capitals become two code points
        points = np.frombuffer("".join(c.lower() if len(c.lower()) == 1 else c for c in joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 255).astype(np.uint8)
    blank = _SPACE[small] & (points < 256)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, column.to_pylist()), np.int64, len(column)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.searchsorted(first, begin)
    letter = _letters()[points]
    total = np.concatenate([[0], np.cumsum(letter)])
    place = np.flatnonzero(letter)
    n = total[last] - total[first]
    script = np.full(len(first), -1)
    has = n > 0
    own = _SCRIPT[np.searchsorted(_STARTS, points[place[total[first[has]]]], "right") - 1]
    script[has] = np.where(own < 0, _OTHER, own)
    base = np.repeat(begin[:-1], np.diff(at))
    return Words(points, first, last, at, n, script, (first - base, last - base))


def grams(words: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index in which, bucket) of the n-grams of 1, 2, 3 and 4 code points of the chosen words, blanks at their ends included."""
    first, size = words.first[which], (words.last - words.first)[which] + 2
    total = np.cumsum(size)
    flat = np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0) - 1
    left = (np.repeat(total, size) - np.arange(len(flat))).astype(np.int32)  # code points to the end of the word
    word = np.repeat(np.arange(len(which), dtype=np.int32), size)
    value = np.zeros(len(flat), np.uint64)
    for n in range(4):
        held = left > n
        flat, left, word = flat[held], left[held], word[held]
        value = (value[held] + np.where(flat + n < 0, 10, words.points[flat + n]).astype(np.uint64)) * _MULT[n]
        value ^= value >> np.uint64(29)
        yield word, ((value * _MULT[0]) >> np.uint64(48)).astype(np.int32)


def word_keys(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    size = words.last - words.first
    if not len(size):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    flat = np.repeat(words.first, size) + place
    return np.add.reduceat(mix(words.points[flat] * _MULT[1] + place.astype(np.uint64) * _MULT[2]), begin)


def _count(languages: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(languages), BUCKETS), np.int64)
        script = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in batches:
            column = texts(batch.column("text"))
            code = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in slices(column, SLICE_BYTES):
                words = read_words(column.slice(a, b - a))
                lang = np.repeat(code[a:b], np.diff(words.at))
                for k in np.unique(code[a:b]).tolist():
                    for _, bucket in grams(words, np.flatnonzero((words.letters > 0) & (lang == k))):
                        count[k] += np.bincount(bucket, minlength=BUCKETS)
                has = words.script >= 0
                np.add.at(script, (lang[has], words.script[has]), words.letters[has])
        for table, kind in ((count, 0), (script, 1)):
            lang, place = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang), kind)), pa.array(lang), pa.array(place), pa.array(table[lang, place])], names=["kind", "lang", "place", "n"])

    return run


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x BUCKETS
    writes: np.ndarray  # scripts x languages


def train(labelled: DataFrame) -> Model:
    """A model of rows (doc_id, text, lang); rows without text or lang say nothing."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((len(SCRIPTS), 0), bool))
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(span, ROWS_PER_LANGUAGE * span // sizes[k]))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(span)) < share[F.col("lang")])
    counted = sample.mapInArrow(_count(languages), "kind long, lang long, place long, n long").groupBy("kind", "lang", "place").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # languages x (BUCKETS + scripts) rows at most
    count, script = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for table, kind in ((count, 0), (script, 1)):
        part = got[got.kind == kind]
        table[part.place.to_numpy(), part.lang.to_numpy()] = part.n.to_numpy()
    logs = np.log(count + SMOOTHING) - np.log(count.sum(axis=0) + SMOOTHING * BUCKETS)
    writes = script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)
    return Model(languages, np.ascontiguousarray((logs - logs.mean(axis=1, keepdims=True)).T, np.float32), writes & (script > 0))


class Scorer:
    """Scores of words by language; a worker keeps those of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys, self.kept = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)), np.float32)

    def fresh(self, words: Words, which: np.ndarray) -> np.ndarray:
        """How much better each language is than the best for the words; -WORD_CAP at worst."""
        total = np.zeros((len(which), len(self.model.languages)), np.float32)
        for word, bucket in grams(words, which):
            for k, logs in enumerate(self.model.logs):
                total[:, k] += np.bincount(word, logs[bucket], len(which))
        allowed = self.model.writes[words.script[which]]
        allowed[~allowed.any(axis=1)] = True
        total -= np.where(allowed, total, -np.inf).max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(total, -WORD_CAP), np.float32(-2 * WORD_CAP))

    def scores(self, words: Words) -> np.ndarray:
        """words x languages; 0 for a word without letters."""
        out = np.zeros((len(words.first), len(self.model.languages)), np.float32)
        has = np.flatnonzero(words.letters > 0)
        if not len(has) or not self.model.languages:
            return out
        keys, one, back = np.unique(word_keys(words)[has], return_index=True, return_inverse=True)
        if (len(self.keys) + len(keys)) * out.shape[1] > KEPT_SCORES:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        lack = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        lack[inside] = self.keys[at[inside]] != keys[inside]
        if lack.any():
            self.kept = np.insert(self.kept, at[lack], self.fresh(words, has[one[lack]]), axis=0)
            self.keys = np.insert(self.keys, at[lack], keys[lack])
            at = np.searchsorted(self.keys, keys)
        out[has] = self.kept[at][back]
        return out


def _highest(gain: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the largest sum of gain over a run of its text's words that ends with it."""
    after = np.cumsum(gain)
    apart = (after.max() - after.min() + np.abs(gain).max() + 1.0) * doc  # so that no run begins in another text
    return after - np.minimum.accumulate(after - gain - apart) - apart


def loose(scores: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language of the best total, and the words that the best labelling may give another one.

    A stretch of other labels costs a change at least, and gains at most the sum, over
    its words, of the best other score less this language's.  A word in no run whose
    sum reaches the cost has its text's language for certain.
    """
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=np.float64)])
    one = (total[at[1:]] - total[at[:-1]]).argmax(axis=1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = scores[np.arange(len(scores)), one[doc]].astype(np.float64)
    others = scores.copy()
    others[np.arange(len(scores)), one[doc]] = -np.inf
    gain = others.max(axis=1) - own
    ends = _highest(gain, doc)
    begins = _highest(gain[::-1], doc[-1] - doc[::-1])[::-1]
    return one, ends + begins - gain > SWITCH - 1e-3


def viterbi(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The best label of each word, when a change of label within a text costs SWITCH."""
    if not scores.size or scores.shape[1] == 1:
        return np.zeros(len(scores), np.int16)
    one, free = loose(scores, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = one[doc].astype(np.int16)
    if free.any():
        new, last = free.copy(), free.copy()
        new[1:] &= ~free[:-1] | (doc[1:] != doc[:-1])
        last[:-1] &= ~free[1:] | (doc[1:] != doc[:-1])
        first, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        before = first > at[:-1][doc[first]]  # words of the text's language stand there
        after = end < at[1:][doc[first]]
        out[free] = _steps(scores[free], np.concatenate([[0], np.cumsum(end - first)]), one[doc[first]], before, after)
    return out


def _steps(scores: np.ndarray, at: np.ndarray, one: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Viterbi of all stretches at once, word by word, longest first.

    before, after: a word with label `one` stands at that side of the stretch.
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, size, one = at[:-1][order], n[order], one[order]
    width = scores.shape[1]
    back = np.zeros(scores.shape, np.int16)
    other = np.arange(width) != one[:, None]
    state = np.where(other & before[order][:, None], np.float32(-SWITCH), np.float32(0))
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for t, m in enumerate(live.tolist()):
        now, row = state[:m], begin[:m] + t
        if t:
            top = now.argmax(axis=1)
            best = now[np.arange(m), top] - SWITCH
            stay = now >= best[:, None]
            back[row] = np.where(stay, np.arange(width), top[:, None])
            now = np.where(stay, now, best[:, None])
        now = now + scores[row]
        state[:m] = now - now.max(axis=1, keepdims=True)
    out = np.zeros(len(scores), np.int16)
    label = (state - np.where(other & after[order][:, None], SWITCH, 0)).argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        row = begin[:m] + t
        out[row] = label[:m]
        if t:
            label[:m] = back[row, label[:m]]
    return out


def _labelled(column: pa.StringArray, scorer: Scorer) -> tuple:
    """Words, their labels, the text of each, and of each text the best language's number, score and whether it is und."""
    words, n, width = read_words(column), len(column), len(scorer.model.languages)
    label = viterbi(scorer.scores(words), words.at)
    doc = np.repeat(np.arange(n), np.diff(words.at))
    mass = np.bincount(doc * max(width, 1) + label, words.letters, n * max(width, 1)).reshape(n, max(width, 1))
    letters, best = mass.sum(axis=1), mass.argmax(axis=1)
    none = (letters == 0) | (width == 0)
    score = np.where(none, 0.0, mass[np.arange(n), best] / np.maximum(letters, 1))
    return words, label, doc, np.where(none, width, best), score, none


def _predict(model: Model, with_spans: bool) -> Callable:
    names = np.array([*model.languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column, SLICE_BYTES):
                words, label, doc, best, score, none = _labelled(column.slice(a, b - a), scorer)
                out = [batch.column("doc_id").slice(a, b - a), pa.array(names[best]), pa.array(score)]
                if with_spans:
                    out.append(_spans(words, label, doc, names, none))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    return run


def _keep(model: Model, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            column, good = texts(batch.column("text")), np.zeros(batch.num_rows, bool)
            for a, b in slices(column, SLICE_BYTES):
                *_, score, none = _labelled(column.slice(a, b - a), scorer)
                good[a:b] = ~none & (score >= least)
            yield batch.filter(pa.array(good))

    return run


def _spans(words: Words, label: np.ndarray, doc: np.ndarray, names: np.ndarray, none: np.ndarray) -> pa.Array:
    out: list[list[dict]] = [[] for _ in none]
    if len(doc):
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
            if not none[doc[i]]:
                out[doc[i]].append({"from": int(words.span[0][i]), "to": int(words.span[1][j - 1]), "lang": str(names[label[i]])})
    return pa.array(out, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("lang", pa.string())])))


def identify(docs: DataFrame, model: Model, *, with_spans: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, spans (from, to, lang).

    lang_pred: the language of most letters, of equal ones the first by name; und
    where the text is null or has no letter (Unicode category L), or nothing was
    learned.  score: the part of the letters that it has.
    spans: code points of the runs of one language in the text.  Other columns are
    ignored, repeated rows each get a row, an empty table gives none.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    if with_spans:
        schema += ", spans array<struct<from: long, to: long, lang: string>>"
    return docs.select("doc_id", "text").mapInArrow(_predict(model, with_spans), schema)


def with_language(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs whose text has a language of at least so large a part of its letters.

    Each row is judged by its own text; columns and their order stay.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_keep(model, least_score), kinds)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no model learns from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2

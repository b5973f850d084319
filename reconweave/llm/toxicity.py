"""Toxicity of noisy text: restore by Viterbi over character lattices, then score.

The writer's word has gone through a channel that puts look-alike signs for letters,
repeats letters, and parts letters by spaces or signs.  A lattice holds the words that
may have become what is read; the likeliest path under a character language model and
the channel's costs is the restored text.  Only tokens that the channel can have
touched have more than one path: those with a letter and a look-alike sign, a repeated
letter or an inner sign, and runs of single characters.  Workers keep what they decoded.

The language model counts four characters in a row over all documents.  The classifier
is a lexicon of restored words and word beginnings, each with a lower bound of its log
odds, learned from a bounded sample of labelled rows from which near copies are taken
out.  A word's evidence is its strongest entry; a logistic curve over the strongest
word of a text and the sum of the next ones gives the score.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.scratch import Scratch
from reconweave.llm.words import buffers, counts_in, mix, shingles, slices, span_hashes, spans, texts

#: Labelled rows of each label, at most, that the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: Entries looked at, least documents for one, standard errors taken off its log odds.
ENTRIES, LEAST_DOCS, ERRORS = 1 << 18, 3, 2.5
#: Score from which a text is predicted toxic.
THRESHOLD = 0.7
#: Distinct words of a text, the strongest ones, whose evidence counts.
STRONGEST = 3
#: Costs (negative log likelihoods) of the channel: a look-alike sign, a run of letters, a gap.
SIGN, RUN, GAP = 3.0, 3.0, 1.0
#: Letters that a sign may stand for.
LOOK_ALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
#: Bytes of a word's beginnings that are entries of their own.
BEGINNINGS = (4, 5, 6, 7)
#: Words that a worker remembers.
REMEMBERED = 1 << 19

_CLASSES = 29  # boundary, 26 letters, digit, other letter
_BOUNDARY, _DIGIT, _OTHER = 0, 27, 28
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[128:] = _OTHER
for _k in range(26):
    _CLASS[ord("a") + _k] = _CLASS[ord("A") + _k] = _k + 1
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in LOOK_ALIKE]] = True
_PLAIN = (_CLASS > 0) & (_CLASS != _DIGIT)
_HEAD = (_CLASS == 0) & ~np.isin(np.arange(256), [ord(c) for c in "@$!|+"])  # cut off at a token's ends
_TAIL = _CLASS == 0
_SALT = np.random.default_rng(11).integers(0, 2**63, 16, dtype=np.uint64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CLASSES**4, np.int64)
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            data, offsets = buffers(column.slice(a, b - a))
            c = np.zeros(len(data) + 3 * (b - a + 1), np.int64)  # three boundaries before each text
            c[np.arange(len(data)) + 3 * np.repeat(np.arange(1, b - a + 1), np.diff(offsets))] = _CLASS[data]
            total += np.bincount(((c[:-3] * _CLASSES + c[1:-2]) * _CLASSES + c[2:-1]) * _CLASSES + c[3:], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(class | three before) over all texts; counts of 29**4 grams, at most, come to the driver."""
    got = docs.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(_CLASSES**4)
    n[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    n = n.reshape((_CLASSES,) * 4)
    p = np.full(_CLASSES, 1 / _CLASSES)
    for k in (3, 2, 1, 0):
        own = n.sum(axis=tuple(range(k))) if k else n
        p = (own + 5 * p) / (own.sum(axis=-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def _class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 128 else _OTHER


class Decoder:
    """The likeliest text behind a token."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = array("f", np.ascontiguousarray(log_p, np.float32).tobytes())

    def restore(self, raw: str) -> str:
        """Viterbi over the lattice of a lower-cased token or of single characters with spaces.

        A state is the last three classes; at equal scores the path found first stays,
        which reads signs as they stand.
        """
        log_p, n = self.log_p, len(raw)
        ends = [0] * n  # end of the run of equal characters
        for i in range(n - 1, -1, -1):
            ends[i] = ends[i + 1] if i + 1 < n and raw[i] == raw[i + 1] else i + 1
        best: list[dict[int, tuple]] = [{} for _ in range(n + 1)]
        best[0][0] = (0.0, None)
        for i in range(n):
            c, end = raw[i], ends[i]
            kind = _class(c)
            steps = [(i + 1, (c,), (kind,), 0.0)]
            if end - i > 1 and kind not in (_BOUNDARY, _DIGIT):
                steps.append((end, (c,), (kind,), RUN))
                if end - i > 2:
                    steps.append((end, (c, c), (kind, kind), RUN))
            for letter in LOOK_ALIKE.get(c, ""):
                own = ord(letter) - 96
                steps.append((i + 1, (letter,), (own,), SIGN))
                if end - i > 1:
                    steps.append((end, (letter,), (own,), SIGN + RUN))
            if kind == _BOUNDARY and c not in LOOK_ALIKE and 0 < i < n - 1:
                steps.append((i + 1, (), (), GAP))
            for state, node in best[i].items():
                for to, letters, kinds, cost in steps:
                    score, at = node[0] - cost, state
                    for k in kinds:
                        score += log_p[at * _CLASSES + k]
                        at = at * _CLASSES % _CLASSES**3 + k
                    old = best[to].get(at)
                    if old is None or score > old[0]:
                        best[to][at] = (score, node, letters)
            best[i] = {}
        node = max(best[n].items(), key=lambda x: x[1][0] + log_p[x[0] * _CLASSES])[1]  # a boundary follows
        out = []
        while node[1] is not None:
            out.append("".join(node[2]))
            node = node[1]
        return "".join(reversed(out))


def _entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, hash of the word, hash) of each word and of its beginnings."""
    span, value = [np.arange(len(starts))], [span_hashes(data, starts, ends)]
    for k, size in enumerate(BEGINNINGS):
        on = np.flatnonzero(ends - starts > size)
        span.append(on)
        value.append(mix(span_hashes(data, starts[on], starts[on] + size) ^ _SALT[k]))
    spans_ = np.concatenate(span)
    return spans_, value[0][spans_], np.concatenate(value)


class Reader:
    """Entries of the restored words of texts; keeps what it has decoded."""

    def __init__(self, log_p: np.ndarray):
        self.decoder, self.known = Decoder(log_p), {}

    def _decoded(self, raw: list[bytes], keys: list[int]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {k: self.decoder.restore(r.lower().decode("utf-8", "replace")) for k, r in zip(keys, raw, strict=True) if k not in self.known}
        if fresh:
            parted = pa.array(["".join(c if _class(c) else " " for c in text) for text in fresh.values()])
            data, offsets = buffers(parted)
            starts, ends = spans(data, offsets)
            span, word, value = _entries(data, starts, ends)
            of = (np.searchsorted(offsets, starts, "right") - 1)[span]
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(len(fresh) + 1))
            for key, a, b in zip(fresh, at, at[1:]):
                self.known[key] = np.stack([word[order[a:b]], value[order[a:b]]])

    def entries(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash of the word, hash) of the entries in each text, in no order, repeats included."""
        data, offsets = buffers(column)
        starts, ends = spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        doc = np.searchsorted(offsets, starts, "right") - 1
        head, tail = np.flatnonzero(~_HEAD[data]), np.flatnonzero(~_TAIL[data])
        first = np.append(head, len(data))[np.searchsorted(head, starts)]
        last = np.append(tail, -1)[np.searchsorted(tail, ends) - 1] + 1
        some = first < last
        doc, whole, starts, ends = doc[some], ends[some] - starts[some], first[some], last[some]

        def any_(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[b] > total[a]

        twice = np.zeros(len(data), bool)
        twice[1:] = (data[1:] == data[:-1]) & (data[1:] < 128)
        inner = np.minimum(starts + 1, ends)
        odd = any_(_PLAIN[data], starts, ends) & (any_(~_PLAIN[data], starts, ends) | any_(twice, inner, ends))
        span, word, value = _entries(data, starts[~odd], ends[~odd])
        out = [(doc[~odd][span], word, value)]

        rest = np.flatnonzero(odd)
        lonely = (ends - starts == 1) & (whole == 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], lonely.view(np.int8), [0]])))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            cut = [a, *(np.flatnonzero(doc[a + 1 : b] != doc[a : b - 1]) + a + 1).tolist(), b]
            runs += [(x, y) for x, y in zip(cut, cut[1:]) if y - x >= 3]
        raw = [data[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        raw += [b" ".join(data[starts[a:b]].tobytes()[k : k + 1] for k in range(b - a)) for a, b in runs]
        if raw:
            of = np.concatenate([doc[rest], doc[[a for a, _ in runs]]]).astype(np.int64) if runs else doc[rest]
            joined = pa.array(raw, pa.binary())
            d, o = np.frombuffer(joined.buffers()[2], np.uint8), np.frombuffer(joined.buffers()[1], np.int32, len(raw) + 1).astype(np.int64)
            keys, one, back = np.unique(span_hashes(d, o[:-1], o[1:]), return_index=True, return_inverse=True)
            listed = keys.tolist()
            self._decoded([raw[i] for i in one], listed)
            found = [self.known[k] for k in listed]
            size = np.array([f.shape[1] for f in found])
            place = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate(found, axis=1)
            n = size[back]
            take = np.repeat(place[back], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(of, n), flat[0, take], flat[1, take]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Model:
    """What a scoring task needs: at most 29**4 floats and ENTRIES entries."""

    log_p: np.ndarray
    keys: np.ndarray
    odds: np.ndarray
    curve: tuple[float, float, float]  # bias, and slopes of the strongest word and of the next ones

    def evidence(self, reader: Reader, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of the strongest word of each text, and the sum of the next ones; 0 without any."""
        first, others = np.zeros(len(column)), np.zeros(len(column))
        doc, word, value = reader.entries(column)
        if len(self.keys) and len(value):
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            hit = self.keys[at] == value
            doc, word, odds = doc[hit], word[hit], self.odds[at[hit]]
            order = np.lexsort((-odds, word, doc))
            doc, word, odds = doc[order], word[order], odds[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
            doc, odds = doc[new], odds[new]
            order = np.lexsort((-odds, doc))
            doc, odds = doc[order], odds[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            first[doc[place == 0]] = odds[place == 0]
            next_ = (place > 0) & (place < STRONGEST)
            others = np.bincount(doc[next_], odds[next_], len(column))
        return first, others

    def scores(self, reader: Reader, column: pa.StringArray) -> np.ndarray:
        first, others = self.evidence(reader, column)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * first + self.curve[2] * others, -40, 40)))


def held_out(column: str = "doc_id") -> F.Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            part = column.slice(a, b - a)
            data, offsets = buffers(part)
            starts, ends = spans(data, offsets)
            doc, value = shingles(span_hashes(data, starts, ends), counts_in(offsets, starts), 5)
            out = np.full((4, b - a), 2**64 - 1, np.uint64)
            for k in range(4):
                np.minimum.at(out[k], doc, mix(value ^ _SALT[8 + k]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("toxic", "text")), *(pa.array(x.view(np.int64)) for x in out)], names=["toxic", "text", "m0", "m1", "m2", "m3"])


def _sample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most SAMPLE_ROWS rows of each label without near copies; rows of each label in all.

    Rows are taken by the hash of their text, one of equal texts.  Of rows that share
    the least of their shingles by one of four hashes, one stays.
    """
    one = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.xxhash64("text").alias("h"))
    known = scratch.write(rows.join(one, "doc_id"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    kinds = known.groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    picked = [kinds.filter(F.col("toxic") == y).orderBy("h").limit(SAMPLE_ROWS) for y in (0, 1)]
    picked = scratch.write(picked[0].unionByName(picked[1]), "picked")
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.xxhash64("text") == F.col("h"))  # 2 x SAMPLE_ROWS rows
    found = found.select("toxic", "text").mapInArrow(_minima, "toxic int, text string, m0 long, m1 long, m2 long, m3 long")
    found = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "sample")
    stay = found.drop("text")
    for k in range(4):
        stay = stay.groupBy("toxic", f"m{k}").agg(F.min_by(F.struct(*[c for c in stay.columns if c not in ("toxic", f"m{k}")]), "row").alias("x")).select("toxic", f"m{k}", "x.*")
    return found.select("row", "toxic", "text").join(F.broadcast(stay.select("row")), "row").drop("row"), sizes


def _presence(log_p, only) -> Callable:
    """(entry, toxic, n): in how many texts an entry is; only: sorted hashes to count, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, keep = Reader(log_p.value), only.value if only else None
        for batch in batches:
            column, label = texts(batch.column("text")), batch.column("toxic").to_numpy()
            for a, b in slices(column):
                doc, _, value = reader.entries(column.slice(a, b - a))
                if keep is not None:
                    hit = np.isin(value, keep)
                    doc, value = doc[hit], value[hit]
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                doc, value = doc[new], value[new]
                for y in (0, 1):
                    key, n = np.unique(value[label[a:b][doc] == y], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), y, np.int32)), pa.array(n)], names=["entry", "toxic", "n"])

    return run


def _measured(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = model.value, Reader(model.value.log_p)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                x = [pa.array(np.round(v * 8).astype(np.int64)) for v in m.evidence(reader, column.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), *x], names=["toxic", "first", "others"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes (0 or more) of a logistic curve over the columns of x, by Newton steps with a small ridge."""
    on = list(range(x.shape[1]))
    weight = weight * 1000 / weight.sum()
    while True:
        d = np.column_stack([np.ones(len(x)), x[:, on]])
        c = np.zeros(d.shape[1])

        def loss(c: np.ndarray, d: np.ndarray = d) -> float:
            return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (d @ c))).sum() + 0.005 * (c @ c))

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(d @ c, -40, 40)))
            g = d.T @ (weight * (p - y)) + 0.01 * c
            step = np.linalg.solve((d * (weight * p * (1 - p))[:, None]).T @ d + 0.01 * np.eye(len(c)), g)
            size = 1.0
            while size > 1e-6 and loss(c - size * step) > loss(c):
                size /= 2
            c = c - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        if (c[1:] >= 0).all():
            out = np.zeros(1 + x.shape[1])
            out[[0, *(k + 1 for k in on)]] = c
            return tuple(out.tolist())
        on.pop(int(c[1:].argmin()))


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession) -> Model:
    """The model from all texts (language model) and labelled rows that are not held out.

    labels: doc_id, toxic.  Null labels, labels other than 0 and 1 and ids with both
    teach nothing.  Without rows of both labels every text scores the share of label 1,
    smoothed (a half without any row).
    """
    scratch = Scratch(spark, "toxicity")
    log_p = language_model(docs)
    sent = spark.sparkContext.broadcast(log_p)  # 29**4 floats
    sample, sizes = _sample(docs, labels, scratch)
    sample = scratch.write(sample, "kept")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))
    nothing = Model(log_p, np.zeros(0, np.uint64), np.zeros(0), (prior, 0.0, 0.0))
    if not n0 or not n1:
        return nothing
    schema = "entry long, toxic int, n long"
    many = sample.filter("toxic = 1").mapInArrow(_presence(sent, None), schema).groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    many = many.orderBy(F.desc("n"), "entry").limit(ENTRIES).toPandas()
    keys = many["entry"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, c1 = keys[order], many["n"].to_numpy(np.float64)[order]
    if not len(keys):
        return nothing
    clean = sample.filter("toxic = 0").mapInArrow(_presence(sent, spark.sparkContext.broadcast(keys)), schema).groupBy("entry").agg(F.sum("n").alias("n")).toPandas()  # ENTRIES rows at most
    c0 = np.zeros(len(keys))
    c0[np.searchsorted(keys, clean["entry"].to_numpy(np.int64).view(np.uint64))] = clean["n"].to_numpy(np.float64)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)) - ERRORS * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    model = Model(log_p, keys[odds > 0], odds[odds > 0], (prior, 0.0, 0.0))
    seen = sample.mapInArrow(_measured(spark.sparkContext.broadcast(model)), "toxic int, first long, others long").groupBy("toxic", "first", "others").count().toPandas()  # a row for each pair of eighths
    y = seen["toxic"].to_numpy(np.int64)
    weight = seen["count"].to_numpy(np.float64) * np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    model.curve = fit_curve(seen[["first", "others"]].to_numpy(np.float64) / 8, y, weight)
    return model


def _scores(model, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = model.value, Reader(model.value.log_p)
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                score = m.scores(reader, column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, spark: SparkSession, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text).

    Null and empty texts, and texts without letters, have no evidence and the score of
    that.  Repeated rows each get a row, an empty table gives none, other columns are
    ignored.  Texts are taken whole, however long.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scores(spark.sparkContext.broadcast(model), threshold), f"doc_id {kind}, score double, predicted int")


def _restored(log_p) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(log_p.value)
        for batch in batches:
            out = [None if t is None else " ".join(_restore(decoder, t.split())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return run


def _restore(decoder: Decoder, tokens: list[str]) -> Iterator[str]:
    k = 0
    while k < len(tokens):
        end = k
        while end < len(tokens) and len(tokens[end]) == 1:
            end += 1
        if end - k >= 3:
            yield decoder.restore(" ".join(tokens[k:end]).lower())
            k = end
        else:
            token = tokens[k]
            yield decoder.restore(token.lower()) if any(_class(c) not in (_BOUNDARY, _DIGIT) for c in token) else token
            k += 1


def restore(docs: DataFrame, log_p: np.ndarray, spark: SparkSession) -> DataFrame:
    """doc_id and restored, the lower-cased likeliest text, for each row of docs (doc_id, text); null stays null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_restored(spark.sparkContext.broadcast(log_p)), f"doc_id {kind}, restored string")

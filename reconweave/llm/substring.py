"""Passages that documents share: paragraph MinHash, exact check, components.

Paragraphs run over line ends and are cut where the hash of a word pair is the
least within REACH words on either side, unless the next cut is less than
LEAST_WORDS on.  Such cuts depend on the words around them alone, so a passage has
the same paragraphs wherever it stands, in one line or in many.  Every word is in a
paragraph; a shorter document is one.

1. Equal paragraphs form a class, known by two 64-bit hashes of its lower-cased words.
2. Classes that share one of SINGLE minima over their five-word shingles with another
   go on, with BANDS bands of ROWS minima; both are tuned by bands_for() so that a
   pair at the threshold is met with a chance of RECALL.
3. In a bucket the members meet the least one, and are confirmed by the exact
   Jaccard similarity of their shingles.  In buckets where this leaves more than
   one group, members of different groups meet as well, in blocks.
4. Components of the confirmed links join classes.  The first paragraph of a
   component (least doc_id, then place) stays; those of other documents go.
5. At either end of a run that goes, it grows over the words that equal those
   beside the paragraph that stays.  A run is a passage, and goes, if it has
   PASSAGE_WORDS words or is its whole document; a shorter phrase that documents
   share is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconweave.llm.components import components
from reconweave.llm.minhash import Merged, groups, in_blocks, similar
from reconweave.llm.scratch import Scratch
from reconweave.llm.words import _SHINGLE, buffers, counts_in, mix, slices, span_hashes, spans, texts, word_sets

SHINGLE, PERCENT, RECALL = 5, 80, 0.995
REACH, LEAST_WORDS = 6, 10
#: Words in a row that make a repeated passage.
PASSAGE_WORDS = 40
#: Bytes of paragraphs that are held to be compared at once, about.
HELD_BYTES = 8_000_000
#: Words compared in the first round of growing; each later one has eight times as many.
BESIDE = 64


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of `rows` minima that a pair at the threshold shares one of, with chance recall.

    More rows part paragraphs that are less alike: of n whose similarity is s, about
    n * s**rows are in one bucket.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


ROWS = 5
SINGLE, BANDS = bands_for(PERCENT / 100, RECALL, 1), bands_for(PERCENT / 100, RECALL, ROWS)
_rng = np.random.default_rng(19)
_A = _rng.integers(1, 2**63, SINGLE + ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, SINGLE + ROWS * BANDS, dtype=np.uint64)


def paragraphs(column: pa.StringArray) -> tuple[np.ndarray, ...]:
    """Word hashes, document offsets in them, and (first, end) words of each paragraph."""
    data, offsets = buffers(column)
    starts, ends = spans(data, offsets)
    words, at = span_hashes(data, starts, ends), counts_in(offsets, starts)
    if not len(words):
        return words, at, np.zeros(0, np.int64), np.zeros(0, np.int64), starts, ends
    new = np.zeros(len(words) + 1, bool)
    new[at] = True
    pair = np.zeros(len(words), np.uint64)
    pair[1:] = mix(words[:-1] * _SHINGLE[7] + words[1:] * _SHINGLE[8])
    padded = np.concatenate([np.full(REACH, 2**64 - 1, np.uint64), pair, np.full(REACH, 2**64 - 1, np.uint64)])
    least = padded[: len(words)].copy()
    for k in range(1, 2 * REACH + 1):
        if k != REACH:
            np.minimum(least, padded[k : k + len(words)], out=least)
    cut = new.copy()
    cut[:-1] |= pair < least
    first = np.flatnonzero(cut[:-1])
    begin = at[np.searchsorted(at, first, "right") - 1]
    size = np.diff(np.append(first, len(words)))
    first = first[new[first] | ((size >= LEAST_WORDS) & (first - begin >= LEAST_WORDS))]
    return words, at, first, np.append(first[1:], len(words)), starts, ends


def _minima(words: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int, rows: int, skip: int) -> np.ndarray:
    """Keys of `bands` bands of each paragraph, by the hash functions after `skip`; under SHINGLE words are one shingle."""
    n = np.maximum(end - first - SHINGLE + 1, 1)
    at = np.cumsum(n) - n
    where = np.repeat(first - at, n) + np.arange(n.sum())
    last = np.repeat(end - 1, n)
    value = np.zeros(len(where), np.uint64)
    for k in range(SHINGLE):
        value += np.where(where + k <= last, words[np.minimum(where + k, last)] * _SHINGLE[k], np.uint64(0))
    x = mix(value) & np.uint64(0xFFFFFFFF)
    out = np.empty((len(first), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(first), k, np.uint64)
        for j in range(skip + k * rows, skip + (k + 1) * rows):
            key = mix(key + np.minimum.reduceat(x * _A[j] + _B[j], at))
        out[:, k] = key
    return out


def _hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each paragraph; paragraphs cover all words, in turn."""
    nth = (np.arange(len(words)) - np.repeat(first, end - first)).astype(np.uint64)
    d1 = np.add.reduceat(mix(words + nth * _SHINGLE[9]), first)
    return d1.view(np.int64), np.add.reduceat(mix((words ^ _SHINGLE[11]) + nth * _SHINGLE[10]), first).view(np.int64)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes and the text of each paragraph."""
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            part = column.slice(a, b - a)
            words, _, first, end, starts, ends = paragraphs(part)
            if len(first):
                data = buffers(part)[0].tobytes()
                text = [data[i:j].decode() for i, j in zip(starts[first].tolist(), ends[end - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, _hashes(words, first, end)), pa.array(text, pa.string())], names=["hash", "check", "text"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The BANDS keys of each paragraph by its text."""
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            data, offsets = buffers(column.slice(a, b - a))
            starts, ends = spans(data, offsets)
            at = counts_in(offsets, starts)
            keys = _minima(span_hashes(data, starts, ends), at[:-1], at[1:], BANDS, ROWS, SINGLE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("hash").slice(a, b - a), pa.array(list(keys), pa.list_(pa.int64()))], names=["hash", "bands"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch.column("text"))
        for a, b in slices(column):
            part = column.slice(a, b - a)
            words, at, first, end, starts, ends = paragraphs(part)
            if not len(first):
                continue
            doc = np.searchsorted(at, first, "right") - 1
            size, (d1, d2) = end - first, _hashes(words, first, end)
            keys = _minima(words, first, end, SINGLE, 1, 0).view(np.int64)
            own = [batch.column(c).slice(a, b - a).take(pa.array(doc)) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays(
                [own[0].cast(pa.int64()), own[1], pa.array(np.diff(at)[doc]), pa.array(first - at[doc]), pa.array(size), pa.array(d1), pa.array(d2), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["doc_id", "th", "of", "word", "n_words", "hash", "check", "bands"],
            )


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of paragraphs whose shingle sets have the similarity."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left, right = texts(batch.column("text_a")), texts(batch.column("text_b"))
        for a in range(0, batch.num_rows, 1024):
            n = min(1024, batch.num_rows - a)
            (x, xs), (y, ys) = (word_sets(c.slice(a, n), SHINGLE) for c in (left, right))
            own = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(xs)) << np.uint64(52)) | x
            other = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(ys)) << np.uint64(52)) | y
            common = np.bincount((np.intersect1d(own, other, assume_unique=True) >> np.uint64(52)).astype(np.int64), minlength=n)
            keep[a : a + n] = 100 * common >= PERCENT * (np.diff(xs) + np.diff(ys) - common)
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members of a bucket that the star left in different groups."""
    u, v = [], []
    held, rows, size = [], 0, 0

    def flush() -> None:
        nonlocal held, rows, size
        if not held:
            return
        values, at = word_sets(texts(pa.concat_tables(held).column("text")), SHINGLE)
        base = 0
        for g in held:
            node, merged = g.column("hash").to_numpy(), Merged(g.column("label").to_numpy())
            for i in range(g.num_rows - 1):
                rest = i + 1 + np.flatnonzero(merged.label[i + 1 :] != merged.label[i])
                if len(rest):
                    for j in rest[similar(values, at, base + i, base + rest, PERCENT)]:
                        if merged.label[j] != merged.label[i]:
                            merged.join(i, j)
                            u.append(node[i])
                            v.append(node[j])
            base += g.num_rows
        held, rows, size = [], 0, 0

    for t in groups(batches, ["bucket", "p", "q"]):
        if rows + t.num_rows > 2048 or size + t.nbytes > HELD_BYTES:
            flush()
        held.append(t.select(["hash", "label", "text"]))
        rows, size = rows + t.num_rows, size + t.nbytes
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _beside(most: int) -> Callable:
    """Hashes of up to `most` words outward from each wanted place of a text, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column("text"))
            doc, hashes, place, side, out = [], [], [], [], []
            for a, b in slices(column):
                data, offsets = buffers(column.slice(a, b - a))
                starts, ends = spans(data, offsets)
                words, at = span_hashes(data, starts, ends).astype(np.uint32), counts_in(offsets, starts)
                ids, th = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "th"))
                for i, places in enumerate(batch.column("places").slice(a, b - a).to_pylist()):
                    own = words[at[i] : at[i + 1]]
                    for x in places:
                        n = x["at"]
                        doc.append(ids[i])
                        hashes.append(th[i])
                        place.append(n)
                        side.append(x["side"])
                        out.append((own[n : n + most] if x["side"] > 0 else own[max(0, n - most) : n][::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(hashes, pa.int64()), pa.array(place, pa.int64()), pa.array(side, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "th", "at", "side", "beside"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """more: how many words beside a row equal those beside the one that stays."""
    for batch in batches:
        more = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column("beside").to_pylist(), batch.column("theirs").to_pylist(), strict=True)):
            n = min(len(x), len(y)) // 4
            differ = np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n)
            more[i] = np.argmax(differ) if differ.any() else n
        names = [c for c in batch.schema.names if c not in ("beside", "theirs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(more)], names=[*names, "more"])


#: A row is known by doc_id and the hash of its text; so is the one that keeps a passage.
ROW, FIRST = ["doc_id", "th"], ["first_doc_id", "first_th"]


def _grown(gone: DataFrame, docs: DataFrame, s: Scratch) -> DataFrame:
    """gone with word and n_words grown over equal words; gone: also at_first and n_first, the place that stays."""
    key = [*ROW, "word", "n_words"]
    own = Window.partitionBy(*ROW).orderBy("word")
    end = F.col("word") + F.col("n_words")
    open_ = gone.withColumn("_l", F.coalesce(F.lag(end).over(own) < F.col("word"), F.lit(True))).withColumn("_r", F.coalesce(F.lead("word").over(own) > end, F.lit(True)))
    sides = F.array(
        F.when(F.col("_l"), F.struct(F.lit(-1).alias("side"), F.col("word").alias("at"), F.col("at_first").alias("at_theirs"))),
        F.when(F.col("_r"), F.struct(F.lit(1).alias("side"), end.alias("at"), (F.col("at_first") + F.col("n_first")).alias("at_theirs"))),
    )
    turn = open_.select(*key, *FIRST, F.explode(sides).alias("x")).filter("x is not null").select(*key, *FIRST, "x.*")
    turn, k, grown = s.write(turn, "ends-0"), 0, None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    kinds = "doc_id long, th long, word long, n_words long, first_doc_id long, first_th long, side int, at long, at_theirs long, more long"
    while True:
        most = BESIDE * 8**k
        theirs = turn.select(F.col("first_doc_id").alias("doc_id"), F.col("first_th").alias("th"), F.col("at_theirs").alias("at"), "side")
        places = turn.select(*ROW, "at", "side").unionByName(theirs).distinct().groupBy(*ROW).agg(F.collect_list(F.struct("at", "side")).alias("places"))
        beside = source.join(places, ROW).mapInArrow(_beside(most), "doc_id long, th long, at long, side int, beside binary")
        beside = s.write(beside.groupBy(*ROW, "at", "side").agg(F.min("beside").alias("beside")), f"beside-{k}")  # rows that repeat
        theirs = beside.select(F.col("doc_id").alias("first_doc_id"), F.col("th").alias("first_th"), F.col("at").alias("at_theirs"), "side", F.col("beside").alias("theirs"))
        both = turn.join(beside, [*ROW, "at", "side"]).join(theirs, [*FIRST, "at_theirs", "side"])
        both = both.select(*key, *FIRST, "side", "at", "at_theirs", "beside", "theirs")
        both = s.write(both.mapInArrow(_common, kinds).filter("more > 0"), f"grown-{k}")
        grown = both if grown is None else grown.unionByName(both)
        s.drop(f"ends-{k}", f"beside-{k}")
        k += 1
        turn = both.filter(F.col("more") == most).select(*key, *FIRST, "side", (F.col("at") + F.col("side") * most).alias("at"), (F.col("at_theirs") + F.col("side") * most).alias("at_theirs"))
        turn = s.write(turn, f"ends-{k}")
        if turn.isEmpty():
            break
    left, right = (F.sum(F.when(F.col("side") == x, F.col("more")).otherwise(0)).alias(n) for x, n in ((-1, "_left"), (1, "_right")))
    by = grown.groupBy(*key, *FIRST).agg(left, right)
    out = gone.join(by, [*key, *FIRST], "left").fillna(0, ["_left", "_right"])
    return out.withColumn("word", F.col("word") - F.col("_left")).withColumn("n_words", F.col("n_words") + F.col("_left") + F.col("_right"))


def _passages(rows: DataFrame) -> DataFrame:
    """The rows whose run, with what touches or overlaps it, is a passage or the whole document."""
    own = Window.partitionBy(*ROW).orderBy("word", "n_words")
    end = F.col("word") + F.col("n_words")
    new = F.coalesce(F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)) < F.col("word"), F.lit(True))
    out = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*ROW, "_run")
    size = F.max(end).over(run) - F.min("word").over(run)
    return out.withColumn("_size", size).filter((F.col("_size") >= PASSAGE_WORDS) | (F.col("_size") == F.col("of"))).drop("_new", "_run", "_size")


def _cuts(docs: DataFrame, spark: SparkSession, s: Scratch) -> DataFrame:
    """repeats() with th, the hash of the row's text."""
    kinds = "doc_id long, th long, of long, word long, n_words long, hash long, check long, bands array<long>"
    made = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_features, kinds)
    f = s.write(made, "paragraphs")
    clash = f.groupBy("hash").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("hash")
    clash = s.write(clash, "clash")
    written = docs.select("text").mapInArrow(_written, "hash long, check long, text string")
    if not clash.isEmpty():  # other words with the same hash: about one pair in 2**64
        apart = F.when(F.col("_other"), F.xxhash64("hash", "check")).otherwise(F.col("hash"))
        f, written = (x.join(clash.withColumn("_other", F.lit(True)), "hash", "left").withColumn("hash", apart).select(x.columns) for x in (f, written))
        f = s.write(f, "paragraphs-apart")
    classes = f.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    single = f.select("hash", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = single.groupBy("bucket").agg(F.min("hash").alias("u"), F.max("hash").alias("w")).filter("u <> w").select("bucket")
    needed = s.write(single.join(shared, "bucket").select("hash").distinct(), "needed")
    wanted = s.write(written.select("hash", "text").join(needed, "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text")), "wanted")
    bands = wanted.mapInArrow(_banded, "hash long, bands array<long>").select("hash", F.explode("bands").alias("bucket"))
    bands = s.write(bands, "bands")
    shared = bands.groupBy("bucket").agg(F.min("hash").alias("u"), F.max("hash").alias("w")).filter("u <> w").drop("w")
    members = s.write(bands.join(shared, "bucket"), "members")
    pairs = s.write(members.filter("hash <> u").select("u", F.col("hash").alias("v")).distinct(), "pairs")
    both = pairs.join(wanted.select(F.col("hash").alias("u"), F.col("text").alias("text_a")), "u").join(wanted.select(F.col("hash").alias("v"), F.col("text").alias("text_b")), "v")
    star = s.write(both.select("u", "v", "text_a", "text_b").mapInArrow(_exact, "u long, v long"), "star")
    label = star.groupBy(F.col("v").alias("hash")).agg(F.min("u").alias("up"))
    labelled = members.join(label, "hash", "left").select("bucket", "hash", F.coalesce("up", "hash").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n_members"))
    rest = s.write(labelled.join(mixed.filter("lo <> hi and n_members > 2").drop("lo", "hi"), "bucket"), "rest")
    sizes = rest.select("bucket", "n_members").distinct()
    met = in_blocks(rest.drop("n_members").join(wanted, "hash"), "bucket", sizes, "hash")
    met = met.select("bucket", "p", "q", "hash", "label", "text").mapInArrow(_meet, "u long, v long")
    joined = s.write(components(star.unionByName(met), s, "links").select(F.col("node").alias("hash"), "component"), "joined")
    s.drop("needed", "bands", "members", "pairs", "wanted", "star", "rest")
    of = classes.join(joined, "hash", "left").select("hash", "doc_id", "last", F.coalesce("component", "hash").alias("component_id"))
    of = s.write(of, "classes")
    many = of.groupBy("component_id").agg(F.min("doc_id").alias("first_doc_id"), F.max("last").alias("last_doc_id")).filter("first_doc_id <> last_doc_id")
    again = of.join(many, "component_id").select("hash", "component_id", "first_doc_id")
    rows = s.write(f.select(*ROW, "of", "word", "n_words", "hash").join(again, "hash").drop("hash"), "rows")
    stays = rows.filter("doc_id = first_doc_id").groupBy("component_id").agg(F.min(F.struct("th", "word", "n_words")).alias("x"))
    stays = stays.select("component_id", F.col("x.th").alias("first_th"), F.col("x.word").alias("at_first"), F.col("x.n_words").alias("n_first"))
    gone = s.write(rows.filter("doc_id <> first_doc_id").distinct().join(stays, "component_id"), "gone")
    s.drop("paragraphs", "paragraphs-apart", "clash", "classes", "joined", "rows")
    return _passages(_grown(gone, docs, s)).select(*ROW, "word", "n_words", "first_doc_id", "component_id")


def repeats(docs: DataFrame, spark: SparkSession, scratch: Scratch | None = None) -> DataFrame:
    """One row for each repeated paragraph that goes: doc_id, word, n_words, first_doc_id, component_id.

    word, n_words: the paragraph's place in its document's words, grown at the ends
    of a run; first_doc_id: the document that keeps it.  docs: doc_id (integer, not
    null) and text; other columns are ignored.  Null and empty texts have no
    paragraphs.  Repeats inside one document stay, and so do those of rows that share
    its doc_id.  Rows that repeat doc_id and text give their places once; rows that
    repeat a doc_id with another text give those of each text.  An empty table gives
    none.
    """
    return _cuts(docs, spark, scratch or Scratch(spark, "substring")).drop("th")


def cut_words(text: str, gone: list[tuple[int, int]]) -> str:
    """text without the word ranges (first, end); lines left blank go too."""
    raw = text.encode()
    starts, ends = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at, kept = 0, []
    for a, b in gone:
        kept.append(raw[at : starts[a]])
        at = max(at, ends[b - 1])
    return "\n".join(x for x in (b"".join(kept) + raw[at:]).decode().split("\n") if x.strip())


def _remove(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for i, cuts in enumerate(batch.column("_cuts").to_pylist()):
                if cuts:
                    out[i] = cut_words(out[i], sorted({(c["word"], c["word"] + c["n_words"]) for c in cuts}))
                    keep[i] = bool(out[i])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names).filter(pa.array(keep))

    return run


def without_repeats(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs with the repeated passages cut out of text; a text of which nothing is left goes.

    Cuts are of a row's own text, whatever other rows have its doc_id.  Other columns
    stay as they are, except that n_chars, where there is one, follows the text.  Rows
    without repeats stay as they are, null and empty texts too.
    """
    s = Scratch(spark, "substring")
    cuts = _cuts(docs, spark, s).groupBy("doc_id", F.col("th").alias("_th")).agg(F.collect_set(F.struct("word", "n_words")).alias("_cuts"))
    cuts = Scratch(spark, "cuts").write(cuts, "cuts")
    s.clear()
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumn("_th", F.xxhash64("text")).join(cuts, ["doc_id", "_th"], "left").select(*names, "_cuts").mapInArrow(_remove(names), kinds)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out

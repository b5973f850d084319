"""Near-duplicate documents: MinHash, banding, exact verification, components.

1. Documents with equal shingle sets, known by a 128-bit digest, form a class.
2. Each class has HASHES universal hash minima; BANDS keys of ROWS minima each.
3. In a bucket of equal band keys each member meets the least one.  A pair whose
   signatures agree enough is a candidate.  In buckets where this leaves more than
   one group, members of different groups meet as well, in blocks of signatures.
4. Components of the candidate links bound all links.  Each is dealt into blocks of
   its members' whole shingle sets, with a few pivots that all its blocks share, and
   pairs of a block are confirmed by the exact similarity.  Where this leaves a large
   component in several parts, members of different parts meet, the largest part's
   among themselves excepted.  Components of the confirmed links are the result.

So rows and comparisons grow with a group's size, and with its square only for
documents of different parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.components import components
from reconweave.llm.scratch import Scratch
from reconweave.llm.words import mix, slices, texts, word_sets

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
#: Members of a block when the members of a large group meet, and the set values it holds.
BLOCK, BLOCK_VALUES = 384, 2_000_000
#: Members of a large candidate component that are in all its blocks, about.
PIVOTS = 16

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_C = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_D = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima (uint32) of each set; sets: non-empty runs of values."""
    x, first = values & np.uint64(0xFFFFFFFF), at[:-1]
    out, work = np.empty((len(first), HASHES), np.uint32), np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _A[k], out=work)
        np.add(work, _B[k], out=work)
        out[:, k] = np.minimum.reduceat(work, first) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64) * _C
    return mix(parts.sum(axis=2, dtype=np.uint64) + _D)


def agreement_floor(threshold: float, miss: float = 1e-8) -> int:
    """Agreeing minima that a pair at the threshold reaches but with chance `miss`."""
    from math import comb

    total = 0.0
    for k in range(HASHES + 1):
        total += comb(HASHES, k) * threshold**k * (1 - threshold) ** (HASHES - k)
        if total > miss:
            return k
    return 0


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets that are not empty, and two 64-bit digests of each."""
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return full, np.zeros(0, np.int64), np.zeros(0, np.int64)
    d1 = np.add.reduceat(mix(values + np.uint64(1)), at[:-1][full]).view(np.int64)
    d2 = np.add.reduceat(mix(values ^ np.uint64(0x5BF03635D1F2A3C7)), at[:-1][full]).view(np.int64)
    return full, d1, d2


def _features(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                values, at = word_sets(column.slice(a, b - a), size)
                full, *both = digests(values, at)
                d1, d2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                d1[full], d2[full] = both
                sig, keys = [None] * (b - a), [None] * (b - a)
                if len(full):
                    minima = signatures(values, np.append(at[:-1][full], at[-1]))
                    bands, low = band_keys(minima).view(np.int64), minima.astype(np.uint8)
                    for j, i in enumerate(full):
                        sig[i], keys[i] = low[j].tobytes(), bands[j]
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays(
                    [own[0].cast(pa.int64()), own[1], pa.array(np.diff(at).astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n", "d1", "d2", "sig", "bands"],
                )

    return run


def _sets(size: int) -> Callable:
    """The digests and the whole set, as bytes, of each text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column("text"))
            for a, b in slices(column):
                values, at = word_sets(column.slice(a, b - a), size)
                full, d1, d2 = digests(values, at)
                whole = [values[at[i] : at[i + 1]].tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(whole, pa.binary())], names=["d1", "d2", "values"])

    return run


def _agreeing(floor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= floor))

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys out of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(new).tolist()
        if not cuts or cuts[0]:
            held.append(batch.slice(0, cuts[0] if cuts else batch.num_rows))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows][: len(cuts)], strict=True):  # none in a batch inside one run
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


class Merged:
    """Groups of the rows of a block that are joined so far."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _meet(floor: int) -> Callable:
    """Links between rows of different groups whose signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for t in groups(batches, ["bucket", "p", "q"]):
            rep = t.column("rep").to_numpy()
            merged = Merged(t.column("label").to_numpy())
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            for i in range(len(rep) - 1):
                other = i + 1 + np.flatnonzero(merged.label[i + 1 :] != merged.label[i])
                for j in other[(sig[other] == sig[i]).sum(axis=1) >= floor]:
                    if merged.label[j] != merged.label[i]:
                        merged.join(i, j)
                        u.append(rep[i])
                        v.append(rep[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def similar(values: np.ndarray, at: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * common >= percent * union for set i with each of the others."""
    own, n = values[at[i] : at[i + 1]], np.diff(at)
    can = np.flatnonzero((100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])) & (n[others] > 0))
    out = np.zeros(len(others), bool)
    if len(can) and len(own):
        size = n[others[can]]
        first = np.cumsum(size) - size
        flat = values[np.repeat(at[others[can]] - first, size) + np.arange(size.sum())]
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[place] == flat).astype(np.int64), first)
        out[can] = 100 * common >= percent * (len(own) + size - common)
    return out


def _confirm(floor: int, percent: int) -> Callable:
    """Links confirmed on the whole sets that join rows not yet joined in the block.

    A row whose side is 1 meets only the rows whose side is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["class", "kind", "p", "q"]):
            u, v = [], []
            rep, side, merged = t.column("rep").to_numpy(), t.column("side").to_numpy(), Merged(t.column("label").to_numpy())
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            raw = t.column("values").to_pylist()
            values, at = np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
            for i in np.flatnonzero(side == 0).tolist():
                rest = i + 1 + np.flatnonzero(merged.label[i + 1 :] != merged.label[i])
                rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= floor]
                if len(rest):
                    for j in rest[similar(values, at, i, rest, percent)]:
                        if merged.label[j] != merged.label[i]:
                            merged.join(i, j)
                            u.append(rep[i])
                            v.append(rep[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, member: str, *, shuffles: bool = True) -> DataFrame:
    """Rows dealt so that any two members of a group meet in some (key, p, q).

    Groups of up to BLOCK members are one block; larger ones are cut by hash, and
    each pair of their blocks is a unit of its own.
    """
    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    out = rows.join(sizes, key).withColumn("_k", blocks).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    out = out.withColumn("p", F.least("_b", "_o")).withColumn("q", F.greatest("_b", "_o")).drop("_k", "_b", "_o", "n_members")
    return out.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", member)


def _block_count(members: str, values: str) -> Column:
    """Blocks of at most BLOCK members and BLOCK_VALUES set values on the average."""
    return F.greatest(F.lit(1), F.ceil(F.col(members) / BLOCK), F.ceil(F.col(values) / BLOCK_VALUES)).cast("int")


def _dealt(found: DataFrame, large: DataFrame) -> DataFrame:
    """Members (rep, class) in blocks of their class, pivots in all of them; each its own label."""
    key = F.pmod(F.xxhash64("rep"), F.coalesce("k", F.lit(1))).cast("int")
    pivot = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) * F.col("n_members") < PIVOTS << 30
    blocks = F.when(F.col("k").isNotNull() & pivot, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(key))
    out = found.join(large, "class", "left").select("class", "rep", F.explode(blocks).alias("p"))
    return out.select("class", F.lit(0).alias("kind"), "p", F.lit(0).alias("q"), "rep", F.lit(0).alias("side"), F.col("rep").alias("label"))


def _apart(found: DataFrame, large: DataFrame, label: DataFrame) -> DataFrame:
    """Members of large classes that are in several parts, dealt so that any two of different parts meet.

    The largest part's members (side 1) meet those of other parts (side 0, kind 0);
    the others meet one another (kind 1).
    """
    part = found.join(large.select("class"), "class").join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")).select("class", "rep", "n", "label")
    sizes = part.groupBy("class", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("w"))
    top = sizes.groupBy("class").agg(F.max(F.struct("n", "w", "label")).alias("x"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > x.n")
    top = top.select("class", F.col("x.label").alias("_top"), F.col("x.n").alias("_ln"), F.col("x.w").alias("_lw"), (F.col("n") - F.col("x.n")).alias("_rn"), (F.col("w") - F.col("x.w")).alias("_rw"))
    top = top.select("class", "_top", _block_count("_ln", "_lw").alias("_l"), _block_count("_rn", "_rw").alias("_r"))
    out = part.join(top, "class")
    own = lambda c: F.pmod(F.xxhash64("rep", F.lit(2)), F.col(c)).cast("int")
    unit = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"))
    over = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    theirs = over("_r", lambda x: unit(0, own("_l"), x))
    others = F.concat(over("_l", lambda x: unit(0, x, own("_r"))), over("_r", lambda x: unit(1, F.least(x, own("_r")), F.greatest(x, own("_r")))))
    largest = F.col("label") == F.col("_top")
    out = out.select("class", "rep", "label", largest.cast("int").alias("side"), F.explode(F.when(largest, theirs).otherwise(others)).alias("x"))
    return out.select("class", "x.kind", "x.p", "x.q", "rep", "side", "label")


def _meeting(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    rows = dealt.join(sets, "rep").select("class", "kind", "p", "q", "rep", "side", "label", "sig", "values")
    return rows.repartition("class", "kind", "p", "q").sortWithinPartitions("class", "kind", "p", "q", "side", "rep")


def _labelled(docs: DataFrame, spark: SparkSession, shingle: int, percent: int, s: Scratch) -> DataFrame:
    """Each row of docs: doc_id, th (hash of the text), n, component_id and first_th, that of the least row."""
    floor = agreement_floor(percent / 100)
    schema = "doc_id long, th long, n long, d1 long, d2 long, sig binary, bands array<long>"
    made = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_features(shingle), schema)
    f = s.write(made.withColumn("row", F.monotonically_increasing_id()), "features")  # row: fixed, as it is written
    classes = f.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "row")).alias("least"))
    classes = s.write(classes.select(F.col("least.row").alias("rep"), "d1", "d2", "least"), "classes")
    one = s.write(f.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", "sig", "bands"), "one")

    bands = one.select("rep", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n_members")).filter("n_members > 1")
    members = s.write(bands.join(shared, "bucket"), "members")
    signs = one.select("rep", "sig")
    star = members.filter("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    star = star.join(signs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_b")), "v")
    star = star.join(signs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_a")), "u")
    star = s.write(star.select("u", "v", "sig_a", "sig_b").mapInArrow(_agreeing(floor), "u long, v long"), "star")

    label = star.groupBy(F.col("v").alias("rep")).agg(F.min("u").alias("up"))
    labels = members.join(label, "rep", "left").select("bucket", "rep", "n_members", F.coalesce("up", "rep").alias("label"))
    mixed = labels.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n_members").alias("n_members"))
    mixed = mixed.filter("lo <> hi and n_members > 2").select("bucket", "n_members")  # of two, both met
    rest = labels.drop("n_members").join(signs, "rep")
    met = in_blocks(rest, "bucket", mixed, "rep").mapInArrow(_meet(floor), "u long, v long")

    found = components(star.unionByName(met), s, "candidates").select(F.col("node").alias("rep"), F.col("component").alias("class"))
    found = s.write(found.join(one.select("rep", "n"), "rep"), "found")
    s.drop("members", "star")
    key = classes.select("rep", "d1", "d2", F.col("least.doc_id").alias("doc_id")).join(found.select("rep"), "rep").join(signs, "rep")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(key.select("doc_id"), "doc_id", "left_semi")
    sets = whole.select("text").mapInArrow(_sets(shingle), "d1 long, d2 long, values binary").join(key.drop("doc_id"), ["d1", "d2"])
    sets = s.write(sets.groupBy("rep").agg(F.first("sig").alias("sig"), F.first("values").alias("values")), "sets")
    large = found.groupBy("class").agg(F.count(F.lit(1)).alias("n_members"), F.sum("n").alias("w")).withColumn("k", _block_count("n_members", "w"))
    large = s.write(large.filter("k > 1").select("class", "n_members", "k"), "large")
    confirm = _confirm(floor, percent)
    links = s.write(_meeting(_dealt(found.select("rep", "class"), large), sets).mapInArrow(confirm, "u long, v long"), "links")
    joined = s.write(components(links, s, "parts").select(F.col("node").alias("rep"), "component"), "joined-0")
    apart = s.write(_apart(found, large, joined), "apart")
    if not apart.isEmpty():
        more = _meeting(apart, sets).mapInArrow(confirm, "u long, v long")
        joined = s.write(components(links.unionByName(more), s, "all").select(F.col("node").alias("rep"), "component"), "joined-1")
    s.drop("one", "found", "sets", "large", "links", "apart")

    inside = joined.join(classes.select("rep", "d1", "d2", "least"), "rep")
    least = inside.groupBy("component").agg(F.min("least").alias("_least"))
    inside = inside.join(least, "component").select("d1", "d2", "_least")
    of_class = classes.select("d1", "d2", "least").join(inside, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("_least", "least").alias("first"))
    of_class = s.write(of_class, "of-class")
    s.drop("classes", "joined-0", "joined-1")
    out = f.select("doc_id", "th", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    return out.select("doc_id", "th", "n", F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.col("first.th").alias("first_th"))


def near_duplicates(docs: DataFrame, spark: SparkSession, *, shingle: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs: doc_id (integer, not null) and text; other columns are ignored.  Null,
    empty and blank texts have no shingles, are linked with nothing and are kept.
    Equal texts are linked.  Rows that repeat a doc_id with other text each follow
    their own text, so they are linked as two documents would be, and component_id
    is the least doc_id of those linked.  An empty table gives an empty result.  Sets
    hold 52-bit hashes of shingles.  The result reads tables of the scratch folder,
    which whoever gives one may clear afterwards.
    """
    out = _labelled(docs, spark, shingle, percent, scratch or Scratch(spark, "minhash"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, spark: SparkSession, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each near-duplicate group: least doc_id, then least hash of the text.

    Rows with the same doc_id and text are a group's copies like others, so one of
    them stays, whichever.  Rows without shingles all stay.
    """
    s = Scratch(spark, "minhash")
    rows = _labelled(docs, spark, shingle, percent, s)
    stays = rows.filter("n = 0 or doc_id = component_id and th = first_th").groupBy("doc_id", "th").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_rows"))
    stays = Scratch(spark, "kept").write(stays.select("doc_id", F.col("th").alias("_th"), (F.expr("n > 0 and _rows > 1")).alias("_again")), "ids")
    s.clear()
    out = docs.withColumn("_th", F.xxhash64("text"))
    once = out.join(stays.filter("not _again").drop("_again"), ["doc_id", "_th"], "left_semi")
    again = stays.filter("_again")
    if not again.isEmpty():
        once = once.unionByName(out.join(again.drop("_again"), ["doc_id", "_th"], "left_semi").dropDuplicates(["doc_id", "_th"]))
    return once.select(docs.columns)

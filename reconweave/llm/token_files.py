"""Token ids in files of separately compressed documents with a shared dictionary.

A file: MAGIC, the SHA-256 of the zstandard dictionary, the file's range partition and
the ids that stand before it there, one frame for each document, then the offset index
(doc_id, offset, bytes, tokens of each frame), the number of frames and MAGIC again.
So the files alone say what they hold; the manifest only names them.  Ids are little-endian unsigned 16-bit where the
vocabulary allows, else 32-bit, as the flag behind MAGIC says.  The dictionary is
trained on the serialized ids of a bounded sample and kept beside the files, so one
short document is read by two small reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.bpe import Encoder
from reconweave.llm.scratch import Scratch
from reconweave.llm.token_counts import sample
from reconweave.llm.words import slices, texts

MAGIC = b"RWTOKEN1"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("tokens", "<u4")])
PLACE = struct.Struct("<IQ")
HEADER = len(MAGIC) + 1 + 32 + PLACE.size
#: The dictionary: rows to learn from, and bytes.
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 3000, 64_000, 3
#: It learns from whole documents in pieces of so many bytes.
PIECE_BYTES = 16_384
#: A file ends when its frames have so many bytes.
FILE_BYTES = 64_000_000


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _serial(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[bytes, bool]:
    """A dictionary of the sample's serialized ids (empty if it is too small), and whether ids are wide."""
    import zstandard

    encoder = Encoder.of(tokenizer)
    wide = encoder.tokenizer.get_vocab_size() > 65_536
    rows = [r["text"] for r in sample(docs.select("doc_id", "text"), SAMPLE_ROWS).collect()]
    column, parts = texts(pa.array(rows, pa.string())), []
    for a, b in slices(column):
        ids, at = encoder.encode(column.slice(a, b - a))
        for x in np.split(ids, at[1:-1]):
            whole = _serial(np.append(x, end_id), wide)
            parts += [whole[k : k + PIECE_BYTES] for k in range(0, len(whole), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes(), wide
    except (zstandard.ZstdError, ValueError):
        return b"", wide


class Writer:
    """Writes documents to files below a folder; a file has its name when it is whole."""

    def __init__(self, root: str, dictionary: bytes, wide: bool, part: int = 0):
        import zstandard

        self.fs, self.root = _open(root)
        self.part, self.start = part, 0
        self.wide, self.digest = wide, hashlib.sha256(dictionary).digest()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=False).compress
        self.out = None

    def add(self, doc_id: int, ids: np.ndarray) -> tuple[str, int, int]:
        """File, offset and bytes of the document's frame."""
        if self.out is not None and self.offset > FILE_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{self.root}/ids-{uuid.uuid4().hex}.bin"
            self.out, self.index, self.offset = self.fs.open_output_stream(f"{self.name}.part"), [], HEADER
            self.out.write(MAGIC + bytes([self.wide]) + self.digest + PLACE.pack(self.part, self.start))
        frame = self.compress(_serial(ids, self.wide))
        self.out.write(frame)
        self.index.append((doc_id, self.offset, len(frame), len(ids)))
        self.offset += len(frame)
        self.start += len(ids)
        return self.name.rpartition("/")[2], self.index[-1][1], len(frame)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(np.array(self.index, INDEX).tobytes() + struct.pack("<Q", len(self.index)) + MAGIC)
            self.out.close()
            self.fs.move(f"{self.name}.part", self.name)
            self.out = None


class Reader:
    """Reads documents of one file by offset, or by doc_id through its index."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(HEADER, 0)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 : len(MAGIC) + 33] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: another format or dictionary")
        self.part, self.start = PLACE.unpack(head[len(MAGIC) + 33 :])
        self.kind = "<u4" if head[len(MAGIC)] else "<u2"
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def at(self, offset: int, size: int) -> np.ndarray:
        return np.frombuffer(self.decompress(self.file.read_at(size, offset)), self.kind).astype(np.uint32)

    def index(self) -> np.ndarray:
        end = self.file.size()
        n, magic = struct.unpack("<Q8s", self.file.read_at(16, end - 16))
        if magic != MAGIC:
            raise ValueError("the file has no index")
        return np.frombuffer(self.file.read_at(n * INDEX.itemsize, end - 16 - n * INDEX.itemsize), INDEX)

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document; None if the file lacks it."""
        index = self.index()
        k = int(np.searchsorted(index["doc_id"], doc_id))
        if k == len(index) or index["doc_id"][k] != doc_id:
            return None
        return self.at(int(index["offset"][k]), int(index["bytes"][k]))


def _write(root: str, tokenizer: str, end_id: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (dictionary, wide) = Encoder.of(tokenizer), shared.value
        part, start = TaskContext.get().partitionId(), 0
        writer = Writer(root, dictionary, wide, part)
        for batch in batches:
            column, docs = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(column):
                ids, at = encoder.encode(column.slice(a, b - a))
                rows = []
                for doc_id, own in zip(docs[a:b], np.split(ids, at[1:-1]), strict=True):
                    own = np.append(own, np.uint32(end_id))
                    rows.append((doc_id, part, start, len(own), *writer.add(doc_id, own)))
                    start += len(own)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "part", "local_start", "n_tokens", "file", "offset", "bytes"])
        writer.close()

    return run


def _places(root: str, shared) -> Callable:
    """Partition, ids before it there, and ids of each file, by its own header and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, r.part, r.start, int(r.index()["tokens"].sum())) for f in batch.column("file").to_pylist() for r in [Reader(f"{root}/{f}", shared.value[0])]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["file", "part", "before", "tokens"])

    return run


def _read(root: str, shared) -> Callable:
    """The documents of each file in turn: ids before the document, its ids' number and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows = Reader(f"{root}/{file}", shared.value[0]), []
                for doc_id, offset, size, _ in reader.index().tolist():
                    ids = reader.at(offset, size)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_files(docs: DataFrame, spark: SparkSession, tokenizer: str, root: str, *, end_id: int = 0) -> tuple[DataFrame, object]:
    """Writes docs in ascending doc_id order below root; the manifest and the broadcast dictionary.

    The manifest (doc_id, part, local_start, n_tokens, file, offset, bytes) is a
    Parquet table, so it names only the files of tasks that succeeded.
    """
    dictionary, wide = train_dictionary(docs, tokenizer, end_id)
    fs, path = _open(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((dictionary, wide))  # DICTIONARY_BYTES at most
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(_write(root, tokenizer, end_id, shared), "doc_id long, part int, local_start long, n_tokens long, file string, offset long, bytes long")
    made.write.parquet(f"{root}/manifest")
    return spark.read.schema(made.schema).parquet(f"{root}/manifest"), shared


def round_trip(docs: DataFrame, spark: SparkSession, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of docs, read back from its files.

    A null text is empty; every document ends with end_id.  Rows of one doc_id
    follow one another in the order of their texts.  Other columns are ignored; an
    empty table gives none.
    """
    root = Scratch(spark, "token-files").root
    manifest, shared = write_files(docs, spark, tokenizer, root, end_id=end_id)
    files = manifest.select("file").distinct()
    found = files.mapInArrow(_places(root, shared), "file string, part long, before long, tokens long").collect()  # a row for each file
    starts, total = [], 0
    for r in sorted(found, key=lambda r: (r["part"], r["before"])):
        starts.append((r["file"], total))
        total += r["tokens"]
    each = spark.createDataFrame(starts, "file string, start long")
    return each.repartition(max(1, len(starts))).mapInArrow(_read(root, shared), "doc_id long, start long, n_tokens long, ids_crc32 long")

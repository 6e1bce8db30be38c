"""Token ids in seekable files of independent zstandard frames.

A file holds the ids of successive documents as little-endian unsigned 32-bit integers. Frames are cut between
documents once they hold FRAME_IDS ids, and none depends on another. After them come a skippable frame with the
documents' ids and lengths and, as the public seekable format has it, a seek table with each frame's sizes and the
low 32 bits of the XXH64 of its content. A reader takes the table from the file's end and decompresses no frame but
those with the documents asked for.

Documents are dealt by range of doc_id, one file for each range, and written to the shared folder under a name of the
attempt, then renamed; a repeated task writes the same file again. Reading needs the folder alone: the files' names
are in order of doc_id, and each file's footer says how many ids it holds.

Nulls and edge cases: a null or empty text has the end id alone. Null ids come first, rows that repeat an id stand in
the order of their texts. A very long text is whole in one frame. An empty table gives no file and no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, partitions, scratch_path, ship, slices, texts_of
from .encode import encoder

FRAME_IDS = 65_536
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1


class SeekableWriter:
    """Appends documents to an open file."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.frames = out, []
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.held: list[bytes] = []
        self.n_held, self.n_ids = 0, 0
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], ids, np.array([len(ids)], np.int64))

    def extend(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents one after the other: all their ids, and how many each has."""
        self.docs += doc_ids
        self.lengths.append(lengths)
        self.n_ids += len(ids)
        ends, at = np.cumsum(lengths), 0
        while (k := int(np.searchsorted(ends, at + FRAME_IDS - self.n_held))) < len(ends):
            self._hold(ids[at : ends[k]])
            self._frame()
            at = int(ends[k])
        self._hold(ids[at:])

    def _hold(self, ids: np.ndarray) -> None:
        if len(ids):
            self.held.append(ids.astype("<u4").tobytes())
            self.n_held += len(ids)

    def _frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._frame()
        n = len(self.docs)
        known = np.array([d is not None for d in self.docs], bool)
        index = struct.pack("<Q", n) + np.packbits(known).tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.concatenate([np.zeros(0, np.int64), *self.lengths]).astype("<u8").tobytes()
        index = self.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = [*self.frames, (8 + len(index), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(entries), 0x80, FOOTER_MAGIC))


class SeekableReader:
    """Reads the tables of an open file at once and frames when they are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(table[:, 0])]
        self.frames = table[:-1]
        raw = zstandard.decompress(self._at(self.starts[n - 1] + 8, int(table[-1, 0]) - 8))
        (docs,) = struct.unpack_from("<Q", raw)
        at = 8 + -(-docs // 8)
        known = np.unpackbits(np.frombuffer(raw, np.uint8, at - 8, 8))[:docs].astype(bool)
        ids = np.frombuffer(raw, "<i8", docs, at)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.begins = np.r_[0, np.cumsum(self.lengths)]
        self.edges = np.r_[0, np.cumsum(self.frames[:, 1] // 4)]

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(int(start))
        return self.source.read(int(n))

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.decompress(self._at(self.starts[k], self.frames[k, 0]), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the document at place i; decompresses its frame alone, and none for a document without ids."""
        if not self.lengths[i]:
            return np.zeros(0, "<u4")
        k = int(np.searchsorted(self.edges, self.begins[i], "right")) - 1
        return self.frame(k)[self.begins[i] - self.edges[k] : self.begins[i + 1] - self.edges[k]]

    def all(self) -> Iterator[np.ndarray]:
        """The ids of each document, in order."""
        i = 0
        for k in range(len(self.frames)):
            ids = self.frame(k)
            while i < len(self.docs) and self.begins[i] < self.edges[k + 1]:
                yield ids[self.begins[i] - self.edges[k] : self.begins[i + 1] - self.edges[k]]
                i += 1
        for _ in range(i, len(self.docs)):  # without ids, after the last frame
            yield np.zeros(0, "<u4")


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> None:
    """Encode and write all documents under the folder, a file for each range of doc_id that has some."""
    ship(spark)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context = encoder(tokenizer), TaskContext.get()
        files, folder = pafs.FileSystem.from_uri(uri)
        files.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():06d}.ids.zst"
        attempt = f"{folder}/.{name}.{context.taskAttemptId()}"
        with files.open_output_stream(attempt) as out:
            held = SeekableWriter(out)
            for batch in batches:
                texts, ids = texts_of(batch), column(batch, "doc_id").to_pylist()
                for i, j, data, offsets in slices(texts):
                    held.extend(ids[i:j], *own.encode_slice(data, offsets, end_id))
            held.close()
        if held.docs:
            files.move(attempt, f"{folder}/{name}")
        else:
            files.delete_file(attempt)
        yield pa.RecordBatch.from_pydict({"docs": [len(held.docs)]})

    dealt.mapInArrow(run, "docs long").agg(F.sum("docs")).collect()


def listed(spark: SparkSession, uri: str) -> list[str]:
    """The files' names in the order of their documents; the driver sees names alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(n for n in found if n.endswith(".ids.zst") and not n.startswith("."))


def read(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the folder's files alone; one file to a task."""
    ship(spark)
    names = listed(spark, uri)
    dealt = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))

    def opened(batches: Iterable[pa.RecordBatch]):
        files, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{folder}/{row['name']}") as source:
                    yield row, SeekableReader(source)

    def footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in opened(batches):
            yield pa.RecordBatch.from_pydict({"name": [row["name"]], "ids": [int(held.begins[-1])]})

    sizes = sorted((r["name"], r["ids"]) for r in dealt.mapInArrow(footers, "name string, ids long").collect())  # a row for each file
    before = np.cumsum([0, *(n for _, n in sizes)])
    placed = spark.createDataFrame([(name, int(b)) for (name, _), b in zip(sizes, before)], "name string, before long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in opened(batches):
            crc = [zlib.crc32(x) for x in held.all()]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(held.docs, pa.int64()), "start": pa.array(held.begins[:-1] + row["before"]), "n_tokens": pa.array(held.lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.repartition(max(1, len(names))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write to the shared folder and read back."""
    uri = scratch_path(spark, "ids")
    write(spark, docs, tokenizer, end_id, uri)
    return read(spark, uri)

"""Token-id files of independent zstandard frames.

A file holds, in ascending doc_id order, frames of whole documents (little-endian unsigned 32-bit ids); then a skippable
frame with the directory (doc_ids and lengths); then, as a skippable frame, the seek table: for each frame its
compressed size, its size and the lower half of the xxh64 of its content. A reader takes the table from the end of the
file, the directory, and only the frames that it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling, tokens

#: Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed when it has as many ids.
FRAME_IDS = 1 << 16
LEVEL = 3
NO_ID = -(1 << 63)
MANIFEST = "part int, path string, n_documents long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Writer:
    def __init__(self, sink, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self.sink, self.frame_ids = sink, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.per_frame: list[int] = [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.open.append(ids)
        self.size += len(ids)
        self.per_frame[-1] += 1
        if self.size >= 4 * self.frame_ids:
            self._close()

    def _close(self) -> None:
        import xxhash

        if not self.open:
            return
        data = b"".join(self.open)
        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0
        self.per_frame.append(0)

    def finish(self) -> None:
        self._close()
        directory = struct.pack("<QQ", len(self.docs), len(self.table)) + b"".join(
            np.array(x, dtype=kind).tobytes() for x, kind in ((self.per_frame[: len(self.table)], "<u4"), (self.docs, "<i8"), (self.lengths, "<u8"))
        )
        packed = self.compressor.compress(directory)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, 0))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Reads documents of one file, opened for random access."""

    def __init__(self, source) -> None:
        import zstandard

        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        end = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.table = table[:-1]
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        packed = self._at(int(self.starts[-2]), int(table[-1, 0]))
        directory = self.decompressor.decompress(packed[8:])
        docs, frames = struct.unpack("<QQ", directory[:16])
        at = 16 + 4 * frames
        self.frame_of = np.repeat(np.arange(frames), np.frombuffer(directory[16:at], dtype="<u4"))
        self.docs = np.frombuffer(directory[at : at + 8 * docs], dtype="<i8")
        self.lengths = np.frombuffer(directory[at + 8 * docs :], dtype="<u8").astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, number: int) -> bytes:
        import xxhash

        data = self.decompressor.decompress(self._at(int(self.starts[number]), int(self.table[number, 0])), max_output_size=int(self.table[number, 1]))
        if len(data) != self.table[number, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[number, 2]:
            raise ValueError(f"frame {number} does not match its checksum")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids) of the wanted documents, or of all; other frames stay packed."""
        held, data = -1, b""
        for i in range(len(self.docs)) if wanted is None else np.flatnonzero(np.isin(self.docs, list(wanted))).tolist():
            frame = int(self.frame_of[i])
            if frame != held:
                held, data = frame, self.frame(frame)
                begin = int(self.begins[np.searchsorted(self.frame_of, frame)])
            at = 4 * (int(self.begins[i]) - begin)
            doc = int(self.docs[i])
            yield None if doc == NO_ID else doc, int(self.begins[i]), data[at : at + 4 * int(self.lengths[i])]


def store(path: str):
    """The file system of a path that all machines see, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _written(batches: Iterator[pa.RecordBatch], folder: str, name: str, end: int, frame_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    # A repeated task writes a new file; the manifest names the one that counts.
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
    files, inner = store(path)
    sink = writer = None
    for batch in batches:
        for piece in rolling.batches(batch, "text", tokens.TEXT_BYTES):
            if writer is None:
                files.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = files.open_output_stream(inner, compression=None)
                writer = Writer(sink, frame_ids)
            for doc, ids in zip(piece.column("doc_id").to_pylist(), tokens.encoded(piece, name, end), strict=True):
                writer.add(doc, ids)
    if writer is not None:
        writer.finish()
        sink.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()), pa.array([sum(writer.lengths)], pa.int64())],
            names=["part", "path", "n_documents", "n_ids"],
        )


def write_ids(docs: DataFrame, folder: str, name: str = tokens.TOKENIZER, end: int = tokens.END, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode all documents, write them by ascending doc_id, and return the manifest: part, path, n_documents, n_ids.

    Every row is a document, also one of a repeated doc_id; rows without doc_id come first. A null text is empty: it
    has the end id alone. Other columns are ignored. Without rows there is no file.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    folder = _uri(folder)
    return base.kept_table(ordered.mapInArrow(lambda it: _written(it, folder, name, end, frame_ids), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch], wanted: set[int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            files, inner = store(path)
            with files.open_input_file(inner) as source:
                rows = [(doc, before + start, len(ids) // 4, zlib.crc32(ids)) for doc, start, ids in Reader(source).documents(wanted)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """Documents from the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = manifest.count()
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before).select("path", "before").repartition(max(1, files))
    return placed.mapInArrow(lambda it: _read(it, wanted), DOCUMENTS)


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(base.table(spark, sf_dir, "documents"), base.shared_folder(spark)))

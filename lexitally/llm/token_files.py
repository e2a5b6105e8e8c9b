"""Files of token ids: independent zstandard frames with a seek table behind them.

A file holds the ids of a run of documents as little-endian unsigned 32-bit numbers, cut into
frames of ``FRAME_IDS`` ids. Each frame is a zstandard frame of its own, with zstandard's own
checksum. Behind them stand two skippable frames, which any zstandard reader passes over: the
documents (their ids, starts and lengths, as a compressed Arrow stream), and, last, a seek
table in the public seekable format, with compressed size, size and checksum (the low 32 bits
of XXH64) of every frame, the documents included. A reader finds the table from the end of the
file, and decompresses the frames of the documents that it is asked for, no others.

Documents are sorted by id over all files by Spark; each task streams its part into one file.
A file gets its name when it is whole, and a task that runs again writes the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.encode import encoder, slices
from lexitally.session import scratch_dir, written

WIDTH = 4
FRAME_IDS = 1 << 16
# Frames that are cut from what waits at once.
FRAMES = 8
LEVEL = 1
# Fixed values of the zstandard formats.
SKIPPABLE = 0x184D2A50
SEEK_SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file; documents are added in the order in which they are numbered."""

    def __init__(self, out: pa.NativeFile, id_type: pa.DataType) -> None:
        self.out = out
        self.id_type = id_type
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = 0
        self.names: list = []
        self.lengths: list[int] = []

    def add(self, name: object, ids: bytes) -> None:
        """Add a document: its own id, and the ids of its tokens."""
        self.names.append(name)
        self.lengths.append(len(ids) // WIDTH)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= FRAMES * FRAME_IDS * WIDTH:
            self._frames(False)

    def _frames(self, everything: bool) -> None:
        """Write the full frames of what waits, or all of it."""
        data, size = b"".join(self.waiting), FRAME_IDS * WIDTH
        end = len(data) if everything else len(data) - len(data) % size
        for begin in range(0, end, size):
            self._frame(data[begin : min(begin + size, end)])
        self.waiting, self.size = [data[end:]], len(data) - end

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), checksum(data)))

    def close(self) -> None:
        self._frames(True)
        lengths = np.array(self.lengths, dtype=np.int64)
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array(self.names, self.id_type),
                pa.array(np.cumsum(lengths) - lengths),
                pa.array(lengths),
            ],
            names=["doc_id", "start", "length"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        data = sink.getvalue().to_pybytes()
        packed = self.compressor.compress(data)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        # A skippable frame has no content, so it counts as size zero in the table.
        self.table.append((len(packed) + 8, 0, checksum(data)))
        body = b"".join(struct.pack("<III", *entry) for entry in self.table)
        foot = struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(body) + len(foot)) + body + foot)


class Reader:
    """Reads documents of one file by their numbers."""

    FOOT = 9

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        size = source.size()
        foot = self._read(size - self.FOOT, self.FOOT)
        frames, flags, magic = struct.unpack("<IBI", foot)
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        begin = size - self.FOOT - 12 * frames
        table = np.frombuffer(self._read(begin, 12 * frames), dtype="<u4").reshape(-1, 3)
        self.sums = table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.starts = [0, *np.cumsum(table[:, 1], dtype=np.int64).tolist()]
        packed = self._read(int(self.places[-2]) + 8, int(table[-1, 0]) - 8)
        rows = pa.ipc.open_stream(self._content(packed, frames - 1)).read_all()
        self.names = rows.column("doc_id")
        self.begins = rows.column("start").to_pylist()
        self.lengths = rows.column("length").to_pylist()
        self.frame, self.data = -1, b""
        self.frames_read = 0

    def _read(self, begin: int, size: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(size)

    def _content(self, packed: bytes, frame: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(packed)
        if checksum(data) != self.sums[frame]:
            raise ValueError(f"checksum of frame {frame} is wrong")
        return data

    def _load(self, frame: int) -> bytes:
        if frame != self.frame:
            begin, end = int(self.places[frame]), int(self.places[frame + 1])
            self.frame, self.data = frame, self._content(self._read(begin, end - begin), frame)
            self.frames_read += 1
        return self.data

    def __len__(self) -> int:
        return len(self.lengths)

    def document(self, number: int) -> bytes:
        """The ids of a document; only the frames that hold them are decompressed."""
        start, length = self.begins[number] * WIDTH, self.lengths[number] * WIDTH
        end, parts = start + length, []
        frame = bisect_right(self.starts, start) - 1
        while start < end:
            data = self._load(frame)
            at = start - self.starts[frame]
            part = data[at : at + end - start]
            parts.append(part)
            start += len(part)
            frame += 1
        return b"".join(parts)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class TokenFiles:
    """Written files: ``part, path, documents, ids`` each, and ``part, number, doc_id``."""

    files: DataFrame
    names: DataFrame


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenFiles:
    """Write the ids of all documents, in ascending order of their ids, below ``folder``.

    ``folder`` must be one that the driver and all executors reach. ``end_id`` follows each
    document. A null text is an empty one; rows without an id come first, rows that repeat
    an id in the order of their texts. An empty table gives no files.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spread = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()),
            T.StructField("number", T.LongType()), named.schema["doc_id"],
            T.StructField("ids", T.LongType()),
        ]
    )
    end = end_id.to_bytes(WIDTH, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        path = f"{folder}/part-{part:06d}.ids.zst"
        files, place = opened(path)
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        draft = f"{place}.{context.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                out = files.open_output_stream(draft)
                writer = Writer(out, batch.schema.field("doc_id").type)
            texts = batch.column("text").to_pylist()
            for piece in slices(texts):
                first = len(writer.names)
                own = batch.column("doc_id")[piece.start : piece.stop]
                for name, ids in zip(own.to_pylist(), encoder(tokenizer).encode(texts[piece])):
                    writer.add(name, ids + end)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([path] * n, pa.string()),
                        pa.array(range(first, first + n), pa.int64()),
                        own,
                        pa.array(writer.lengths[first:], pa.int64()),
                    ],
                    names=schema.names,
                )
        if writer is not None:
            writer.close()
            out.close()
            files.move(draft, place)

    rows = written(spread.mapInArrow(work, schema), "token-rows")
    files = rows.groupBy("part", "path").agg(
        F.count("*").alias("documents"), F.sum("ids").alias("ids")
    )
    return TokenFiles(files, rows.select("part", "number", "doc_id"))


def read_back(token_files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document, out of the files alone.

    ``start`` counts the ids of all documents before it, in all files. Without ``with_ids``
    the column ``ids`` is null.
    """
    files, id_type = token_files.files, token_files.names.schema["doc_id"]
    schema = T.StructType(
        [
            id_type, T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    # As many rows as there are files. The number of tasks is given, since Spark would
    # put so few rows into one.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.withColumn(
        "first", F.sum("ids").over(W.orderBy("part")) - F.col("ids")
    ).repartitionByRange(tasks, "part")
    return placed.mapInArrow(partial(_read_all, with_ids), schema)


def _read_all(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, place = opened(row["path"])
            with files.open_input_file(place) as source:
                reader = Reader(source)
                yield from _batches(reader, row["first"], with_ids)


def _batches(
    reader: Reader, first: int, with_ids: bool, limit: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    begin, held, sums, size = 0, [], [], 0
    for number in range(len(reader)):
        ids = reader.document(number)
        held.append(ids if with_ids else None)
        sums.append(zlib.crc32(ids))
        size += len(ids)
        if size < limit and number + 1 < len(reader):
            continue
        end = number + 1
        yield pa.RecordBatch.from_arrays(
            [
                reader.names.slice(begin, end - begin).combine_chunks(),
                pa.array([start + first for start in reader.begins[begin:end]], pa.int64()),
                pa.array(reader.lengths[begin:end], pa.int64()),
                pa.array(sums, pa.int64()),
                pa.array(held, pa.binary()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
        )
        begin, held, sums, size = end, [], [], 0


def documents(token_files: TokenFiles, wanted: DataFrame) -> DataFrame:
    """The ids of some documents: ``doc_id, ids`` for each id of ``wanted`` that there is.

    Only the frames that hold them are decompressed.
    """
    asked = wanted.select(F.col(wanted.columns[0]).alias("doc_id")).distinct()
    rows = token_files.names.join(asked, "doc_id").join(token_files.files, "part")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source, reader = "", None, None
        for batch in batches:
            found = []
            for path, number in zip(
                batch.column("path").to_pylist(), batch.column("number").to_pylist()
            ):
                if path != now:
                    if source is not None:
                        source.close()
                    files, place = opened(path)
                    now, source = path, files.open_input_file(place)
                    reader = Reader(source)
                found.append(reader.document(number))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], names=schema.names
            )
        if source is not None:
            source.close()

    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("path", "number", "doc_id").repartition(tasks, "path")
    return ordered.sortWithinPartitions("path", "number").mapInArrow(work, schema)


def digests(token_files: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    return read_back(token_files, with_ids=False).drop("ids")


def scratch_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "token-files")

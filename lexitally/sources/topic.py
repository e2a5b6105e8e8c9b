"""A topic in a shared folder, as a source and a sink of streams: keyed records with offsets.

For places without a broker. A micro-batch appends its records with one file per task and then,
as one small file that is put in place whole, the list of these: readers see all of a batch or
nothing, and a batch that runs again finds its list and appends nothing. One query writes to
a topic at a time.

Readers keep their offsets in their own checkpoint; reading changes nothing in the topic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

FORMAT = "lexitally_topic"
RECORDS = "key BINARY, value BINARY"
SCHEMA = f"{RECORDS}, offset BIGINT, batch BIGINT"


class Log:
    """The lists of a topic's files, one per batch, named by the offsets that they hold."""

    def __init__(self, path: str) -> None:
        # A file:/path of Hadoop's is the same as a plain one.
        plain = path.removeprefix("file:") if path.startswith("file:/") else path
        plain = "/" + plain.lstrip("/") if "://" not in plain else plain
        self.files, root = fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")
        self.root = root.rstrip("/")

    def ranges(self) -> list[tuple[int, int, int]]:
        """``first, end, batch`` of all lists, in order."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = (info.base_name for info in found if info.base_name.endswith(".json"))
        return sorted(tuple(map(int, name.removesuffix(".json").split("-"))) for name in names)

    def end(self) -> int:
        return max((end for _, end, _ in self.ranges()), default=0)

    def pieces(self, start: int, end: int) -> list[Piece]:
        """The parts of files that hold these offsets."""
        found = []
        for first, last, batch in self.ranges():
            if first >= end or last <= start:
                continue
            with self.files.open_input_stream(self._name(first, last, batch)) as stream:
                listed = json.loads(stream.read())
            for name, count in listed:
                low, high = max(first, start), min(first + count, end)
                if low < high:
                    found.append(Piece(name, low - first, high - low, low, batch))
                first += count
        return found

    def append(self, batch: int, listed: list[tuple[str, int]]) -> bool:
        """Put a batch's list in place; false if that was done before."""
        ranges = self.ranges()
        if ranges and max(number for _, _, number in ranges) >= batch:
            return False
        first = ranges[-1][1] if ranges else 0
        last = first + sum(count for _, count in listed)
        if last > first:
            self.files.create_dir(f"{self.root}/log")
            hidden = f"{self.root}/log/.{uuid.uuid4().hex}"
            with self.files.open_output_stream(hidden) as stream:
                stream.write(json.dumps(listed).encode())
            self.files.move(hidden, self._name(first, last, batch))
        return True

    def _name(self, first: int, last: int, batch: int) -> str:
        return f"{self.root}/log/{first:020d}-{last:020d}-{batch:010d}.json"


@dataclass
class Piece(InputPartition):
    name: str
    skip: int
    count: int
    first: int
    batch: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    count: int


class TopicDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema: StructType) -> TopicStreamReader:
        return TopicStreamReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options)


class TopicReader(DataSourceReader):
    """All records that are there, or those up to ``endingOffset``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.end = int(options.get("endingoffset", -1))

    def partitions(self) -> Sequence[InputPartition]:
        log = Log(self.path)
        return log.pieces(0, self.end if self.end >= 0 else log.end())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition)


def records(path: str, piece: Piece | None) -> Iterator[pa.RecordBatch]:
    """The records of a piece with their offsets and batch; one batch of rows is held at a time."""
    if piece is None:  # a topic without records
        return
    log = Log(path)
    skip, left, offset = piece.skip, piece.count, piece.first
    with log.files.open_input_file(f"{log.root}/data/{piece.name}") as file:
        for batch in pq.ParquetFile(file).iter_batches():
            part = batch.slice(skip, left)
            skip = max(0, skip - batch.num_rows)
            if part.num_rows:
                places = pa.array(range(offset, offset + part.num_rows), pa.int64())
                number = pa.array([piece.batch] * part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("value"), places, number],
                    names=["key", "value", "offset", "batch"],
                )
                left, offset = left - part.num_rows, offset + part.num_rows


class TopicStreamReader(DataSourceStreamReader):
    """``startingOffsets`` is latest or earliest, for a query without a checkpoint.

    ``recordsPerBatch`` limits a micro-batch. A source is not told where a query that starts again
    has got to, so the limit needs ``progress``, a folder of the query's own, in which its last end
    is noted. Nothing but the limit depends on that.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.latest = options.get("startingoffsets", "latest") == "latest"
        self.limit = int(options.get("recordsperbatch", 0))
        self.progress = options.get("progress")
        if self.limit and not self.progress:
            raise ValueError("recordsPerBatch needs a folder for progress")
        self.last: int | None = None

    def initialOffset(self) -> dict:
        return {"offset": Log(self.path).end() if self.latest else 0}

    def latestOffset(self) -> dict:
        end = Log(self.path).end()
        if self.limit:
            if self.last is None:
                noted = self._noted()
                self.last = self.initialOffset()["offset"] if noted is None else noted
            end = min(end, self.last + self.limit)
            self.last = end
        return {"offset": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = max(self.last or 0, end["offset"])
        return Log(self.path).pieces(start["offset"], end["offset"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition)

    def commit(self, end: dict) -> None:
        if self.progress:
            noted = Log(self.progress)
            noted.files.create_dir(noted.root)
            with noted.files.open_output_stream(f"{noted.root}/end") as stream:
                stream.write(str(end["offset"]).encode())

    def _noted(self) -> int | None:
        noted = Log(self.progress)
        if noted.files.get_file_info(f"{noted.root}/end").type == fs.FileType.NotFound:
            return None
        with noted.files.open_input_stream(f"{noted.root}/end") as stream:
            return int(stream.read() or 0)


class TopicWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        log, name, count = Log(self.path), f"{uuid.uuid4().hex}.parquet", 0
        log.files.create_dir(f"{log.root}/data")
        writer = None
        for batch in iterator:
            batch = batch.select(["key", "value"])
            if writer is None:
                writer = pq.ParquetWriter(f"{log.root}/data/{name}", batch.schema, filesystem=log.files)
            writer.write_batch(batch)
            count += batch.num_rows
        if writer is not None:
            writer.close()
        return Written(name, count)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """All tasks are done: their files become the batch, unless it has been appended before."""
        written = [(m.name, m.count) for m in messages if m is not None and m.count]
        if not Log(self.path).append(batchId, written):
            self.abort(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        log = Log(self.path)
        for message in messages:
            if message is not None and message.count:
                log.files.delete_file(f"{log.root}/data/{message.name}")


def read_topic(spark: SparkSession, path: str, end: int | None = None) -> DataFrame:
    """``key, value, offset`` of all records, or of those before offset ``end``."""
    spark.dataSource.register(TopicDataSource)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if end is None else reader.option("endingOffset", end)).load()


def follow_topic(
    spark: SparkSession, path: str, starting: str = "latest", records_per_batch: int | None = None,
    progress: str | None = None,
) -> DataFrame:
    """The records as a stream, from the newest on or, with ``earliest``, from the first."""
    spark.dataSource.register(TopicDataSource)
    reader = spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", starting)
    if records_per_batch is not None:
        reader = reader.option("recordsPerBatch", records_per_batch)
    return (reader if progress is None else reader.option("progress", progress)).load()


def topic_writer(records: DataFrame, path: str) -> DataStreamWriter:
    """A sink that appends ``key, value`` records, each batch once."""
    records.sparkSession.dataSource.register(TopicDataSource)
    return records.select("key", "value").writeStream.format(FORMAT).option("path", path)

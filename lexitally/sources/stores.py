"""What streams leave behind: keyed state that is read as a table, and output.

Spark keeps the state of a streaming query in its state store, writes it batch by batch, and
cleans it up; nothing is kept beside it. It can be read as of any batch that is retained
(``spark.sql.streaming.minBatchesToRetain``, 100 unless set), whether the query runs or not,
and a batch that runs again leaves the same state. Output is written by Spark's file sink, whose
readers see whole batches, each once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexitally.operators.counts import stem_counts
from lexitally.session import file_system

BATCH = "batch_id"
# Queries of a store, which are also the names of their output.
OUTCOMES, DESCRIPTIONS, COUNTS, SEEN = "outcomes", "descriptions", "counts", "seen"

COUNTS_SCHEMA = "word STRING, n BIGINT"
DESCRIPTIONS_SCHEMA = "product_id STRING, text STRING"
OUTCOMES_SCHEMA = (
    "request_id BIGINT, ts TIMESTAMP_NTZ, product_id STRING, host STRING, status BIGINT,"
    " message STRING, batch_id BIGINT"
)
# The state in which a stream of keys notes by which row each key was stored.
FIRST = "first"
# State on the executors' disks, of which a batch writes only what it changed.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_settings(spark: SparkSession) -> None:
    """Streams that the session starts from now on keep their state in RocksDB."""
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)


@dataclass(frozen=True)
class StreamStore:
    """A folder, shared by all executors, with the checkpoints and the output of streams."""

    spark: SparkSession
    root: str

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/checkpoints/{query}"

    def output(self, query: str) -> str:
        """The folder of a query's output, which is there from now on."""
        path = f"{self.root}/{query}"
        files, place = file_system(self.spark, path)
        files.mkdirs(place)
        return path

    def read(self, query: str, schema: str | StructType) -> DataFrame:
        """The output of all finished batches."""
        return self.spark.read.schema(schema).parquet(self.output(query))

    def stream(self, query: str, schema: str | StructType) -> DataFrame:
        """The output as the input of another stream."""
        return self.spark.readStream.schema(schema).parquet(self.output(query))

    def batches(self, query: str) -> tuple[int, int]:
        """The oldest and newest batch whose state can be read; -1 twice before the first."""
        files, place = file_system(self.spark, f"{self.checkpoint(query)}/state")
        if not files.exists(place):
            return -1, -1
        known = self.spark.read.format("state-metadata").load(self.checkpoint(query))
        found = known.agg(F.min("minBatchId"), F.max("maxBatchId")).first()
        return (-1, -1) if found[1] is None else (found[0], found[1])

    def state(
        self, query: str, until: int | None = None, variable: str | None = None
    ) -> DataFrame | None:
        """The ``key`` and ``value`` rows after the newest batch, or after batch ``until``;
        None before the first batch."""
        oldest, newest = self.batches(query)
        until = newest if until is None else min(until, newest)
        if newest < 0 or until < 0:
            return None
        if until < oldest:
            raise ValueError(f"state of the batches before {oldest} is no longer kept in {self.root}")
        return self._reader(variable).option("batchId", until).load(self.checkpoint(query))

    def changes(self, query: str, since: int) -> DataFrame:
        """The ``key`` and ``value`` of all that batches from ``since`` on have changed."""
        reader = self._reader(None).option("readChangeFeed", "true")
        return reader.option("changeStartBatchId", since).load(self.checkpoint(query))

    def _reader(self, variable: str | None):
        reader = self.spark.read.format("statestore")
        return reader if variable is None else reader.option("stateVarName", variable)

    def counts(self, until: int | None = None) -> DataFrame:
        """Counts per stem after the newest batch, or as a reader after batch ``until`` saw them."""
        rows = self.state(COUNTS, until)
        if rows is None:
            return self.spark.createDataFrame([], COUNTS_SCHEMA)
        return stem_counts(rows.select("key.word", "value.*").toDF("word", "n"))

    def deltas(self, since: int | None = None) -> DataFrame:
        """``batch_id, word, n``: what each batch has added, from ``since`` or the oldest on
        whose state before it can still be read."""
        oldest, newest = self.batches(COUNTS)
        if newest < 0:
            return self.spark.createDataFrame([], f"{BATCH} BIGINT, {COUNTS_SCHEMA}")
        since = max(0, oldest + 1 if oldest > 0 else 0) if since is None else since
        changed = self.changes(COUNTS, since).select(BATCH, "key.word", "value.*")
        totals = changed.toDF(BATCH, "word", "total")
        if since > 0:
            before = self.state(COUNTS, since - 1).select(F.lit(since - 1).cast("long"), "key.word", "value.*")
            totals = totals.unionByName(before.toDF(BATCH, "word", "total"))
        last = F.lag("total", 1, 0).over(Window.partitionBy("word").orderBy(BATCH))
        added = totals.select(BATCH, "word", (F.col("total") - last).alias("n"))
        return stem_counts(added.where(F.col(BATCH) >= since), [BATCH])

    def seen(self, until: int | None = None, query: str = SEEN, key: str = "product_id") -> DataFrame:
        """The stored keys, each with the batch that stored it."""
        rows = self.state(query, until, FIRST)
        if rows is None:
            return self.spark.createDataFrame([], f"{key} STRING, {BATCH} BIGINT")
        return rows.select(
            F.col("user_map_key.key").alias(key), F.col("user_map_value")[BATCH].alias(BATCH)
        )


@dataclass(frozen=True)
class BatchFolder:
    """Tables with a folder per batch; a batch that runs again replaces its own."""

    spark: SparkSession
    root: str

    def write(self, table: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{BATCH}={batch_id}")

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of all batches with their ``batch_id``; none while there is no batch."""
        schema = StructType.fromDDL(f"{schema}, {BATCH} BIGINT")
        path = f"{self.root}/{table}"
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

"""Feeds of requests and descriptions as streams, and the topic descriptions go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.session import file_system


def table_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """A growing parquet table as a stream; ``files_per_batch`` limits each batch.

    The schema is that of the files already there, of which there must be one.
    """
    table = spark.read.parquet(path)
    files, place = file_system(spark, path)
    if files.getFileStatus(place).isFile():
        folder, name = path.rstrip("/").rsplit("/", 1)
        path = f"{folder}/{{{name}}}"  # a single file, which only a pattern may name
    reader = spark.readStream.schema(table.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def topic_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting_offsets: str = "latest",
    records_per_batch: int | None = None,
) -> DataFrame:
    """Keys and values of a Kafka topic as text, from the newest record on.

    Offsets are kept in the stream's checkpoint and never committed to Kafka.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if records_per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", records_per_batch)
    return topic_text(reader.load())


def topic_text(records: DataFrame, *others: str | Column) -> DataFrame:
    """Records of a topic as ``product_id, text``, next to other columns of theirs."""
    return records.select(
        F.col("key").cast("string").alias("product_id"),
        F.col("value").cast("string").alias("text"),
        *others,
    )


def publish(descriptions: DataFrame, servers: str, topic: str) -> None:
    """Append accepted descriptions to a Kafka topic, keyed by product."""
    (
        topic_records(descriptions)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .save()
    )


def topic_records(descriptions: DataFrame) -> DataFrame:
    return descriptions.select(
        F.col("product_id").cast("binary").alias("key"), F.col("text").cast("binary").alias("value")
    )

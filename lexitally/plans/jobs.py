"""Whole jobs: from a feed of requests to ranked words, as a batch or step by step."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.text import Tokenizer
from lexitally.operators.counts import word_counts
from lexitally.operators.ranking import MAX_K, with_rank
from lexitally.operators.requests import accepted_descriptions
from lexitally.session import file_system, scratch_dir
from lexitally.sources.feeds import table_stream
from lexitally.sources.stores import StreamStore
from lexitally.streaming.jobs import run_counts, run_requests, stream_accepted


def top_words(
    requests: DataFrame,
    descriptions: DataFrame,
    k: int | str,
    max_k: int | None = MAX_K,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """The first K words over the descriptions of the products asked for."""
    accepted = accepted_descriptions(requests, descriptions)
    return with_rank(word_counts(accepted, tokenizer=tokenizer), k, max_k)


def accepted_by_day(requests: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Counts per day of acceptance and stem: the deltas of one-day batches."""
    accepted = accepted_descriptions(requests, descriptions)
    day = F.to_date("ts").alias("day")
    return word_counts(accepted.select(day, "text"), keys=["day"])


def parts_by_time(rows: DataFrame, column: str, cuts: Iterable[str]) -> list[DataFrame]:
    """The rows before the first cut, between the cuts, and from the last cut on."""
    bounds: list[Column] = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    at = F.col(column)
    lower = [None, *bounds]
    upper = [*bounds, None]
    parts = []
    for low, high in zip(lower, upper):
        part = rows if low is None else rows.where(at >= low)
        parts.append(part if high is None else part.where(at < high))
    return parts


# Bytes of the input of a feed for each of its files.
FEED_FILE = 8 << 20


def _count_files(spark: SparkSession, folder: str) -> int:
    files, place = file_system(spark, f"{folder}/*.parquet")
    return len(files.globStatus(place))


def _files_for(spark: SparkSession, part: DataFrame) -> int:
    """How many files a part is to have, by the bytes of the tables that it is made of."""
    sizes = 0
    for name in part.inputFiles():
        files, place = file_system(spark, unquote(name))
        sizes += files.getFileStatus(place).getLen()
    return max(1, -(-sizes // FEED_FILE))


def feed_of(spark: SparkSession, parts: Iterable[DataFrame], root: str) -> DataFrame:
    """The parts as a feed in this order, and a micro-batch per part.

    A stream takes a number of files at a time, so all parts have as many, however few rows they
    have: as many as the largest needs for no task to have more than its share.
    """
    parts, place = list(parts), f"{root}/feed"
    each = max((_files_for(spark, part) for part in parts), default=1)
    for part in parts:
        before = _count_files(spark, place)
        rows = part.repartition(each)
        rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(place)
        # Tasks without rows write no file, but for one.
        for _ in range(_count_files(spark, place), before + each):
            part.limit(0).write.mode("append").parquet(place)
    return table_stream(spark, place, files_per_batch=each)


def stream_requests(
    spark: SparkSession, parts: Iterable[DataFrame], descriptions: DataFrame, counted: bool = True
) -> StreamStore:
    """Answer the requests of the parts, a micro-batch each, and count the words of the
    descriptions that these have made accepted."""
    store = StreamStore(spark, scratch_dir(spark, "requests"))
    run_requests(feed_of(spark, parts, store.root), descriptions, store, None).awaitTermination()
    if counted:
        run_counts(stream_accepted(store, descriptions), store, None).awaitTermination()
    return store


def stream_texts(
    spark: SparkSession, parts: Iterable[DataFrame], restarted: bool = False
) -> StreamStore:
    """Count the words of parts of ``product_id, text``, a micro-batch each; ``restarted``
    stops the stream after every part, and starts it again when the next is there."""
    store = StreamStore(spark, scratch_dir(spark, "texts"))
    parts = list(parts)
    for some in [[part] for part in parts] if restarted else [parts]:
        run_counts(feed_of(spark, some, store.root), store, None).awaitTermination()
    return store

"""Streaming forms of the counting and request jobs.

State is Spark's: running counts are an aggregation in the state store, products are keyed state
that answers each request, and both are read back with `StreamStore`. A service is a chain of
such queries. The first answers requests, the next ones follow its output, which has each batch
once, whatever was stopped and started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lexitally.functions.text import Tokenizer, tokenize
from lexitally.operators.counts import flat_tokens, plain_words
from lexitally.operators.requests import (
    BAD_REQUEST,
    CREATED,
    NOT_FOUND,
    OK,
    ORDER,
    described_keys,
    locate,
    message,
    request_mark,
)
from lexitally.session import written
from lexitally.sources.stores import (
    BATCH,
    COUNTS,
    DESCRIPTIONS,
    OUTCOMES,
    OUTCOMES_SCHEMA,
    SEEN,
    StreamStore,
    use_state_settings,
)
from lexitally.streaming.keys import stream_insert

# Fixed value: milliseconds between micro-batches.
INTERVAL_MILLIS = 1000


def stream_word_counts(
    texts: DataFrame, text: str = "text", tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Running counts over a stream of texts, for output mode complete or update.

    A stream allows one aggregation here, so every token is stemmed before it is counted;
    `stream_plain_counts` leaves the stemming to the reader of the totals.
    """
    tokens = flat_tokens(texts, text, tokenizer=tokenizer)
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def stream_plain_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Running counts of words that are not stemmed yet, for output mode complete.

    Whoever takes the totals stems them with `stem_counts`, each distinct word once.
    """
    return plain_words(texts, text).groupBy("word").agg(F.count("*").alias("n"))


def stream_first_wins(
    requests: DataFrame, descriptions: DataFrame, delay: str | None = None
) -> DataFrame:
    """The key of each requested product that has a description, once over the stream.

    Products without a description are not remembered. The state grows with the
    products; with ``delay`` a product may come again once that time has passed on
    ``ts``, and is forgotten then.
    """
    located = locate(requests).where(F.col("product_id").isNotNull())
    found = located.join(described_keys(descriptions), "product_id", "left_semi")
    if delay is None:
        return found.select("product_id").dropDuplicates(["product_id"])
    timed = found.withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["product_id"]).select("product_id")


def with_trigger(writer: DataStreamWriter, interval_millis: int | None) -> DataStreamWriter:
    """A batch per interval, or, with None, batches until the input is used up."""
    if interval_millis is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{interval_millis} milliseconds")


def started(
    stream: DataFrame, store: StreamStore, query: str, interval_millis: int | None, mode: str,
    sink: str = "parquet",
) -> StreamingQuery:
    """Start a query of the store; its checkpoint belongs to the store, under its name."""
    use_state_settings(store.spark)
    writer = stream.writeStream.format(sink).outputMode(mode)
    if sink == "parquet":
        writer = writer.option("path", store.output(query))
    writer = writer.option("checkpointLocation", store.checkpoint(query))
    return with_trigger(writer, interval_millis).start()


def run_batches(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    interval_millis: int | None = INTERVAL_MILLIS,
) -> StreamingQuery:
    """Start a query that calls ``write`` on each micro-batch, an ordinary DataFrame.

    A batch may run again after a failure; what it wrote has to be replaced then, as
    `BatchFolder` does.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return with_trigger(writer, interval_millis).start()


def run_counts(
    texts: DataFrame,
    store: StreamStore,
    interval_millis: int | None = INTERVAL_MILLIS,
    text: str = "text",
) -> StreamingQuery:
    """Add the words of each micro-batch of texts to the counts of the store.

    The state has a row per word. Words are stemmed when counts are read, each once.
    """
    counted = stream_plain_counts(texts, text)
    return started(counted, store, COUNTS, interval_millis, "update", "noop")


def run_insert(
    rows: DataFrame,
    key: str,
    order: tuple[str, ...],
    store: StreamStore,
    interval_millis: int | None = INTERVAL_MILLIS,
    mark: Column | None = None,
) -> StreamingQuery:
    """Store the keys of a stream; the output has every row with its answer (`stream_insert`)."""
    return started(stream_insert(rows, key, order, mark), store, SEEN, interval_millis, "append")


def stream_outcomes(
    requests: DataFrame, descriptions: DataFrame, arriving: DataFrame | None = None
) -> DataFrame:
    """The outcome of every request of a stream, as `request_outcome` has it, and its batch.

    A product is stored by its first request that finds a description. ``descriptions`` is a
    table, of texts or of products only, as it is when the query starts. ``arriving`` is a
    stream of products that get a description while it runs: their requests find it from the
    batch on in which it comes.
    """
    located = locate(requests).select("request_id", "ts", "url", "product_id", "host")
    keys = described_keys(descriptions).withColumn("found", F.lit(True))
    found = located.join(keys, "product_id", "left").select(
        *located.columns, F.coalesce("found", F.lit(False)).alias("found")
    )
    told = None if arriving is None else arriving.select("product_id")
    answers = stream_insert(found, "product_id", ORDER, request_mark(), F.col("found"), told)
    duplicate = F.col("stored") | (F.col("may") & ~F.col("first"))
    status = (
        F.when(F.col("product_id").isNull(), BAD_REQUEST)
        .when(F.col("first"), CREATED)
        .when(duplicate, OK)
        .otherwise(NOT_FOUND)
    )
    rows = answers.withColumn("status", status.cast("bigint")).withColumn("message", message())
    return rows.select("request_id", "ts", "product_id", "host", "status", "message", BATCH)


def run_requests(
    requests: DataFrame,
    descriptions: DataFrame,
    store: StreamStore,
    interval_millis: int | None = INTERVAL_MILLIS,
    arriving: DataFrame | None = None,
) -> StreamingQuery:
    """Answer the requests of a stream (`stream_outcomes`); products are kept in its state.

    Which products are described is written down once, so that no batch reads the texts.
    """
    described = written(described_keys(descriptions), "described")
    outcomes = stream_outcomes(requests, described, arriving)
    return started(outcomes, store, OUTCOMES, interval_millis, "append")


def stream_accepted(store: StreamStore, descriptions: DataFrame) -> DataFrame:
    """``product_id, text`` of the products that the store's requests have stored, as a stream.

    ``descriptions`` is a table or, if some come while the stream runs, a stream of all of
    them, which are then kept in its state until their product is asked for.
    """
    created = store.stream(OUTCOMES, OUTCOMES_SCHEMA).where(F.col("status") == CREATED)
    texts = descriptions.where(F.col("text").isNotNull()).select("product_id", "text")
    return created.select("product_id").join(texts, "product_id")


def run_accepted(
    store: StreamStore, descriptions: DataFrame, interval_millis: int | None = INTERVAL_MILLIS
) -> StreamingQuery:
    """Write the accepted descriptions, each once, as the input of further queries."""
    accepted = stream_accepted(store, descriptions)
    return started(accepted, store, DESCRIPTIONS, interval_millis, "append")

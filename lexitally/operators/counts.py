"""Word counts: whole, per batch, merged, running and as of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitally.functions.stemming import stem
from lexitally.functions.text import Tokenizer, clean_words, is_kept, tokenize


def flat_tokens(
    texts: DataFrame,
    text: str = "text",
    keys: Sequence[str] = (),
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """One row per token of each text, next to ``keys``."""
    return texts.select(*keys, F.explode(tokenizer(F.col(text))).alias("word"))


def plain_words(
    texts: DataFrame,
    text: str = "text",
    keys: Sequence[str] = (),
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """One row per kept word, not stemmed."""
    words = texts.select(*keys, F.explode(clean_words(F.col(text))).alias("word"))
    return words.where(is_kept(F.col("word"), stop_words))


def without_listed(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts per ``word``, and maybe other keys, without the words of a table."""
    return counts.join(listed.select("word").distinct(), "word", "left_anti").select(counts.columns)


def stem_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per stem from counts per word."""
    stems = counts.select(*keys, stem(F.col("word")).alias("word"), "n")
    return stems.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def word_counts(
    texts: DataFrame,
    text: str = "text",
    keys: Sequence[str] = (),
    tokenizer: Tokenizer | None = None,
    stop_words: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """How often each stem occurs, over all texts or per value of ``keys``.

    Words are counted first and only the distinct ones are stemmed, which gives the same
    counts since the stem depends on the word alone. A stop list may be a table with a
    column ``word``, of any length. A ``tokenizer`` of one's own is applied to each text
    and counted as it is.
    """
    if tokenizer is not None:
        tokens = flat_tokens(texts, text, keys, tokenizer)
        return tokens.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    listed = isinstance(stop_words, DataFrame)
    words = plain_words(texts, text, keys, () if listed else stop_words)
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    if listed:
        counts = without_listed(counts, stop_words)
    return stem_counts(counts, keys)


def stem_vocabulary(words: DataFrame) -> DataFrame:
    """Each distinct word with its stem."""
    return words.select("word").distinct().select("word", stem(F.col("word")).alias("stem"))


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """Counts of several batches added up."""
    merged = deltas[0].select("word", "n")
    for delta in deltas[1:]:
        merged = merged.unionByName(delta.select("word", "n"))
    return reduce_by_key(merged, "word", F.sum("n").alias("n"))


def reduce_by_key(rows: DataFrame, key: str | Sequence[str], *reducers: Column) -> DataFrame:
    """One row per key with the given aggregates; any associative one combines early."""
    key = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*key).agg(*reducers)


def batch_word_counts(
    texts: DataFrame, batch: Column, text: str = "text", name: str = "batch"
) -> DataFrame:
    """Counts per batch and stem; ``batch`` gives the batch of a row."""
    return word_counts(texts.select(batch.alias(name), text), text, keys=[name])


# Batches of a block, as a power of two.
BLOCK_BITS = 10


def batch_block(deltas: DataFrame, batch: str) -> Column:
    """The block of a batch, which is a number, a day, or a time of whole seconds."""
    kind = deltas.schema[batch].dataType.typeName()
    if kind == "date":
        number = F.unix_date(batch)
    elif kind.startswith("timestamp"):
        number = F.unix_seconds(F.col(batch).cast("timestamp"))
    else:
        number = F.col(batch)
    return F.call_function("shiftright", number.cast("bigint"), F.lit(BLOCK_BITS))


def running_counts(
    deltas: DataFrame, batch: str = "batch", key: str = "word", block: Column | None = None
) -> DataFrame:
    """Total of each key after each batch it occurs in.

    The batches are cut into blocks of 1,024 numbers, days or seconds, or by a ``block``
    of the caller's. Totals of blocks are summed up first, then the batches inside each
    block, so no task has to walk through all the batches of a key that is in every one.
    """
    block = batch_block(deltas, batch) if block is None else block
    steps = (
        deltas.withColumn("_block", block)
        .groupBy(key, "_block", batch)
        .agg(F.sum("n").alias("n"))
    )
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = Window.partitionBy(key, "_block").orderBy(batch).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = (
        deltas.withColumn("_block", block)
        .groupBy(key, "_block")
        .agg(F.sum("n").alias("_sum"))
        .select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return (
        steps.withColumn("_inside", F.sum("n").over(inside))
        .join(offsets, [key, "_block"])
        .select(batch, key, "n", (F.col("_before") + F.col("_inside")).alias("total"))
    )


def counts_as_of(deltas: DataFrame, until: Column, batch: str = "batch") -> DataFrame:
    """Counts a reader sees once the batches up to ``until`` are complete."""
    return reduce_by_key(
        deltas.where(F.col(batch) <= until), "word", F.sum("n").alias("n")
    )

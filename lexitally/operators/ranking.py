"""Ranked answers: the whole order, the first K, K per batch, and the JSON form.

The order is by count, then by word, both descending, so every answer is determined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitally.operators.order import numbered
from lexitally.session import written

# Fixed value: the largest answer a capped store gives is one row more than this.
MAX_K = 1000
NO_K = "Could not extract topK value from the request query params Map()"


def parse_k(k: int | str | None) -> int:
    """K as a 32-bit integer, from a number or from text."""
    if k is None:
        raise ValueError(NO_K)
    text = str(k)
    if isinstance(k, bool) or not re.fullmatch(r"[+-]?[0-9]+", text):
        raise ValueError(f"The requested topK value {k} is invalid")
    value = int(text)
    if not -(2**31) <= value < 2**31:
        raise ValueError(f"The requested topK value {k} is invalid")
    return value


def _order(n: str, word: str):
    return F.desc(n), F.desc(word)


def ranked_words(counts: DataFrame, n: str = "n", word: str = "word") -> DataFrame:
    return counts.orderBy(*_order(n, word))


def _size(k: int | str, max_k: int | None) -> int:
    size = max(parse_k(k), 0)
    return size if max_k is None else min(size, max_k + 1)


def top_k(
    counts: DataFrame, k: int | str, max_k: int | None = MAX_K, n: str = "n", word: str = "word"
) -> DataFrame:
    """The first K words; none if K is not positive.

    The store gives positions 0 to ``max_k``, so up to ``max_k + 1`` rows; with None it
    gives any number, sorted by range, so that no task holds them all.
    """
    if max_k is None:
        ranked = with_rank(counts, k, None, n, word)
        return ranked.orderBy("rank").select(word, n)
    return ranked_words(counts, n, word).limit(_size(k, max_k))


def with_rank(
    counts: DataFrame, k: int | str, max_k: int | None = MAX_K, n: str = "n", word: str = "word"
) -> DataFrame:
    """The first K words with their positions; only up to ``max_k + 1`` meet in one task."""
    size = _size(k, max_k)
    if max_k is None:
        placed = numbered(counts.select(word, n), *_order(n, word))
        return placed.where(F.col("place") < size).select(
            (F.col("place") + 1).alias("rank"), word, n
        )
    position = F.row_number().over(Window.orderBy(*_order(n, word)))
    top = top_k(counts, k, max_k, n, word)
    return top.select(position.cast("bigint").alias("rank"), word, n)


def json_answer(counts: DataFrame, k: int | str, max_k: int = MAX_K) -> DataFrame:
    """One row ``{"topK":K,"wordCounts":[["word",n],...]}``, best word first.

    The list stands in one row, so it is capped.
    """
    top = top_k(counts, k, max_k)
    ranked = F.sort_array(F.collect_list(F.struct("n", "word")), asc=False)
    # The list with just the word, its end replaced by the count: quoting is Spark's.
    pairs = F.transform(
        ranked,
        lambda e: F.concat(
            F.rtrim(F.to_json(F.array(e["word"])), F.lit("]")), F.format_string(",%d]", e["n"])
        ),
    )
    body = F.format_string(
        '{"topK":%d,"wordCounts":[%s]}', F.lit(parse_k(k)), F.concat_ws(",", pairs)
    )
    return top.agg(body.alias("answer"))


# Slices of a group that are cut to their first rows before the group is put together.
SLICES = 64
# Batches of a block that one task looks at, as a power of two.
BATCH_BLOCK_BITS = 8


def first_per_group(
    rows: DataFrame, group: Sequence[str], size: int, n: str = "n", word: str = "word"
) -> DataFrame:
    """The first ``size`` rows of each group, however large the group is."""
    def cut(rows: DataFrame, *by: str) -> DataFrame:
        best = Window.partitionBy(*by).orderBy(*_order(n, word))
        placed = rows.withColumn("_place", F.row_number().over(best))
        return placed.where(F.col("_place") <= size).drop("_place")

    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(word), F.lit(SLICES)))
    return cut(cut(dealt, *group, "_deal").drop("_deal"), *group)


def top_k_per_batch(
    running: DataFrame,
    k: int | str,
    batch_no: str = "batch_no",
    total: str = "total",
    word: str = "word",
) -> DataFrame:
    """The first K words after every batch, words absent from that batch included.

    ``running`` has one row per batch and word that occurs in it: the batch (a value of
    any kind that grows with time; a row without one fails the job) and the word's total
    so far. Batches are numbered from 0 first. A total holds until the word's next batch.
    Each such span is cut into the nodes of a dyadic tree, at most two per level; a word
    among the first K of a batch is among the first K of the node that brings it there,
    so only K words per node go on. Nodes are handed down to blocks of batches, again K words
    per block, and inside the blocks to their batches. Nothing is ever spread out over
    batches times words, and no table with a row per batch is broadcast.
    """
    size = max(parse_k(k), 0)
    level, first, last = F.col("_level"), F.col("_first"), F.col("_last")
    missing = F.raise_error(F.lit("top_k_per_batch: a row has no batch"))
    running = running.select(
        F.coalesce(F.col(batch_no), missing.cast(running.schema[batch_no].dataType)).alias("_batch"),
        word,
        total,
    )
    running = written(running, "running")
    batches = written(
        numbered(running.select("_batch").distinct(), F.col("_batch"), name="_no"), "batches"
    )
    many = batches.count()
    # The totals of a word, blocks of batches at a time, so that a word that is in every
    # batch is not one task's work: the next batch is looked up inside the block, and at
    # the end of a block it is the first batch of the word's next block.
    # Both tables are small as files, which says nothing about them in memory.
    spans = running.join(batches.hint("merge"), "_batch").select(
        word, total, F.col("_no").alias("_from"), F.shiftright("_no", 12).alias("_block")
    )
    inside = Window.partitionBy(word, "_block").orderBy("_from")
    across = Window.partitionBy(word).orderBy("_block")
    block_starts = spans.groupBy(word, "_block").agg(F.min("_from").alias("_start"))
    next_block = block_starts.select(
        word, "_block", F.lead("_start").over(across).alias("_next_start")
    )
    spans = (
        spans.withColumn("_next", F.lead("_from").over(inside))
        .join(next_block, [word, "_block"])
        .withColumn("_until", F.coalesce("_next", "_next_start", F.lit(many)))
    )
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    # A span of n batches has no node above level log2(n).
    highest = F.length(F.bin(F.col("_until") - F.col("_from"))) - 1
    span_levels = F.explode(F.sequence(F.lit(0), highest)).alias("_level")
    ends = spans.select(word, total, "_from", "_until", span_levels).select(
        word,
        total,
        level,
        F.call_function("shiftright", F.col("_from") + step - 1, level).alias("_first"),
        F.call_function("shiftright", F.col("_until"), level).alias("_last"),
    )
    cut = ends.where(first < last).select(
        word,
        total,
        level,
        F.explode(
            F.array(F.when(first % 2 == 1, first), F.when(last % 2 == 1, last - 1))
        ).alias("_node"),
    ).where(F.col("_node").isNotNull())
    node_tops = first_per_group(cut, ["_level", "_node"], size, total, word)

    high = level >= BATCH_BLOCK_BITS
    shift = F.abs(level - BATCH_BLOCK_BITS)
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    start = F.col("_node") * step
    handed = node_tops.where(high).select(
        word, total, F.explode(F.sequence(start, start + step - 1)).alias("_block")
    )
    handed = first_per_group(handed, ["_block"], size, total, word)
    handed = handed.select(word, total, "_block", F.lit(BATCH_BLOCK_BITS).alias("_level"), F.col("_block").alias("_node"))
    low = node_tops.where(~high).select(
        word, total, F.call_function("shiftright", F.col("_node"), shift).alias("_block"), "_level", "_node"
    )
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    start = F.col("_node") * step
    # A block's rows are in one task before they are spread out, and are not moved again.
    found = handed.unionByName(low).repartition("_block").select(
        "_block", word, total, F.explode(F.sequence(start, start + step - 1)).alias("_no")
    )
    final = Window.partitionBy("_block", "_no").orderBy(*_order(total, word))
    first = found.withColumn("rank", F.row_number().over(final).cast("bigint"))
    first = first.where(F.col("rank") <= size)
    return first.join(batches.hint("merge"), "_no").select(
        F.col("_batch").alias(batch_no), "rank", word, total
    )

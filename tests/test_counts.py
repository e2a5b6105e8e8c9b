"""Counts, running totals and ranked answers."""

import io
import json
import random
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lexitally.operators import counts, ranking


def frame_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "word string, n bigint")


def by_hand(pairs, k):
    return sorted(pairs, key=lambda p: (p[1], p[0]), reverse=True)[:k]


PAIRS = [("a", 3), ("b", 5), ("c", 3), ("d", 1), ("e", 5)]


def test_top_k_and_ties(spark):
    rows = ranking.top_k(frame_of(spark, PAIRS), 4).collect()
    assert [tuple(r) for r in rows] == [("e", 5), ("b", 5), ("c", 3), ("a", 3)]


@pytest.mark.parametrize("k, size", [(0, 0), (-3, 0), ("2", 2), ("+3", 3), (100, 5)])
def test_top_k_sizes(spark, k, size):
    assert ranking.top_k(frame_of(spark, PAIRS), k).count() == size


@pytest.mark.parametrize("k", ["", "x", "1.5", " 2", "2147483648", True])
def test_bad_k(k):
    with pytest.raises(ValueError, match="invalid"):
        ranking.parse_k(k)


def test_absent_k():
    with pytest.raises(ValueError, match="Could not extract topK"):
        ranking.parse_k(None)


def test_cutoff_is_inclusive(spark):
    many = spark.range(50).select(F.format_string("w%d", "id").alias("word"), F.col("id").alias("n"))
    assert ranking.top_k(many, 40, max_k=10).count() == 11
    assert ranking.top_k(many, 5, max_k=10).count() == 5
    assert ranking.top_k(many, 40).count() == 40


def test_rank(spark):
    rows = ranking.with_rank(frame_of(spark, PAIRS), 3).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "e", 5), (2, "b", 5), (3, "c", 3)]


def test_json_answer(spark):
    odd = PAIRS + [('q"]', 9), ("back\\", 8)]
    answer = ranking.json_answer(frame_of(spark, odd), 4).first().answer
    assert json.loads(answer) == {
        "topK": 4, "wordCounts": [['q"]', 9], ["back\\", 8], ["e", 5], ["b", 5]],
    }
    plain = ranking.json_answer(frame_of(spark, PAIRS), 2).first().answer
    assert plain == '{"topK":2,"wordCounts":[["e",5],["b",5]]}'
    assert ranking.json_answer(frame_of(spark, []), 2).first().answer == '{"topK":2,"wordCounts":[]}'


def test_merged_parts_equal_the_whole(spark):
    texts = [("red apples and red pears",), ("apples fell",), (None,), ("",), ("pears",)]
    whole = spark.createDataFrame(texts, "text string")
    parts = [spark.createDataFrame([t], "text string") for t in texts]
    merged = counts.merge_counts(*[counts.word_counts(p) for p in parts])
    assert sorted(merged.collect()) == sorted(counts.word_counts(whole).collect())


def test_reducers(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v int")
    rows = counts.reduce_by_key(frame, "k", F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert {tuple(r) for r in rows.collect()} == {("a", 1, 5), ("b", 2, 2)}


def made_up_deltas(seed, words, batches, size):
    rng = random.Random(seed)
    # One word is in nearly every batch.
    rows = Counter()
    for batch in rng.sample(range(batches), size):
        rows[(batch, "often")] += rng.randrange(1, 4)
        for _ in range(rng.randrange(3)):
            rows[(batch, f"w{rng.randrange(words)}")] += rng.randrange(1, 6)
    return [(b, w, n) for (b, w), n in rows.items()]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_counts(spark, block):
    deltas = made_up_deltas(1, 5, 60, 40)
    frame = spark.createDataFrame(deltas, "batch bigint, word string, n bigint")
    size = F.floor(F.col("batch") / block)
    found = {
        (r.batch, r.word): r.total
        for r in counts.running_counts(frame, block=size).collect()
    }
    assert found == {
        (b, w): sum(n for b2, w2, n in deltas if w2 == w and b2 <= b) for b, w, _ in deltas
    }
    as_of = counts.counts_as_of(frame, F.lit(30)).collect()
    want = Counter()
    for b, w, n in deltas:
        if b <= 30:
            want[w] += n
    assert {r.word: r.n for r in as_of} == dict(want)


EPOCH_MILLIS = 1_790_000_000_000


@pytest.mark.parametrize(
    "k, batches, size, first",
    [
        (1, 30, 20, 0), (3, 20_000, 60, EPOCH_MILLIS), (4, 9_000, 40, -5_000), (1200, 40, 25, 0),
        (2, 10, 6, 2**62),
    ],
)
def test_top_k_per_batch(spark, k, batches, size, first):
    deltas = made_up_deltas(k, 12, batches, size)
    totals, running, want = Counter(), [], {}
    for batch in sorted({b for b, _, _ in deltas}):
        for _, word, n in [d for d in deltas if d[0] == batch]:
            totals[word] += n
            running.append((first + batch, word, totals[word]))
        want[first + batch] = by_hand(totals.items(), k)
    frame = spark.createDataFrame(running, "batch_no bigint, word string, total bigint")
    rows = ranking.top_k_per_batch(frame, k).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.batch_no, r["rank"])):
        found.setdefault(r.batch_no, []).append((r.word, r.total))
    assert found == want


def test_batches_are_never_broadcast(spark):
    """A table with a row per batch is small as a file, and many times that on the driver."""
    running = spark.range(3_000).select(
        F.col("id").alias("batch_no"), F.concat(F.lit("w"), F.col("id") % 5).alias("word"), F.col("id").alias("total")
    )
    rows = ranking.top_k_per_batch(running, 2)
    assert rows.count() == 2 * 3_000 - 1
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain("formatted")
    merged = re.findall(r"SortMergeJoin.*\nLeft keys \[\d+\]: \[(\w+)#", out.getvalue())
    assert {"_batch", "_no"} <= set(merged)


def test_a_row_without_a_batch_fails(spark):
    frame = spark.createDataFrame([(1, "a", 1), (None, "b", 2)], "batch_no bigint, word string, total bigint")
    with pytest.raises(Exception, match="has no batch"):
        ranking.top_k_per_batch(frame, 1).collect()


@pytest.mark.parametrize("kind", ["bigint", "date", "timestamp", "timestamp_ntz"])
def test_running_counts_of_any_kind_of_batch(spark, kind):
    frame = spark.range(3000).select(F.col("id").alias("batch"), F.lit("w").alias("word"), F.lit(1).alias("n"))
    if kind == "date":
        frame = frame.withColumn("batch", F.date_from_unix_date(F.col("batch").cast("int")))
    elif kind != "bigint":
        frame = frame.withColumn("batch", F.timestamp_seconds("batch").cast(kind))
    totals = [r.total for r in counts.running_counts(frame).orderBy("batch").collect()]
    assert totals == list(range(1, 3001))


def test_an_answer_without_a_cap_is_sorted_by_range(spark):
    many = spark.range(5000).select(F.format_string("w%04d", "id").alias("word"), (F.col("id") % 7).alias("n"))
    want = sorted(((r.n, r.word) for r in many.collect()), reverse=True)[:4000]
    assert [(r.n, r.word) for r in ranking.top_k(many, 4000, max_k=None).collect()] == want
    ranked = ranking.with_rank(many, 4000, max_k=None).collect()
    assert sorted((r["rank"], r.n, r.word) for r in ranked) == [
        (i + 1, n, word) for i, (n, word) in enumerate(want)
    ]

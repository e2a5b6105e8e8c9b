"""A topic in a folder: late starts, restarts, limits, replays and odd records."""

import glob
import os

import pytest
from lexitally.sources import feeds, topic
from pyspark.sql import functions as F


def publish(spark, folder, *ranges):
    """Ranges of numbered descriptions as micro-batches of the topic."""
    for begin, end in ranges:
        rows = spark.range(begin, end, 1, 2).select(
            F.format_string("P%d", "id").alias("product_id"), F.col("id").cast("string").alias("text")
        )
        rows.write.mode("append").parquet(f"{folder}/feed")
        records = feeds.topic_records(feeds.table_stream(spark, f"{folder}/feed"))
        run(topic.topic_writer(records, f"{folder}/topic"), f"{folder}/publisher").awaitTermination()


def run(writer, checkpoint):
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark, folder, name, starting, limit=None):
    """The query, which takes what there is and goes on."""
    rows = topic.follow_topic(spark, f"{folder}/topic", starting, limit, f"{folder}/{name}/progress")
    writer = feeds.topic_text(rows, "offset").writeStream.format("parquet").option("path", f"{folder}/{name}/out")
    query = writer.option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(processingTime="100 milliseconds").start()
    query.processAllAvailable()
    return query


def received(spark, folder, name):
    rows = spark.read.parquet(f"{folder}/{name}/out").collect()
    assert all(r.product_id == f"P{r.text}" for r in rows)
    return sorted(r.offset for r in rows)


def test_a_batch_is_appended_once(spark, folder):
    publish(spark, folder, (0, 10), (10, 25))
    for place in ("commits/1", "commits/.1.crc"):
        os.remove(f"{folder}/publisher/{place}")
    files = len(glob.glob(f"{folder}/topic/data/*"))
    publish(spark, folder, (25, 26))
    rows = topic.read_topic(spark, f"{folder}/topic").collect()
    assert sorted(r.offset for r in rows) == list(range(26))
    assert {bytes(r.key) for r in rows} == {f"P{i}".encode() for i in range(26)}
    # Offsets go by batch, and what the batch wrote when it ran again is gone.
    assert all(r.batch == (0 if r.offset < 10 else 1 if r.offset < 25 else 2) for r in rows)
    assert len(glob.glob(f"{folder}/topic/data/*")) <= files + 2
    early = topic.read_topic(spark, f"{folder}/topic", end=7)
    assert sorted(r.offset for r in early.collect()) == list(range(7))


def test_a_late_start_sees_only_what_is_new(spark, folder):
    publish(spark, folder, (0, 20))
    query = follow(spark, folder, "late", "latest")
    try:
        publish(spark, folder, (20, 30))
        query.processAllAvailable()
    finally:
        query.stop()
    publish(spark, folder, (30, 35))
    follow(spark, folder, "late", "latest").stop()
    # The restart goes on where it was, not at the latest record.
    assert received(spark, folder, "late") == list(range(20, 35))
    # Reading has changed nothing: another reader has all of it.
    follow(spark, folder, "other", "earliest").stop()
    assert received(spark, folder, "other") == list(range(35))


def test_batches_have_a_limit(spark, folder):
    publish(spark, folder, (0, 20))
    query = follow(spark, folder, "slow", "earliest", 8)
    query.stop()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [8, 8, 4]
    publish(spark, folder, (20, 40))
    query = follow(spark, folder, "slow", "earliest", 8)
    query.stop()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [8, 8, 4]
    assert received(spark, folder, "slow") == list(range(40))
    with pytest.raises(ValueError, match="progress"):
        topic.TopicStreamReader({"path": folder, "recordsperbatch": "5"})


def test_odd_records(spark, folder):
    rows = spark.createDataFrame([(None, b"v"), (b"k", None), (b"", b"\x00\xff"), (None, None)], "key binary, value binary")
    rows.coalesce(1).write.parquet(f"{folder}/feed")
    assert topic.read_topic(spark, f"{folder}/topic").count() == 0
    records = feeds.table_stream(spark, f"{folder}/feed").withColumn("offset", F.lit("clash"))
    run(topic.topic_writer(records, f"file:{folder}/topic"), f"{folder}/publisher").awaitTermination()
    found = topic.read_topic(spark, f"{folder}/topic").select("key", "value").collect()
    assert sorted(map(str, found)) == sorted(map(str, rows.collect()))

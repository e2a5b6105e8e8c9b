"""Streams against batches, replays, restarts and readers in between."""

import glob
import os
import random

import pytest
from lexitally.operators import counts, keyset, requests
from lexitally.plans import jobs as plans
from lexitally.plans.jobs import feed_of
from lexitally.session import Scratch, remove, scratch_dir, written
from lexitally.sources import feeds, stores
from lexitally.sources.tables import request_rows
from lexitally.streaming import jobs
from lexitally.streaming.keys import stream_insert
from pyspark.sql import functions as F

PARTS = [
    [("A", "red apples"), ("B", "red pears")],
    [("C", "green apples and pears")],
    [("D", "apples"), ("E", None)],
]
SCHEMA = "product_id string, text string"


def part(spark, i):
    return spark.createDataFrame(PARTS[i], SCHEMA)


def whole(spark, until=2):
    return spark.createDataFrame([r for p in PARTS[: until + 1] for r in p], SCHEMA)


def as_dict(rows):
    return {r.word: r.n for r in rows.collect()}


def feed_and_run(spark, folder, *rows):
    store = stores.StreamStore(spark, folder)
    jobs.run_counts(feed_of(spark, rows, folder), store, None).awaitTermination()
    return store


def test_counts_as_of_every_batch(spark, folder):
    """With a restart between the first batches, and two batches of one run after that."""
    assert stores.StreamStore(spark, folder).counts().count() == 0
    feed_and_run(spark, folder, part(spark, 0))
    store = feed_and_run(spark, folder, part(spark, 1), part(spark, 2))
    assert store.batches(stores.COUNTS) == (0, 2)
    deltas = store.deltas()
    for until in range(3):
        want = as_dict(counts.word_counts(whole(spark, until)))
        assert as_dict(store.counts(until)) == want
        as_of = counts.counts_as_of(deltas, F.lit(until), stores.BATCH)
        assert as_dict(as_of) == want
        own = as_dict(counts.word_counts(part(spark, until)))
        assert as_dict(deltas.where(F.col(stores.BATCH) == until)) == own
        if until:
            assert as_dict(store.deltas(until).where(F.col(stores.BATCH) == until)) == own
    assert as_dict(store.counts(99)) == as_dict(store.counts()) == as_dict(counts.word_counts(whole(spark)))
    assert store.counts(-1).count() == 0


def uncommitted(checkpoint, batch):
    """Makes a checkpoint as it is if the program ended while that batch, its last, was on."""
    for place in glob.glob(f"{checkpoint}/commits/{batch}") + glob.glob(f"{checkpoint}/commits/.{batch}.crc"):
        os.remove(place)


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    store = feed_and_run(spark, folder, part(spark, 0), part(spark, 1))
    before = as_dict(store.counts())
    uncommitted(store.checkpoint(stores.COUNTS), 1)
    store = feed_and_run(spark, folder)
    assert store.batches(stores.COUNTS) == (0, 1)
    assert as_dict(store.counts()) == before == as_dict(counts.word_counts(whole(spark, 1)))
    # So does one that is followed by a new one.
    uncommitted(store.checkpoint(stores.COUNTS), 1)
    store = feed_and_run(spark, folder, part(spark, 2))
    assert as_dict(store.counts()) == as_dict(counts.word_counts(whole(spark)))


def test_state_of_old_batches_is_dropped(spark, folder):
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", 2)
    try:
        one = spark.createDataFrame([("A", "apples")], SCHEMA)
        store = feed_and_run(spark, folder, *[one] * 8)
        assert as_dict(store.counts()) == {"appl": 8}
        oldest, newest = store.batches(stores.COUNTS)
        assert newest == 7 and oldest > 0
        assert as_dict(store.counts(6)) == {"appl": 7}
        with pytest.raises(ValueError, match="no longer kept"):
            store.counts(0)
        added = {(r.batch_id, r.n) for r in store.deltas().collect()}
        assert added == {(batch, 1) for batch in range(oldest + 1, 8)}
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")


def test_a_batch_writes_what_it_changed(spark, folder):
    """However much the state holds: a small batch adds small files to it."""
    many = spark.range(20_000).select(
        F.lit("A").alias("product_id"), F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjklm").alias("text")
    )
    store = feed_and_run(spark, folder, many)

    def size():
        places = glob.glob(f"{store.checkpoint(stores.COUNTS)}/state/**", recursive=True)
        return sum(os.path.getsize(p) for p in places if os.path.isfile(p))

    first = size()
    for i in range(3):
        feed_and_run(spark, folder, part(spark, i))
    assert size() - first < first / 4
    assert as_dict(store.counts(0)) == as_dict(counts.word_counts(many))


def test_batches_of_ones_own(spark, folder):
    """A folder per batch; a batch that runs again replaces its own."""
    tables = stores.BatchFolder(spark, folder)
    assert tables.read("t", stores.COUNTS_SCHEMA).count() == 0
    seen = []

    def write(rows, batch_id):
        seen.append(batch_id)
        tables.write("t", batch_id, counts.word_counts(rows))

    feed = feed_of(spark, [part(spark, 0), part(spark, 1)], folder)
    jobs.run_batches(feed, f"{folder}/checkpoint", write, None).awaitTermination()
    uncommitted(f"{folder}/checkpoint", 1)
    jobs.run_batches(feed, f"{folder}/checkpoint", write, None).awaitTermination()
    assert seen == [0, 1, 1]
    merged = counts.merge_counts(tables.read("t", stores.COUNTS_SCHEMA))
    assert as_dict(merged) == as_dict(counts.word_counts(whole(spark, 1)))


# Keys in the state


@pytest.fixture(scope="module")
def keyed():
    """Rows in three batches: few keys, one of them with a third of the rows, nulls and ties."""
    random.seed(11)
    rows = []
    for n in range(600):
        key = None if n % 17 == 0 else "hot" if n % 3 == 0 else f"k{random.randrange(40)}"
        at = None if n % 23 == 0 else random.randrange(50)
        rows.append((key, at, n if n % 29 else None, n / 7, random.randrange(3)))
    return rows


KEYED = "k string, at bigint, id bigint, v double, batch int"


def keyed_batches(spark, rows):
    frame = spark.createDataFrame(rows, KEYED).withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz"))
    return [frame.where(F.col("batch") == batch) for batch in range(3)], frame


@pytest.mark.parametrize("restarted", [False, True])
def test_stored_keys_equal_the_batch(spark, folder, keyed, restarted):
    rows = random.Random(restarted).sample(keyed, len(keyed))
    batches, frame = keyed_batches(spark, rows)
    store = stores.StreamStore(spark, folder)
    for some in [[b] for b in batches] if restarted else [batches]:
        feed = feed_of(spark, some, folder)
        query = jobs.run_insert(feed, "k", ("ts", "id"), store, None, F.xxhash64("v"))
        query.awaitTermination()
    answers = store.read(stores.SEEN, f"{KEYED}, ts timestamp_ntz, batch_id bigint, stored boolean, first boolean")
    answers.cache()
    assert answers.count() == len(rows)
    assert answers.where("batch_id <> batch or (k is null and (stored or first))").count() == 0
    # One row of each key is first, the least by place of the first batch that has the key.
    want = keyset.first_wins(frame.withColumn("b", F.timestamp_seconds("batch")), "k", ["b"])
    firsts = answers.where("first")
    assert {(r.k, r.batch_id) for r in firsts.collect()} == {(r.k, r.b.second) for r in want.collect()}
    for batch, own in enumerate(batches):
        known = {r.k for r in firsts.where(F.col("batch_id") < batch).collect()}
        new = own.where(~F.col("k").isin(list(known))) if known else own
        least = {(r.k, r.ts, r.id) for r in keyset.first_wins(new, "k", ["ts", "id"]).collect()}
        got = firsts.where(F.col("batch_id") == batch).collect()
        assert {(r.k, r.ts, r.id) for r in got} == least and len(got) == len(least)
        assert {r.k for r in store.seen(batch, key="k").collect()} == known | {k for k, _, _ in least}
        assert answers.where(F.col("batch_id") == batch).where("stored").select("k").distinct().count() == len(
            {r[0] for r in rows if r[4] == batch} & known
        )
    flags = {r.batch: (r.duplicate, r.duplicate_strict) for r in keyset.duplicate_flag(frame, "k", "batch").collect()}
    found = answers.where("k is not null").groupBy("batch").agg(
        F.bool_or("stored").alias("duplicate"), F.bool_or(~F.col("first")).alias("strict")
    )
    assert {r.batch: (r.duplicate, r.strict) for r in found.collect()} == flags
    # Values come back as they went in.
    columns = ["k", "ts", "id", "v", "batch"]
    assert sorted(map(str, answers.select(columns).collect())) == sorted(map(str, frame.select(columns).collect()))


def test_a_batch_of_keys_that_runs_again(spark, folder, keyed):
    batches, _ = keyed_batches(spark, keyed)
    store = stores.StreamStore(spark, folder)

    def run(*some):
        feed = feed_of(spark, some, folder)
        jobs.run_insert(feed, "k", ("ts", "id"), store, None, F.xxhash64("v")).awaitTermination()
        answers = store.read(stores.SEEN, f"{KEYED}, batch_id bigint, stored boolean, first boolean")
        return sorted(map(str, answers.collect())), sorted(map(str, store.seen(key="k").collect()))

    before = run(*batches[:2])
    uncommitted(store.checkpoint(stores.SEEN), 1)
    assert run() == before
    assert store.seen(key="k").count() < len(run(batches[2])[1]) + 1


@pytest.mark.parametrize("restarted", [False, True])
def test_a_part_of_many_files_is_one_batch(spark, folder, restarted, monkeypatch):
    """Parts of many rows, of one and of none; those of many rows are not one file."""
    spark.range(20_000, numPartitions=4).selectExpr("concat('P', id) product_id", "id").write.parquet(f"{folder}/a b")
    rows = spark.read.parquet(f"{folder}/a b")
    sizes = [os.path.getsize(name) for name in glob.glob(f"{folder}/a b/*.parquet")]
    monkeypatch.setattr(plans, "FEED_FILE", sum(sizes) // 5 + 1)
    parts = [rows.where("id < 9000"), rows.where("id = 9000"), rows.where("id < 0"), rows.where("id > 9000")]
    seen = []

    def write(batch, batch_id):
        seen.append((batch_id, batch.count(), batch.select(F.input_file_name()).distinct().count()))

    for some in [[part] for part in parts] if restarted else [parts]:
        feed = feed_of(spark, some, folder)
        jobs.run_batches(feed, f"{folder}/checkpoint", write, None).awaitTermination()
    assert seen == [(0, 9_000, 5), (1, 1, 1), (2, 0, 0), (3, 10_999, 5)]


def test_keys_need_an_order(spark, folder):
    rows = feed_of(spark, [part(spark, 0)], folder)
    with pytest.raises(ValueError, match="text"):
        stream_insert(rows, "product_id", ["text"])


def test_counts_in_stream_state(spark, folder):
    whole(spark).repartition(3).write.parquet(f"{folder}/feed")
    feed = feeds.table_stream(spark, f"{folder}/feed", files_per_batch=1)
    query = (
        jobs.stream_word_counts(feed)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("words_so_far")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert as_dict(spark.table("words_so_far")) == as_dict(counts.word_counts(whole(spark)))


REQUESTS = [
    [(1, "P1"), (2, "P1"), (3, "P2"), (4, "P9")],
    [(5, "P2"), (6, "P3"), (7, None), (8, "P9"), (9, "P3")],
    [(10, "P1"), (11, "P4")],
]


def asked(spark, rows):
    urls = [(i, f"http%3A%2F%2Fwww.amazon.com%2Fproduct%2F{p}" if p else "%zz") for i, p in rows]
    return spark.createDataFrame(urls, "request_id bigint, url string").select(
        "request_id", F.timestamp_micros("request_id").cast("timestamp_ntz").alias("ts"), "url"
    )


@pytest.mark.parametrize("restarted", [False, True])
def test_request_stream_equals_the_batch(spark, folder, restarted):
    found = spark.createDataFrame(
        [(f"P{i}", f"word{'x' * i} apples") for i in range(1, 5)], SCHEMA
    )
    store = stores.StreamStore(spark, folder)
    parts = [asked(spark, rows) for rows in REQUESTS]
    for some in [[p] for p in parts] if restarted else [parts]:
        feed = feed_of(spark, some, folder)
        jobs.run_requests(feed, found, store, None).awaitTermination()
        jobs.run_counts(jobs.stream_accepted(store, found), store, None).awaitTermination()
    jobs.run_accepted(store, found, None).awaitTermination()
    everything = asked(spark, [r for rows in REQUESTS for r in rows])
    outcomes = store.read(stores.OUTCOMES, stores.OUTCOMES_SCHEMA)
    batch = requests.request_outcome(everything, found)
    columns = ["request_id", "ts", "product_id", "host", "status", "message"]
    assert sorted(map(str, outcomes.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    assert {r.batch_id for r in outcomes.collect()} == {0, 1, 2}
    accepted = requests.accepted_descriptions(everything, found)
    assert as_dict(store.counts()) == as_dict(counts.word_counts(accepted))
    want = sorted(accepted.select("product_id", "text").collect())
    kept = store.read(stores.DESCRIPTIONS, stores.DESCRIPTIONS_SCHEMA)
    assert sorted(kept.select("product_id", "text").collect()) == want
    stored = store.seen(query=stores.OUTCOMES)
    won = outcomes.where("status = 201").select("product_id", "batch_id")
    assert sorted(stored.collect()) == sorted(won.collect())


def test_stream_and_batch_agree_on_odd_requests(spark, folder):
    """Requests without a time, without a number, and several without both."""
    rows = [(None, None, "A/1"), (None, None, "A/2"), (3, None, "B/1"), (1, 5, "B/2"), (None, 4, "C/1"), (2, 4, "C/2")]
    urls = [(i, t, f"http%3A%2F%2Fwww.amazon.com%2Fproduct%2F{p.replace('/', '%2F')}") for i, t, p in rows * 2]
    frame = spark.createDataFrame(urls, "request_id bigint, t bigint, url string").select(
        "request_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "url"
    ).distinct()
    found = spark.createDataFrame([("A",), ("B",), ("C",)], "product_id string")
    store = stores.StreamStore(spark, folder)
    jobs.run_requests(feed_of(spark, [frame], folder), found, store, None).awaitTermination()
    stream = store.read(stores.OUTCOMES, stores.OUTCOMES_SCHEMA).where("status = 201")
    batch = requests.request_outcome(frame, found).where("status = 201")
    columns = ["product_id", "request_id", "ts"]
    assert sorted(map(str, stream.select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    assert stream.count() == 3


def test_a_description_that_comes_later_is_accepted(spark, folder):
    """Between two batches of one running query, without a restart."""
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/texts")

    store = stores.StreamStore(spark, folder)
    write([("P1", "apples")])
    there = spark.read.parquet(f"{folder}/texts")
    texts = feeds.table_stream(spark, f"{folder}/texts")
    asked(spark, [(1, "P9"), (2, "P1")]).write.parquet(f"{folder}/feed")
    feed = feeds.table_stream(spark, f"{folder}/feed")
    query = jobs.run_requests(feed, there, store, 100, arriving=texts)
    try:
        query.processAllAvailable()
        write([("P9", "pears")])
        asked(spark, [(3, "P9"), (4, "P9"), (5, "P8")]).write.mode("append").parquet(f"{folder}/feed")
        query.processAllAvailable()
        asked(spark, [(6, "P9"), (7, "P1")]).write.mode("append").parquet(f"{folder}/feed")
        query.processAllAvailable()
    finally:
        query.stop()
    statuses = {r.request_id: r.status for r in store.read(stores.OUTCOMES, stores.OUTCOMES_SCHEMA).collect()}
    # The request that came with the description, or the next one, finds it.
    first = min(i for i in (3, 6) if statuses[i] == 201)
    assert statuses | {3: 201, 4: 200, 6: 200} == {1: 404, 2: 201, 3: 201, 4: 200, 5: 404, 6: 200, 7: 200}
    assert first == 3 or statuses[3] == statuses[4] == 404
    # Texts that come while it runs are followed as a stream as well, and joined as such.
    jobs.run_accepted(store, texts, None).awaitTermination()
    accepted = store.stream(stores.DESCRIPTIONS, stores.DESCRIPTIONS_SCHEMA)
    jobs.run_counts(accepted, store, None).awaitTermination()
    assert as_dict(store.counts()) == {"appl": 1, "pear": 1}


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_first_wins_on_a_stream(spark, folder, delay):
    found = spark.createDataFrame([("P1", "a"), ("P2", "b"), ("P3", "c")], SCHEMA)
    rows = asked(spark, [r for rows in REQUESTS for r in rows]).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    rows.repartition(4).write.parquet(f"{folder}/feed")
    feed = feeds.table_stream(spark, f"{folder}/feed", files_per_batch=1)
    query = (
        jobs.stream_first_wins(feed, found, delay)
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = [r.product_id for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(kept) == ["P1", "P2", "P3"]


def test_interval_trigger(spark, folder):
    part(spark, 0).write.parquet(f"{folder}/feed")
    store = stores.StreamStore(spark, folder)
    feed = feeds.table_stream(spark, f"{folder}/feed")
    query = jobs.run_counts(feed, store, 200)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert as_dict(store.counts()) == as_dict(counts.word_counts(part(spark, 0)))


def test_topic_records_round_trip(spark):
    rows = part(spark, 0)
    back = feeds.topic_text(feeds.topic_records(rows))
    assert back.collect() == rows.collect()


def test_request_rows(spark):
    events = spark.createDataFrame(
        [(1201, "view"), (4, "error"), (5, "error"), (6, "signup")],
        "event_id bigint, event_type string",
    ).withColumn("ts", F.current_timestamp())
    located = requests.locate(request_rows(events)).orderBy("request_id").collect()
    assert [(r.product_id, r.host) for r in located] == [
        (None, None), (None, None), ("P6", "www.amazon.co.uk"), ("P1", "www.amazon.de"),
    ]


class Settings(dict):
    """Stands in for a session with the given settings."""

    def __init__(self, master, **conf):
        super().__init__(conf)
        self.conf = self
        self.sparkContext = self
        self.master = master


def test_scratch_folder_is_the_shared_one():
    shared = Settings("spark://host", **{"spark.checkpoint.dir": "hdfs://name/shared/"})
    first = scratch_dir(shared, "x")
    assert first.startswith("hdfs://name/shared/x-") and first != scratch_dir(shared, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Settings("spark://host"), "x")
    assert "/x-" in scratch_dir(Settings("local[2]"), "x")


def test_written_table(spark):
    table = written(part(spark, 0), "t")
    assert sorted(table.collect()) == sorted(part(spark, 0).collect())


def test_a_scratch_folder_can_be_removed(spark, folder):
    part(spark, 0).write.parquet(f"{folder}/table")
    assert remove(spark, f"{folder}/table") and not remove(spark, f"{folder}/table")
    assert not os.path.exists(f"{folder}/table")


def test_scratch_tables_go(spark):
    scratch = Scratch(spark, "tables")
    one, two, three = (scratch.written(part(spark, i), f"t{i}") for i in range(3))
    scratch.drop(one)
    scratch.keep(three)
    places = glob.glob(f"{scratch.root.removeprefix('file://')}/*")
    assert [os.path.basename(place) for place in places] == ["t2-3"]
    assert sorted(map(str, three.collect())) == sorted(map(str, part(spark, 2).collect()))
    scratch.close()
    assert not os.path.exists(scratch.root.removeprefix("file://"))

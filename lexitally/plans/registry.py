"""The runnable queries: each takes a session and a data folder, and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions import addresses, markup, stemming, text, urls
from lexitally.functions.once import with_once
from lexitally.operators import counts, keyset, ranking
from lexitally.operators import requests as asked
from lexitally.plans import jobs
from lexitally.session import scratch_dir, written
from lexitally.sources import feeds, stores, topic
from lexitally.sources.tables import (
    description_rows,
    descriptions,
    item_xml,
    read_table,
    requests,
)
from lexitally.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
TOP = 25
AS_OF = "2024-01-10"
PART_CUTS = ("2024-01-11", "2024-01-21")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def words_of(array) -> Column:
    return F.array_join(array, " ")


# --- sources and sinks ----------------------------------------------------------------


@query
def scan_requests(spark, folder):
    return requests(spark, folder)


def published(spark, parts: list[DataFrame], name: str) -> str:
    """A topic with the descriptions of some parts, a micro-batch each."""
    root = scratch_dir(spark, name)
    records = feeds.topic_records(jobs.feed_of(spark, parts, root))
    writer = topic.topic_writer(records, f"{root}/topic")
    writer = writer.option("checkpointLocation", f"{root}/checkpoint")
    streams.with_trigger(writer, None).start().awaitTermination()
    return f"{root}/topic"


@query
def stream_source(spark, folder):
    """Every description through a topic of key and value records, followed from its start."""
    root = scratch_dir(spark, "source")
    place = published(spark, [descriptions(spark, folder)], "topic")
    received = feeds.topic_text(topic.follow_topic(spark, place, "earliest"))
    writer = received.writeStream.format("parquet").option("path", f"{root}/out")
    writer = writer.option("checkpointLocation", f"{root}/checkpoint")
    streams.with_trigger(writer, None).start().awaitTermination()
    return spark.read.schema(stores.DESCRIPTIONS_SCHEMA).parquet(f"{root}/out")


def page_with_id(html: Column) -> Column:
    """A page whose article has the id of descriptions, with entities and quoted signs."""
    opening = (
        f"<article title='a > b' data-x=\"</article> id='{markup.DESCRIPTION_ID}'\""
        f' id="{markup.DESCRIPTION_ID}">'
    )
    first = "<p>caf&eacute; &mdash; <b title=\"x>y\">it&rsquo;s</b> &#x41;</p>"
    return F.replace(html, F.lit("<article>"), F.lit(opening + first))


@query
def html_by_id(spark, folder):
    """The first paragraph of the element with the id of descriptions."""
    pages = read_table(spark, folder, "pages").select("page_id", "html")
    shown = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(page_with_id(F.col("html")))
    return pages.select("page_id", markup.first_paragraph(shown).alias("text"))


@query
def html_first_text(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select(
        "page_id", markup.first_paragraph(F.col("html"), None, "article").alias("text")
    )


@query
def xml_editorial_review(spark, folder):
    return item_xml(spark, folder).select(
        "doc_id", markup.editorial_review(F.col("xml")).alias("text")
    )


@query
def publish_descriptions(spark, folder):
    """The accepted descriptions, appended to a topic batch by batch and read back."""
    place = published(spark, accepted_parts(spark, folder), "publish")
    return feeds.topic_text(topic.read_topic(spark, place), F.col("batch").alias(stores.BATCH))


def inserted(spark, folder) -> stores.StreamStore:
    """The requested products, stored in the state of a stream of three batches."""
    store = stores.StreamStore(spark, scratch_dir(spark, "seen"))
    rows = asked.locate(requests(spark, folder)).select("request_id", "ts", "product_id")
    feed = jobs.feed_of(spark, jobs.parts_by_time(rows, "ts", PART_CUTS), store.root)
    streams.run_insert(feed, "product_id", asked.ORDER, store, None).awaitTermination()
    return store


@query
def insert_seen(spark, folder):
    """Keys stored batch by batch, each by the first batch that brings it."""
    return inserted(spark, folder).seen()


@query
def scan_seen(spark, folder):
    return inserted(spark, folder).seen().select("product_id")


@query
def stream_insert(spark, folder):
    """Every request of a stream with the answer if its product was stored before."""
    schema = "request_id BIGINT, product_id STRING, batch_id BIGINT, stored BOOLEAN, first BOOLEAN"
    return inserted(spark, folder).read(stores.SEEN, schema)


@query
def stream_duplicate_flag(spark, folder):
    """Per micro-batch, whether it brought a product that was stored before."""
    answers = stream_insert(spark, folder).where(F.col("product_id").isNotNull())
    return answers.groupBy(stores.BATCH).agg(
        F.count("*").alias("rows"),
        F.count_if("first").alias("new_keys"),
        F.bool_or("stored").alias("duplicate"),
        F.bool_or(~F.col("first")).alias("duplicate_strict"),
    )


def counted_in_parts(spark, folder) -> stores.StreamStore:
    return jobs.stream_texts(spark, accepted_parts(spark, folder))


@query
def upsert_counts(spark, folder):
    """Counts that three micro-batches have added to the state of a stream."""
    return counted_in_parts(spark, folder).counts()


@query
def scan_counts(spark, folder):
    """The whole count store, read back."""
    return counted_in_parts(spark, folder).counts()


@query
def json_answer(spark, folder):
    return ranking.json_answer(counts.word_counts(documents(spark, folder)), TOP)


# --- URLs -----------------------------------------------------------------------------


@query
def decode_url(spark, folder):
    return requests(spark, folder).select(
        "request_id", urls.decode_url(F.col("url")).alias("decoded")
    )


@query
def split_path(spark, folder):
    parts = urls.split_path(urls.decode_url(F.col("url")))
    return read_table(spark, folder, "pages").select(
        "page_id",
        F.size(parts).cast("bigint").alias("n"),
        F.array_join(parts, "|").alias("parts"),
    )


@query
def extract_host(spark, folder):
    found = urls.url_text(F.col("url"))
    return read_table(spark, folder, "pages").select(
        "page_id", urls.extract_host(found, "example.").alias("host")
    )


@query
def extract_product_id(spark, folder):
    found = urls.url_text(F.col("url"))
    return read_table(spark, folder, "pages").select(
        "page_id",
        urls.extract_product_id(found, "example.").alias("product_id"),
        urls.extract_product_id(found, "blog").alias("product_id_blog"),
    )


@query
def product_locator(spark, folder):
    locator = urls.product_locator(F.col("url")).alias("_l")
    return requests(spark, folder).select("request_id", locator).select(
        "request_id", "_l.product_id", "_l.host"
    )


@query
def marketplace(spark, folder):
    host = F.col("host")
    return asked.locate(requests(spark, folder)).select(
        "request_id",
        urls.marketplace(host).alias("marketplace"),
        urls.marketplace(host, by_label=False).alias("marketplace_unsplit"),
    )


# --- text -----------------------------------------------------------------------------


@query
def strip_tags(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query
def punct_to_space(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.punct_to_space(F.col("text")).alias("text")
    )


@query
def keep_letters(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.keep_letters(F.col("text")).alias("text")
    )


def lowered(column: str):
    return F.lower(text.keep_letters(text.punct_to_space(text.strip_tags(F.col(column)))))


@query
def lower_text(spark, folder):
    return documents(spark, folder).select("doc_id", lowered("text").alias("text"))


@query
def split_words(spark, folder):
    parts = text.split_words(lowered("text"))
    return documents(spark, folder).select(
        "doc_id",
        F.size(parts).cast("bigint").alias("n"),
        F.array_join(parts, "|").alias("words"),
    )


@query
def min_length(spark, folder):
    kept = F.filter(text.split_words(lowered("html")), text.is_long_enough)
    return read_table(spark, folder, "pages").select("page_id", words_of(kept).alias("words"))


@query
def remove_stopwords(spark, folder):
    return documents(spark, folder).select(
        "doc_id", words_of(text.plain_tokens(F.col("text"))).alias("words")
    )


@query
def remove_listed_words(spark, folder):
    """A stop list of one's own, as a table: here the words of the benchmark passages."""
    listed = counts.plain_words(read_table(spark, folder, "benchmark"), stop_words=())
    left = counts.word_counts(documents(spark, folder), keys=["doc_id"], stop_words=listed)
    return left.groupBy("doc_id").agg(F.sum("n").alias("n"))


@query
def stem_vocabulary(spark, folder):
    return counts.stem_vocabulary(counts.plain_words(documents(spark, folder)))


@query
def stem_steps(spark, folder):
    """Every distinct word after each step of the stemmer; short ones stay as they are."""
    words = counts.plain_words(documents(spark, folder)).distinct()
    out = words.withColumn("_w", F.reverse(stemming.mark_vowel_y(F.col("word"))))
    for step in stemming.STEPS:
        out = out.withColumn("_w", step(F.col("_w"))).withColumn(
            step.__name__,
            F.when(F.length("word") > 2, F.lower(F.reverse("_w"))).otherwise(F.col("word")),
        )
    return out.drop("_w")


@query
def stem_predicates(spark, folder):
    word = F.col("word")
    return counts.plain_words(documents(spark, folder)).distinct().select(
        "word",
        stemming.sound_pattern(word).alias("sounds"),
        stemming.measure(word).alias("turns"),
        stemming.has_vowel(word).alias("has_vowel"),
        stemming.ends_in_double_consonant(word).alias("double_consonant"),
        stemming.ends_short(word).alias("short_end"),
        F.endswith(word, F.lit("ing")).alias("ends_ing"),
    )


@query
def tokenize(spark, folder):
    tokens = text.tokenize(F.col("text"))
    return documents(spark, folder).select("doc_id", tokens.alias("_t")).select(
        "doc_id", F.size("_t").cast("bigint").alias("n"), words_of("_t").alias("tokens")
    )


# --- counts ---------------------------------------------------------------------------


@query
def word_counts(spark, folder):
    return counts.word_counts(documents(spark, folder))


@query
def flat_tokens(spark, folder):
    return counts.flat_tokens(documents(spark, folder), keys=["doc_id"])


@query
def custom_tokenizer(spark, folder):
    """Counts under a tokenizer given by the caller: words as they are written."""
    return counts.word_counts(
        documents(spark, folder), tokenizer=lambda t: F.split(t, r"\s+")
    )


@query
def batch_word_counts(spark, folder):
    return jobs.accepted_by_day(requests(spark, folder), descriptions(spark, folder))


@query
def merge_counts(spark, folder):
    docs = documents(spark, folder)
    even = F.col("doc_id") % 2 == 0
    return counts.merge_counts(
        counts.word_counts(docs.where(even)), counts.word_counts(docs.where(~even))
    )


@query
def reduce_by_key(spark, folder):
    return counts.reduce_by_key(
        read_table(spark, folder, "lineitem"),
        "l_partkey",
        F.sum(F.col("l_quantity").cast("bigint")).alias("sum_quantity"),
        F.max("l_extendedprice").alias("max_price"),
        F.min("l_extendedprice").alias("min_price"),
    )


def events_by_day(spark, folder) -> DataFrame:
    day = F.to_date("ts").alias("day")
    events = read_table(spark, folder, "events").select(day, F.col("event_type").alias("word"))
    return events.groupBy("day", "word").agg(F.count("*").alias("n"))


@query
def running_counts(spark, folder):
    return counts.running_counts(events_by_day(spark, folder), batch="day")


@query
def running_word_counts(spark, folder):
    deltas = written(batch_word_counts(spark, folder), "deltas")
    return counts.running_counts(deltas, batch="day")


@query
def counts_as_of(spark, folder):
    until = F.lit(AS_OF).cast("date")
    return counts.counts_as_of(batch_word_counts(spark, folder), until, batch="day")


# --- key sets -------------------------------------------------------------------------


@query
def contains(spark, folder):
    located = asked.locate(requests(spark, folder)).select("request_id", "product_id")
    stored = descriptions(spark, folder)
    return keyset.contains(located, stored, "product_id")


@query
def new_keys(spark, folder):
    located = asked.locate(requests(spark, folder))
    return keyset.new_keys(located, descriptions(spark, folder), "product_id")


@query
def first_wins(spark, folder):
    located = asked.locate(requests(spark, folder))
    return keyset.first_wins(located, "product_id", asked.ORDER, ["url"])


@query
def duplicate_flag(spark, folder):
    day = F.to_date("ts")
    located = asked.locate(requests(spark, folder)).withColumn("day", day)
    return keyset.duplicate_flag(located, "product_id", "day")


@query
def put_overwrite(spark, folder):
    events = read_table(spark, folder, "events")
    return keyset.put_overwrite(events, "user_id", "value", ["ts", "event_id"])


@query
def batch_remove(spark, folder):
    returned = read_table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    keys = returned.select(F.col("l_orderkey").alias("o_orderkey"))
    return keyset.batch_remove(read_table(spark, folder, "orders"), keys, "o_orderkey").select(
        "o_orderkey", "o_orderstatus"
    )


def part_keys(spark, folder) -> DataFrame:
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key")
    return read_table(spark, folder, "part").select(key)


@query
def key_locator(spark, folder):
    return part_keys(spark, folder).select(
        "key", addresses.key_address(F.col("key")).alias("_a")
    ).select("key", "_a.bucket", "_a.offset")


@query
def seen_bits(spark, folder):
    return keyset.seen_bits(part_keys(spark, folder), "key")


@query
def seen_bitmaps(spark, folder):
    """How many bits are set per bucket, counted in its bitmap pages."""
    pages = keyset.seen_bitmaps(keyset.seen_bits(part_keys(spark, folder), "key"))
    return pages.groupBy("bucket").agg(
        F.sum("n").alias("bits"), F.count("*").alias("pages")
    )


@query
def approx_contains(spark, folder):
    located = asked.locate(requests(spark, folder)).select("request_id", "product_id")
    bits = keyset.seen_bits(descriptions(spark, folder), "product_id")
    return keyset.maybe_contains(located, bits, "product_id")


def set_in_batches(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Requests of three batches with their answers from a bit set, and its pages at the end."""
    located = asked.locate(requests(spark, folder)).select("request_id", "ts", "product_id")
    pages, answers = keyset.no_bitmaps(located), []
    for batch_id, part in enumerate(jobs.parts_by_time(located, "ts", PART_CUTS)):
        answered, pages = keyset.set_and_report(part, pages, "product_id")
        pages = written(pages, "pages")
        answers.append(answered.withColumn(stores.BATCH, F.lit(batch_id).cast("bigint")))
    return reduce(DataFrame.unionByName, answers).drop("ts"), pages


@query
def set_and_report(spark, folder):
    """Every request with the answer if its product's bit was set by an earlier batch."""
    return set_in_batches(spark, folder)[0]


@query
def merged_bitmaps(spark, folder):
    """How many bits are set per bucket in pages that were merged batch by batch."""
    pages = set_in_batches(spark, folder)[1]
    return pages.groupBy("bucket").agg(F.sum("n").alias("bits"), F.count("*").alias("pages"))


# --- ranking --------------------------------------------------------------------------


@query
def ranked_words(spark, folder):
    return ranking.ranked_words(word_counts(spark, folder))


@query
def top_k(spark, folder):
    return ranking.top_k(word_counts(spark, folder), 10)


@query
def cutoff(spark, folder):
    return ranking.top_k(word_counts(spark, folder), 2000, max_k=ranking.MAX_K)


@query
def rank_column(spark, folder):
    return ranking.with_rank(word_counts(spark, folder), TOP)


def with_day_number(running: DataFrame) -> DataFrame:
    return running.withColumn("batch_no", F.unix_date("day").cast("bigint"))


def events_by_second(spark, folder) -> DataFrame:
    """Event types per second, numbered in milliseconds since 1970."""
    millis = (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("batch_no")
    events = read_table(spark, folder, "events").select(millis, F.col("event_type").alias("word"))
    return events.groupBy("batch_no", "word").agg(F.count("*").alias("n"))


@query
def top_words_per_second(spark, folder):
    """The first three event types after every second in which there was an event."""
    # Blocks of about a thousand seconds.
    block = F.call_function("shiftright", F.col("batch_no"), F.lit(20))
    running = counts.running_counts(events_by_second(spark, folder), batch="batch_no", block=block)
    return ranking.top_k_per_batch(running, 3)


@query
def top_k_per_batch(spark, folder):
    """The first three event types after every day."""
    running = with_day_number(running_counts(spark, folder))
    return ranking.top_k_per_batch(running, 3)


@query
def top_words_per_batch(spark, folder):
    """The first ten words after every day on which a description was accepted."""
    running = running_word_counts(spark, folder)
    return ranking.top_k_per_batch(with_day_number(running), 10)


# --- requests -------------------------------------------------------------------------


@query
def fetch_join(spark, folder):
    located = asked.locate(requests(spark, folder)).select("request_id", "product_id")
    return asked.fetch_join(located, descriptions(spark, folder))


@query
def missing_requests(spark, folder):
    located = asked.locate(requests(spark, folder)).select("request_id", "product_id", "host")
    return asked.missing_requests(located, descriptions(spark, folder))


@query
def missing_report(spark, folder):
    located = asked.locate(requests(spark, folder))
    return asked.missing_report(located, descriptions(spark, folder))


@query
def request_outcome(spark, folder):
    asking = requests(spark, folder)
    products = written(asked.requested_products(asking), "products")
    return asked.request_outcome(asking, descriptions(spark, folder), products=products)


@query
def outcome_summary(spark, folder):
    return asked.outcome_summary(request_outcome(spark, folder))


@query
def accepted_descriptions(spark, folder):
    return asked.accepted_descriptions(requests(spark, folder), descriptions(spark, folder))


@query
def end_to_end(spark, folder):
    return jobs.top_words(requests(spark, folder), descriptions(spark, folder), TOP)


@query
def end_to_end_xml(spark, folder):
    """The same with descriptions out of item documents."""
    found = with_once(item_xml(spark, folder), text=markup.editorial_review(F.col("xml")))
    found = description_rows(found)
    return jobs.top_words(requests(spark, folder), found, TOP)


@query
def end_to_end_html(spark, folder):
    """The same with descriptions out of web pages."""
    pages = read_table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id")
    found = description_rows(
        with_once(pages, text=markup.first_paragraph(F.col("html"), None, "article"))
    )
    return jobs.top_words(requests(spark, folder), found, TOP)


# --- streams --------------------------------------------------------------------------


def request_parts(spark, folder) -> list[DataFrame]:
    return jobs.parts_by_time(requests(spark, folder), "ts", PART_CUTS)


def accepted_parts(spark, folder) -> list[DataFrame]:
    accepted = written(accepted_descriptions(spark, folder), "accepted")
    return jobs.parts_by_time(accepted, "ts", PART_CUTS)


@query
def micro_batch(spark, folder):
    """Counts of each micro-batch of descriptions."""
    return jobs.stream_texts(spark, accepted_parts(spark, folder)).deltas()


@query
def stream_word_count(spark, folder):
    """Counts over the whole stream of documents, kept in the stream's own state."""
    store = stores.StreamStore(spark, scratch_dir(spark, "running"))
    texts = feeds.table_stream(spark, f"{folder}/documents.parquet")
    streams.run_counts(texts, store, None).awaitTermination()
    return store.counts()


@query
def stream_processor(spark, folder):
    """A stream processor of the caller's own: documents and characters per language."""
    root = scratch_dir(spark, "processor")
    store = stores.BatchFolder(spark, f"{root}/store")
    docs = feeds.table_stream(spark, f"{folder}/documents.parquet")

    def per_language(rows: DataFrame, batch_id: int) -> None:
        sums = rows.groupBy("lang").agg(
            F.count("*").alias("docs"), F.sum("n_chars").alias("chars")
        )
        store.write("languages", batch_id, sums)

    streams.run_batches(docs, f"{root}/checkpoint", per_language, None).awaitTermination()
    sums = store.read("languages", "lang STRING, docs BIGINT, chars BIGINT")
    return sums.groupBy("lang").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))


@query
def stream_first_wins(spark, folder):
    """The products of the request stream that have a description, once each."""
    root = scratch_dir(spark, "first")
    requests(spark, folder).write.parquet(f"{root}/feed")
    firsts = streams.stream_first_wins(
        feeds.table_stream(spark, f"{root}/feed"), descriptions(spark, folder)
    )
    writer = firsts.writeStream.format("parquet")
    writer = writer.option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint"
    )
    streams.with_trigger(writer, None).start().awaitTermination()
    return spark.read.schema("product_id STRING").parquet(f"{root}/out")


@query
def rate_limit(spark, folder):
    """Requests taken when every micro-batch may read one file only."""
    root = scratch_dir(spark, "limited")
    store = stores.BatchFolder(spark, f"{root}/store")
    for part in request_parts(spark, folder):
        part.write.mode("append").parquet(f"{root}/feed")
    feed = feeds.table_stream(spark, f"{root}/feed", files_per_batch=1).withColumn(
        "file", F.col("_metadata.file_name")
    )

    def write(rows: DataFrame, batch_id: int) -> None:
        per_file = rows.groupBy("file").agg(F.count("*").alias("n"))
        store.write("taken", batch_id, per_file)

    streams.run_batches(feed, f"{root}/checkpoint", write, None).awaitTermination()
    taken = store.read("taken", "file STRING, n BIGINT")
    per_batch = taken.groupBy(stores.BATCH).agg(
        F.count("*").alias("files"), F.sum("n").alias("n")
    )
    return per_batch.agg(F.sum("n").alias("requests"), F.max("files").alias("files_per_batch"))


@query
def checkpoint_restart(spark, folder):
    """Counts of a stream that was stopped and started again between its batches."""
    return jobs.stream_texts(spark, accepted_parts(spark, folder), restarted=True).counts()


@query
def serve_snapshot(spark, folder):
    """What a reader of the stream's state sees after its second batch."""
    return jobs.stream_texts(spark, accepted_parts(spark, folder)).counts(until=1)


@query
def stream_request_outcome(spark, folder):
    store = jobs.stream_requests(
        spark, request_parts(spark, folder), descriptions(spark, folder), counted=False
    )
    return store.read(stores.OUTCOMES, stores.OUTCOMES_SCHEMA).drop("ts")


@query
def stream_end_to_end(spark, folder):
    store = jobs.stream_requests(
        spark, request_parts(spark, folder), descriptions(spark, folder)
    )
    return ranking.with_rank(store.counts(), TOP)

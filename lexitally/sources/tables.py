"""The given tables and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.session import dealt_out


# Tables whose rows are long texts.
TEXTS = ("documents", "pages", "benchmark", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return dealt_out(table) if name in TEXTS else table


def request_rows(events: DataFrame) -> DataFrame:
    """Page requests made of events: duplicates, bad URLs and several hosts among them."""
    page = F.concat(F.lit("%2Fgp%2Fproduct%2FP"), (F.col("event_id") % 1200).cast("string"))

    def at(host: str) -> Column:
        return F.concat(F.lit(f"http%3A%2F%2F{host}"), page)

    kind = F.col("event_type")
    bad = F.when(F.col("event_id") % 2 == 0, at("www.example.com")).otherwise(
        "http%3A%2F%2Fwww.amazon.com%2Fgp%2Fproduct%2F"
    )
    url = (
        F.when(kind == "error", bad)
        .when(kind == "signup", at("www.amazon.co.uk"))
        .when(kind == "view", at("www.amazon.de"))
        .otherwise(at("www.amazon.com"))
    )
    return events.select(F.col("event_id").alias("request_id"), "ts", url.alias("url"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return request_rows(read_table(spark, folder, "events"))


def description_rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("product_id"), "text"
    )


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return description_rows(read_table(spark, folder, "documents"))


def item_xml(spark: SparkSession, folder: str) -> DataFrame:
    """Item documents holding another review first and, but for some, the description."""
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    review = F.concat(
        F.lit("<EditorialReview><Source>Product Description</Source><Content>"),
        text,
        F.lit("</Content></EditorialReview>"),
    )
    xml = F.concat(
        F.lit(
            "<ItemLookupResponse><Items><Item><EditorialReviews>"
            "<EditorialReview><Source>Other</Source><Content>no</Content></EditorialReview>"
        ),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(review),
        F.lit("</EditorialReviews></Item></Items></ItemLookupResponse>"),
    )
    return read_table(spark, folder, "documents").select("doc_id", xml.alias("xml"))

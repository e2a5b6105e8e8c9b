"""From page requests to outcomes and accepted descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.once import with_once
from lexitally.functions.urls import (
    HOST_MARKER,
    PRODUCT_MARKER,
    extract_host,
    extract_product_id,
    url_text,
)
from lexitally.operators.keyset import first_wins, packed

# Requests are taken in this order.
ORDER = ("ts", "request_id")

# Status codes and their messages.
CREATED, OK, NOT_FOUND, BAD_REQUEST = 201, 200, 404, 400
MESSAGES = {
    CREATED: "Description of product %s has been successfully processed",
    OK: "Product %s description digest is already present, no fetching/processing required",
    NOT_FOUND: "Product %s description is missing on %s",
    BAD_REQUEST: "Product URL %s is invalid",
}
NO_URL = "Could not extract product URL from the request form Map()"


def locate(
    requests: DataFrame, host_marker: str = HOST_MARKER, product_marker: str = PRODUCT_MARKER
) -> DataFrame:
    """The requests with ``product_id`` and ``host``, both NULL if the URL is invalid."""
    text = F.col("_text")
    found = with_once(
        requests.withColumn("_text", url_text(F.col("url"))),
        _id=extract_product_id(text, product_marker),
        _host=extract_host(text, host_marker),
    )
    valid = F.col("_id").isNotNull() & F.col("_host").isNotNull()
    return found.select(
        *requests.columns,
        F.when(valid, F.col("_id")).alias("product_id"),
        F.when(valid, F.col("_host")).alias("host"),
    )


def request_place(requests: DataFrame) -> tuple[Column, Column]:
    """The place of a request in the order of requests, as a number, and its mark."""
    return packed(requests, ORDER), request_mark()


def request_mark() -> Column:
    """A number that tells a request from others of the same place, which come without a time
    or number or repeat both."""
    return F.xxhash64(*ORDER, "url")


def requested_products(requests: DataFrame) -> DataFrame:
    """Per validly requested product its requests ``n`` and the first of them: its ``place``
    and ``mark``."""
    located = locate(requests).where(F.col("product_id").isNotNull())
    place, mark = request_place(located)
    return located.groupBy("product_id").agg(
        F.min(place).alias("place"), F.min_by(mark, place).alias("mark"), F.count("*").alias("n")
    )


def described_keys(descriptions: DataFrame) -> DataFrame:
    """The products that have a description.

    A table of nothing but ``product_id`` is taken as it is: who keeps one saves reading
    all texts to learn which products have any.
    """
    if "text" in descriptions.columns:
        descriptions = descriptions.where(F.col("text").isNotNull())
    return descriptions.select("product_id").distinct()


def product_facts(
    products: DataFrame, descriptions: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """The requested products with flags: has a description, is stored already.

    Descriptions and stored keys are cut down to the requested products first. Where
    these are few, as in a micro-batch, Spark sends them to the large tables, which then
    need no shuffle.
    """
    def flagged(table: DataFrame, name: str) -> DataFrame:
        asked = products.select("product_id")
        keys = table.select("product_id").join(asked, "product_id", "left_semi").distinct()
        return keys.withColumn(name, F.lit(True))

    facts = products.join(flagged(described_keys(descriptions), "found"), "product_id", "left")
    if seen is None:
        return facts.withColumn("stored", F.lit(False))
    return facts.join(flagged(seen, "stored"), "product_id", "left")


def request_outcome(
    requests: DataFrame,
    descriptions: DataFrame,
    seen: DataFrame | None = None,
    products: DataFrame | None = None,
) -> DataFrame:
    """One status and message per request.

    In this order: an invalid URL is 400, a product stored before is 200, one without a
    description is 404, the first request of any other is 201 and the later ones 200. Requests
    without a time or a number come before others. Rows that are equal in time, number and URL
    are one request that came several times, and get one answer.

    ``products`` are the `requested_products` of these requests. They are used several
    times; given as a written table they save reading the requests as often.
    """
    located = locate(requests).select("request_id", "ts", "url", "product_id", "host")
    products = requested_products(requests) if products is None else products
    facts = product_facts(products, descriptions, seen)
    rows = located.join(facts.drop("n"), "product_id", "left")
    place, mark = request_place(rows)
    is_first = (place == F.col("place")) & (mark == F.col("mark"))
    status = (
        F.when(F.col("product_id").isNull(), BAD_REQUEST)
        .when(F.col("stored"), OK)
        .when(F.col("found").isNull(), NOT_FOUND)
        .when(is_first, CREATED)
        .otherwise(OK)
    )
    return (
        rows.withColumn("status", status.cast("bigint"))
        .withColumn("message", message())
        .select("request_id", "ts", "product_id", "host", "status", "message")
    )


def message() -> Column:
    """The message to a request of ``url, product_id, host, status``."""
    return (
        F.when(F.col("url").isNull(), NO_URL)
        .when(F.col("status") == BAD_REQUEST, F.format_string(MESSAGES[BAD_REQUEST], "url"))
        .when(
            F.col("status") == NOT_FOUND,
            F.format_string(MESSAGES[NOT_FOUND], "product_id", "host"),
        )
        .when(F.col("status") == CREATED, F.format_string(MESSAGES[CREATED], "product_id"))
        .otherwise(F.format_string(MESSAGES[OK], "product_id"))
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Requests by status, and how many products they are about."""
    per_product = outcomes.groupBy("status", "product_id").agg(F.count("*").alias("n"))
    return per_product.groupBy("status").agg(
        F.sum("n").alias("requests"), F.count("product_id").alias("products")
    )


def fetch_join(located: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The located requests with the text of their product, NULL if it has none."""
    located = located.where(F.col("product_id").isNotNull())
    return located.join(descriptions.select("product_id", "text"), "product_id", "left")


def missing_requests(located: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The located requests whose product has no description."""
    located = located.where(F.col("product_id").isNotNull())
    described = described_keys(descriptions)
    return located.join(described, "product_id", "left_anti")


def missing_report(located: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Requested products without a description: their requests and the last of them.

    Requests are added up per product before they meet the descriptions. The products
    are not remembered anywhere, so a description that comes later is accepted.
    """
    asked = (
        located.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.count("*").alias("requests"), F.max("ts").alias("last_ts"))
    )
    described = described_keys(descriptions)
    return asked.join(described, "product_id", "left_anti")


def accepted_descriptions(
    requests: DataFrame, descriptions: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """The products accepted, each once, with the request that won and the text.

    Duplicates and stored products go before the descriptions are looked at. There must
    be one description per product; `put_overwrite` makes it so.
    """
    firsts = first_wins(locate(requests), "product_id", ORDER).drop("n")
    if seen is not None:
        firsts = firsts.join(seen.select("product_id").distinct(), "product_id", "left_anti")
    texts = descriptions.where(F.col("text").isNotNull()).select("product_id", "text")
    return firsts.join(texts, "product_id").select("product_id", *ORDER, "text")

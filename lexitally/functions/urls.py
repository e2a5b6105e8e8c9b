"""Product locators from encoded page URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitally.functions.once import let

# What marks the host part and the part before the product key, and the
# host endings that have a marketplace of their own.
HOST_MARKER = "amazon"
PRODUCT_MARKER = "product"
MARKETPLACES = ("com", "uk", "de", "fr", "jp", "ca")
DEFAULT_MARKETPLACE = "com"


def decode_url(url: Column) -> Column:
    """Percent-decoded URL with ``+`` as a space; NULL if it cannot be decoded."""
    return F.try_url_decode(url)


def split_path(url: Column) -> Column:
    """Parts between slashes; empty parts at the end go, inner ones stay."""
    trimmed = F.rtrim(url, F.lit("/"))
    only_slashes = (trimmed == "") & (url != "")
    return F.when(only_slashes, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "/")
    )


def url_text(url: Column) -> Column:
    """The decoded URL without slashes at its end, as the next two functions take it."""
    return F.rtrim(decode_url(url), F.lit("/"))


# They find parts by searching for slashes, without making an array of them. Markers hold
# no slash.


def extract_host(text: Column, marker: str = HOST_MARKER) -> Column:
    """First part that contains the host marker, or NULL."""
    before = F.substring_index(text, marker, 1)
    onwards = F.substring(text, F.locate(marker, text), F.length(text))
    part = F.concat(F.substring_index(before, "/", -1), F.substring_index(onwards, "/", 1))
    return F.when(F.contains(text, F.lit(marker)), part)


def extract_product_id(text: Column, marker: str = PRODUCT_MARKER) -> Column:
    """Part after the first one that contains the marker, or NULL past the end.

    A URL without such a part gives its first part, as if the marker were in a part
    before it.
    """
    onwards = F.substring(text, F.locate(marker, text), F.length(text))
    following = F.substring_index(F.substring_index(onwards, "/", 2), "/", -1)
    return (
        F.when(~F.contains(text, F.lit(marker)), F.substring_index(text, "/", 1))
        .when(F.contains(onwards, F.lit("/")), following)
    )


def product_locator(
    url: Column, host_marker: str = HOST_MARKER, product_marker: str = PRODUCT_MARKER
) -> Column:
    """``struct(product_id, host)`` of an encoded URL, or NULL if it is invalid."""
    def parts_of(text: Column) -> Column:
        return F.struct(
            extract_product_id(text, product_marker).alias("product_id"),
            extract_host(text, host_marker).alias("host"),
        )

    def valid_only(found: Column) -> Column:
        return F.when(found["product_id"].isNotNull() & found["host"].isNotNull(), found)

    return let(let(url_text(url), parts_of), valid_only)


def marketplace(host: Column, by_label: bool = True) -> Column:
    """Marketplace of a host: its last label that names one, ``com`` if none does.

    ``by_label=False`` gives ``com`` for every host, as a lookup that never sees the
    labels does.
    """
    default = F.lit(DEFAULT_MARKETPLACE)
    if not by_label:
        return F.when(host.isNotNull(), default)
    labels = F.filter(F.split(host, r"\."), lambda p: p.isin(*MARKETPLACES))
    return F.when(host.isNotNull(), F.coalesce(F.try_element_at(labels, F.lit(-1)), default))

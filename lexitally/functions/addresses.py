"""Bit addresses of keys: a name-based UUID, split into a bucket and an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitally.functions.once import let

# The namespace of the UUIDs and the number of buckets.
NAMESPACE = "d4d1c83d-d63a-46cf-8597-d6e8d2a0b0ba"
BUCKETS = 1024


def _digits(uuid: Column, first: int, count: int) -> Column:
    return F.conv(F.substring(uuid, first, count), 16, 10).cast("bigint")


def key_uuid(key: Column) -> Column:
    """The 32 hex digits of the version-3 UUID of a key in the namespace."""
    space = F.unhex(F.lit(NAMESPACE.replace("-", "")))
    # The variant bits 10 on top of the two low bits of the digit.
    variants = ("0123456789abcdef", "89ab89ab89ab89ab")
    return let(
        F.md5(F.concat(space, F.encode(key, "UTF-8"))),
        lambda digest: F.concat(
            F.substring(digest, 1, 12),
            F.lit("3"),
            F.substring(digest, 14, 3),
            F.translate(F.substring(digest, 17, 1), *variants),
            F.substring(digest, 18, 15),
        ),
    )


def address_of(uuid: Column) -> Column:
    """``struct(bucket, offset)`` of a UUID given as 32 hex digits.

    The bucket is the size of the signed remainder of the low half, which is always
    negative; the offset is the size of the signed 32-bit fold of the high half.
    """

    def bucket(u: Column) -> Column:
        low = _digits(u, 30, 3).bitwiseAND(F.lit(BUCKETS - 1))
        return ((F.lit(BUCKETS) - low) % BUCKETS).cast("bigint")

    def offset(u: Column) -> Column:
        fold = _digits(u, 1, 8).bitwiseXOR(_digits(u, 9, 8))
        return let(fold, lambda f: F.when(f >= 2**31, F.lit(2**32) - f).otherwise(f))

    return let(uuid, lambda u: F.struct(bucket(u).alias("bucket"), offset(u).alias("offset")))


def key_address(key: Column) -> Column:
    return address_of(key_uuid(key))

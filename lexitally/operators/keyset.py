"""Operators on sets of keys: membership, first wins, overwrite, remove, bit addresses.

Key sets are compared after their rows were reduced to distinct keys, which combines
before the shuffle. Where every row needs an answer, the rows are joined to one row per key;
Spark splits the rows of a key that has many of them over several tasks (adaptive skew joins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.addresses import key_address
from lexitally.functions.once import with_once


def contains(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows with a flag ``contained``: is their key in ``seen``?"""
    stored = seen.select(key).distinct().withColumn("contained", F.lit(True))
    joined = rows.join(stored, key, "left")
    return joined.withColumn("contained", F.coalesce("contained", F.lit(False))).select(
        *rows.columns, "contained"
    )


def new_keys(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The distinct keys of the rows that are not in ``seen``."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(seen.select(key).distinct(), key, "left_anti")


# A first part of a packed number is a time; times further from 1970 than this many microseconds
# (some 85,000 years) count as that far. A second part is any whole number of 64 bits, or null.
FURTHEST, SECOND = 27 * 10**17, 2**64 + 1
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def packed(rows: DataFrame, order: Sequence[str]) -> Column | None:
    """One or two order columns as one number that sorts the same way, if they allow it.

    Nulls come first, as they do in Spark's own order, and the number is never null. Times
    without a zone are taken as they stand, whatever the zone of the session. The minimum of a
    number is kept in place while rows are aggregated by hash; that of a struct is not, and its
    rows would be sorted before the shuffle.
    """
    kinds = [rows.schema[name].dataType.typeName() for name in order]
    if len(order) > 2 or (len(order) == 2 and not kinds[0].startswith("timestamp")):
        return None
    numbers = []
    for name, kind in zip(order, kinds):
        column, least = F.col(name), _least(kind, order)
        if kind.startswith("timestamp"):
            number = _micros(column, kind)
        elif kind == "date":
            number = F.unix_date(column).cast("decimal(38,0)")
        elif kind in ("byte", "short", "integer", "long"):
            number = column.cast("decimal(38,0)")
        else:
            return None
        if least == FURTHEST:
            near = F.least(F.greatest(number, _whole(-FURTHEST)), _whole(FURTHEST))
            number = F.when(number.isNotNull(), near)
        numbers.append(F.coalesce(number + _whole(least + 1), _whole(0)).cast("decimal(38,0)"))
    if len(numbers) == 1:
        return numbers[0]
    return (numbers[0] * _whole(SECOND) + numbers[1]).cast("decimal(38,0)")


def _least(kind: str, order: Sequence[str]) -> int:
    """How far below zero a part of a packed number may be; of two parts the times are bounded."""
    return FURTHEST if kind.startswith("timestamp") and len(order) == 2 else 2**63


def _micros(column: Column, kind: str) -> Column:
    """Microseconds since 1970; those of a time without a zone do not look at the session's."""
    if kind == "timestamp":
        return F.unix_micros(column).cast("decimal(38,0)")
    seconds = (column - F.expr(EPOCH)).cast("interval second").cast("decimal(38,6)")
    return (seconds * 1_000_000).cast("decimal(38,0)")


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(abs(value)))},0)")


def unpacked(number: Column, rows: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns out of the number that `packed` has made of them."""
    parts = [number]
    if len(order) == 2:
        second = F.pmod(number, _whole(SECOND).cast("decimal(38,0)"))
        first = ((number - second) / _whole(SECOND)).cast("decimal(38,0)")
        parts = [first, second]
    columns = []
    for name, part in zip(order, parts):
        kind = rows.schema[name].dataType
        value = (part - _whole(_least(kind.typeName(), order) + 1)).cast("decimal(38,0)")
        if kind.typeName() == "timestamp":
            value = F.timestamp_micros(value.cast("bigint"))
        elif kind.typeName().startswith("timestamp"):
            seconds = (value / 1_000_000).cast("decimal(18,6)")
            value = F.expr(EPOCH) + F.make_dt_interval(secs=seconds)
        elif kind.typeName() == "date":
            value = F.date_from_unix_date(value.cast("int"))
        columns.append(F.when(part > 0, value.cast(kind)).alias(name))
    return columns


def first_wins(
    rows: DataFrame, key: str, order: Sequence[str], payload: Sequence[str] = ()
) -> DataFrame:
    """One row per key, the first by ``order``, and the number ``n`` of its rows.

    Nulls come first. A minimum rather than a window: it combines before the shuffle, so a key
    that owns most rows costs no task more than any other. Times and whole numbers are compared
    as one packed number; the winner's other columns are joined to it, the least ones if several
    rows are first.
    """
    rows = rows.where(F.col(key).isNotNull())
    number = packed(rows, order)
    if number is None:
        first = F.min(F.struct(*order, *payload)).alias("_first")
        found = rows.groupBy(key).agg(first, F.count("*").alias("n"))
        return found.select(key, "_first.*", "n")
    found = rows.groupBy(key).agg(F.min(number).alias("_first"), F.count("*").alias("n"))
    if not payload:
        return found.select(key, *unpacked(F.col("_first"), rows, order), "n")
    winners = found.withColumnRenamed(key, "_key")
    own = rows.select(key, *order, *payload, number.alias("_own"))
    same = (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_first"))
    first = F.min(F.struct(*order, *payload)).alias("_first")
    joined = own.join(winners, same).groupBy(key).agg(first, F.max("n").alias("n"))
    return joined.select(key, "_first.*", "n")


def duplicate_flag(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """Per batch, whether it brought a key that was stored before; it is stored anyway.

    ``duplicate`` asks for keys stored by an earlier batch. ``duplicate_strict`` also
    counts a key that comes twice in one batch, as a store that sets keys one by one does.
    Compared are numbers: distinct keys of a batch and keys that are new in it.
    """
    per_batch = (
        rows.where(F.col(key).isNotNull()).groupBy(key, batch).agg(F.count("*").alias("n"))
    )
    brought = per_batch.groupBy(batch).agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys")
    )
    fresh = (
        per_batch.groupBy(key)
        .agg(F.min(batch).alias(batch))
        .groupBy(batch)
        .agg(F.count("*").alias("new_keys"))
    )
    new = F.coalesce("new_keys", F.lit(0))
    return brought.join(fresh, batch, "left").select(
        batch,
        "rows",
        "keys",
        new.alias("new_keys"),
        (F.col("keys") > new).alias("duplicate"),
        (F.col("rows") > new).alias("duplicate_strict"),
    )


def put_overwrite(
    rows: DataFrame, key: str, value: str, order: Sequence[str]
) -> DataFrame:
    """The last value of each key by ``order``, in which nulls come first."""
    number = packed(rows, order)
    last = F.max_by(F.col(value), F.struct(*order) if number is None else number)
    return rows.groupBy(key).agg(last.alias(value))


def batch_remove(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store without the given keys."""
    return store.join(keys.select(key).distinct(), key, "left_anti")


# --- approximate sets: two keys may share a bit -------------------------------------


def seen_bits(keys: DataFrame, key: str) -> DataFrame:
    """The distinct bit addresses of the keys."""
    stored = with_once(keys.where(F.col(key).isNotNull()).select(key), _a=key_address(F.col(key)))
    return stored.select("_a.bucket", "_a.offset").distinct()


def seen_bitmaps(bits: DataFrame) -> DataFrame:
    """The bits of a set as bitmap pages of a bucket, with their number of set bits.

    Bits travel to their page as two numbers, and each page is filled where it lives;
    filling pages before the shuffle would send a page for every few bits.
    """
    at = F.col("offset") + 1  # positions in Spark's bitmaps begin with 1
    placed = bits.select(
        "bucket", F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit")
    )
    return (
        placed.repartition("bucket", "page")
        .groupBy("bucket", "page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .withColumn("n", F.bitmap_count("bits"))
    )


def maybe_contains(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """The rows with a flag ``contained``; never False for a stored key.

    Addresses are worked out and looked up once per distinct key.
    """
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    at = with_once(keys, _a=key_address(F.col(key))).select(
        key, F.col("_a.bucket").alias("bucket"), F.col("_a.offset").alias("offset")
    )
    stored = at.join(bits.select("bucket", "offset"), ["bucket", "offset"], "left_semi")
    flags = stored.select(key, F.lit(True).alias("contained"))
    joined = rows.join(flags, key, "left")
    return joined.withColumn("contained", F.coalesce("contained", F.lit(False))).select(
        *rows.columns, "contained"
    )


def merge_bitmaps(*pages: DataFrame) -> DataFrame:
    """Bitmap pages of several batches as those of one set that has all their bits."""
    columns = ["bucket", "page", "bits"]
    every = pages[0].select(columns)
    for more in pages[1:]:
        every = every.unionByName(more.select(columns))
    merged = every.groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.withColumn("n", F.bitmap_count("bits"))


def bit_is_set(bits: Column, position: Column) -> Column:
    """Is the bit at a position, counted from 0, set in a bitmap?"""
    byte = F.conv(F.hex(F.substr(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), F.pmod(position, F.lit(8)).cast("int")) == 1


def set_and_report(rows: DataFrame, pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A batch of rows, each with ``was_set``: was its key's bit set before the batch? And the
    bitmap pages with the batch's bits set as well.

    Two keys may share a bit: a stored key is always reported as set, a new one seldom is. A row
    without a key sets no bit. Addresses are worked out and looked up once per distinct key, and
    only the pages that the batch touches are joined to it.
    """
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    at = with_once(keys, _a=key_address(F.col(key)))
    place = F.col("_a.offset") + 1  # positions in Spark's bitmaps begin with 1
    at = at.select(
        key, F.col("_a.bucket").alias("bucket"), F.bitmap_bucket_number(place).alias("page"),
        F.bitmap_bit_position(place).alias("bit"),
    )
    found = at.join(pages.select("bucket", "page", "bits"), ["bucket", "page"], "left")
    flags = found.select(key, F.coalesce(bit_is_set(F.col("bits"), F.col("bit")), F.lit(False)).alias("was_set"))
    joined = rows.join(flags, key, "left")
    answered = joined.withColumn("was_set", F.coalesce("was_set", F.lit(False)))
    return answered.select(*rows.columns, "was_set"), merge_bitmaps(pages, seen_bitmaps(seen_bits(rows, key)))


def no_bitmaps(rows: DataFrame) -> DataFrame:
    """The bitmap pages of an empty set, in the session of some rows."""
    schema = "bucket INT, page BIGINT, bits BINARY, n BIGINT"
    return rows.sparkSession.createDataFrame([], schema)

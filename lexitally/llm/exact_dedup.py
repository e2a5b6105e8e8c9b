"""Exact dedup over a cuckoo-filter index of live digests.

Each task keeps its digests in a cuckoo table: a slot holds a short print of a digest and
the number of its stored key. A print that matches is a hit only after the stored key has
been compared; a table that finds no room is rebuilt, twice as large, from the stored keys.
Digests can be taken out again.

Rows are first put together per task of the scan, so that a text with any number of copies
sends one entry per task; entries then meet in a task by digest. The index can be kept as a
table and changed later (`changed_index`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.session import written

# Slots of a bucket, and moves after which a table counts as full.
SLOTS = 4
KICKS = 128
# Digests that a task's index holds before it is given out and begun anew.
HELD = 200_000
# What an entry of a task's input is.
STORED, REMOVED, ADDED = 0, 1, 2


class CuckooIndex:
    """Digests (bytes of uniform content, 8 at least) with a value each."""

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.values: list[Any] = []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = bytearray(2 * SLOTS * buckets)
        self.slots = memoryview(self.prints).cast("H")
        self.rows = [-1] * (SLOTS * buckets)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """The print, which is never zero, and the two buckets of a digest."""
        mark = int.from_bytes(key[:2], "big") or 1
        one = int.from_bytes(key[2:8], "big") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 7 & self.mask)

    def _slot(self, key: bytes) -> int:
        """The slot of a digest, or -1; a matching print alone is not enough."""
        mark, one, other = self._places(key)
        for bucket in (one, other) if one != other else (one,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[slot] == mark and self.keys[self.rows[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The row of a live digest, or -1."""
        slot = self._slot(key)
        return self.rows[slot] if slot >= 0 else -1

    def _place(self, key: bytes, row: int) -> bool:
        mark, bucket, other = self._places(key)
        for k in range(KICKS):
            for at in (bucket, other):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.slots[slot]:
                        self.slots[slot], self.rows[slot] = mark, row
                        return True
            # Both are full: take the place of one, which goes on to its other bucket.
            slot = other * SLOTS + k % SLOTS
            mark, self.slots[slot] = self.slots[slot], mark
            row, self.rows[slot] = self.rows[slot], row
            bucket = other
            other = self._other(bucket, mark)
        return False

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            live = ((key, row) for row, key in enumerate(self.keys) if key is not None)
            if all(self._place(key, row) for key, row in live):
                return

    def insert(self, key: bytes, value: Any) -> int:
        """Store a digest that is not live, and give its row."""
        row = self.free.pop() if self.free else len(self.keys)
        if row == len(self.keys):
            self.keys.append(key)
            self.values.append(value)
        else:
            self.keys[row], self.values[row] = key, value
        if not self._place(key, row):
            self._resize()
        return row

    def delete(self, key: bytes) -> bool:
        """Take a digest out; false if it was not live."""
        slot = self._slot(key)
        if slot < 0:
            return False
        row = self.rows[slot]
        self.slots[slot], self.rows[slot] = 0, -1
        self.keys[row] = self.values[row] = None
        self.free.append(row)
        return True

    def live(self) -> Iterator[tuple[bytes, Any]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def _larger(one: Any, other: Any) -> Any:
    if one is None or other is None:
        return other if one is None else one
    return max(one, other)


def _indexed(entries: DataFrame, held: int, in_order: bool) -> DataFrame:
    """``digest, keep_id, n`` of what is live after each task's entries, in their order.

    ``entries`` are ``kind, digest, keep_id, n``. An index that holds ``held`` digests is given
    out and begun anew, at once or, if the entries are in order of the digests' first two bytes,
    when these change: then all entries of a digest meet in one index.
    """
    kept = entries.select("digest", "keep_id", "n")
    schema = kept.schema

    def given(index: CuckooIndex, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        live = list(index.live())
        for i in range(0, len(live), 10_000):
            part = live[i : i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in part], pa.binary()),
                    pa.array([value[0] for _, value in part], id_type),
                    pa.array([value[1] for _, value in part], pa.int64()),
                ],
                names=["digest", "keep_id", "n"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, id_type, before = CuckooIndex(), pa.null(), None
        for batch in batches:
            id_type = batch.schema.field("keep_id").type
            columns = (batch.column(c).to_pylist() for c in ("kind", "digest", "keep_id", "n"))
            for kind, digest, keep_id, n in zip(*columns):
                if len(index) >= held and (not in_order or digest[:2] != before):
                    yield from given(index, id_type)
                    index = CuckooIndex()
                before = digest[:2]
                if kind == REMOVED:
                    index.delete(digest)
                    continue
                row = index.find(digest)
                if row < 0:
                    index.insert(digest, [keep_id, n])
                else:
                    value = index.values[row]
                    value[0] = _larger(value[0], keep_id)
                    value[1] += n
        yield from given(index, id_type)

    return entries.mapInArrow(work, schema)


def _entries(rows: DataFrame, kind: int) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "digest", "keep_id", F.col("n").cast("long"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: the SHA-256 of each text; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def changed_index(
    index: DataFrame | None, added: DataFrame | None = None, removed: DataFrame | None = None,
    held: int = HELD,
) -> DataFrame:
    """The index after a change: ``digest, keep_id, n`` per live digest.

    ``added`` are rows of ``doc_id, digest``, ``removed`` digests that are to go, whatever
    their number of rows; what is both removed and added is live with the added rows only.
    A digest that is not live can be removed without effect. A task holds little more than
    ``held`` digests at a time.
    """
    parts = []
    if index is not None:
        parts.append(_entries(index, STORED))
    if added is not None:
        own = added.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).alias("n"))
        # Copies that one task reads are put together before anything is sent.
        parts.append(_entries(_indexed(_entries(own, ADDED), held, False), ADDED))
    if removed is not None:
        id_type = (parts[0].schema["keep_id"].dataType) if parts else T.LongType()
        gone = removed.select("digest", F.lit(None).cast(id_type).alias("keep_id"), F.lit(0).alias("n"))
        parts.append(_entries(gone, REMOVED))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    ordered = entries.repartition("digest").sortWithinPartitions(F.substring("digest", 1, 2), "kind")
    return _indexed(ordered, held, True)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row.

    Of equal texts the row with the largest id stays. Of rows that repeat both id and text
    one stays. Rows without an id stay only if no row of their text has one. Null and empty
    texts are equal. An empty table gives no rows.
    """
    rows = written(digests(docs, id_col, text_col), "exact-digests")
    groups = changed_index(None, rows)
    # Rows that repeat an id are told apart by number, before the join: a window after it
    # would keep Spark from splitting the rows of a frequent text.
    nth = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy(F.lit(0)))
    joined = rows.withColumn("nth", nth).join(groups, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (same & (F.col("nth") == 1)).alias("kept"), "digest",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = duplicates(docs, id_col, text_col)
    marks = written(
        found.groupBy(F.col("doc_id").alias("marked_id"), F.lower(F.hex("digest")).alias("marked"))
        .agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
        .where("not stays or n > 1"),
        "exact-marks",
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), key.alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("marked_id")) & (F.col("own") == F.col("marked"))
    # The marks grow with the documents: they are never broadcast, whatever their size here.
    stays = rows.join(marks.hint("merge"), same, "left_anti")
    if not marks.where("stays").isEmpty():
        repeated = rows.join(marks.where("stays").hint("merge"), same)
        stays = stays.unionByName(repeated.dropDuplicates(["own_id", "own"]).select(*rows.columns))
    return stays.select("row.*")

"""Sharding: minimax contiguous partition of groups of equal texts.

Groups of equal texts are atomic and ordered by the SHA-256 of their text. The smallest
capacity that lets the ordered groups be cut into the wanted number of shards is found by
binary search with a greedy check; the cuts are then put where shards of at most that
capacity come out most even.

Sizes of all groups are prefix-summed in Spark. The search needs only a few of the sums: the
driver holds a bounded number of them (two for each of ``POINTS`` stretches), walks with
lower and upper bounds where sums in between are unknown, and has Spark look up more sums
only in the stretches that leave the capacity undecided. The capacity found is the exact
optimum over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexitally.session import written

# Bytes that a document takes besides its text.
OVERHEAD = 16
# Stretches per look-up: the bound of what the driver holds.
POINTS = 1 << 15
# Hex digits of the digest that name a bucket of groups to be summed up by one task.
DIGITS = 3
# Pieces of a shard that are numbered apart.
PIECES = 1024


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )


def prefix_sums(sized: DataFrame) -> DataFrame:
    """``digest, size, sum``: each group with the sizes of all groups up to it."""
    bucket = F.substring("digest", 1, DIGITS)
    groups = sized.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("bucket", bucket)
    # At most 16 ** DIGITS rows, so one task and a broadcast are enough.
    before = (
        groups.groupBy("bucket")
        .agg(F.sum("size").alias("total"))
        .select(
            "bucket",
            (F.sum("total").over(W.orderBy("bucket")) - F.col("total")).alias("before"),
        )
    )
    inside = F.sum("size").over(W.partitionBy("bucket").orderBy("digest"))
    return (
        groups.withColumn("inside", inside)
        .join(F.broadcast(before), "bucket")
        .select("digest", "size", (F.col("before") + F.col("inside")).alias("sum"))
    )


class _Sums:
    """Some of the prefix sums, and the stretches in which there are more."""

    def __init__(self, sums: DataFrame, total: int) -> None:
        self.cell_size = max(1, -(-total // POINTS))
        self.cells = sums.select("sum", F.expr(f"sum div {self.cell_size}").alias("cell"))
        self.points = [0]
        self.open: dict[int, int] = {}
        self._add(self.cells.groupBy("cell").agg(*self._ends()))

    @staticmethod
    def _ends() -> list[Column]:
        return [F.min("sum").alias("low"), F.max("sum").alias("high"), F.count("*").alias("n")]

    def _add(self, found: DataFrame) -> None:
        known = set(self.points)
        for row in found.select("low", "high", "n").collect():
            known.update((row["low"], row["high"]))
            if row["n"] > 2:
                self.open[row["low"]] = row["high"]
        self.points = sorted(known)

    def at_most(self, value: int) -> int:
        """The largest known sum up to the value."""
        return self.points[bisect_right(self.points, value) - 1]

    def at_least(self, value: int) -> int:
        """The smallest known sum from the value on."""
        return self.points[min(bisect_left(self.points, value), len(self.points) - 1)]

    def bound(self, value: int) -> int:
        """No sum up to the value, known or not, is larger than this."""
        low = self.at_most(value)
        return min(value, self.open[low] - 1) if low in self.open else low

    def refine(self, spans: list[tuple[int, int]]) -> bool:
        """Look up sums in the open stretches that touch one of the spans."""
        touched = [
            (low, high)
            for low, high in self.open.items()
            if any(low < end and begin < high for begin, end in spans)
        ]
        if not touched:
            return False
        parts = max(2, POINTS // len(touched))
        rows = []
        for low, high in touched:
            del self.open[low]
            rows.append((low // self.cell_size, low, high, max(1, -(-(high - low) // parts))))
        spark = self.cells.sparkSession
        gaps = spark.createDataFrame(rows, "cell long, gap long, gap_end long, step long")
        inner = (
            self.cells.join(F.broadcast(gaps), "cell")
            .where("sum > gap and sum < gap_end")
            .groupBy("gap", F.expr("(sum - gap) div step").alias("part"))
            .agg(*self._ends())
        )
        known = len(self.points)
        self._add(inner)
        # Between the outermost sums found and the ends of a stretch there are no others.
        return len(self.points) > known


def smallest_capacity(sums: _Sums, total: int, largest: int, shards: int) -> int:
    """The least capacity with which the greedy walk needs no more than ``shards`` shards."""

    def walk(capacity: int) -> tuple[int, int, list[tuple[int, int]]]:
        low = high = 0
        spans = []
        for _ in range(shards):
            low = sums.at_most(low + capacity)
            high = sums.bound(high + capacity)
            spans.append((low, high + 1))
        return low, high, spans

    mean = -(-total // shards)
    while True:
        # Below `no` no cut is possible; with `yes` one surely is.
        no, yes = max(mean, largest) - 1, mean + largest
        begin, end = no, yes
        while end - begin > 1:
            middle = (begin + end) // 2
            if walk(middle)[0] == total:
                end = middle
            else:
                begin = middle
        yes = end
        end = yes
        begin = no
        while end - begin > 1:
            middle = (begin + end) // 2
            if walk(middle)[1] < total:
                begin = middle
            else:
                end = middle
        no = begin
        if yes - no <= 1:
            return yes
        # A span reaches from the shortest walk to the longest one in question.
        spans = [(a[0], b[1]) for a, b in zip(walk(no + 1)[2], walk(yes)[2])]
        if not sums.refine(spans):
            return yes


def even_cuts(sums: _Sums, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of all shards but the last, none over the capacity, as even as may be."""
    latest = [0]
    for _ in range(shards):
        latest.append(sums.at_most(latest[-1] + capacity))
    earliest = [total]
    for _ in range(shards):
        earliest.append(sums.at_least(max(0, earliest[-1] - capacity)))
    earliest.reverse()
    cuts, last = [], 0
    for j in range(1, shards):
        low = max(last, earliest[j])
        high = sums.at_most(min(last + capacity, latest[j]))
        ideal = last + (total - last) // (shards - j + 1)
        # No shard is left empty before a group that is larger than the ideal.
        ends = [end for end in (sums.at_most(ideal), sums.at_least(ideal)) if end > last]
        last = min(ends, key=lambda end: abs(end - ideal), default=last)
        last = min(max(last, low), high)
        cuts.append(last)
    return cuts


def shard_contiguous(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot`` for every row of ``docs``.

    ``size`` is the bytes of the text in UTF-8 and ``OVERHEAD``. Rows of equal text share a
    shard, however many they are; a null text counts as an empty one. ``slot`` numbers the
    rows of a shard without gaps. A null id is numbered like any other, repeated rows each
    get a slot of their own. An empty table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    sized = written(_sized(docs, id_col, text_col), "sharding-sizes")
    sums = written(prefix_sums(sized), "sharding-sums")
    facts = sums.agg(F.max("sum").alias("total"), F.max("size").alias("largest")).first()
    ends: list[str] = []
    if facts["total"]:
        known = _Sums(sums, facts["total"])
        capacity = smallest_capacity(known, facts["total"], facts["largest"], shards)
        cuts = even_cuts(known, facts["total"], capacity, shards)
        # A cut at zero leaves the shards before it empty.
        rows = sums.where(F.col("sum").isin(sorted(set(cuts)))).select("sum", "digest").collect()
        names = {row["sum"]: row["digest"] for row in rows} | {0: ""}
        ends = [names[cut] for cut in cuts]
    shard = F.lit(0)
    for end in ends:
        shard = shard + (F.col("digest") > F.lit(end)).cast("int")
    piece = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PIECES))
    placed = sized.select("*", shard.alias("shard"), piece.alias("piece"))
    # At most shards * PIECES rows.
    before = (
        placed.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .select(
            "shard",
            "piece",
            (F.sum("n").over(W.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("first"),
        )
    )
    order = W.partitionBy("shard", "piece").orderBy("doc_id", "digest")
    return (
        placed.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(before), ["shard", "piece"])
        .select(
            "doc_id", "size", "text_crc32", "digest", "shard",
            (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        )
    )

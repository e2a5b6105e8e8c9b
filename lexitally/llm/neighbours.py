"""Nearest neighbours by inner product, over learned partitions.

On a bounded sample the graph of nearest neighbours is built and cut into partitions of nearly
equal size that keep neighbours together. A small classifier learns, from the vector alone, in
which partitions a vector's neighbours lie. It then gives every row its partition, and every
query the most probable ones, in which all rows are compared exactly. How many these are is
measured on vectors of the sample that were held out: as few as have the recall asked for.

Rows meet queries in cells: a partition of many rows is dealt over several, each of a bounded
size, and a query goes to all cells of its partitions. The sample gives each query a score that
its neighbours have at least, so cells send on little besides these. Of rows with equal vectors
only those of the smallest ids can be among the nearest, however many there are: the others
ask, but are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.vectors import usable
from lexitally.session import written

SEED = 42
# The fit's sample: so many vectors at most, and fewer of them if their entries are more.
SAMPLE, SAMPLE_ENTRIES = 20_000, 1 << 22
# One in so many of the sample is held out, to measure how many partitions are asked.
HELD_OUT = 10
# Rows of a partition at least, and partitions at most. They do not grow with the rows, as then
# the cells would that a query has to be sent to.
ROWS, PARTITIONS = 128, 64
# Neighbours of a vector in the graph, and the weight of a vector's own place against theirs.
LINKS, STAY = 10, 0.5
# Rounds that move centres, and rounds that move vectors along the graph; how much larger than
# the mean a partition may get.
CENTRES, MOVES, SLACK = 4, 10, 1.05
# Steps of the classifier's fit, vectors of a step, and the rate.
STEPS, BATCH, RATE = 400, 2000, 0.05
# The recall on held-out vectors that the number of asked partitions must have.
RECALL = 0.95
# Entries of the vectors of a cell, and queries that are compared with it at once.
CELL, BLOCK = 1 << 20, 256
NEIGHBOURS = 20


@dataclass(frozen=True)
class Router:
    """Weights of the classifier, a column per partition, the last row for the constant; how
    many partitions a query is sent to, and the recall that had; and the sample, with the
    partition of each of its vectors."""

    weights: np.ndarray
    probes: int
    recall: float
    sample: np.ndarray
    parts: np.ndarray

    def order(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The most probable partitions of each vector, the first first."""
        scores = _with_one(_directions(vectors)) @ self.weights
        return np.argsort(-scores, axis=1, kind="stable")[:, :count]

    def least(self, vectors: np.ndarray, asked: np.ndarray, count: int) -> np.ndarray:
        """Scores that ``count`` rows of the asked partitions besides the vector's own reach for
        sure, since vectors of the sample do."""
        found = np.full(len(vectors), -np.inf)
        if len(self.sample) > count:
            asks = np.zeros((len(vectors), self.weights.shape[1]), dtype=bool)
            np.put_along_axis(asks, asked, True, axis=1)
            scores = np.where(asks[:, self.parts], vectors @ self.sample.T, -np.inf)
            found = -np.partition(-scores, count, axis=1)[:, count] - _margin(vectors, self.sample)
        return found


def _directions(vectors: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(sizes > 0, sizes, 1)


def _margin(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of a product of matrices may differ in their last digits from place to place."""
    return 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()


def _with_one(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.ones((len(vectors), 1))])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def graph(sample: DataFrame, among: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``place, nearest``: for each ``place, vector`` of the sample the places of its nearest
    ``count`` among the given vectors, which are at most the sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                place = part.column("place").to_numpy()
                scores = _rows(part) @ among.T
                own = np.flatnonzero(place < len(among))
                scores[own, place[own]] = -np.inf
                best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("place"),
                        pa.FixedSizeListArray.from_arrays(pa.array(best.ravel()), count).cast(
                            pa.list_(pa.int64())
                        ),
                    ],
                    names=["place", "near"],
                )

    table = sample.mapInArrow(work, "place long, near array<long>").toArrow()
    near = table.column("near").combine_chunks().flatten().to_numpy().reshape(-1, count)
    return table.column("place").to_numpy(), near


def balanced(scores: np.ndarray, most: int) -> np.ndarray:
    """For each row the partition (column) of its best score in which there is room; rows for
    which the choice matters most choose first."""
    scores = scores.copy()
    count = scores.shape[1]
    if count == 1:
        return np.zeros(len(scores), dtype=np.int64)
    best = np.partition(scores, count - 2, axis=1)[:, -2:]
    todo = np.argsort(best[:, 0] - best[:, 1], kind="stable")
    found, room = np.empty(len(scores), dtype=np.int64), np.full(count, most)
    while len(todo):
        choice = scores[todo].argmax(axis=1)
        order = np.argsort(choice, kind="stable")
        chosen = choice[order]
        # The rank of each row among those that choose the same partition.
        rank = np.arange(len(order)) - np.searchsorted(chosen, chosen)
        fits = rank < room[chosen]
        found[todo[order[fits]]] = chosen[fits]
        room -= np.bincount(chosen[fits], minlength=count)
        scores[:, room == 0] = -np.inf
        todo = todo[np.sort(order[~fits])]
    return found


def _near_counts(near: np.ndarray, part: np.ndarray, count: int) -> np.ndarray:
    """Per row the share of its neighbours in each partition."""
    flat = (np.arange(len(near))[:, None] * count + part[near]).ravel()
    return np.bincount(flat, minlength=len(near) * count).reshape(-1, count) / near.shape[1]


def partitioned(vectors: np.ndarray, near: np.ndarray, count: int) -> np.ndarray:
    """Partitions of nearly equal size of the neighbour graph: at first around centres, then
    every vector goes where most of its neighbours are, if there is room."""
    most = int(np.ceil(SLACK * len(vectors) / count))
    ways = _directions(vectors)
    some = np.random.default_rng(SEED).choice(len(vectors), count, replace=False)
    part = balanced(ways @ ways[some].T, most)
    for _ in range(CENTRES):
        sums = np.zeros((count, vectors.shape[1]))
        np.add.at(sums, part, ways)
        part = balanced(ways @ _directions(sums).T, most)
    for _ in range(MOVES):
        scores = _near_counts(near, part, count)
        scores[np.arange(len(part)), part] += STAY / near.shape[1]
        part = balanced(scores, most)
    return part


def classifier(vectors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights of a softmax regression onto the wanted shares of partitions."""
    rows = _with_one(_directions(vectors))
    random = np.random.default_rng(SEED)
    weights = np.zeros((rows.shape[1], wanted.shape[1]))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        some = random.integers(0, len(rows), BATCH)
        scores = rows[some] @ weights
        found = np.exp(scores - scores.max(axis=1, keepdims=True))
        found /= found.sum(axis=1, keepdims=True)
        slope = rows[some].T @ (found - wanted[some]) / BATCH
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        ahead = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights -= RATE * ahead
    return weights


def fit(rows: DataFrame, neighbours: int, recall: float = RECALL) -> Router:
    """The router for ``vec_id, vector`` rows: one partition if there are few rows."""
    n = rows.count()
    count = max(1, min(PARTITIONS, n // ROWS))
    first = rows.select("vector").first()
    size = len(first["vector"]) if first else 0
    if count == 1:
        return Router(np.zeros((size + 1, 1)), 1, 1.0, np.zeros((0, size)), np.zeros(0, np.int64))
    most = min(SAMPLE, max(10 * count, SAMPLE_ENTRIES // size))
    some = rows.select("vector").sample(min(1.0, most / n), SEED).limit(2 * most)
    vectors = _rows(some.toArrow().combine_chunks().to_batches()[0])
    vectors = vectors[np.random.default_rng(SEED).permutation(len(vectors))]
    fitted = len(vectors) - len(vectors) // HELD_OUT
    spark = rows.sparkSession
    sample = spark.createDataFrame(
        pa.table({"place": np.arange(len(vectors)), "vector": list(vectors)})
    )
    # Tasks by the work, which is the square of the sample, not by its few bytes.
    sample = sample.repartition(max(1, len(vectors) // 1000))
    among = vectors[:fitted]
    place, near = graph(sample, among, max(neighbours, LINKS))
    near = near[np.argsort(place)]
    scores = np.einsum("ij,ikj->ik", among, among[near[:fitted]])
    closest = np.argsort(-scores, axis=1)[:, :LINKS]
    links = np.take_along_axis(near[:fitted], closest, axis=1)
    part = partitioned(among, links, count)
    weights = classifier(among, _near_counts(links, part, count))
    router = Router(weights, count, 1.0, vectors, np.zeros(0, np.int64))
    # Where the held-out vectors' neighbours are in the index, in the order of their asking.
    own = router.order(vectors, 1)[:, 0]
    asked = router.order(vectors[fitted:], count)
    rank = np.argsort(asked, axis=1)
    ranks = np.take_along_axis(rank, own[near[fitted:, :neighbours]], axis=1)
    found = np.cumsum(np.bincount(ranks.ravel(), minlength=count)) / ranks.size
    probes = min(count, int(np.searchsorted(found, recall)) + 1)
    return Router(weights, probes, float(found[probes - 1]), vectors, own)


def _indexed(rows: DataFrame, router: Router, is_query: Column, count: int) -> DataFrame:
    """``vec_id, vector, asks, found, parts, least, row``: the partition of each row, and for
    queries all that are asked, the most probable first; if a row can be ``found``, and what
    score a query's neighbours have at least."""
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    # One more than are asked for, as the query is no neighbour of its own.
    order = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"))
    first = F.row_number().over(order) <= count + 1
    named = rows.select("vec_id", "vector", asks, first.alias("found")).where("asks or found")
    schema = T.StructType(list(named.schema.fields))
    schema = schema.add("parts", T.ArrayType(T.LongType())).add("least", T.DoubleType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                vectors = _rows(batch)
                order = router.order(vectors, router.probes)
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                least = np.full(len(vectors), -np.inf)
                if asks.any():
                    least[asks] = router.least(vectors[asks], order[asks], count)
                lengths = np.where(asks, router.probes, 1)
                flat = order[np.arange(router.probes) < lengths[:, None]]
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                parts = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(least)], names=schema.names)

    found = named.mapInArrow(work, schema)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "neighbours-index")


def in_cells(index: DataFrame, cell: int) -> DataFrame:
    """``part, cell, asks, row, vec_id, vector, least``: each row that can be found in one cell
    of its partition, of ``cell`` entries or less, and each query in all cells of those it asks."""
    part = F.col("parts")[0]
    rows = index.where("found")
    sizes = rows.groupBy(part.alias("part")).agg(
        F.sum(F.size("vector")).alias("n"), F.max(F.size("vector")).alias("one")
    )
    found = sizes.collect()  # A row per partition.
    # Dealt by hash, cells are not quite equal: so some more than are needed if they are.
    cells = np.zeros(max((row["part"] for row in found), default=0) + 1, dtype=np.int64)
    for row in found:
        cells[row["part"]] = 1 if row["n"] <= cell else -(-2 * row["n"] // max(cell, row["one"]))
    counts = F.array(*[F.lit(int(n)) for n in cells])
    own = F.pmod(F.xxhash64("row"), counts[part]).cast("int")
    names = ["row", "vec_id", "vector", "least"]
    rows = rows.select(part.alias("part"), own.alias("cell"), F.lit(False).alias("asks"), *names)
    asked = index.where("asks").select(*names, F.explode("parts").alias("part"))
    # A partition without rows has nothing to be asked.
    asked = asked.where((F.col("part") < len(cells)) & (counts[F.col("part")] > 0))
    asked = asked.select(
        "part", F.explode(F.sequence(F.lit(0), (counts[F.col("part")] - 1).cast("int"))).alias("cell"),
        F.lit(True).alias("asks"), *names,
    )
    return rows.unionByName(asked)


def _best(
    queries: np.ndarray, query_rows: np.ndarray, least: np.ndarray, rows: np.ndarray,
    ids: np.ndarray, numbers: np.ndarray, count: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, row, score`` of each query's best rows but its own that have its least score;
    ``ids`` are in the order in which equally good rows are taken."""
    scores = queries @ rows.T
    scores[query_rows[:, None] == numbers[None, :]] = -np.inf
    place = max(0, scores.shape[1] - count)
    lowest = np.partition(scores, place, axis=1)[:, place] - _margin(queries, rows)
    query, row = np.nonzero((scores >= np.maximum(lowest, least)[:, None]) & (scores > -np.inf))
    exact = (queries[query] * rows[row]).sum(axis=1)
    order = np.lexsort((numbers[row], ids[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    kept = rank < count
    return query[kept], row[kept], exact[kept]


def compared(cells: DataFrame, count: int) -> DataFrame:
    """``row, query_id, vec_id, number, score``: the best of each cell for each query in it."""
    names = ["part", "cell", "asks", "row", "vec_id", "vector", "least"]
    ordered = cells.select(*names).repartition("part", "cell").sortWithinPartitions(*names[:3])
    kind = cells.schema["vec_id"].dataType
    schema = T.StructType().add("row", T.LongType()).add("query_id", kind).add("vec_id", kind)
    schema = schema.add("number", T.LongType()).add("score", T.DoubleType())

    def found(queries: pa.RecordBatch, rows: pa.RecordBatch, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers, vectors = rows.column("row").to_numpy(), _rows(rows)
        for begin in range(0, queries.num_rows, BLOCK):
            part = queries.slice(begin, BLOCK)
            query, row, score = _best(
                _rows(part), part.column("row").to_numpy(), part.column("least").to_numpy(),
                vectors, order, numbers, count,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").take(pa.array(query)),
                    part.column("vec_id").take(pa.array(query)),
                    rows.column("vec_id").take(pa.array(row)), pa.array(numbers[row]), pa.array(score),
                ],
                names=schema.names,
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, order = None, None, None
        for batch in batches:
            parts, numbers, asks = (
                batch.column(name).to_numpy(zero_copy_only=False) for name in names[:3]
            )
            change = (np.diff(parts) != 0) | (np.diff(numbers) != 0) | (np.diff(asks.astype(int)) != 0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            for begin, end in zip(starts, starts[1:]):
                if begin == end:
                    continue
                here, some = (parts[begin], numbers[begin]), batch.slice(begin, end - begin)
                if here != place:
                    place, held, order = here, None, None
                if not asks[begin]:
                    held = some if held is None else pa.concat_batches([held, some])
                    order = None
                elif held is not None:
                    if order is None:
                        order = pc.rank(held.column("vec_id"), tiebreaker="dense").to_numpy().astype(np.int64)
                    yield from found(some, held, order)

    return ordered.mapInArrow(work, schema)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    count: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell: int = CELL,
    router: Router | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` (a condition on
    ``vec_id``) holds, the nearest others found by inner product, nearest first.

    All rows are indexed. Equally near ones come by smaller id, null ids after others.
    Rows whose vector is null, empty, zero, of another length than most, or holds a null,
    infinite or undefined entry take no part. Rows that repeat are rows like any other: each
    asks and is found, and a copy of a query is its neighbour. Fewer rows than ``count`` are all
    given. An empty table, or no query, gives no rows. Other columns are not looked at.
    """
    rows = usable(vectors, id_col, vector_col)
    rows = rows.where(F.exists("vector", lambda c: c != 0))
    router = fit(rows, count) if router is None else router
    index = _indexed(rows, router, is_query, count)
    best = compared(in_cells(index, cell), count)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "number")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")

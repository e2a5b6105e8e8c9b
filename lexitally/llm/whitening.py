"""Embedding whitening by shifted CholeskyQR.

Vectors become whole numbers ``floor(64 * entry) + 1000000``. Their centred rows are the tall
matrix A. A pass over the rows sums the Gram matrix of A times the inverse of the R found so
far; its Cholesky factor, which the first time is that of the matrix with a small shift, is
multiplied onto R. After two or three passes the rows are orthonormal to rounding, and the
singular value decomposition of R gives the components without the squared condition number
that the covariance has.

Rows stay where they are: a task sends one Gram matrix, and these are summed entry by entry in
Spark. The driver holds a few matrices of dimension times dimension, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.vectors import usable

# Vectors to whole numbers. Entries beyond the bound, either way, count as the bound.
SCALE, OFFSET, BOUND = 64.0, 1_000_000, float(2**40)
# Components that are given.
COMPONENTS = 32
# Passes at most, and how near to the identity the last Gram matrix must be.
PASSES, TOLERANCE = 8, 1e-12
# Directions whose variance is below this share of the largest, times the dimensions, have none:
# it is the rounding of the first Gram matrix.
RANK = 1e-15
# Rows that are worked on at once.
ROWS = 4096
LONG_MAX = 2**63 - 1

FLAT_SCHEMA = "i int, j int, value double"


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``total`` per dimension; ``axes`` has a component per
    column, by falling ``eigenvalues``, and ``trace`` is that of the covariance."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, which have one length, as whole numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    scaled = np.floor(np.clip(SCALE * flat, -BOUND, BOUND)).astype(np.int64) + OFFSET
    return scaled.reshape(batch.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def centred(whole: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Rows less their mean; its whole part is taken off exactly."""
    return (whole - total // n) - (total % n) / n


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular factor, column by column."""
    found = np.empty_like(rows)
    for j in range(factor.shape[1]):
        known = found[:, :j] @ factor[:j, j]
        found[:, j] = (rows[:, j] - known) / factor[j, j]
    return found


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the matrices that tasks gave entry by entry."""
    table = rows.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros((size, size))
    at = table.column("i").to_numpy(), table.column("j").to_numpy()
    found[at] = table.column("value").to_numpy()
    return found


def _entries(values: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(values.shape, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(values.ravel())],
        names=["i", "j", "value"],
    )


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sums of their whole numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in _pieces(batches):
            part = matrix(batch).sum(axis=0)
            n, sums = n + batch.num_rows, part if sums is None else sums + part
        if sums is not None:
            values = np.concatenate([[n], sums])
            place = pa.array(np.arange(-1, len(sums), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([place, pa.array(values)], names=["j", "value"])

    parts = rows.mapInArrow(work, "j int, value long")
    table = parts.groupBy("j").agg(F.sum("value").alias("value")).orderBy("j").toArrow()
    values = table.column("value").to_numpy()
    return (int(values[0]), values[1:].copy()) if len(values) else (0, np.zeros(0, np.int64))


def gram(
    rows: DataFrame, n: int, total: np.ndarray, basis: np.ndarray | None = None,
    factor: np.ndarray | None = None,
) -> np.ndarray:
    """The Gram matrix of the centred rows, in a ``basis`` (a column per direction) if one is
    given, times the inverse of ``factor``."""
    size = len(total) if basis is None else basis.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in _pieces(batches):
            part = centred(matrix(batch), n, total)
            if basis is not None:
                part = part @ basis
            if factor is not None:
                part = solved(part, factor)
            part = part.T @ part
            found = part if found is None else found + part
        if found is not None:
            yield _entries(found)

    return _summed(rows.mapInArrow(work, FLAT_SCHEMA), size)


def _factor(values: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor; with a shift that makes rounding harmless where asked for,
    or where there is none without."""
    size = len(values)
    shift = 11 * (n * size + size * (size + 1)) * np.finfo(float).eps / 2 * np.trace(values)
    for _ in range(64):
        try:
            return np.linalg.cholesky(values + shifted * shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift, shifted = (100 * shift if shifted else shift), True
    raise ValueError("the Gram matrix has no Cholesky factor")


def fit(rows: DataFrame) -> Whitening:
    """The whitening of all ``vec_id, vector`` rows (`usable`)."""
    n, total = totals(rows)
    size = len(total)
    now = gram(rows, n, total) if n else np.zeros((0, 0))
    trace = float(np.trace(now))
    if not trace:
        return Whitening(n, total, np.zeros((size, 0)), np.zeros(0), 0.0)
    # Directions without variance would be rounding blown up by each pass: they are left out.
    values, vectors = np.linalg.eigh(now)
    varied = values > RANK * size * values[-1]
    basis = None if varied.all() else vectors[:, varied]
    if basis is not None:
        now = basis.T @ now @ basis
    factor = _factor(now, n, True)
    for _ in range(PASSES):
        now = gram(rows, n, total, basis, factor)
        if np.abs(now - np.eye(len(now))).max() < TOLERANCE:
            break
        factor = _factor(now, n, False) @ factor
    _, sizes, axes = np.linalg.svd(factor)
    axes = axes.T if basis is None else basis @ axes.T
    # Either sign is right; the largest entry is made positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitening(n, total, axes, sizes**2 / n, float((sizes**2).sum() / n))


def _projected(whole: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    rows = centred(whole, model.n, model.total)
    return rows @ model.axes[:, :components] / np.sqrt(model.eigenvalues[:components])


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity; 0 if there
    is no component."""
    size = len(model.eigenvalues[:components])
    if not size:
        return 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((size + 1, size + 1))
        for batch in _pieces(batches):
            part = _projected(matrix(batch), model, components)
            part = np.hstack([part, np.ones((len(part), 1))])
            found += part.T @ part
        if found[size, size]:
            yield _entries(found)

    sums = _summed(rows.mapInArrow(work, FLAT_SCHEMA), size + 1) / model.n
    covariance = sums[:size, :size] - np.outer(sums[:size, size], sums[:size, size])
    return float(np.abs(covariance - np.eye(size)).max())


def deviations(whole: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Per row the exact sum of ``(n * x - total) ** 2``; null if no long holds it."""
    apart = np.abs(whole.astype(object) * n - total) if n >= 2**20 else np.abs(whole * n - total)
    if not apart.size:
        return [0] * len(whole)
    if int(apart.max()) ** 2 * apart.shape[1] <= LONG_MAX:
        return (apart.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = (apart.astype(object) ** 2).sum(axis=1).tolist()
    return [value if value <= LONG_MAX else None for value in sums]


def whitened(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each
    component of each row that takes part, fitted on all of these.

    Rows whose vector is null, empty, of another length than most, or holds a null, infinite or
    undefined entry take no part. Components are numbered from 1; there are fewer where the rows have fewer directions with
    variance, and no rows if they have none (one vector, all equal, an empty table). Equal
    rows are as many rows of the result, null and repeated ids are kept, and other columns are
    not looked at. Equal eigenvalues may have any axes of their space. An entry of over 2**40 /
    64, either way, counts as that; `deviation` is null where no long holds it.
    """
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows)
    error = identity_error(rows, model, components)
    explained = model.eigenvalues[:components] / (model.trace or 1.0)
    size = len(explained)
    schema = T.StructType([rows.schema["vec_id"]])
    for name, kind in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
        ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()),
    ):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches) if size else ():
            whole = matrix(batch)
            count = batch.num_rows
            row = np.repeat(np.arange(count), size)
            far = pa.array(deviations(whole, model.n, model.total), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, model.n)),
                    far.take(pa.array(row)),
                    pa.array(_projected(whole, model, components).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * size, error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(work, schema)

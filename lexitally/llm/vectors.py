"""Rows of a table of vectors that can be worked with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector``, the entries as doubles, of the rows that take part.

    Rows go whose vector is null, empty, or holds a null, infinite or undefined entry, and
    rows whose vector does not have the commonest length (of several the largest).
    """
    named = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = named.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fits)
    lengths = kept.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return kept.where(F.size("vector") == (first["length"] if first else 0))

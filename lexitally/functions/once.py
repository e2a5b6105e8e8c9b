"""Values that are worked out once, however often they are mentioned.

Catalyst copies an expression to each place that mentions it, and a filter on a column
that was computed is pushed down with the whole computation in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``use`` may mention its argument many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns that filters and joins after them cannot repeat."""
    fields = [column.alias(name) for name, column in columns.items()]
    return rows.select("*", F.inline(F.array(F.struct(*fields))))

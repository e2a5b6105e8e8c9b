"""Keys stored in the state of a stream, and the answer to each row: was its key set?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    MapState,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from lexitally.operators.keyset import packed
from lexitally.sources.stores import BATCH, FIRST

# Keys are dealt to so many groups by hash, each with a map of its keys in the state. A group costs
# far more than a row, so keys do not get one each.
GROUPS = 256
# What goes to the processor beside a row's own columns: its group, its key, its place in the order,
# if it may store its key, and if it only tells that others may.
GROUP, KEY, PLACE, MAY, TELLS = "group", "key", "place", "may", "tells"
ANSWERS = f"{BATCH} BIGINT, stored BOOLEAN, first BOOLEAN, may BOOLEAN"


class KeyInsert(StatefulProcessor):
    """Stores each key with its first row, and answers every row.

    The rows of a group come in pieces, of which one is held at a time, and beside it the first
    row so far of each new key. Where others tell that a key may be stored, rows that cannot be
    answered before all of them have come are held as well.
    """

    def __init__(self, told: bool) -> None:
        self.told = told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState(FIRST, "key string", f"{BATCH} long, place string")
        if self.told:
            self.open = handle.getMapState("open", "key string", f"{BATCH} long")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        batch = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
        known: dict[str, bool] = {}
        held, waiting = None, []
        for part in self._telling(rows, batch, waiting) if self.told else rows:
            stored = self._among(part[KEY], self.first, known)
            able = part[MAY].to_numpy() & ~stored & part[KEY].notna().to_numpy()
            yield _answered(part[~able], batch, stored[~able])
            some = part[able] if held is None else pd.concat([held, part[able]], ignore_index=True)
            if len(some):
                # The first row so far of each key is held back, any other one is answered.
                order = np.lexsort((some[PLACE].to_numpy().astype("S"), pd.factorize(some[KEY])[0]))
                ordered = some[KEY].to_numpy()[order]
                best = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                held = some.iloc[order[best]]
                yield _answered(some.iloc[order[~best]], batch, False)
        if held is not None:
            for name, place in zip(held[KEY], held[PLACE]):
                self.first.updateValue((name,), (batch, place))
            yield _answered(held, batch, False, True)

    def _among(self, keys: pd.Series, state: MapState, known: dict[str, bool]) -> np.ndarray:
        """Which of the keys the state has; each is looked up once."""
        codes, names = pd.factorize(keys)
        for name in names:
            if name not in known:
                known[name] = state.containsKey((name,))
        found = np.array([known[name] for name in names] + [False], dtype=bool)
        return found[codes]

    def _telling(
        self, rows: Iterator[pd.DataFrame], batch: int, waiting: list[pd.DataFrame]
    ) -> Iterator[pd.DataFrame]:
        """The rows that are to be answered; those of opened keys may store them."""
        known: dict[str, bool] = {}
        told: set[str] = set()
        for part in rows:
            tells = part[TELLS].to_numpy()
            told.update(part[KEY][tells])
            part = part[~tells]
            may = part[MAY].to_numpy() | self._among(part[KEY], self.open, known)
            decided = may | part[KEY].isna().to_numpy()
            waiting.append(part[~decided])
            yield part[decided].assign(**{MAY: may[decided]})
        for name in told:
            if not known.get(name, False):
                self.open.updateValue((name,), (batch,))
        for part in waiting:
            yield part.assign(**{MAY: part[KEY].isin(told)})

    def close(self) -> None:
        pass


def _answered(part: pd.DataFrame, batch: int, stored, first: bool = False) -> pd.DataFrame:
    names = [name for name in part.columns if name not in (GROUP, KEY, PLACE, MAY, TELLS)]
    answers = {BATCH: batch, "stored": stored, "first": first, "may": part[MAY].to_numpy()}
    return pd.DataFrame({name: part[name].array for name in names} | answers, index=part.index)


def stream_insert(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    mark: Column | None = None,
    may: Column | None = None,
    told: DataFrame | None = None,
) -> DataFrame:
    """The rows of a stream with ``batch_id, stored, first, may``.

    The first row of a key by ``order`` in the first batch that has one stores the key: it is
    ``first``. Rows of later batches find it ``stored``. So a row's key was set before it came
    unless it is ``first``, and rows that are neither came in the batch that stored the key, or
    may not store theirs. Rows without a key are neither. ``mark``, a number, tells rows of one
    place apart; of rows that are equal in that too one is taken.

    ``may`` says if a row may store its key, all may unless given. Keys of the stream ``told``
    may from the batch on in which they come; the answers say so.

    The state has a row per key, as text. Columns must be of plain types.
    """
    place = packed(rows, order)
    if place is None:
        raise ValueError(f"rows cannot be put in order by {', '.join(order)}")
    columns = rows.columns
    tie = F.lit("") if mark is None else F.lpad(F.hex(mark), 16, "0")
    # Rows without a key may go anywhere.
    dealt = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))
    group = F.pmod(dealt.otherwise(F.xxhash64(*columns)), F.lit(GROUPS)).cast("int")
    # Text keeps every value as it is on its way through pandas, which has no null numbers.
    inner = [f"c{i}" for i in range(len(columns))]
    texts = [F.base64(c) if t == "binary" else F.col(c).cast("string") for c, t in rows.dtypes]
    place = F.concat(F.lpad(place.cast("string"), 38, "0"), tie)
    asked = rows.select(
        *[text.alias(name) for text, name in zip(texts, inner)],
        F.col(key).cast("string").alias(KEY),
        group.alias(GROUP),
        place.alias(PLACE),
        F.coalesce(F.lit(True) if may is None else may, F.lit(False)).alias(MAY),
        F.lit(False).alias(TELLS),
    )
    if told is not None:
        tells = told.where(F.col(key).isNotNull()).select(
            *[F.lit(None).cast("string").alias(name) for name in inner],
            F.col(key).cast("string").alias(KEY),
            F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(GROUPS)).cast("int").alias(GROUP),
            F.lit("").alias(PLACE), F.lit(True).alias(MAY), F.lit(True).alias(TELLS),
        )
        asked = asked.unionByName(tells)
    schema = ", ".join(f"{name} STRING" for name in inner)
    found = asked.groupBy(GROUP).transformWithStateInPandas(
        KeyInsert(told is not None), f"{schema}, {ANSWERS}", "Append", "None"
    )
    back = [
        (F.unbase64(name) if t == "binary" else F.col(name).cast(t)).alias(c)
        for name, (c, t) in zip(inner, rows.dtypes)
    ]
    return found.select(
        *back, BATCH, "stored", "first", "may"
    )

"""Hierarchical packing of documents into sequences of several lengths.

Documents are cut into full windows of the longest length; what is left of each is routed to
the shortest tier that holds it. Tiers are packed from the longest to the shortest: a window
begins with a piece of its own tier, and its gap is filled with the longest pieces of shorter
tiers that fit, the last gap with the head of a piece that is cut there. Windows are full, but
for the last ones of a task, whose ids go to windows of falling length. Full windows of all
tiers are then dealt to steps of equal numbers of ids.

Each task packs what it reads, in the order in which it reads it, and holds no more than the
pieces and windows that wait: there is no shuffle, and a lost task gives the same again.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.encode import encoder, slices

# Lengths of sequences; all powers of two, the longest last.
TIERS = (64, 128, 256, 512, 1024)
# Ids of a step, and steps that are balanced together.
STEP_IDS = 8192
STEPS = 16
# Sequences of a task at most, as a power of two.
TASK_BITS = 40
# Bytes of an id.
WIDTH = 4


@dataclass
class Piece:
    """``length`` ids of a document from ``start`` on."""

    length: int
    doc: int
    start: int
    ids: bytes = field(repr=False)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = length * WIDTH
        return (
            Piece(length, self.doc, self.start, self.ids[:at]),
            Piece(self.length - length, self.doc, self.start + length, self.ids[at:]),
        )


@dataclass
class Window:
    size: int
    pieces: list[Piece]
    number: int = 0
    step: int = 0

    @property
    def filled(self) -> int:
        return sum(piece.length for piece in self.pieces)


class Packer:
    """Windows out of documents that come one after the other."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if any(tier & (tier - 1) for tier in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be powers of two in rising order")
        self.tiers = tiers
        # Pieces that wait, by length; those of a tier stand together.
        self.waiting: list[Piece] = []

    def add(self, doc: int, ids: bytes) -> list[Window]:
        """The full windows of a document; its rest waits."""
        longest = self.tiers[-1]
        n = len(ids) // WIDTH
        windows = []
        for start in range(0, n - longest + 1, longest):
            part = ids[start * WIDTH : (start + longest) * WIDTH]
            windows.append(Window(longest, [Piece(longest, doc, start, part)]))
        if rest := n % longest:
            self._wait(Piece(rest, doc, n - rest, ids[(n - rest) * WIDTH :]))
        return windows

    def _wait(self, piece: Piece) -> None:
        insort(self.waiting, piece, key=lambda other: other.length)

    def _tier(self, length: int) -> int:
        return next(tier for tier in self.tiers if tier >= length)

    def _take(self, most: int) -> Piece | None:
        """The longest piece that waits, of those up to a length."""
        at = bisect_right(self.waiting, most, key=lambda piece: piece.length)
        return self.waiting.pop(at - 1) if at else None

    def pack(self) -> list[Window]:
        """Full windows of what waits, as far as there are pieces to fill them."""
        windows = []
        total = sum(piece.length for piece in self.waiting)
        # What is left must be able to fill the window of the longest piece.
        while self.waiting and total >= self._tier(self.waiting[-1].length):
            first = self.waiting.pop()
            window = Window(self._tier(first.length), [first])
            gap = window.size - first.length
            while gap:
                piece = self._take(gap)
                if piece is None:
                    # All that wait are longer than the gap; the shortest one is cut.
                    piece, rest = self.waiting.pop(0).cut(gap)
                    self._wait(rest)
                window.pieces.append(piece)
                gap -= piece.length
            total -= window.size
            windows.append(window)
        return windows

    def finish(self) -> list[Window]:
        """All that still waits, in windows of falling length; the last may not be full."""
        windows = self.pack()
        rest = self.waiting[::-1]
        self.waiting = []
        while rest:
            total = sum(piece.length for piece in rest)
            fits = [tier for tier in self.tiers if tier <= total]
            size = fits[-1] if fits else total
            window = Window(self.tiers[-1] if not fits else size, [])
            gap = size
            while gap:
                piece = rest.pop(0)
                if piece.length > gap:
                    piece, left = piece.cut(gap)
                    rest.insert(0, left)
                window.pieces.append(piece)
                gap -= piece.length
            windows.append(window)
        return windows


def deal(windows: list[Window], first_step: int, step_ids: int = STEP_IDS) -> int:
    """Give windows to steps of about ``step_ids`` ids, the longest first; the next step."""
    total = sum(window.size for window in windows)
    steps = [(0, first_step + k) for k in range(max(1, round(total / step_ids)))]
    heapq.heapify(steps)
    for window in sorted(windows, key=lambda w: -w.size):
        filled, step = heapq.heappop(steps)
        window.step = step
        heapq.heappush(steps, (filled + window.size, step))
    return first_step + len(steps)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    tiers: tuple[int, ...] = TIERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length, tier, step_id``.

    ``tokenizer`` is the path of a tokenizers file; without ``with_ids`` the column ``ids``
    is null. ``end_id`` follows each document's ids
    and counts in ``doc_tokens``. ``ids`` are little-endian unsigned 32-bit numbers.
    ``sequence_length`` is the number of ids of the sequence, ``tier`` the length it is
    padded to. Numbers of sequences and steps are unique, not gapless. A null text is an
    empty one, of which the end id alone is packed; repeated rows and null ids are
    documents like any other. An empty table gives no rows. Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = T.StructType(
        [
            named.schema["doc_id"],
            *[
                T.StructField(name, kind)
                for name, kind in (
                    ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
                    ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()),
                    ("sequence_id", T.LongType()), ("offset", T.LongType()),
                    ("sequence_length", T.LongType()), ("tier", T.IntegerType()),
                    ("step_id", T.LongType()),
                )
            ],
        ]
    )
    end = end_id.to_bytes(WIDTH, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << TASK_BITS
        packer = Packer(tiers)
        # Of documents of which pieces wait or are in windows that wait.
        names: dict[int, tuple] = {}
        numbers = {"doc": 0, "window": base, "step": base}
        queue: list[Window] = []
        id_type = None

        def rows(windows: list[Window]) -> pa.RecordBatch:
            numbers["step"] = deal(windows, numbers["step"])
            columns: list[list] = [[] for _ in whole.fields]
            for window in windows:
                offset, filled = 0, window.filled
                for piece in window.pieces:
                    doc_id, n = names[piece.doc]
                    row = (
                        doc_id, piece.start, piece.length,
                        piece.ids if with_ids else None, zlib.crc32(piece.ids), n,
                        numbers["window"], offset, filled, window.size, window.step,
                    )
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += piece.length
                numbers["window"] += 1
            types = [
                id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
            ]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names=whole.names)

        def groups(everything: bool) -> list[list[Window]]:
            """Windows of the queue in groups of ``STEPS`` steps, taken out of it."""
            found: list[list[Window]] = [[]]
            size = 0
            for window in queue:
                found[-1].append(window)
                size += window.size
                if size >= STEP_IDS * STEPS:
                    found.append([])
                    size = 0
            rest = found.pop()
            queue.clear()
            if everything and rest:
                found.append(rest)
            else:
                queue.extend(rest)
            return found

        def forget() -> None:
            used = {piece.doc for piece in packer.waiting}
            used.update(piece.doc for window in queue for piece in window.pieces)
            for doc in [doc for doc in names if doc not in used]:
                del names[doc]

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts):
                for doc_id, found in zip(ids[part], encoder(tokenizer).encode(texts[part])):
                    numbers["doc"] += 1
                    names[numbers["doc"]] = (doc_id, len(found) // WIDTH + 1)
                    queue += packer.add(numbers["doc"], found + end)
                queue += packer.pack()
                for group in groups(False):
                    yield rows(group)
                forget()
        queue += packer.finish()
        for group in groups(True):
            yield rows(group)

    return named.mapInArrow(work, whole)

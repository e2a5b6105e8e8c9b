"""Spelling variants: words of a corpus with near words that are much more frequent.

Near words differ by one symbol replaced, inserted or deleted. Of two words of which the shorter
has ``m`` symbols, they then have the first ``m // 2`` or the last ``m - m // 2`` symbols
in common. So every word goes, for both halves and for ``m`` as its length and one less, to the
words with the same half. Words that meet are put into bidirectional FM-indexes (`fm_index`) of
bounded size, and each is searched there: its half is matched exactly from the middle to the
delimiter, and the interval is extended over the other half with one error. No two words are
compared, and what a half has in common with a third of all words costs memory in no task: such
words are dealt over several indexes, each of which all of them search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.fm_index import LEFT, RIGHT, BidirectionalIndex, near_words
from lexitally.session import written

# Letters of words, and which are lowered.
LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Of runs whose hash this number divides one letter is taken away.
TYPO = 97
# A word's least length and occurrences, and how many times as frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 5, 3, 2
# Symbols of an index, but for one that holds a single word.
SYMBOLS = 1 << 20

ROW_SCHEMA = "word string, n long, near long, form string, form_n long"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words of all texts, with the letters that the rule takes away.

    A null text has no words; in a row without an id no letter is taken away.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LENGTH)
    run, code = F.col("run"), F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (code % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    words = runs.select(F.when(code % TYPO == 0, shorter).otherwise(run).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= LENGTH) & (F.col("n") >= OCCURRENCES))


def halves(words: DataFrame) -> DataFrame:
    """``way, m, key, word, n``: each word with every half that a near word can share.

    ``way`` is the direction of the search from the half: over what follows the first half, or
    over what stands before the last one.
    """
    length = F.length("word")
    sizes = F.when(length > LENGTH, F.array(length - 1, length)).otherwise(F.array(length))
    rows = words.select("word", "n", F.explode(sizes).alias("m"))
    first = F.floor(F.col("m") / 2).cast("int")
    last = F.col("m") - first
    both = F.array(
        F.struct(F.lit(RIGHT).alias("way"), F.substr("word", F.lit(1), first).alias("half")),
        F.struct(F.lit(LEFT).alias("way"), F.substr("word", F.length("word") - last + 1).alias("half")),
    )
    rows = rows.select("word", "n", "m", F.inline(both))
    return rows.select("way", "m", F.xxhash64("way", "m", "half").alias("key"), "word", "n")


def dealt(rows: DataFrame, symbols: int) -> DataFrame:
    """The rows with ``cell, indexed, asked``: where a word is indexed and where it is searched.

    Words of one half of up to so many ``symbols`` meet in one cell, -1. More are dealt to
    parts by hash, and each pair of parts is a cell, in which the words of one part are searched
    among the other's.
    """
    parts = F.least(F.ceil(2 * F.col("size") / symbols), 2 * F.col("words")).cast("int")
    large = (
        rows.groupBy("key")
        .agg(F.sum(F.col("m") + 2).alias("size"), F.count("*").alias("words"))
        .where((F.col("size") > symbols) & (F.col("words") > 1))
        .select("key", parts.alias("parts"))
    )
    # Written first, so that Spark knows its size, mostly nothing, before it plans the join.
    rows = rows.join(written(large, "spelling-large"), "key", "left")
    own, parts = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.col("parts")

    def cell(one, other, indexed: bool, asked: bool):
        number = (one * parts + other).alias("cell")
        return F.struct(number, F.lit(indexed).alias("indexed"), F.lit(asked).alias("asked"))

    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own)
    cells = F.concat(
        F.array(cell(own, own, True, True)),
        F.transform(others, lambda x: cell(own, x, True, False)),
        F.transform(others, lambda x: cell(x, own, False, True)),
    )
    alone = F.struct(F.lit(-1).alias("cell"), F.lit(True).alias("indexed"), F.lit(True).alias("asked"))
    cells = F.when(parts.isNull(), F.array(alone)).otherwise(cells)
    return rows.select("way", "m", "key", "word", "n", F.inline(cells))


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The words as rows of dense symbols in code-point order, their lengths, and the bits."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    used, symbols = np.unique(codes, return_inverse=True)
    found = np.zeros((len(words), width), dtype=np.int16)
    found[np.arange(width) < lengths[:, None]] = symbols + 1
    return found, lengths, max(1, int(len(used)).bit_length())


def searched(way: int, m: int, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """For each asked word with near ones among the indexed words how many these are, and the
    most frequent of them, of several the first in code-point order."""
    order = np.array(sorted(range(len(rows["word"])), key=rows["word"].__getitem__))
    words = [rows["word"][i] for i in order]
    n, indexed, asked = (rows[name][order] for name in ("n", "indexed", "asked"))
    matrix, lengths, bits = _matrix(words, m + 1)
    kept = np.flatnonzero(indexed)
    index = BidirectionalIndex(matrix[kept], lengths[kept], bits)
    first = m // 2
    half = first if way == RIGHT else m - first
    found = []
    for length, kinds in ((m, (True, True, False)), (m + 1, (False, False, True))):
        some = np.flatnonzero(asked & (lengths == length))
        if len(some):
            row, hit = near_words(index, matrix[some], lengths[some], half, way, kinds)
            found.append((some[row], kept[hit]))
    row, hit = (np.concatenate(side) for side in zip(*found))
    if way == LEFT:
        # Words that also share the first half are found from there.
        new = (matrix[row, :first] != matrix[hit, :first]).any(axis=1)
        row, hit = row[new], hit[new]
    best = np.lexsort((hit, -n[hit], row))
    row, hit = row[best], hit[best]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    near = np.diff(np.append(starts, len(row)))
    row, hit = row[starts], hit[starts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in row], pa.string()), pa.array(n[row]), pa.array(near),
            pa.array([words[i] for i in hit], pa.string()), pa.array(n[hit]),
        ],
        names=["word", "n", "near", "form", "form_n"],
    )


def _ends(way: np.ndarray, m: np.ndarray, cell: np.ndarray, key: np.ndarray, symbols: int) -> list[int]:
    """Where sorted rows are cut: where direction, length or cell change, and between halves
    after so many symbols."""
    group = np.flatnonzero(np.diff(key) != 0) + 1
    change = (np.diff(way) != 0) | (np.diff(m) != 0) | (np.diff(cell) != 0)
    hard = set((np.flatnonzero(change) + 1).tolist())
    ends, total, before = [], 0, 0
    for end in group.tolist():
        total += (end - before) * (int(m[before]) + 1)
        before = end
        if end in hard or total >= symbols:
            ends.append(end)
            total = 0
    return ends


def near_counts(rows: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """`searched` for all cells of `dealt` rows, several halves in one index."""
    names = ["way", "m", "cell", "key", "word", "n", "indexed", "asked"]
    ordered = (
        rows.select(*names).repartition("way", "m", "cell", "key").sortWithinPartitions(*names[:4])
    )

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        # A word whose half no other word of the cell has is near to none of them.
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if not met.any():
            return None
        batch = batch.filter(pa.array(met))
        found = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in names[5:]}
        found["word"] = batch.column("word").to_pylist()
        if not (found["indexed"].any() and found["asked"].any()):
            return None
        return searched(batch.column("way")[0].as_py(), batch.column("m")[0].as_py(), found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch if held is None else pa.concat_batches([held, batch])
            places = (now.column(name).to_numpy() for name in names[:4])
            begin = 0
            for end in _ends(*places, symbols):
                if found := chunk(now.slice(begin, end - begin)):
                    yield found
                begin = end
            held = now.slice(begin)
        if held is not None and (found := chunk(held)):
            yield found

    return ordered.mapInArrow(work, ROW_SCHEMA)


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow a word, for every word that has one.

    Frequencies at least double from word to form, so chains are short and have no rings. Each
    round goes twice as far as the one before.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(further, "root", "left")
        after = joined.select("word", F.coalesce("next", "root").alias("root"), "next")
        after = written(after, "spelling-roots")
        if after.where(F.col("next").isNotNull()).isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    symbols: int = SYMBOLS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of `vocabulary`.

    ``n_near`` near words has a word; its form is the most frequent of them, of equally frequent
    ones the first in code-point order, if it is at least twice as frequent, else null. Only
    the two columns are read. Null and empty texts, an empty table and texts without a long word
    give no words; rows that repeat count as often as they come; a word may have any length.
    """
    words = written(vocabulary(docs, id_col, text_col), "spelling-words")
    found = near_counts(dealt(halves(words), symbols), symbols)
    none = words.select(
        "word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("form"),
        F.lit(None).cast("long").alias("form_n"),
    )
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))
    merged = none.unionByName(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(best).alias("best")
    )
    much = -F.col("best.less") >= TIMES * F.col("n")
    named = written(
        merged.select(
            "word", "n", "n_near", F.when(much, F.col("best.form")).alias("form"),
            F.when(much, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = rooted(named.where(F.col("form").isNotNull()))
    joined = named.join(roots, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

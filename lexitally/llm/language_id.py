"""Language identification: words first, then ever shorter character n-grams.

The model is fitted on a bounded sample of labelled documents: at most ``PER_LANGUAGE`` of
each language, chosen by a hash of the id. It holds, per language, the ``WORDS`` most frequent
words and the ``GRAMS`` most frequent character n-grams of each length, so its size is bounded
by the number of languages, and it is sent to all tasks. A word that the model has in any
language scores by its log frequency in each; another scores by its longest n-grams that the
model has, less for every length that is given up. Languages are equally likely beforehand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.encode import slices

PER_LANGUAGE = 5_000
WORDS = 20_000
GRAMS = 5_000
LONGEST = 5
# What a shorter n-gram's score is multiplied by, and what is added to each count.
BACKOFF = 0.8
ADDED = 0.5
UNKNOWN = "und"
# Tokens remembered by a worker, and tokens of a long text that are worked on together.
REMEMBERED = 700_000
STEP = 200_000

LETTERS = regex.compile(r"\p{L}+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders; single letters have none."""
    if n == 1:
        return list(word)
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


@dataclass
class Model:
    """Log frequencies per language of words (length 0) and of n-grams of each length."""

    languages: list[str]
    rows: dict[int, dict[str, int]]
    scores: dict[int, np.ndarray]
    # Score and number of words of tokens between white space.
    tokens: dict[str, int] = field(default_factory=dict)
    sums: np.ndarray | None = None

    @classmethod
    def of(cls, counts: list[tuple[str, int, str, int]]) -> Model:
        """From rows of language, length, gram and count."""
        languages = sorted({language for language, _, _, _ in counts})
        rows: dict[int, dict[str, int]] = {}
        for _, n, gram, _ in counts:
            known = rows.setdefault(n, {})
            known.setdefault(gram, len(known))
        tables = {n: np.full((len(known), len(languages)), ADDED) for n, known in rows.items()}
        place = {language: i for i, language in enumerate(languages)}
        for language, n, gram, count in counts:
            tables[n][rows[n][gram], place[language]] += count
        scores = {n: np.log(table / table.sum(axis=0)) for n, table in tables.items()}
        return cls(languages, rows, scores)

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words in small letters, a row each."""
        found = np.zeros((len(words), len(self.languages)))
        whole = self.rows.get(0, {})
        # Of each length: the words it scores, their n-grams, and how many each has.
        places: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        grams_of: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        sizes: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        lengths = [(n, self.rows[n]) for n in range(LONGEST, 0, -1) if n in self.rows]
        for i, word in enumerate(words):
            if (row := whole.get(word)) is not None:
                places[0].append(i)
                grams_of[0].append(row)
                sizes[0].append(1)
                continue
            for n, known in lengths:
                if rows := [known[gram] for gram in grams(word, n) if gram in known]:
                    places[n].append(i)
                    grams_of[n] += rows
                    sizes[n].append(len(rows))
                    break
        for n, at in enumerate(places):
            if at:
                count = np.array(sizes[n])
                sums = np.add.reduceat(self.scores[n][grams_of[n]], np.cumsum(count) - count)
                weight = BACKOFF ** (LONGEST - n) if n else 1.0
                found[at] = weight * sums / count[:, None]
        return found

    def _learn(self, new: list[str]) -> None:
        """Work out the scores of tokens that are not remembered, all at once."""
        first = len(self.tokens)
        self.tokens.update(zip(new, range(first, first + len(new))))
        words = [LETTERS.findall(token.lower()) for token in new]
        distinct = list(set(chain.from_iterable(words)))
        place = dict(zip(distinct, range(len(distinct))))
        scores = self.words(distinct)
        counts = np.array([len(found) for found in words])
        flat = [place[word] for word in chain.from_iterable(words)]
        self.sums[first : first + len(new)] = 0.0
        self.sums[first : first + len(new), -1] = counts
        has = np.flatnonzero(counts)
        if len(has):
            starts = (np.cumsum(counts) - counts)[has]
            self.sums[first + has, :-1] = np.add.reduceat(scores[flat], starts)

    def _totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores and number of words of lists of tokens."""
        known = self.tokens
        needed = set(chain.from_iterable(texts))
        new = needed.difference(known)
        if self.sums is None or len(known) + len(new) > len(self.sums):
            # All is forgotten to make room, and what is needed now worked out again.
            known.clear()
            new = needed
            self.sums = np.zeros((max(REMEMBERED, len(new)), len(self.languages) + 1))
        if new:
            self._learn(list(new))
        return [
            self.sums[np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)
            for tokens in texts
        ]

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text and its probability; nothing is known of texts without
        a letter."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = []
        for part in slices(texts):
            tokens = [text.split() for text in texts[part]]
            if len(tokens) == 1:
                # One long text goes in steps, so that what is remembered stays bounded.
                steps = [tokens[0][i : i + STEP] for i in range(0, len(tokens[0]), STEP)] or [[]]
                totals = [sum(self._totals([step])[0] for step in steps)]
            else:
                totals = self._totals(tokens)
            for total in totals:
                best = int(np.argmax(total[:-1]))
                chance = 1.0 / np.exp(total[:-1] - total[best]).sum()
                found.append((self.languages[best], float(chance)) if total[-1] else (UNKNOWN, 0.0))
        return found

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a row without an id is not held out."""
    rest = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` rows of each language, or all; ``doc_id, lang, text``."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # One row per language.
    return labelled.join(F.broadcast(counts), "lang").where(draw < per_language / F.col("n"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(language, Counter()).update(LETTERS.findall(text.lower()))
        columns: list[list] = [[], [], [], []]
        for language, counted in words.items():
            for n in range(LONGEST + 1):
                found = counted
                if n:
                    found = Counter()
                    for word, count in counted.items():
                        for gram in grams(word, n):
                            found[gram] += count
                columns[0] += [language] * len(found)
                columns[1] += [n] * len(found)
                columns[2] += found.keys()
                columns[3] += found.values()
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds)],
            names=["lang", "n", "gram", "count"],
        )


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """The model of the labelled rows of ``docs``; rows without an id, text or label are not
    learned from."""
    labelled = docs.where(~is_held_out(id_col)).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    labelled = labelled.where("doc_id is not null and lang is not null and text is not null")
    counted = sample(labelled).select("lang", "text").mapInArrow(
        _gram_counts, "lang string, n int, gram string, count long"
    )
    sums = counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    order = W.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")
    limit = F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)
    kept = (
        sums.withColumn("nth", F.row_number().over(order))
        .where((F.col("nth") <= WORDS) & (F.col("nth") <= limit))
        .select("lang", "n", "gram", "count")
    )
    # Bounded for each language by the numbers above.
    return Model.of([tuple(row) for row in kept.collect()])


def predicted(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, repeated ones too.

    Texts that are null or have no letter, and all texts if nothing was learned, are
    ``und`` with score zero. An empty table gives no rows. Only the text is looked at.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            named.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = own.predict_all([text or "" for text in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=schema.names,
            )

    return named.mapInArrow(work, schema)

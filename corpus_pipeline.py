"""From raw documents to packed sequences: five stages over the whole corpus.

Each stage takes the documents that its predecessor kept, as a table that has been written and
read again, and works on all of them. All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

In every stage a null text counts as an empty one, texts may have any length and are read whole,
columns besides id, text, language and source are carried along whatever they are named, and an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexitally.llm import exact_dedup, packing, quality_rules, queries, simhash
from lexitally.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of quality rules.

    Each row is judged by itself, so repeated rows stay or go together. An empty text fails.
    """
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    A row without an id stays only if no row of its text has one. Of rows that repeat both id and
    text one stays. Texts are compared by their whole SHA-256.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, alike by 0.8 or more in five-word shingles, one.

    The smallest id stays, of several texts with that id the one with the smallest SHA-256; rows
    without an id come last, and rows that repeat both id and text stay or go together. Blocks of
    SimHash fingerprints put most copies together; what they leave apart is compared by the first
    shingles of each set, which miss no pair, and every link is verified by the shingles. Texts
    without a word are alike.
    """
    return simhash.deduplicated(docs, simhash.SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and size classes have their target weights.

    A null source or language is one of its own, the same as an empty one. Rows of one id are drawn
    or left together, and the draw depends on nothing but the id.
    """
    return queries.mixture(docs).where("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids.

    An empty text is its end id alone. Rows that repeat are packed as often as they come.
    """
    return packing.pack(docs, queries.TOKENIZER, end_id=0, with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

# Fingerprints and tokens cannot be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

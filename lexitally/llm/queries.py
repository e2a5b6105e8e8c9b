"""The registered queries of the operators, and their answers in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.llm import (
    exact_dedup,
    html_extraction,
    language_id,
    mixing,
    neighbours,
    packing,
    quality_rules,
    sharding,
    simhash,
    spelling,
    token_counts,
    token_files,
    whitening,
)
from lexitally.llm import sql as answers

SHARDS = 40
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Powers below one lift small sources, languages and size classes.
MIX = {"source": 0.5, "lang": 0.7, "topic": 0.5}
MIX_SHARE = 0.5


def mixture(docs: DataFrame) -> DataFrame:
    """Documents with the probability of their source, language and topic."""
    return mixing.mixed(
        docs,
        {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.size_class()},
        {name: mixing.tempered(power) for name, power in MIX.items()},
        MIX_SHARE,
    )


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    found = html_extraction.extracted(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its probability in the mixture, and whether it was drawn."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixture(docs).select(
        "row.doc_id", "source", "lang", "topic", "tokens",
        F.round("probability", 4).alias("probability"), "kept",
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    docs = table(spark, folder, "documents")
    return sharding.shard_contiguous(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    docs = table(spark, folder, "documents")
    return packing.pack(docs, TOKENIZER, end_id=0, with_ids=False).drop("ids")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of every document, and whether they are more than 512."""
    counts = token_counts.token_counts(table(spark, folder, "documents"), TOKENIZER)
    over = F.col("n_tokens") > token_counts.LIMIT
    return counts.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and the verdict of the table of rules."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs)
    return judged.select("row.doc_id", "counts.*", "base_failed", "kept")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs)
    held_out = language_id.is_held_out().alias("held_out")
    return language_id.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out, "lang_pred", "score"
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one of its text that stays."""
    found = exact_dedup.duplicates(table(spark, folder, "documents"))
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", digest)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the component that it is in."""
    found = simhash.near_groups(table(spark, folder, "documents"))
    fingerprint = F.lower(F.lpad(F.hex("narrow"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document, written to files and read back from them."""
    docs = table(spark, folder, "documents")
    files = token_files.write(docs, token_files.scratch_folder(spark), TOKENIZER, end_id=2)
    return token_files.digests(files)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first 32 whitened components of all."""
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with the frequent word that it is a variant of."""
    return spelling.variants(table(spark, folder, "documents"))


def op13_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found among all vectors of those whose id is divisible by 20."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_mixing, op3_sharding, op4_packing, op5_token_counts, op6_quality_rules,
        op7_language_id, op8_exact_dedup, op9_simhash, op10_token_files,
        op11_whitening, op12_spelling, op13_neighbours,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": answers.mixing(MIX, MIX_SHARE),
    "op6_quality_rules": answers.quality_rules(),
    "op8_exact_dedup": answers.EXACT_DEDUP,
}

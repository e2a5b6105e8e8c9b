"""Tokenizer, stop list and stemmer."""

import hashlib
import random
import time

import compare
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexitally.functions import stemming, stopwords, text
from lexitally.operators.counts import flat_tokens, word_counts
from lexitally.plans import oracle

TOKENS = [
    ("<b>foo</b>bar baz", "foobar baz"),
    ("foo\nbar", "foobar"),
    ("wi-fi 4k don't", "wi fi"),
    ("The Kindle, reader.", "kindle reader"),
    ("été", ""),
    ("", ""),
    (None, ""),
    ("a < b and c", ""),
    ("x <y foo <z bar", "foo bar"),
    ("<a\nhref>glue</a>d CC-BY-NC!", "glued cc nc"),
    (" lead  and   trail ", "lead trail"),
    ("UPPER\ttab 100% a1b2", "uppertab ab"),
]

STEMS = """
caresses caress ponies poni ties ti cats cat feed feed agreed agre disabled disabl
matting mat mating mate meetings meet milling mill messing mess ies i aed a als al
happy happi sky sky yes ye yyy yyi relational relat conditional condit
rationalization ration hopping hop hoping hope controlling control adoption adopt
station station geology geologi electricity electr goodness good replacement replac
universities univers kindle kindl ones on uses us names name takes take parts part
""".split()
STEMS = list(zip(STEMS[::2], STEMS[1::2]))


def values(spark, column, expression, rows):
    frame = spark.createDataFrame([(r,) for r in rows], f"{column} string")
    return [r[0] for r in frame.select(expression(F.col(column)).alias("x")).collect()]


def test_stop_list():
    words = stopwords.english_stop_words()
    assert len(words) == 368
    digest = hashlib.sha256("\n".join(words).encode()).hexdigest()
    assert digest == "b4546516dc2c5435dd01cc101eb6b577b912363e26b3bc1d63b73da498bc392a"


def test_plain_tokens(spark):
    found = values(
        spark, "t", lambda c: F.array_join(text.plain_tokens(c), " "), [t for t, _ in TOKENS]
    )
    assert found == [want for _, want in TOKENS]


def test_single_steps_agree_with_the_fused_form(spark):
    def step_by_step(c):
        letters = text.keep_letters(text.punct_to_space(text.strip_tags(c)))
        return F.array_join(F.filter(text.split_words(F.lower(letters)), lambda w: w != ""), " ")

    def fused(c):
        return F.array_join(F.filter(text.clean_words(c), lambda w: w != ""), " ")

    chars = "abZ <>-+:;,.\n\t é1'"
    rng = random.Random(3)
    rows = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert values(spark, "t", step_by_step, rows) == values(spark, "t", fused, rows)


def test_many_unclosed_tags_take_linear_time(spark):
    frame = spark.range(1).select(F.repeat(F.lit("<ab "), 500_000).alias("t"))
    begin = time.time()
    kept = frame.select(F.length(text.strip_tags(F.col("t")))).first()[0]
    assert kept == 2_000_000 and time.time() - begin < 30


def test_stem_vectors(spark):
    found = values(spark, "w", stemming.stem, [w for w, _ in STEMS])
    assert found == [s for _, s in STEMS]


def test_short_words_stay(spark):
    assert values(spark, "w", stemming.stem, ["as", "is", "y", "ed", ""]) == [
        "as", "is", "y", "ed", "",
    ]


def test_stems_of_made_up_words_agree_with_sql(spark):
    suffixes = (
        "ational tional enci anci izer bli alli entli eli ousli ization ation ator alism "
        "iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful "
        "ness al ance ence er ic able ible ant ement ment ent sion tion ion ou ism ate iti "
        "ous ive ize ed eed ing ies sses s y e ll l"
    ).split()
    rng = random.Random(5)
    words = set()
    for _ in range(40_000):
        start = "".join(rng.choice("abeiyyltszwxdngoc") for _ in range(rng.randrange(6)))
        end = "".join(rng.choice(suffixes) for _ in range(rng.randrange(3)))
        words.add(start + end)
    words = sorted(w for w in words if len(w) > 1)
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"word": words}))
    sql = oracle.vocabulary_stems("tokens AS (SELECT word FROM given)", "SELECT * FROM stems")
    want = dict(con.execute(sql).fetchall())
    assert dict(zip(words, values(spark, "w", stemming.stem, words))) == want


def test_very_long_words_take_linear_time(spark):
    frame = spark.range(1).select(
        F.explode(
            F.array(F.repeat(F.lit("abracadabrayyst"), 60_000), F.repeat(F.lit("l"), 900_000))
        ).alias("w")
    )
    begin = time.time()
    frame.select(F.length(stemming.stem(F.col("w")))).collect()
    assert time.time() - begin < 30


def test_stems_that_are_stop_words_stay(spark):
    frame = spark.createDataFrame([("Ones uses names",)], "text string")
    assert {r.word for r in word_counts(frame).collect()} == {"on", "us", "name"}


def test_late_and_early_stemming_agree(spark):
    frame = spark.createDataFrame([(t,) for t, _ in TOKENS] + [("cats cat catting",)], "text string")
    late = compare.rows_of(["word", "n"], word_counts(frame).collect())
    early = flat_tokens(frame).groupBy("word").agg(F.count("*").alias("n"))
    assert compare.rows_of(["word", "n"], early.collect()) == late


@pytest.mark.parametrize("keys", [[], ["id"]])
def test_stop_list_as_a_table(spark, keys):
    frame = spark.createDataFrame([(1, "one twos three twos")], "id int, text string")
    stops = spark.createDataFrame([("twos",), ("twos",)], "word string")
    rows = word_counts(frame, keys=keys, stop_words=stops).collect()
    assert sorted(r.word for r in rows) == ["on", "three"]


def test_own_tokenizer(spark):
    frame = spark.createDataFrame([("a|b|a",)], "text string")
    counts = word_counts(frame, tokenizer=lambda c: F.split(c, r"\|"))
    assert {tuple(r) for r in counts.collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("word, sounds", [("yyy", "CVC"), ("sky", "CCV"), ("toy", "CVC"), ("syzygy", "CVCVCV")])
def test_sounds(spark, word, sounds):
    assert values(spark, "w", stemming.sound_pattern, [word]) == [sounds]

"""Tokenizer steps as Column functions, and the whole tokenizer.

Every pattern runs in time linear in the text: a quantifier that could be retried is
possessive, so a long run of letters or of unclosed ``<`` stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitally.functions.stemming import stem
from lexitally.functions.stopwords import english_stop_words

Tokenizer = Callable[[Column], Column]

# The characters that separate words (the hyphen first, so that it stays
# a plain character inside brackets), and the shortest word kept.
SEPARATORS = "-+:;,."
MIN_LENGTH = 2


def strip_tags(text: Column) -> Column:
    """Delete ``<...>`` with nothing in its place; an unclosed ``<`` stays.

    The second alternative swallows and restores the rest of the text after an
    unclosed ``<``, so that later ``<`` are not each scanned to the end again.
    """
    stripped = F.regexp_replace(text, r"<[^>]*+>|(<[^>]*+\z)", "$1")
    return F.when(F.contains(text, F.lit("<")), stripped).otherwise(text)


def punct_to_space(text: Column) -> Column:
    """Turn each of ``- + : ; , .`` into one space."""
    return F.regexp_replace(text, f"[{SEPARATORS}]", " ")


def keep_letters(text: Column) -> Column:
    """Delete everything but ASCII letters and spaces, gluing the neighbours."""
    return F.regexp_replace(text, "[^a-zA-Z ]++", "")


def split_words(text: Column) -> Column:
    """Split on runs of white space; none at the end makes an empty word."""
    return F.split(F.rtrim(text), r"\s+")


def clean_words(text: Column) -> Column:
    """Tags, punctuation, letters, case and split in two passes over the text.

    Deleting what is neither a letter nor a separator first, and splitting on runs of
    separators after, gives what the single steps give one after the other. The letters
    are listed since Java looks up listed characters faster than it checks ranges.
    """
    kept = F.regexp_replace(strip_tags(text), f"[^{SEPARATORS} {ascii_letters}]++", "")
    return F.split(F.lower(kept), f"[{SEPARATORS} ]+")


def is_long_enough(word: Column) -> Column:
    return F.length(word) >= MIN_LENGTH


def is_kept(word: Column, stop_words: Sequence[str] | None = None) -> Column:
    """True for words that are long enough and not on the stop list."""
    stops = english_stop_words() if stop_words is None else stop_words
    return is_long_enough(word) & ~word.isin(*stops) if stops else is_long_enough(word)


def plain_tokens(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Kept words of a text, in order, not stemmed; no text gives no tokens."""
    words = F.filter(clean_words(text), lambda w: is_kept(w, stop_words))
    return F.coalesce(words, F.array().cast("array<string>"))


def tokenize(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """The whole tokenizer: kept words in order, each stemmed."""
    return F.transform(plain_tokens(text, stop_words), stem)

"""Quality rules: a table of thresholds compiled into one projection.

Counts of a text (words, symbols, lines, repeats) come out of column functions, the ratios
out of the counts, and the verdict is one expression made of the table. There are no user
functions and no shuffles; a text is worked on where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.once import let, with_once

# Word boundaries are these characters and no others.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Words in a window whose repeats are counted.
WINDOW = 5

# Frequent words of English, German, French and Spanish prose.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he in is it not of on or that the "
    "this to was were which with "
    "als auch auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht "
    "sich sie sind und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas plus pour "
    "que qui se son sur un une "
    "al como con del el ella esta este la las lo los más no para pero por que se sin su sus "
    "un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts and the range in which it passes; a ratio over none passes."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    # Texts with fewer words are not held to the rule.
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=0.5),
    Rule("upper_ratio", "n_upper", "n_letters", high=0.5),
)
COUNTS = (
    "n_words word_chars n_symbols n_stop_words n_lines n_dup_lines n_repeat_words n_upper n_letters"
).split()


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows in order."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        def start(pair: Column, k: Column) -> Column:
            before = F.get(sorted_pairs, k - 1)["h"].eqNullSafe(pair["h"])
            after = F.get(sorted_pairs, k + 1)["h"].eqNullSafe(pair["h"])
            return F.when(before | after, pair["i"])

        return F.array_sort(F.array_compact(F.transform(sorted_pairs, start)))

    # Each start covers its window, less what the start before it has covered.
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(pairs, starts),
        nothing,
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")
        ),
        lambda acc: acc["n"],
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row, counts`` for every row: the row itself as a struct, and the struct of counts.

    Columns of ``docs`` lie in ``row`` only, so none of their names can clash. A null text
    counts as an empty one, of which all counts are zero. Windows are told apart by their
    64-bit XXH64.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = with_once(rows, words=words)
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    rows = with_once(
        rows,
        windows=F.when(F.size("words") >= WINDOW, window).otherwise(none),
        lines=F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
    )
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    core = F.lower(F.regexp_replace("text", "[.,;:!?()\"¿¡]", ""))
    stops = F.filter(F.split(core, "[\\x20\\x09-\\x0D]+"), lambda w: w.isin(STOP_WORDS))
    letters = F.regexp_replace("text", "[^\\p{L}]+", "")
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", SPACES, "")),
        "n_symbols": _without(F.col("text"), SYMBOLS),
        "n_stop_words": F.size(stops),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(distinct, 0).otherwise(_repeated(F.col("windows"))),
        "n_upper": F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")),
        "n_letters": F.length(letters),
    }
    # One struct at once, so that no later filter repeats the counting.
    struct = F.struct(*[counts[name].cast("long").alias(name) for name in COUNTS])
    return with_once(rows, counts=struct).select("row", "counts")


def base_failed(counts: Column) -> Column:
    """Too few words, or over a fifth of them in repeated windows."""
    n = counts["n_words"]
    return (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)


def ratio(rule: Rule, counts: Column) -> Column:
    whole = counts[rule.whole]
    return F.when(whole > 0, counts[rule.part] / whole).otherwise(F.lit(0.0))


def verdict(rules: tuple[Rule, ...], counts: Column) -> Column:
    """The table as one boolean expression: true if every rule passes."""
    passed = F.lit(True)
    for rule in rules:
        value = ratio(rule, counts)
        good = F.lit(True)
        if rule.low is not None:
            good = good & (value >= rule.low)
        if rule.high is not None:
            good = good & (value <= rule.high)
        exempt = (counts[rule.whole] == 0) | (counts["n_words"] < rule.from_words)
        passed = passed & (exempt | good)
    return passed


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """``row, counts, base_failed, kept`` for every row, repeated ones too."""
    rows = with_counts(docs, text_col)
    counts = F.col("counts")
    failed = base_failed(counts)
    return rows.select(
        "row", "counts", failed.alias("base_failed"), (~failed & verdict(rules, counts)).alias("kept")
    )


def passing(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    return judge(docs, rules, text_col).where("kept").select("row.*")

"""Porter's suffix stripper as a chain of regular expressions on one Column.

Two ideas keep it short and fast. A ``y`` counts as a vowel after a consonant and as a
consonant elsewhere, so the chain first writes each vowel ``y`` as ``Y``; from then on
"vowel" and "consonant" are plain character classes, and the marks stay right since later
steps only cut or rewrite the end of a word. And the word is turned round, so that its
suffix is what a pattern meets first: most patterns fail on their first letter, and
conditions on the rest of the word are what follows.

Each step mentions its input once, so the chain stays linear in size and runs wherever a
Column does: in a projection, inside ``transform`` or on a stream. Conditions use
possessive quantifiers, so a word of any length is matched in linear time.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWEL = "[aeiouY]"
CONSONANT = "[^aeiouY]"

# Conditions on the rest of a word, read backwards: it has a vowel; it goes from a vowel to
# a consonant at least once ("one turn") or twice.
HAS_VOWEL = f"{CONSONANT}*+{VOWEL}"
ONE_TURN = f"{VOWEL}*+{CONSONANT}++{VOWEL}"
TWO_TURNS = f"{ONE_TURN}++{CONSONANT}++{VOWEL}"
# One turn, ending consonant-vowel-consonant, the last not w, x or y.
SHORT = f"[^aeiouYwxy]{VOWEL}{CONSONANT}++$"

# Suffix and replacement, applied where the rest has one turn or more.
DOUBLE_SUFFIXES = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "logi": "log",
}
SINGLE_SUFFIXES = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
# Suffixes removed where the rest has two turns or more; "ion" also needs
# an s or a t before it.
LAST_SUFFIXES = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


def _backwards(text: str) -> str:
    return text[::-1]


def _not_in_longer(suffix: str, suffixes) -> str:
    """Lookaheads that stop a suffix from matching inside a longer one of the step."""
    longer = [s[: -len(suffix)] for s in suffixes if s != suffix and s.endswith(suffix)]
    return "".join(f"(?!{_backwards(head)})" for head in longer)


def _swap_suffixes(word: Column, table: dict[str, str], condition: str) -> Column:
    """Replace the longest suffix of ``table`` if what precedes it meets ``condition``.

    A rule keeps the letters its suffix and replacement share and adds the others, so
    rules that add the same letters make one pattern.
    """
    by_tail: dict[str, list[str]] = {}
    for suffix, replacement in table.items():
        shared = commonprefix([suffix, replacement])
        cut, kept = _backwards(suffix[len(shared):]), _backwards(shared)
        rest = f"{_not_in_longer(suffix, table)}{condition}"
        by_tail.setdefault(replacement[len(shared):], []).append(f"{cut}(?={kept}{rest})")
    # Longer tails first: what they write ends in e, which no other suffix does.
    for tail in sorted(by_tail, key=len, reverse=True):
        word = F.regexp_replace(word, f"^(?:{'|'.join(by_tail[tail])})", _backwards(tail))
    return word


def mark_vowel_y(word: Column) -> Column:
    """Write each ``y`` that acts as a vowel as ``Y``.

    In a run of y every second one is a vowel, beginning with the first after a
    consonant and with the second at the start of the word or after a vowel.
    """
    first = r"(?<=[^aeiouy])|(?<=^y)|(?<=[aeiou]y)"
    marked = F.regexp_replace(word, rf"(?:{first}|\G(?!^))y(y?)", "Y$1")
    return F.when(F.contains(word, F.lit("y")), marked).otherwise(word)


# The steps work on marked words turned round.


def drop_plural(word: Column) -> Column:
    """sses to ss, ies to i, and a final s that follows no s goes."""
    return F.regexp_replace(word, "^(?:se(?=ss|i)|s(?=[^s]))", "")


def drop_past_and_gerund(word: Column) -> Column:
    """eed to ee; ed and ing go after a vowel, and the end is tidied where they went.

    at, bl, iz and short stems get an e back; doubled letters other than l, s, z become
    single. What the second pattern writes does not fit the third.
    """
    word = F.regexp_replace(word, f"^d(?=ee{ONE_TURN})", "")
    ending = f"^(?:de(?!e)|gni)(?={HAS_VOWEL})"
    word = F.regexp_replace(word, f"{ending}(?=ta|lb|zi|{SHORT})", "e")
    return F.regexp_replace(word, rf"{ending}(?:([^aeiouyYlsz])(?=\1)|y(?=Y))?", "")


def final_y_to_i(word: Column) -> Column:
    """A final y becomes i if there is a vowel before it."""
    return F.regexp_replace(word, f"^[yY](?={HAS_VOWEL})", "i")


def swap_double_suffixes(word: Column) -> Column:
    return _swap_suffixes(word, DOUBLE_SUFFIXES, ONE_TURN)


def swap_single_suffixes(word: Column) -> Column:
    return _swap_suffixes(word, SINGLE_SUFFIXES, ONE_TURN)


def drop_last_suffix(word: Column) -> Column:
    needs = {"ion": "(?=[st])"}
    rules = [
        f"{_backwards(s)}{_not_in_longer(s, LAST_SUFFIXES)}{needs.get(s, '')}"
        for s in LAST_SUFFIXES
    ]
    return F.regexp_replace(word, f"^(?:{'|'.join(rules)})(?={TWO_TURNS})", "")


def drop_final_e_and_l(word: Column) -> Column:
    """A final e goes unless the rest is short; a final ll becomes l after two turns."""
    final_e = f"e(?!{SHORT})(?={ONE_TURN})"
    final_l = f"l(?=l)(?={TWO_TURNS})"
    return F.regexp_replace(word, f"^(?:{final_e}(?:{final_l})?|{final_l})", "")


STEPS = (
    drop_plural,
    drop_past_and_gerund,
    final_y_to_i,
    swap_double_suffixes,
    swap_single_suffixes,
    drop_last_suffix,
    drop_final_e_and_l,
)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay as they are."""
    out = F.reverse(mark_vowel_y(word))
    for step in STEPS:
        out = step(out)
    return F.when(F.length(word) > 2, F.lower(F.reverse(out))).otherwise(word)


def sound_pattern(word: Column) -> Column:
    """The word with V for each vowel and C for each consonant."""
    marked = F.regexp_replace(mark_vowel_y(word), VOWEL, "V")
    return F.regexp_replace(marked, "[^V]", "C")


def measure(word: Column) -> Column:
    """How often a vowel is followed by a consonant."""
    return F.regexp_count(sound_pattern(word), F.lit("VC")).cast("bigint")


def has_vowel(word: Column) -> Column:
    return F.contains(sound_pattern(word), F.lit("V"))


def ends_in_double_consonant(word: Column) -> Column:
    return mark_vowel_y(word).rlike(r"([^aeiouyY])\1$|Yy$")


def ends_short(word: Column) -> Column:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return mark_vowel_y(word).rlike(f"{CONSONANT}{VOWEL}[^aeiouYwxy]$")

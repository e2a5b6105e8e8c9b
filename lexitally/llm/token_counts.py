"""Token counts by rank-synchronous merging of arrays.

Distinct pre-tokens of a batch are held as one flat array of symbols, with the length of each.
In every round each pre-token finds its lowest-ranked pair and merges all of that pair's
occurrences, all pre-tokens at once; pre-tokens without a pair that can be merged leave, and
the symbols that they have left are counted. A merged symbol only takes part in pairs of
higher rank than the one that made it, so merging all occurrences together is the same as
merging them one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.encode import LONG, REMEMBERED, slices

LIMIT = 512
NONE = np.iinfo(np.int32).max
# White space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The public pattern of byte-level BPE; a fixed value.
PRE_TOKENS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_UNSAFE = re.compile(r"\s \s")


def byte_names() -> list[str]:
    """The character that stands for each byte in vocabularies of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merger:
    """The merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.uint64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order.astype(np.int32)
        self.bytes = np.array([vocabulary[name] for name in byte_names()], dtype=np.uint64)
        specials = [token["content"] for token in data.get("added_tokens", [])]
        specials.sort(key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << np.uint64(32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word, none of them empty, ends up with."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        found = lengths.copy()
        if not words:
            return found
        words_left = np.arange(len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full(len(symbols), NONE, dtype=np.int32)
        ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = NONE
        while len(words_left):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            alive = lowest < NONE
            if not alive.all():
                found[words_left[~alive]] = lengths[~alive]
                stay = np.repeat(alive, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                lengths, words_left, lowest = lengths[alive], words_left[alive], lowest[alive]
                if not len(words_left):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # Of a run of one symbol, as in "aaa", every second pair is merged.
            first = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            lengths -= np.bincount(
                np.searchsorted(starts, at, side="right") - 1, minlength=len(lengths)
            )
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            symbols, ranks = symbols[stay], ranks[stay]
            moved = at - np.arange(len(at))
            last = np.zeros(len(symbols), dtype=bool)
            last[np.cumsum(lengths) - 1] = True
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            ranks[changed[last[changed]]] = NONE
            changed = changed[~last[changed]]
            ranks[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        return found


class Counter:
    """Numbers of tokens of texts; those of frequent pieces are remembered."""

    def __init__(self, path: str) -> None:
        self.merger = Merger(path)
        # Of pieces after a blank, without it, and of pre-tokens.
        self.known: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def _pre_tokens(self, lists: list[list[str]]) -> list[int]:
        new = list(set(chain.from_iterable(lists)).difference(self.tokens))
        counts = self.merger.counts([token.encode("utf-8", "surrogatepass") for token in new])
        self.tokens.update(zip(new, counts.tolist()))
        found = [sum(map(self.tokens.__getitem__, tokens)) for tokens in lists]
        for token in new:
            if len(token) > LONG:
                del self.tokens[token]
        return found

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings.

        A border between a character that is no white space and a blank is one between
        pre-tokens, so texts are cut there, unless a run of white space would be cut.
        """
        for known in (self.known, self.tokens):
            if len(known) > REMEMBERED // 2:
                known.clear()
        parts: list[list[str]] = []
        heads: list[list[str]] = []
        for text in texts:
            if _UNSAFE.search(text):
                heads.append(PRE_TOKENS.findall(text))
                parts.append([])
            else:
                head, *rest = text.split(" ")
                heads.append(PRE_TOKENS.findall(head))
                parts.append(rest)
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        counts = self._pre_tokens([PRE_TOKENS.findall(" " + piece) for piece in new])
        self.known.update(zip(new, counts))
        known = self.known
        found = [
            head + sum([known[part] for part in rest])
            for head, rest in zip(self._pre_tokens(heads), parts)
        ]
        for piece in new:
            if len(piece) > LONG:
                del known[piece]
        return found

    def count(self, texts: list[str]) -> list[int]:
        special = self.merger.special
        if special is None or not any(special.search(text) for text in texts):
            return self._plain(texts)
        pieces = [special.split(text) for text in texts]
        counts = iter(self._plain(list(chain.from_iterable(pieces))))
        # A special string between two pieces is one token.
        return [sum(next(counts) for _ in parts) + len(parts) - 1 for parts in pieces]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of this worker, which tasks share one after the other."""
    return Counter(path)


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row, repeated ones too.

    ``tokenizer`` is the path of a tokenizers file of byte-level BPE. No tokens are added;
    its special strings are one token each where a text has them. A null text is an empty
    one and has no tokens. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    schema = T.StructType(
        [named.schema["doc_id"], named.schema["n_bytes"], T.StructField("n_tokens", T.LongType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[int] = []
            for part in slices(texts):
                found += counter(tokenizer).count(texts[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                names=schema.names,
            )

    return named.mapInArrow(work, schema)

"""Ids of texts by a public tokenizer, with the ids of frequent pieces remembered.

Byte-level BPE never merges over the border between a character that is no white space and
the blank after it. Texts are cut there, and each distinct piece is given to the library
once. A text with a blank between two other white space characters is given as it is, since
a run of white space must not be cut.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Pieces remembered by a worker, twice as many at most, and characters of texts worked on
# together.
REMEMBERED = 600_000
BATCH = 4 << 20
# Marks that are split from the letter before them, so that the word is remembered alone.
MARKS = ".,;:!?%$#*&|"
# Characters of a piece that is not remembered.
LONG = 200
# Pieces given to the library as one text, and how its vocabulary writes a blank.
TOGETHER = 500
BLANK = "\u0120"

_UNSAFE = re.compile(r"\s \s")


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, without added special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.after_blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.after_blank[[i for token, i in vocabulary.items() if token[0] == BLANK]] = True
        # Pieces that follow a blank, without it.
        self.known: dict[str, bytes] = {}
        # What was known before there was too much; what is met again is taken over.
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def _ask_pieces(self, pieces: list[str]) -> None:
        """Remember pieces that follow a blank; many are given to the library as one text.

        Only the first id of such a piece stands for bytes that begin with a blank, so the
        ids can be told apart again. Pieces that touch white space are given alone.
        """
        alone = [p for p in pieces if p.strip() != p or not p]
        self.known.update(zip(alone, self._ask([" " + piece for piece in alone])))
        left = set(alone)
        joined = [p for p in pieces if p not in left]
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for group, data in zip(groups, self._ask([" " + " ".join(group) for group in groups])):
            ids = np.frombuffer(data, dtype="<u4")
            at = (np.flatnonzero(self.after_blank[ids]) * 4).tolist()
            if len(at) == len(group):
                at.append(len(data))
                self.known.update(zip(group, [data[a:b] for a, b in zip(at, at[1:])]))
            else:
                self.known.update(zip(group, self._ask([" " + piece for piece in group])))

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
            self.marks.clear()
        new = pieces.difference(self.known)
        if again := new.intersection(self.old):
            self.known.update((piece, self.old[piece]) for piece in again)
            new -= again
        self.long = [piece for piece in new if len(piece) > LONG]
        parted, asked = [], set()
        for piece in new:
            word = piece.rstrip(MARKS)
            if len(word) < len(piece) and word and word[-1].isalpha():
                parted.append((piece, word, piece[len(word) :]))
                if word not in self.known:
                    if (ids := self.old.get(word)) is None:
                        asked.add(word)
                    else:
                        self.known[word] = ids
            else:
                asked.add(piece)
        self._ask_pieces(list(asked))
        marks = list({end for _, _, end in parted}.difference(self.marks))
        self.marks.update(zip(marks, self._ask(marks)))
        for piece, word, end in parted:
            self.known[piece] = self.known[word] + self.marks[end]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        pieces, whole = {}, []
        for i, text in enumerate(texts):
            if _UNSAFE.search(text):
                whole.append(i)
            else:
                pieces[i] = text.split(" ")
        # The first piece has no blank before it.
        first = self._ask([parts.pop(0) for parts in pieces.values()])
        self._learn(set(chain.from_iterable(pieces.values())))
        result: list[bytes] = [b""] * len(texts)
        known = self.known
        for head, (i, parts) in zip(first, pieces.items()):
            if len(parts) > 1:
                result[i] = b"".join((head, *itemgetter(*parts)(known)))
            else:
                result[i] = head + b"".join([known[part] for part in parts])
        for i, ids in zip(whole, self._ask([texts[i] for i in whole])):
            result[i] = ids
        for piece in self.long:
            del known[piece]
        return result


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker, which tasks share one after the other."""
    return Encoder(path)


def slices(texts: list[str], limit: int = BATCH) -> list[slice]:
    """Runs of texts of about ``limit`` characters together, one text at least."""
    found, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            found.append(slice(begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(texts):
        found.append(slice(begin, len(texts)))
    return found

"""A bidirectional FM-index over delimited words, for many searches at once.

The words stand in one text, each between two delimiters. Two wavelet matrices hold the
symbols before every suffix in suffix order, one of the text of the words and one of the text
of the words read backwards. A match is a pair of rank intervals, of the suffixes that begin
with it and of the backward suffixes that begin with it backwards, and a symbol can be put to
either end of it: the interval of that direction is looked up, the other one is cut down by the
number of smaller symbols. All operations work on arrays of matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEFT, RIGHT = 0, 1


class Wavelet:
    """Ranks in an array of symbols below ``2**bits``."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        now = symbols
        for level in range(bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            counts = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(~one, out=counts[1:])
            self.zeros.append(counts)
            now = np.concatenate([now[~one], now[one]])
        # Where the run of each symbol begins after the last level, whose order is by bits read
        # backwards, and where it would in sorted order.
        self.begin = np.full(1 << bits, len(now), dtype=np.int64)
        runs = np.flatnonzero(np.diff(now, prepend=-1))
        self.begin[now[runs]] = runs
        counts = np.bincount(symbols, minlength=1 << bits)
        self.smaller = np.cumsum(counts) - counts

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        """For a symbol per interval: the ranks ``low, high`` of the suffixes that begin with it
        and go on as the interval does, and how many of the interval have a smaller symbol."""
        less = np.zeros(len(low), dtype=np.int64)
        for level, counts in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            zero_low, zero_high = counts[low], counts[high]
            less += np.where(one, zero_high - zero_low, 0)
            low = np.where(one, counts[-1] + low - zero_low, zero_low)
            high = np.where(one, counts[-1] + high - zero_high, zero_high)
        at = self.smaller[symbol] - self.begin[symbol]
        return low + at, high + at, less

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple:
        """``row, symbol, low, high, smaller`` for every symbol of every interval; only symbols
        that are there are looked at."""
        row = np.flatnonzero(high > low)
        low, high = low[row].astype(np.int64), high[row].astype(np.int64)
        symbol, less = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for counts in self.zeros:
            zero_low, zero_high = counts[low], counts[high]
            some = zero_high > zero_low
            other = high - low > zero_high - zero_low
            row = np.concatenate([row[some], row[other]])
            symbol = np.concatenate([2 * symbol[some], 2 * symbol[other] + 1])
            less = np.concatenate([less[some], (less + zero_high - zero_low)[other]])
            ones_low, ones_high = counts[-1] + low - zero_low, counts[-1] + high - zero_high
            low = np.concatenate([zero_low[some], ones_low[other]])
            high = np.concatenate([zero_high[some], ones_high[other]])
        at = self.smaller[symbol] - self.begin[symbol]
        return row, symbol, low + at, high + at, less


def suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of the suffixes, of which each counts up to its next delimiter (0).
    Of equal ones those before the last delimiter come first, others by place.

    The text must begin and end with a delimiter, and the words in it must be sorted: then this
    is the order of the whole suffixes.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    places = np.roll(np.arange(n), n - 1 - ends[-2]) if len(ends) > 1 else np.arange(n)
    # Symbols from each place up to and with the delimiter.
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
    width = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for i in range(width):
        # What follows the delimiter does not count.
        shifted = np.zeros(n, dtype=np.int64)
        shifted[: max(0, n - i)] = text[i:]
        key = (key << bits) | np.where(left > i, shifted, 0)
    order = places[np.argsort(key[places], kind="stable")]
    longest = int(left.max())
    while width < longest:
        change = np.concatenate([[0], np.diff(key[order]) != 0])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(change) + 1
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + np.where(left > width, after, 0)
        order = places[np.argsort(key[places], kind="stable")]
        width *= 2
    return order


@dataclass
class Matches:
    """Rank intervals: ``low[LEFT]`` in the order of the suffixes, ``low[RIGHT]`` in that of the
    backward suffixes, both with ``size`` ranks."""

    low: tuple[np.ndarray, np.ndarray]
    size: np.ndarray

    def take(self, rows: np.ndarray) -> Matches:
        return Matches((self.low[LEFT][rows], self.low[RIGHT][rows]), self.size[rows])


class BidirectionalIndex:
    """An index of distinct words of symbols 1 to ``2**bits - 1``, sorted by their symbols.

    ``words`` has a word per row, filled up with zeros; ``lengths`` are at least 1.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, bits: int) -> None:
        self.count = len(words)
        columns = np.arange(words.shape[1])
        backward = np.where(
            columns < lengths[:, None],
            np.take_along_axis(words, np.maximum(lengths[:, None] - 1 - columns, 0), axis=1), 0,
        )
        self.ways = []
        for way in (LEFT, RIGHT):
            order = np.arange(self.count)
            rows = words
            if way == RIGHT:
                order = np.lexsort(backward.T[::-1])
                rows = backward[order]
            lined = np.hstack([rows, np.zeros((self.count, 1), rows.dtype)])
            inside = np.arange(lined.shape[1]) <= lengths[order][:, None]
            text = np.concatenate([[0], lined[inside]]).astype(np.int64)
            places = suffixes(text, bits)
            self.ways.append(Wavelet(text[places - 1], bits))
            if way == LEFT:
                # The word that each place is in or, for a delimiter, before.
                starts = np.concatenate([[0], np.cumsum(lengths + 1)])
                self.word = np.searchsorted(starts, places, "right") - 1
        self.size = len(text)

    def whole(self, count: int) -> Matches:
        """The empty match, which every suffix begins with."""
        zero = np.zeros(count, dtype=np.int64)
        return Matches((zero, zero), np.full(count, self.size))

    def extend(self, found: Matches, symbol: np.ndarray, way: int) -> Matches:
        """Each match with its symbol before it (LEFT) or after it (RIGHT); size 0 for none."""
        low, high, less = self.ways[way].step(symbol, found.low[way], found.low[way] + found.size)
        other = found.low[1 - way] + less
        lows = (low, other) if way == LEFT else (other, low)
        return Matches(lows, high - low)

    def extend_any(self, found: Matches, way: int) -> tuple[np.ndarray, np.ndarray, Matches]:
        """Each match with every symbol that stands there, as ``row, symbol, matches``."""
        row, symbol, low, high, less = self.ways[way].branches(
            found.low[way], found.low[way] + found.size
        )
        other = found.low[1 - way][row] + less
        lows = (low, other) if way == LEFT else (other, low)
        return row, symbol, Matches(lows, high - low)

    def located(self, found: Matches) -> np.ndarray:
        """The words of matches that begin with the delimiter before a word and end with the one
        after it; such a match is one word."""
        return self.word[found.low[LEFT]]


def near_words(
    index: BidirectionalIndex, words: np.ndarray, lengths: np.ndarray, half: int, way: int,
    lengths_to: tuple[bool, bool, bool],
) -> tuple[np.ndarray, np.ndarray]:
    """``row, word`` for indexed words one symbol away from each searched word.

    The ``half`` symbols at the end of the word that lies opposite to ``way`` are matched as they
    are, from the middle to the delimiter; then the match goes over the other part in direction
    ``way`` with one symbol replaced, inserted or deleted, those of the three that
    ``lengths_to`` asks for. Each near word is found once: of equal ways to insert or
    delete a symbol in a run of it, the last one in that direction is taken.
    """
    replace, insert, delete = lengths_to
    count, width = words.shape
    columns = np.arange(width)
    # Symbols in the order in which the search goes: the exact half begins at the delimiter.
    if way == RIGHT:
        path = words
    else:
        path = np.take_along_axis(words, np.maximum(lengths[:, None] - 1 - columns, 0), axis=1)
        path = np.where(columns < lengths[:, None], path, 0)
    path = np.hstack([path, np.zeros((count, 2), path.dtype)]).astype(np.int64)

    def kept(found: Matches, *others: np.ndarray) -> tuple:
        alive = np.flatnonzero(found.size > 0)
        return found.take(alive), *(values[alive] for values in others)

    found, row = index.whole(count), np.arange(count)
    for i in range(half - 1, -1, -1):
        found, row = kept(index.extend(found, path[row, i], 1 - way), row)
    found, row = kept(index.extend(found, np.zeros(len(row), np.int64), 1 - way), row)

    # Matches with an error wait until the search is where they go on.
    rows, hits = [], []
    waiting: dict[int, list[tuple[Matches, np.ndarray]]] = {}

    def put(at: np.ndarray, match: Matches, of: np.ndarray) -> None:
        for place in np.unique(at) if len(at) else ():
            some = np.flatnonzero(at == place)
            waiting.setdefault(int(place), []).append((match.take(some), of[some]))

    for i in range(half, width + 1):
        # With one error so far: symbol i of the path is next, the delimiter after the last.
        erred = waiting.pop(i, [])
        if erred:
            match = Matches(
                tuple(np.concatenate([m.low[w] for m, _ in erred]) for w in (LEFT, RIGHT)),
                np.concatenate([m.size for m, _ in erred]),
            )
            of = np.concatenate([r for _, r in erred])
            match, of = kept(index.extend(match, path[of, i], way), of)
            ended = i == lengths[of]
            rows.append(of[ended])
            hits.append(index.located(match.take(np.flatnonzero(ended))))
            going = np.flatnonzero(~ended)
            put(np.full(len(going), i + 1), match.take(going), of[going])
        # Without one: all of the path before symbol i is matched.
        found, row = kept(found, row)
        if not len(row):
            if not waiting:
                break
            continue
        now, after = path[row, i], path[row, i + 1]
        open_ = i < lengths[row]
        if delete:
            some = np.flatnonzero(open_ & (now != after))
            put(np.full(len(some), i + 1), found.take(some), row[some])
        if replace or insert:
            at, symbol, match = index.extend_any(found, way)
            other = (symbol != 0) & (symbol != now[at])
            if replace:
                some = np.flatnonzero(other & open_[at])
                put(np.full(len(some), i + 1), match.take(some), row[at[some]])
            if insert:
                some = np.flatnonzero(other)
                # The path goes on with the same symbol.
                put(np.full(len(some), i), match.take(some), row[at[some]])
                erred = waiting.pop(i, [])
                for match, of in erred:
                    match, of = kept(index.extend(match, path[of, i], way), of)
                    ended = i == lengths[of]
                    rows.append(of[ended])
                    hits.append(index.located(match.take(np.flatnonzero(ended))))
                    going = np.flatnonzero(~ended)
                    put(np.full(len(going), i + 1), match.take(going), of[going])
        going = np.flatnonzero(open_)
        found, row = found.take(going), row[going]
        found = index.extend(found, path[row, i], way)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *hits])

"""SimHash near-dedup: pigeonhole blocks, then Hamming distance.

A document's fingerprint is the majority of the bits of its shingles' XXH64. Fingerprints
are split into blocks; two that differ in at most ``distance`` bits agree in at least
``blocks - distance`` blocks, so every set of ``share`` blocks is a key, and fingerprints
are compared within keys only. Equal fingerprints are one class before that, whatever the
number of their documents.

Keys are sorted and walked through; a run of equal keys is compared with itself in pieces
and gives no more links than it has fingerprints (a tree of close pairs for all that are
connected inside the run), never all pairs. Runs of more than ``RUN`` fingerprints are dealt over
several tasks, each of which compares two parts of the run.

With a similarity of shingle sets, that is a first step only, which puts most copies together:
its links are verified by the shingles. The second step misses no pair. Shingles have one order,
in which common ones come last; two sets that are alike by ``s`` share one of the first
``n - ceil(s * n) + 1`` of each. So these are keys, and all pairs of a key that the first step
has left apart, and that are alike by their sizes and places as far as can be seen, are looked at.
Rows that have such a partner get the parities of their set, two to four bits for each
shingle: two sets differ in at least as many shingles as parities, so most pairs that are not alike
end in the key where they met, and only the others are sent on and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm.components import components
from lexitally.session import Scratch, written

SEED = 42
# Fingerprints of one key that a task compares at once.
RUN = 20_000
# Shingles whose bits are counted at once, and rows of a comparison.
STEP = 1 << 16
ROWS = 128
# Texts in which common shingles are looked for, and how many of these are held at most. They
# come last in the order of shingles, so that few sets meet in a key; no pair depends on it.
SAMPLE = 10_000
COMMON = 200_000
# Runs up to this length are paired all at once, and pairs sent on together.
SHORT = 16
PAIRS = 1 << 18
# Parities of a set at most, 1 kB: of sets of over 4,096 shingles more pairs are left to verify.
PARITIES = 1 << 13


@dataclass(frozen=True)
class Method:
    """How documents are compared.

    ``shingle`` words make a shingle; ``repeats`` says if a shingle counts as often as it
    occurs. ``distance`` bits may differ of 64. Keys are made of ``share`` of ``blocks``
    blocks; no close pair is missed while ``blocks - share >= distance``. If ``wide`` is
    set, a close pair must also differ in at most ``wide_distance`` bits of a second
    fingerprint of 256 bits over distinct shingles of ``wide`` words. Pairs that differ in
    fewer bits, by the ``limits``, are linked before others.
    """

    shingle: int = 3
    repeats: bool = True
    distance: int = 3
    blocks: int = 6
    share: int = 3
    wide: int = 0
    wide_distance: int = 0
    limits: tuple[int, ...] = (64,)


# Texts whose sets of five-word shingles may be alike by 0.8 or more. At 0.8 a bit of the wide
# fingerprint differs with probability acos(2 * 0.8 / 1.8) / pi = 0.151, 39 bits of 256; 50
# are two standard deviations more. Sets of words differ less, which is why they are blocked.
# This finds most copies, but misses some of which a passage was added or cut; what it leaves
# apart is compared by keys of shingles, which miss none.
SIMILAR = Method(
    shingle=1, repeats=False, distance=11, blocks=9, share=2, wide=5, wide_distance=50,
    limits=(10, 20, 30, 40, 50),
)
SIMILARITY = 0.8


def shingles(words: list[bytes], size: int) -> Iterable[bytes]:
    """Runs of ``size`` words; fewer words are one shingle, none are none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(size))))


def hashes(words: list[bytes], size: int, repeats: bool) -> np.ndarray:
    found = shingles(words, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(s, SEED) for s in (found if repeats else set(found))), dtype=np.uint64
    )


def majority(values: np.ndarray) -> int:
    """The 64 bits that are set in over half of the values; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), STEP):
        part = values[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(values))
    return int.from_bytes(bits.tobytes(), "big")


def _mixed(values: np.ndarray, lane: int) -> np.ndarray:
    """Further hash bits of hashed values (the finisher of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, method: Method) -> tuple[int, bytes]:
    """The fingerprint of a text and, if the method has one, its wide fingerprint."""
    # Only the letters A to Z are lowered, and words end at ASCII white space, for bytes.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return _prints(words, hashes(words, method.wide, False) if method.wide else None, method)


def _prints(words: list[bytes], values: np.ndarray | None, method: Method) -> tuple[int, bytes]:
    """Both fingerprints, of words and of their distinct wide shingles."""
    narrow = majority(hashes(words, method.shingle, method.repeats))
    if not method.wide:
        return narrow, b""
    lanes = [majority(_mixed(values, lane)) for lane in range(1, 5)]
    return narrow, b"".join(lane.to_bytes(8, "big") for lane in lanes)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, method: Method, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, narrow, wide``; nothing but the two columns is read."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [named.schema["doc_id"], T.StructField("narrow", T.LongType()), T.StructField("wide", T.BinaryType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), method) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_signed(narrow) for narrow, _ in found], pa.int64()),
                    pa.array([wide for _, wide in found], pa.binary()),
                ],
                names=["doc_id", "narrow", "wide"],
            )

    return named.mapInArrow(work, schema)


def _needed(size: int, similarity: float) -> int:
    """The shingles that a set of ``size`` has in common with any that is alike."""
    return int(np.ceil(similarity * size - 1e-6))


def prefix(
    values: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray
) -> np.ndarray:
    """The first shingles of a set, of which two alike sets share one or more.

    ``common`` are sorted, with a rank above zero each; others have rank zero.
    """
    rank = np.zeros(len(values), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        rank = np.where(common[at] == values, ranks[at], 0)
    if not len(values):
        return values
    ordered = values[np.lexsort((values, rank))]
    return ordered[: len(values) - _needed(len(values), similarity) + 1]


def parities(values: np.ndarray) -> bytes:
    """For each place of a bitmap, whether an odd number of the values falls there.

    The places are a power of two, at least 64 and twice the values, and at most ``PARITIES``.
    """
    places = min(max(64, 1 << (2 * len(values)).bit_length()), PARITIES)
    counts = np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def parities_apart(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """In how many parities pairs of sets differ; in values they differ as often or more.

    A longer bitmap is laid over itself until it has the places of the shorter one.
    """
    lengths = np.array([len(part) // 8 for part in bits], dtype=np.int64)
    flat, begin = np.frombuffer(b"".join(bits), np.uint64), np.cumsum(lengths) - lengths
    apart = np.empty(len(first), dtype=np.int64)
    kinds = lengths[first] * (PARITIES + 1) + lengths[second]
    for kind in np.unique(kinds):
        one, other = divmod(int(kind), PARITIES + 1)
        least, step = min(one, other), max(1, PAIRS // max(one, other))
        of_kind = np.flatnonzero(kinds == kind)
        for i in range(0, len(of_kind), step):
            some = of_kind[i : i + step]
            x = flat[begin[first[some], None] + np.arange(one)].reshape(len(some), -1, least)
            y = flat[begin[second[some], None] + np.arange(other)].reshape(len(some), -1, least)
            both = np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)
            apart[some] = np.bitwise_count(both).sum(axis=1)
    return apart


def common_shingles(docs: DataFrame, size: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and how common each is."""
    texts = docs.select(F.col(text_col).alias("text"))
    some = texts.sample(min(1.0, SAMPLE / max(1, docs.count())), SEED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                values = hashes((text.as_py() or "").encode("utf-8").lower().split(), size, False)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["key"])

    counts = some.mapInArrow(work, "key long").groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    values = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], rows.column("n").to_numpy()[order]


def with_shingles(
    docs: DataFrame, method: Method, similarity: float, id_col: str, text_col: str
) -> DataFrame:
    """``doc_id, digest, narrow, wide, own, size, prefix, bits``: the SHA-256 of each text, its
    fingerprints, and, with a similarity, a digest of its set of shingles, their number, the
    first of them and their parities."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    common, ranks = common_shingles(docs, method.wide, text_col) if similarity else none
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")
    )
    schema = T.StructType([named.schema["doc_id"], named.schema["digest"]])
    for name, kind in (
        ("narrow", T.LongType()), ("wide", T.BinaryType()), ("own", T.BinaryType()),
        ("size", T.LongType()), ("prefix", T.ArrayType(T.LongType())),
        ("bits", T.BinaryType()),
    ):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, own, sizes, firsts, bits = [], [], [], [], []
            for text in batch.column("text"):
                words = text.as_py().encode("utf-8").lower().split()
                values = hashes(words, method.wide, False) if method.wide else none[0]
                prints.append(_prints(words, values, method))
                values = np.unique(values) if similarity else none[0]
                own.append(hashlib.sha256(values.tobytes()).digest() if similarity else b"")
                sizes.append(len(values))
                firsts.append(prefix(values, similarity, common, ranks).view(np.int64))
                bits.append(parities(values) if similarity else b"")
            ends = np.cumsum([0] + [len(first) for first in firsts])
            flat = pa.array(np.concatenate(firsts) if firsts else none[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("digest"),
                    pa.array([_signed(narrow) for narrow, _ in prints], pa.int64()),
                    pa.array([wide for _, wide in prints], pa.binary()),
                    pa.array(own, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                    pa.array(bits, pa.binary()),
                ],
                names=schema.names,
            )

    return named.mapInArrow(work, schema)


def _edges(size: int, blocks: int) -> list[int]:
    return [round(i * size / blocks) for i in range(blocks + 1)]


def with_node(classes: DataFrame, method: Method) -> DataFrame:
    """Classes with one number each: the fingerprint, or a hash of both fingerprints and, if
    there is one, of the digest of the set of shingles."""
    parts = ["narrow", "wide"] + ["own"] * ("own" in classes.columns)
    node = F.xxhash64(*parts) if method.wide else F.col("narrow")
    return classes.withColumn("node", node)


def keyed(classes: DataFrame, method: Method) -> DataFrame:
    """``key, node, narrow, wide`` for every choice of blocks of every class."""
    edges = _edges(64, method.blocks)
    masks = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:])]
    keys = []
    for n, chosen in enumerate(combinations(masks, method.share)):
        mask = F.lit(_signed(sum(chosen)))
        keys.append(F.xxhash64(F.lit(n), F.col("narrow").bitwiseAND(mask)))
    return classes.select("node", "narrow", "wide", F.explode(F.array(*keys)).alias("key"))


def dealt(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The keyed rows with a ``cell``; a key of over ``RUN`` rows has several cells.

    The rows of such a key are dealt to parts by hash, and every pair of parts is a cell,
    so each pair of rows meets in at least one.
    """
    large = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > RUN)
        .select("key", F.expr(f"cast(ceil(2 * n / {RUN}) as int)").alias("parts"))
    )
    # Written first, so that Spark knows its size, mostly nothing, before it plans the join.
    rows = keys.join(scratch.written(large, "large"), "key", "left")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.least(part, other) * F.col("parts") + F.greatest(part, other),
    )
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(cells)
    others = [name for name in keys.columns if name != "key"]
    return rows.select("key", F.explode(cells).alias("cell"), *others)


def _close(
    narrow: np.ndarray, wide: np.ndarray, begin: int, end: int, method: Method
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of the run that are close, the first of them between begin and end, and
    the bits in which the wider fingerprints that are compared differ."""
    apart = np.bitwise_count(narrow[begin:end, None] ^ narrow[None, begin:])
    first, second = np.nonzero(apart <= method.distance)
    keep = first < second
    first, second = first[keep] + begin, second[keep] + begin
    if not method.wide or not len(first):
        return first, second, apart[first - begin, second - begin]
    bits = np.empty(len(first), dtype=np.int64)
    for i in range(0, len(first), STEP):
        part = slice(i, i + STEP)
        bits[part] = np.bitwise_count(wide[first[part]] ^ wide[second[part]]).sum(axis=1)
    keep = bits <= method.wide_distance
    return first[keep], second[keep], bits[keep]


def _hook(root: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Connect pairs in ``root``; the pairs that connected what was apart, a tree of them."""
    used = []
    while len(first):
        one, other = root[first], root[second]
        low, high = np.minimum(one, other), np.maximum(one, other)
        new = low < high
        first, second, low, high = first[new], second[new], low[new], high[new]
        if not len(first):
            break
        # Each root is hooked to one lower root by one pair.
        order = np.lexsort((low, high))
        order = order[np.concatenate([[True], np.diff(high[order]) > 0])]
        root[high[order]] = low[order]
        used += zip(first[order].tolist(), second[order].tolist())
        while (root[root] != root).any():
            root[:] = root[root]
    return used


def run_links(narrow: np.ndarray, wide: np.ndarray, method: Method) -> list[tuple[int, int]]:
    """Close pairs of a run, as few as connect all that are connected.

    Closer pairs come first, so two sets are connected by about the closest pair between
    them. Pairs are looked for again for each step of closeness, so that only those of one
    piece of the run are held at a time.
    """
    n = len(narrow)
    root = np.arange(n)
    found: list[tuple[int, int]] = []
    single = _close(narrow, wide, 0, n, method) if n <= ROWS else None
    for limit in method.limits:
        some = False
        for begin in range(0, n, ROWS):
            first, second, apart = single or _close(narrow, wide, begin, begin + ROWS, method)
            some = some or len(first) > 0
            near = apart <= limit
            found += _hook(root, first[near], second[near])
        if not some:
            break
    return found


def links(cells: DataFrame, method: Method) -> DataFrame:
    """``a, b``: links of nodes that connect, within each cell, all close ones."""
    ordered = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def as_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        wide = b"".join(batch.column("wide").to_pylist())
        return {
            "key": batch.column("key").to_numpy(),
            "cell": batch.column("cell").to_numpy(),
            "node": batch.column("node").to_numpy(),
            "narrow": batch.column("narrow").to_numpy().view(np.uint64),
            "wide": np.frombuffer(wide, np.uint64).reshape(batch.num_rows, -1),
        }

    def linked(rows: dict[str, np.ndarray], begin: int, end: int) -> tuple:
        found = run_links(rows["narrow"][begin:end], rows["wide"][begin:end], method)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2) + begin
        return rows["node"][pairs[:, 0]], rows["node"][pairs[:, 1]]

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        ends = [np.concatenate(side) for side in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array(side) for side in ends], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = as_arrays(batch)
            if held is not None:
                now = {name: np.concatenate([held[name], now[name]]) for name in now}
            change = (now["key"][1:] != now["key"][:-1]) | (now["cell"][1:] != now["cell"][:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            # The last run may go on in the next batch.
            runs = np.flatnonzero(np.diff(starts) > 1)
            if len(runs):
                yield as_batch([linked(now, starts[i], starts[i + 1]) for i in runs])
            held = {name: values[starts[-1] :] for name, values in now.items()}
        if held is not None:
            yield as_batch([linked(held, 0, len(held["key"]))])

    return ordered.mapInArrow(work, "a long, b long")


def _verified(
    size: int, similarity: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shingle_set(text: str) -> set[bytes]:
        return set(shingles(text.encode("utf-8").lower().split(), size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, other = None, set()
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                # Pairs come in the order of their second node.
                if b != node:
                    node, other = b, shingle_set(y.as_py())
                one = shingle_set(x.as_py())
                common = len(one & other)
                keep.append(common >= similarity * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def alike(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: float,
    id_col: str, text_col: str, scratch: Scratch,
) -> DataFrame:
    """The pairs of nodes whose texts' sets of shingles are alike by ``similarity`` or more.

    A class is compared by the text that would stay of it, found by its id and SHA-256. Only texts
    of the pairs are looked at.
    """
    pairs = scratch.written(pairs.distinct(), "pairs")
    scratch.settle()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = nodes.join(classes, "node").select("node", "stays.doc_id", "stays.digest")
    wanted = scratch.written(chosen, "nodes").toDF("node", "own_id", "own")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")
    )
    same = (F.col("digest") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    # Copies with ids of their own meet nowhere. Rows that repeat both lie in one task by now, so
    # all but one are dropped where they are.
    found = texts.join(wanted.hint("merge"), same).dropDuplicates(["digest", "doc_id"])
    # Texts are sent to the pairs: their shingles take several times as much, and cannot be packed.
    found = scratch.written(found.select("node", "text"), "texts")
    scratch.settle()
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(found.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verified(size, similarity), "a long, b long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys those whose key another row has too."""
    held, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch if held is None else pa.concat_batches([held, batch])
        key = now.column("key").to_numpy()
        after = key[1:] == key[:-1]
        same = np.concatenate([[before], after])
        # The last row is told when the next is seen.
        yield now.slice(0, len(key) - 1).filter(pa.array(same[:-1] | after))
        held, before = now.slice(len(key) - 1), bool(same[-1])
    if held is not None and before:
        yield held


def run_pairs(
    rows: dict[str, np.ndarray], starts: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the runs that begin at ``starts`` which have different roots and can be
    alike: the shingle of a run is taken as the first that two sets share, so they share no
    more than are left from there in either; with ``bits``, they differ in no fewer than these do."""
    size, left, root = rows["size"], rows["size"] - rows["pos"], rows["root"]
    share = similarity / (1 + similarity)

    def kept(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.minimum(left[first], left[second])
        keep = both >= share * (size[first] + size[second]) - 1e-6
        keep &= root[first] != root[second]
        first, second = first[keep], second[keep]
        if "bits" in rows and len(first):
            most = (1 - 2 * share) * (size[first] + size[second]) + 1e-6
            nodes, at = np.unique(np.concatenate([first, second]), return_inverse=True)
            keep = parities_apart(rows["bits"][nodes], *np.split(at, 2)) <= most
            first, second = first[keep], second[keep]
        return first, second

    lengths = np.diff(np.append(starts, len(size)))
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    # The rows that follow each row in its run.
    after = np.repeat(starts + lengths, lengths) - np.arange(len(size)) - 1
    short = np.flatnonzero(np.repeat(mixed & (lengths <= SHORT), lengths) & (after > 0))
    for step in range(1, SHORT):
        short = short[after[short] >= step]
        if not len(short):
            break
        yield kept(short, short + step)
    for n in np.flatnonzero(mixed & (lengths > SHORT)):
        run = np.arange(starts[n], starts[n] + lengths[n])
        run = run[np.argsort(size[run], kind="stable")]
        for begin in range(0, len(run), ROWS):
            some = run[begin : begin + ROWS]
            # A larger set than this one is like none of them.
            end = np.searchsorted(size[run], size[some[-1]] / similarity + 1, "right")
            other = run[begin:end]
            first, second = np.triu_indices(len(some), 1, len(other))
            yield kept(some[first], other[second])


def _runs(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows in the order of their keys and cells, cut where a run ends, and where runs begin."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {
            name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names
        }
        if held is not None:
            now = {name: np.concatenate([held[name], now[name]]) for name in now}
        change = (now["key"][1:] != now["key"][:-1]) | (now["cell"][1:] != now["cell"][:-1])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        # The last run may go on in the next batch.
        if len(starts) > 1:
            yield {name: values[: starts[-1]] for name, values in now.items()}, starts[:-1]
        held = {name: values[starts[-1] :] for name, values in now.items()}
    if held is not None:
        yield held, np.array([0])


def apart_pairs(
    prints: DataFrame, roots: DataFrame, similarity: float, scratch: Scratch
) -> DataFrame:
    """``a, b``: all pairs of nodes of different ``roots`` whose sets can be alike.

    Some pairs come several times. ``prints`` are ``node, size, prefix, bits`` in any number of
    rows per node.
    """
    rows = prints.dropDuplicates(["node"]).select(
        "node", "size", F.posexplode("prefix").alias("pos", "key")
    )
    ordered = rows.select("key", "node", "size", "pos").repartition("key").sortWithinPartitions("key")
    shared = ordered.mapInArrow(_shared, "key long, node long, size long, pos int")
    # Most shingles are in one text, so this is much less than there was.
    shared = scratch.written(shared, "shared")
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.written(rooted.select("key", "node", "size", "pos", "root"), "rooted")
    scratch.drop(shared)
    scratch.settle()
    cells = dealt(rooted, scratch)
    names = ["key", "cell", "node", "size", "pos", "root"]
    ordered = cells.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches):
            met = np.zeros(len(rows["key"]), dtype=bool)
            for first, second in run_pairs(rows, starts, similarity):
                met[first] = met[second] = True
            yield pa.RecordBatch.from_arrays([pa.array(rows[name][met]) for name in names], names=names)

    # Only rows with a partner get their bits: no more rows than there are, however many pairs.
    met = scratch.written(ordered.mapInArrow(meeting, ordered.schema), "met")
    scratch.drop(rooted)
    scratch.settle()
    bits = prints.select("node", "bits").dropDuplicates(["node"])
    ordered = met.join(bits, "node").repartition("key", "cell").sortWithinPartitions("key", "cell")

    def as_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        one, other = (np.concatenate(side) for side in zip(*found))
        ends = [np.minimum(one, other), np.maximum(one, other)]
        return pa.RecordBatch.from_arrays([pa.array(side) for side in ends], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches):
            found, n = [], 0
            for first, second in run_pairs(rows, starts, similarity):
                found.append((rows["node"][first], rows["node"][second]))
                n += len(first)
                if n > PAIRS:
                    yield as_batch(found)
                    found, n = [], 0
            if n:
                yield as_batch(found)

    return ordered.mapInArrow(work, "a long, b long")


def _grouped(
    docs: DataFrame, method: Method, similarity: float, id_col: str, text_col: str, whole: bool,
    scratch: Scratch,
) -> DataFrame:
    """The rows of `near_groups`; if ``whole``, with the SHA-256 of each text as ``digest`` and
    the id and digest of the row of its component that stays, ``stays``.

    They are read from two tables of ``scratch``; what else was written there is gone.
    """
    sets = bool(similarity) or whole
    prints = (
        with_node(with_shingles(docs, method, similarity, id_col, text_col), method)
        if sets else with_fingerprints(docs, method, id_col, text_col)
    )
    prints = scratch.written(prints, "prints")
    same = ["narrow", "wide"] + ["own"] * sets
    found = [F.min("doc_id").alias("first"), F.count("*").alias("n")]
    if sets:
        # Rows without an id come after others.
        order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "digest")
        found += [F.min("digest").alias("digest"), F.min(order).alias("stays")]
    classes = scratch.written(with_node(prints.groupBy(*same).agg(*found), method), "classes")
    # Before this the shuffle files of earlier jobs, too, may still be there.
    scratch.settle()
    close = links(dealt(keyed(classes, method), scratch), method)
    if similarity:
        verified = alike(close, classes, docs, method.wide, similarity, id_col, text_col, scratch)
        close = scratch.written(verified, "close")
        scratch.keep(prints, classes, close)
        left = apart_pairs(
            prints.select("node", "size", "prefix", "bits"), components(close, scratch), similarity, scratch
        )
        verified = alike(left, classes, docs, method.wide, similarity, id_col, text_col, scratch)
        more = scratch.written(verified, "close")
        scratch.keep(prints, classes, close, more)
        close = close.unionByName(more)
    roots = components(close, scratch)
    groups = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = scratch.written(groups, "groups")
    scratch.keep(prints, groups)
    totals = [F.min("first").alias("component_id"), F.sum("n").alias("group_size")]
    if sets:
        totals.append(F.min("stays").alias("stays"))
    added = ["stays"] * sets
    named = groups.drop("stays").join(groups.groupBy("root").agg(*totals), "root")
    named = named.select(*same, "component_id", "group_size", *added)
    return prints.join(named, same).select(
        "doc_id", "narrow", "component_id", "group_size", *(["digest"] * sets), *added
    )


def near_groups(
    docs: DataFrame,
    method: Method = Method(),
    similarity: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, narrow, component_id, group_size`` for every row.

    ``component_id`` is the smallest id among the rows that can be reached over links
    between close fingerprints; with a ``similarity``, over all links between sets of
    shingles of ``method.wide`` words that are alike by it or more. A null text counts as an
    empty one; texts without a word have fingerprint zero and are linked like any other.
    Rows without an id are rows like any other; a component of such rows only has a null
    id. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = _grouped(docs, method, similarity, id_col, text_col, False, scratch)
    return found.select("doc_id", "narrow", "component_id", "group_size")


def deduplicated(
    docs: DataFrame,
    method: Method = SIMILAR,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were.

    Of each component the text with the smallest id stays, and of several with that id the
    one with the smallest SHA-256; rows without an id come last. Rows that repeat both id and
    text stay or go together.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    groups = _grouped(docs, method, similarity, id_col, text_col, True, scratch)
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
    stays &= F.col("digest") == F.col("stays.digest")
    going = groups.where((F.col("group_size") > 1) & ~stays)
    gone = going.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone"))
    gone = written(gone.distinct(), "simhash-gone")
    scratch.close()
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), key.alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone"))
    # What goes grows with the documents: it is never broadcast, whatever its size here.
    return rows.join(gone.hint("merge"), same, "left_anti").select("row.*")

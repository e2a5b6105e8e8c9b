"""Whitening, spelling variants and nearest neighbours against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexitally.llm import fm_index, neighbours, queries, spelling, whitening
from lexitally.llm.vectors import usable
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def vectors_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()
    ids = rows.column("vec_id").to_numpy()
    return ids, np.array(rows.column("embedding").to_pylist(), dtype=np.float64)


# Whitening


def check_whitening(found, ids, vectors, components=32):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    rows = x - total / n
    _, values, axes = np.linalg.svd(rows)
    values, axes = values**2 / n, axes.T
    size = min(components, int((values > 1e-16 * values[0]).sum()))
    found = found.toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(ids)
    assert found.vec_id.tolist() == np.repeat(ids[order], size).tolist()
    assert found.component.tolist() == list(range(1, size + 1)) * n
    assert set(found.n) == {n}
    far = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total)) for row in x[order]]
    assert found.deviation.tolist() == np.repeat(far, size).tolist()
    want = (rows @ axes[:, :size] / np.sqrt(values[:size]))[order]
    got = found.whitened.to_numpy().reshape(n, size)
    want *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-7
    shares = found.explained.to_numpy().reshape(n, size)
    assert np.abs(shares / (values / values.sum())[:size] - 1).max() < 1e-9
    error = np.abs(got.T @ got / n - np.outer(got.mean(axis=0), got.mean(axis=0)) - np.eye(size)).max()
    assert error < 1e-9 and set(found.identity_error < 1e-9) == {True}


def test_op11(spark):
    check_whitening(queries.op11_whitening(spark, FOLDER), *vectors_of(spark, FOLDER))


@pytest.mark.parametrize("kind", ["small", "constant", "repeated", "steep", "few"])
def test_whitening_of_odd_matrices(spark, kind):
    random_ = np.random.default_rng(3)
    rows = random_.normal(size=(200, 6)) * 50
    if kind == "constant":
        rows[:, 2] = 7
    elif kind == "repeated":
        rows[:, 3] = rows[:, 1]
        rows[100:] = rows[:100]
    elif kind == "steep":
        rows *= [0.01, 0.1, 1, 10, 100, 1000]
    elif kind == "few":
        rows = rows[:4]
    table = spark.createDataFrame([(i, row) for i, row in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    check_whitening(whitening.whitened(table.repartition(3)), np.arange(len(rows)), rows)


ODD = [
    (1, [1.0, 2.0, 3.0], "a"), (2, [1.0, 2.0, 4.0], "b"), (2, [1.0, 2.0, 4.0], "b"), (None, [1.5, 2.0, 9.0], None),
    (5, None, "x"), (6, [1.0, None, 2.0], "x"), (7, [float("nan"), 1.0, 1.0], "x"), (8, [float("inf"), 1.0, 1.0], "x"),
    (9, [1.0], "x"), (10, [], "x"), (11, [0.0, 0.0, 0.0], "x"),
]
ODD_SCHEMA = "vec_id long, embedding array<float>, rank string"


def test_whitening_of_odd_rows(spark):
    found = whitening.whitened(spark.createDataFrame(ODD, ODD_SCHEMA)).collect()
    # Null, undefined, infinite and shorter vectors are out; repeated rows and null ids are in.
    assert Counter(r.vec_id for r in found) == {1: 3, 2: 6, None: 3, 11: 3}
    assert {r.n for r in found} == {5}
    assert whitening.whitened(spark.createDataFrame([], ODD_SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame(ODD[1:3], ODD_SCHEMA)).collect() == []


def test_deviations_stay_exact():
    whole = np.array([[2**40, 5], [3, 4]])
    total = whole.sum(axis=0)
    want = [sum((2**21 * int(a) - int(t)) ** 2 for a, t in zip(row, total)) for row in whole]
    assert whitening.deviations(whole, 2**21, total) == [None if w > 2**63 - 1 else w for w in want]
    assert whitening.deviations(whole[1:], 2**21, np.array([1, 2])) == [(3 * 2**21 - 1) ** 2 + (4 * 2**21 - 2) ** 2]


# Spelling variants


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda found: found[0].lower(), run)
            code = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def brute_variants(words):
    near, holes = {word: set() for word in words}, defaultdict(set)
    for word in words:
        for i in range(len(word)):
            holes[i, word[:i], word[i + 1 :]].add(word)
            if (shorter := word[:i] + word[i + 1 :]) in words:
                near[word].add(shorter)
                near[shorter].add(word)
    for group in holes.values():
        for word in group:
            near[word] |= group - {word}
    forms = {}
    for word, n in words.items():
        best = min(near[word], key=lambda other: (-words[other], other), default=None)
        forms[word] = best if best and words[best] >= 2 * n else None
    found = set()
    for word, form in forms.items():
        root = word
        while forms[root]:
            root = forms[root]
        found.add((word, form, root, words[word], len(near[word]), words[form] if form else None))
    return found


def variants_of(frame):
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(set(rows)) == len(rows)
    return {tuple(row) for row in rows}


def test_op12(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_words(docs))
    assert len(want) > 10_000 and sum(row[1] is not None for row in want) > 1000
    assert variants_of(queries.op12_spelling(spark, SMALL)) == want


@pytest.mark.parametrize("symbols", [spelling.SYMBOLS, 150])
def test_spelling_of_crowded_words(spark, symbols):
    """Few letters, so that near words, runs of a letter and shared halves abound; with small
    indexes, so that halves are dealt over several."""
    random.seed(1)
    words = ["".join(random.choices("abÀé×", k=random.randint(4, 9))) for _ in range(500)]
    words += ["a" * n for n in range(4, 12)] + ["a" * n + "b" for n in range(4, 12)]
    rows = [(i, " ".join(random.choices(words, k=60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants_of(spelling.variants(docs, symbols=symbols)) == brute_variants(brute_words(rows))


def test_spelling_of_odd_rows(spark):
    long = "q" * 3000
    rows = [
        (1, None), (2, ""), (None, "Straße " * 3), (3, "strasse straße, STRASSE; strassen! " * 3), (3, "strasse"),
        (4, f"{long} {long} {long}x {long}x {long}x " * 2), (5, "日本語 1234 été"), (5, "naïve naive\nNAIVE naïve naïve naive"),
    ] * 2
    docs = spark.createDataFrame([(i, t, "w", 7) for i, t in rows], "doc_id long, text string, word string, n int")
    assert variants_of(spelling.variants(docs)) == brute_variants(brute_words(rows))
    assert variants_of(spelling.variants(docs.limit(0))) == set()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=40))
def test_intervals_of_the_index(words):
    """Any match, put together from either end, has as many ranks as it has occurrences."""
    words = sorted(words)
    lengths = np.array([len(word) for word in words])
    rows = np.zeros((len(words), lengths.max()), dtype=np.int16)
    for row, word in zip(rows, words):
        row[: len(word)] = [ord(c) - 96 for c in word]
    index = fm_index.BidirectionalIndex(rows, lengths, 2)
    text = "$" + "$".join(words) + "$"
    random_ = random.Random(len(text))
    for _ in range(20):
        begin = random_.randrange(len(text))
        end = begin + random_.randint(1, 5)
        part = text[begin:end]
        middle = begin + random_.randrange(len(part))
        found, low, high = index.whole(1), middle, middle
        while (low, high) != (begin, begin + len(part)):
            left = high == begin + len(part) or (low > begin and random_.random() < 0.5)
            low, high, sign = (low - 1, high, text[low - 1]) if left else (low, high + 1, text[high])
            symbol = np.array([0 if sign == "$" else ord(sign) - 96])
            found = index.extend(found, symbol, fm_index.LEFT if left else fm_index.RIGHT)
        if "$" not in part[1:-1]:
            want = sum(text.startswith(part, i) for i in range(len(text)))
            assert found.size[0] == want


# Nearest neighbours


def brute_nearest(ids, vectors, asked, count=20):
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :count]
    return {(int(ids[q]), int(ids[c])) for q, row in zip(asked, best) for c in row}


def check_scores(found, ids, vectors):
    place = {int(i): n for n, i in enumerate(ids)}
    for row in found:
        exact = float((vectors[place[row.query_id]] * vectors[place[row.vec_id]]).sum())
        assert abs(row.score - exact) < 1e-12 and row.query_id != row.vec_id
    ranks = defaultdict(list)
    for row in found:
        ranks[row.query_id].append((row.rank, -row.score, row.vec_id))
    for rows in ranks.values():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)


def test_op13(spark):
    ids, vectors = vectors_of(spark, FOLDER)
    found = queries.op13_neighbours(spark, FOLDER).collect()
    asked = np.flatnonzero(ids % 20 == 0)
    assert Counter(row.query_id for row in found) == {int(ids[q]): 20 for q in asked}
    check_scores(found, ids, vectors)
    want = brute_nearest(ids, vectors, asked)
    got = {(row.query_id, row.vec_id) for row in found}
    assert len(want & got) >= 0.9 * len(want)


@pytest.fixture(scope="module")
def clustered():
    """Vectors around centres, as embeddings lie; a third of them copies of one."""
    random_ = np.random.default_rng(5)
    centres = random_.normal(size=(60, 24))
    rows = centres[random_.integers(0, 60, 6000)] + 0.35 * random_.normal(size=(6000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[::3] = rows[0]
    return rows.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("cell", [neighbours.CELL, 2000])
def test_clustered_vectors_need_few_partitions(spark, clustered, cell):
    ids = np.arange(len(clustered))
    table = spark.createDataFrame(
        [(int(i), row) for i, row in zip(ids, clustered.tolist())], "vec_id long, embedding array<float>"
    ).repartition(4)
    router = neighbours.fit(usable(table, "vec_id", "embedding"), 20)
    assert router.weights.shape[1] == 46 and router.probes < 30 and router.recall >= neighbours.RECALL
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, cell=cell, router=router).collect()
    asked = np.flatnonzero(ids % 20 == 0)
    assert len(found) == 20 * len(asked)
    check_scores(found, ids, clustered)
    got = defaultdict(list)
    for row in found:
        got[row.query_id].append(row)
    # Copies: the smallest ids of those that are equally near.
    for query in (60, 120):
        rows = sorted(got[query], key=lambda row: row.rank)
        assert [row.vec_id for row in rows] == [i for i in range(0, 66, 3) if i != query][:20]
    single = [q for q in asked if q % 3]
    want = brute_nearest(ids, clustered, single)
    hits = {(row.query_id, row.vec_id) for row in found if row.query_id % 3}
    # Where several copies are equally near, others than the first may stand in one's place.
    assert len(want & hits) >= 0.9 * len(want)


def test_neighbours_of_odd_rows(spark):
    found = neighbours.nearest(spark.createDataFrame(ODD, ODD_SCHEMA), F.col("vec_id") % 2 == 0).collect()
    rows = sorted(tuple(row) for row in found if row.vec_id is not None)
    # Both rows of id 2 ask, find each other, the row without an id and row 1; zero is out.
    assert rows == [(2, 2, 2, 21.0)] * 2 + [(2, 3, 1, 17.0)] * 2
    assert [tuple(row) for row in found if row.vec_id is None] == [(2, 1, None, 41.5)] * 2
    empty = spark.createDataFrame([], ODD_SCHEMA)
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(spark.createDataFrame(ODD, ODD_SCHEMA), F.col("vec_id") < 0).collect() == []


def test_balanced_partitions():
    scores = np.random.default_rng(1).normal(size=(100, 7)) + [5, 0, 0, 0, 0, 0, 0]
    found = neighbours.balanced(scores, 15)
    assert np.bincount(found, minlength=7).max() <= 15 and len(found) == 100

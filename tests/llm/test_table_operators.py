"""Mixing, sharding, quality rules and exact dedup against brute force and DuckDB."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexitally.llm import exact_dedup, mixing, quality_rules, queries, sharding
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size string, row string, digest int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert compare.differences(found, con, queries.ORACLE_SQL[name]) == ""


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "one two three", "one two three", long, "x" * 100_000, "ü\n€ 日本"]
    rows = [(i, text, "en", f"s{i % 2}", "big", "r", 1) for i, text in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "one two three", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Sharding


def brute_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] + [float("inf")] * len(sizes)
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j - 1, -1, -1):
                total += sizes[i]
                new[j] = min(new[j], max(best[i], total))
        best = [min(a, b) for a, b in zip(best, new)]
    return best[-1]


def check_shards(rows, source, shards):
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in source)
    place = defaultdict(set)
    slots = defaultdict(list)
    sizes = Counter()
    for r in rows:
        place[r["digest"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(found) == 1 for found in place.values())
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert set(sizes) <= set(range(shards))
    groups = Counter()
    for r in source:
        text = (r[1] or "").encode()
        groups[hashlib.sha256(text).hexdigest()] += len(text) + 16
    wanted = brute_capacity([groups[d] for d in sorted(groups)], shards)
    assert max(sizes.values()) == wanted


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_have_the_smallest_capacity(spark, monkeypatch, shards):
    source = [(i, "t" * (i * 37 % 101) + str(i % 40)) for i in range(90)]
    monkeypatch.setattr(sharding, "POINTS", 4)
    docs = spark.createDataFrame(source, "doc_id long, text string")
    check_shards(sharding.shard_contiguous(docs, shards).collect(), source, shards)


def test_a_large_group_leaves_the_others_even(spark):
    source = [(i, "same" * 40) for i in range(60)] + [(100 + i, f"text {i} " * 3) for i in range(200)]
    docs = spark.createDataFrame(source, "doc_id long, text string")
    rows = sharding.shard_contiguous(docs, 5).collect()
    check_shards(rows, source, 5)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 5


def test_odd_rows_are_sharded(odd, empty):
    rows = sharding.shard_contiguous(odd, 2).collect()
    check_shards(rows, odd_rows(), 2)
    for r in rows:
        if r["doc_id"] == 8:
            assert r["text_crc32"] == zlib.crc32("ü\n€ 日本".encode())
    assert sharding.shard_contiguous(empty, 4).count() == 0


# Quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_counts_of_texts(spark):
    pick = random.Random(5)
    tokens = ["a", "b", "c d", "\n", " ", "\t", "#x", "|", "é", " ", "日本", "\x0b", "a b a b a b"]
    texts = ["".join(pick.choice(tokens) + pick.choice(("", " ")) for _ in range(pick.randint(0, 60))) for _ in range(150)]
    texts += [row[1] for row in odd_rows()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.judge(docs).select("row.*", "counts", "base_failed", "kept").collect():
        counts = brute_counts(row["text"])
        assert {name: row["counts"][name] for name in counts} == counts
        failed = counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]
        assert row["base_failed"] == failed
        assert not (row["kept"] and failed)


def test_rules_keep_prose_and_reject_junk(spark):
    prose = "The house stood in the middle of a field and nobody knew who had built it there."
    texts = {
        prose: True,
        "Das Haus stand in der Mitte und niemand wusste wer es für sie gebaut hat.": True,
        " ".join(f"word{i}###" for i in range(30)): False,
        " | ".join(f"cell{i}" for i in range(60)): False,
        "\n".join(["the same line of the text"] * 9): False,
        prose.upper(): False,
        "too short": False,
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["text"]: r["kept"] for r in quality_rules.judge(docs).select("row.text", "kept").collect()}
    assert found == texts


def test_passing_rows_keep_their_columns(odd, empty):
    kept = quality_rules.passing(odd)
    assert kept.schema == odd.schema
    assert {r["doc_id"] for r in kept.collect()} <= {6}
    assert quality_rules.passing(empty).count() == 0


def test_quality_runs_no_python(spark):
    plan = queries.op6_quality_rules(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Mixing


def test_margins_are_met(spark):
    pick = random.Random(2)
    rows = [
        (i, "x" * pick.randint(1, 400), pick.choice("aaaab"), pick.choice("ppq")) for i in range(4000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = mixing.mixed(
        docs,
        {"source": F.col("source"), "lang": F.col("lang")},
        {"source": mixing.given({"a": 3.0, "b": 1.0}), "lang": mixing.tempered(0.0)},
        0.3,
    ).select("row.doc_id", "source", "lang", "tokens", "probability", "kept").collect()
    total = sum(r["tokens"] for r in found)
    wanted = Counter()
    for r in found:
        wanted[r["source"]] += r["tokens"] * r["probability"]
        wanted[r["lang"]] += r["tokens"] * r["probability"]
    for value, share in (("a", 0.75), ("b", 0.25), ("p", 0.5), ("q", 0.5)):
        assert wanted[value] == pytest.approx(0.3 * total * share, rel=0.01)
    kept = sum(r["tokens"] for r in found if r["kept"])
    assert kept == pytest.approx(0.3 * total, rel=0.1)


def test_a_wanted_cell_is_taken_whole(spark):
    rows = [(i, "x" * 40, "few" if i < 5 else "many") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(
        docs, {"source": F.col("source")}, {"source": mixing.tempered(0.0)}, 0.5
    ).collect()
    assert all(r["probability"] == 1.0 and r["kept"] for r in found if r["source"] == "few")


def test_odd_rows_are_mixed(odd, empty):
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.size_class()}
    targets = {name: mixing.tempered(0.5) for name in dims}
    found = mixing.mixed(odd, dims, targets, 0.5).collect()
    assert len(found) == len(odd_rows())
    assert all(0 <= r["probability"] <= 1 for r in found)
    assert mixing.mixed(empty, dims, targets, 0.5).count() == 0


# Exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


def check_duplicates(found, source):
    groups = brute_groups(source)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    assert len(found) == len(source)
    kept = Counter()
    for r in found:
        ids = by_digest[bytes(r["digest"])]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (max(known) if known else None)
        assert r["group_size"] == len(ids)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[bytes(r["digest"])] += 1
    assert kept == Counter(by_digest.keys())


def test_duplicates_of_odd_rows(odd, empty):
    check_duplicates(exact_dedup.duplicates(odd).collect(), [r[:2] for r in odd_rows()])
    assert exact_dedup.duplicates(empty).count() == 0


def test_duplicates_over_many_tasks(spark):
    rows = [(i * 7 % 3001, f"t{i % 400}" if i % 3 else "hot") for i in range(3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    check_duplicates(exact_dedup.duplicates(docs).collect(), rows)


def test_one_row_of_each_text_stays(odd, empty):
    kept = exact_dedup.deduplicated(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    groups = brute_groups([r[:2] for r in odd_rows()])
    assert Counter(r["text"] or "" for r in rows) == Counter(groups.keys())
    for r in rows:
        known = [i for i in groups[r["text"] or ""] if i is not None]
        assert r["doc_id"] == (max(known) if known else None)
    assert exact_dedup.deduplicated(empty).count() == 0


def key(n):
    return hashlib.sha256(str(n).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_follows_a_set(changes):
    index, live = exact_dedup.CuckooIndex(buckets=2), {}
    for insert, n in changes:
        assert (index.find(key(n)) >= 0) == (n in live)
        if insert and n not in live:
            index.insert(key(n), n)
            live[n] = n
        elif not insert:
            assert index.delete(key(n)) == (live.pop(n, None) is not None)
    assert dict(index.live()) == {key(n): n for n in live}
    assert len(index) == len(live)


def test_cuckoo_index_grows_and_tells_equal_prints_apart():
    index = exact_dedup.CuckooIndex(buckets=2)
    keys = [b"\x00\x01" + bytes(6) + n.to_bytes(4, "big") for n in range(8)] + [key(n) for n in range(5000)]
    for n, one in enumerate(keys):
        index.insert(one, n)
    assert index.mask + 1 > 1000
    assert [index.values[index.find(one)] for one in keys] == list(range(len(keys)))


@pytest.mark.parametrize("held", [1, 2, exact_dedup.HELD])
def test_changed_index(spark, held):
    def rows(pairs):
        return spark.createDataFrame(pairs, "doc_id long, text string")

    def live(index):
        return {(bytes(r["digest"]), r["keep_id"], r["n"]) for r in index.collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).digest()

    first = exact_dedup.changed_index(None, exact_dedup.digests(rows([(1, "a"), (5, "a"), (2, "b")])), held=held)
    assert live(first) == {(digest("a"), 5, 2), (digest("b"), 2, 1)}
    gone = exact_dedup.digests(rows([(0, "a"), (0, "z")])).select("digest")
    more = exact_dedup.digests(rows([(3, "a"), (9, "c"), (1, "b")]))
    second = exact_dedup.changed_index(first, more, gone, held)
    assert live(second) == {(digest("a"), 3, 1), (digest("b"), 2, 2), (digest("c"), 9, 1)}


def test_an_index_that_begins_anew_loses_nothing(spark):
    """Few digests are held, so every task gives out many indexes of its entries."""
    texts = [(i, f"text {i % 400}") for i in range(3000)]
    found = exact_dedup.digests(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    index = exact_dedup.changed_index(None, found, held=5)
    gone = found.where(F.col("doc_id") < 100).select("digest")
    for some, n in ((index, 400), (exact_dedup.changed_index(index, None, gone, 5), 300)):
        rows = some.collect()
        assert len(rows) == len({bytes(r.digest) for r in rows}) == n
        assert {(bytes(r.digest), r.keep_id, r.n) for r in rows} <= {
            (hashlib.sha256(f"text {i}".encode()).digest(), max(range(i, 3000, 400)), len(range(i, 3000, 400)))
            for i in range(400)
        }

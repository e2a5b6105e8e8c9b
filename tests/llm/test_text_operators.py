"""Packing, token counts, token files, near dedup and languages against brute force."""

import json
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
import zstandard
from lexitally.llm import language_id, packing, queries, simhash, token_counts, token_files
from lexitally.llm.components import components
from lexitally.llm.encode import Encoder
from pyspark.sql import functions as F
from test_table_operators import SCHEMA, odd_rows
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(queries.TOKENIZER)
PARTS = (
    " |  |\n|\t| \n|\xa0|\x1c|\x85|a|B|é|日本|1|²|'s|'ll|'|.|!|<|endoftext|>|_|\r\n|　|​|👍🏽|́"
).split("|") + ["<|endoftext|>", "word", "words,", "aaaa", "x" * 300]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def made_up_texts(n=4000, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Tokens


def test_encoder_and_counter_agree_with_the_library():
    texts = made_up_texts() + [" " + "ab" * n for n in range(30)] + ["ha" * n + "aaa" * n for n in range(20)]
    texts += [chr(i) + " b" + chr(i) * 2 + "1" for i in range(1, 0x3100)]
    want = [library(text) for text in texts]
    encoded = Encoder(queries.TOKENIZER).encode(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoded] == want
    assert token_counts.Counter(queries.TOKENIZER).count(texts) == [len(ids) for ids in want]


def test_merged_symbols_take_part_in_later_merges_only():
    with open(queries.TOKENIZER, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    made = {}
    for rank, merge in enumerate(merges):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        assert made.get(left, -1) < rank and made.get(right, -1) < rank
        made.setdefault(left + right, rank)


def test_what_is_remembered_stays_bounded(monkeypatch):
    from lexitally.llm import encode

    monkeypatch.setattr(encode, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    encoder, counter = Encoder(queries.TOKENIZER), token_counts.Counter(queries.TOKENIZER)
    for i in range(0, 400, 20):
        texts = made_up_texts(400)[i : i + 20]
        want = [library(text) for text in texts]
        assert [len(ids) // 4 for ids in encoder.encode(texts)] == [len(ids) for ids in want]
        assert counter.count(texts) == [len(ids) for ids in want]
    assert len(encoder.known) < 600 and not any(len(piece) > 200 for piece in encoder.known)


def test_token_counts_of_odd_rows(odd, empty):
    found = token_counts.token_counts(odd, queries.TOKENIZER).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library(r[1]))) for r in odd_rows()]
    assert Counter(map(tuple, found)) == Counter(want)
    assert token_counts.token_counts(empty, queries.TOKENIZER).count() == 0


def test_token_count_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    for r in queries.op5_token_counts(spark, FOLDER).collect():
        n = len(library(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


# Packing


def check_packing(rows, source, longest=1024):
    """Every id of every document in exactly one piece, sequences gapless and full."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    ids = defaultdict(list)
    for doc_id, text in source:
        ids[doc_id].append(np.array(library(text) + [0], dtype="<u4"))
    for r in rows:
        candidates = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        part = [x[r.start : r.start + r.length].tobytes() for x in candidates]
        assert r.ids_crc32 in {zlib.crc32(x) for x in part}
        assert bytes(r.ids) in part
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length, r.tier, r.step_id))
    for doc_id, arrays in ids.items():
        want = Counter(i for x in arrays for i in range(len(x)))
        assert Counter(i for a, n in pieces[doc_id] for i in range(a, a + n)) == want
    unfilled = 0
    for found in sequences.values():
        end = 0
        for offset, length, size, tier, _ in sorted(found):
            assert offset == end and length > 0
            end += length
        assert end == size <= tier <= longest
        assert len({(t, s) for _, _, _, t, s in found}) == 1
        unfilled += end < tier
    return unfilled


def test_packing_of_odd_rows(odd, empty):
    found = packing.pack(odd.coalesce(1), queries.TOKENIZER).collect()
    assert check_packing(found, [r[:2] for r in odd_rows()]) <= 1
    assert packing.pack(empty, queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("tasks", [1, 5])
def test_packing_wastes_one_window_per_task_at_most(spark, tasks):
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text").repartition(tasks)
    found = packing.pack(docs, queries.TOKENIZER).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(found, source) <= tasks
    tiers = Counter(r.tier for r in found)
    assert len(tiers) >= 3


def test_packer_cuts_one_piece_per_window():
    pick, packer, windows = random.Random(1), packing.Packer((64, 128, 256)), []
    lengths = [pick.randint(1, 700) for _ in range(400)]
    for doc, n in enumerate(lengths):
        windows += packer.add(doc, np.arange(n, dtype="<u4").tobytes())
        windows += packer.pack()
    windows += packer.finish()
    assert sum(w.filled for w in windows) == sum(lengths)
    assert sum(w.filled < w.size for w in windows) <= 1
    first = packing.deal(windows[:64], 10, step_ids=1024)
    filled = Counter()
    for window in windows[:64]:
        filled[window.step] += window.size
    assert set(filled) == set(range(10, first))
    assert max(filled.values()) - min(filled.values()) <= 256


def test_tiers_are_powers_of_two():
    with pytest.raises(ValueError, match="powers of two"):
        packing.Packer((64, 100))


# Token files


def want_digests(source):
    at, want = 0, []
    for doc_id, text in source:
        ids = np.array(library(text) + [2], dtype="<u4").tobytes()
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return want


def test_token_files_round_trip(spark, folder):
    docs = queries.table(spark, FOLDER, "documents").repartition(3)
    files = token_files.write(docs, f"{folder}/files", queries.TOKENIZER)
    found = token_files.digests(files).orderBy("doc_id").collect()
    source = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r) for r in found] == want_digests(source)
    names = [n for n in sorted(os.listdir(f"{folder}/files")) if not n.startswith(".")]
    assert all(n.endswith(".ids.zst") for n in names) and len(names) == files.files.count()
    # Any zstandard reader passes over the two tables at the end.
    whole = b""
    for name in names:
        with open(f"{folder}/files/{name}", "rb") as file:
            reader = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
            whole += reader.read()
    assert len(whole) // 4 == sum(r.n_tokens for r in found)
    wanted = spark.createDataFrame([(5,), (17,), (10**9,)], "id long")
    some = {r.doc_id: bytes(r.ids) for r in token_files.documents(files, wanted).collect()}
    assert {i: zlib.crc32(ids) for i, ids in some.items()} == {
        r.doc_id: r.ids_crc32 for r in found if r.doc_id in (5, 17)
    }


def test_odd_rows_in_files(odd, empty, folder):
    files = token_files.write(odd, f"{folder}/odd", queries.TOKENIZER)
    found = token_files.digests(files).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(
        (d, n, c) for d, _, n, c in want_digests([r[:2] for r in odd_rows()])
    )
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    nothing = token_files.write(empty, f"{folder}/empty", queries.TOKENIZER)
    assert token_files.digests(nothing).count() == 0


def test_a_reader_decompresses_only_what_is_asked_for(folder, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    monkeypatch.setattr(token_files, "FRAMES", 2)
    path = f"{folder}/x"
    with pa.OSFile(path, "wb") as out:
        writer = token_files.Writer(out, pa.int64())
        for i in range(50):
            writer.add(i, np.full(30 + i, i, dtype="<u4").tobytes())
        writer.close()
    with pa.OSFile(path, "rb") as source:
        reader = token_files.Reader(source)
        assert len(reader) == 50
        assert np.frombuffer(reader.document(20), "<u4").tolist() == [20] * 50
        assert reader.frames_read <= 2 < len(reader.sums) // 4
        begin = int(reader.places[3])
    with open(path, "r+b") as file:
        file.seek(begin + 20)
        byte = file.read(1)
        file.seek(begin + 20)
        file.write(bytes([byte[0] ^ 1]))
    with pa.OSFile(path, "rb") as source:
        reader = token_files.Reader(source)
        with pytest.raises(Exception):
            for i in range(50):
                reader.document(i)


# Near dedup


def brute_fingerprint(text, size=3):
    import xxhash

    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    found = found or ([b" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def brute_components(rows, close):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if close(rows[i], rows[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def check_groups(found, source, size=3):
    prints = {i: brute_fingerprint(text, size) for i, text in source}
    assert {r.doc_id: r.narrow % (1 << 64) for r in found} == prints
    ids = sorted(prints)
    roots = brute_components(ids, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in found} == {i: ids[r] for i, r in zip(ids, roots)}
    sizes = Counter(roots)
    assert {r.doc_id: r.group_size for r in found} == {i: sizes[r] for i, r in zip(ids, roots)}


def test_near_groups_of_the_documents(spark):
    docs = queries.table(spark, FOLDER, "documents")
    source = [(r.doc_id, r.text) for r in docs.collect()]
    check_groups(simhash.near_groups(docs).collect(), source)


@pytest.mark.parametrize("run", [3, 20_000])
def test_near_groups_of_many_copies(spark, monkeypatch, run):
    pick = random.Random(4)
    base = [f"w{pick.randint(0, 500)}" for _ in range(300)]
    source = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.choice((0, 0, 1, 2, 5))):
            words[pick.randrange(300)] = f"v{pick.randint(0, 99)}"
        source.append((i, " ".join(words)))
    source += [(200 + i, f"one {i} other text that has no twin {i * 7}") for i in range(40)]
    source += [(300, ""), (301, None), (302, " \n")]
    monkeypatch.setattr(simhash, "RUN", run)
    docs = spark.createDataFrame(source, "doc_id long, text string").repartition(5)
    check_groups(simhash.near_groups(docs).collect(), source)


def test_links_are_close_pairs_and_few():
    pick = np.random.default_rng(1)
    narrow = np.uint64(12345) ^ (np.uint64(1) << pick.integers(0, 64, 700, dtype=np.uint64))
    found = simhash.run_links(narrow, np.zeros((700, 0), np.uint64), simhash.Method())
    assert all(int(narrow[a] ^ narrow[b]).bit_count() <= 3 for a, b in found)
    assert len(found) == 699


def test_odd_rows_near_dedup(odd, empty):
    found = simhash.near_groups(odd).collect()
    assert len(found) == len(odd_rows())
    by_id = {r.doc_id: r for r in found}
    assert by_id[4].component_id == by_id[5].component_id == 4
    assert by_id[1].component_id == by_id[0].component_id == 0
    kept = simhash.deduplicated(odd)
    assert kept.schema == odd.schema
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[4] == 3 and ids[5] == 0 and ids[None] == 0 and ids[6] == 1
    assert simhash.near_groups(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


def sets(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_similar_texts_go_and_others_stay(spark):
    pick = random.Random(9)
    source, alike, apart = [], [], []
    for g in range(60):
        base = [f"w{g}x{pick.randint(0, 10**6)}" if pick.random() < 0.6 else pick.choice("the of and to in".split()) for _ in range(400)]
        source.append((10 * g, " ".join(base)))
        near = list(base)
        for _ in range(4):
            near[pick.randrange(400)] = "changed"
        source.append((10 * g + 1, " ".join(near)))
        far = list(base)
        for _ in range(40):
            far[pick.randrange(400)] = f"other{pick.randint(0, 99)}"
        source.append((10 * g + 2, " ".join(far)))
    for i in range(0, len(source), 3):
        for j, into in ((1, alike), (2, apart)):
            a, b = sets(source[i][1]), sets(source[i + j][1])
            into.append((len(a & b) / len(a | b), source[i + j][0]))
    docs = spark.createDataFrame(source, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    wanted = [i for similarity, i in alike if similarity >= 0.8]
    assert len(wanted) > 50
    assert sum(i not in kept for i in wanted) >= 0.95 * len(wanted)
    assert all(i in kept for similarity, i in apart if similarity < 0.8)
    assert all(10 * g in kept for g in range(60))


def check_similar(found, source):
    """Components over all pairs whose sets of five-word shingles are alike by 0.8 or more."""
    shingles = {i: sets(text) for i, text in source}
    ids = sorted(shingles)

    def close(i, j):
        both = len(shingles[i] & shingles[j])
        return both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both)

    roots = brute_components(ids, close)
    assert len(set(roots)) < len(ids)
    assert {r.doc_id: r.component_id for r in found} == {i: ids[r] for i, r in zip(ids, roots)}


@pytest.mark.parametrize("run", [3, 20_000])
def test_copies_with_a_passage_added_or_cut_are_all_found(spark, monkeypatch, run):
    pick = random.Random(11)
    source = []
    for g in range(150):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice((12, 60, 400)))]
        passage = [f"v{pick.randint(0, 10**6)}" for _ in range(len(words) // 4 - 1)]
        at = pick.randrange(len(words) // 5 + 1)
        other = pick.choice((words + passage, passage + words, words[: len(words) - at]))
        source += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    # Opening words that many texts have, and texts of a few words.
    source += [(400 + i, "all of these begin with the same few words " + f"x{i} " * 5) for i in range(60)]
    source += [(500 + i, f"a b {i % 4}") for i in range(8)]
    monkeypatch.setattr(simhash, "RUN", run)
    docs = spark.createDataFrame(source, "doc_id long, text string")
    check_similar(simhash.near_groups(docs, simhash.SIMILAR, 0.8).collect(), source)


def test_links_are_found_though_closer_fingerprints_are_not_alike(spark):
    pick = random.Random(12)
    source = []
    for g in range(12):
        base = [f"w{pick.randint(0, 10**6)}" for _ in range(120)]
        for i in range(40):
            words = list(base)
            for _ in range(pick.randint(2, 5)):
                words[pick.randrange(120)] = f"v{pick.randint(0, 10**6)}"
            source.append((100 * g + i, " ".join(words)))
    docs = spark.createDataFrame(source, "doc_id long, text string")
    check_similar(simhash.near_groups(docs, simhash.SIMILAR, 0.8).collect(), source)


def test_candidates_take_less_room_than_their_texts(spark, monkeypatch):
    """What is written of the texts that are compared, and sent to their pairs, is packed text."""
    pick, sizes = random.Random(13), {}
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(pick.choices(words, k=900)) for _ in range(100)]
    source = [(2 * i + j, text + " more" * j) for i, text in enumerate(texts) for j in range(2)]
    write = simhash.Scratch.written

    def written(self, rows, name):
        table = write(self, rows, name)
        files = [Path(urlparse(file).path) for file in table.inputFiles()]
        sizes[name] = max(sizes.get(name, 0), sum(file.stat().st_size for file in files))
        return table

    monkeypatch.setattr(simhash.Scratch, "written", written)
    docs = spark.createDataFrame(source, "doc_id long, text string")
    kept = simhash.deduplicated(docs)
    assert {r.doc_id for r in kept.collect()} == set(range(0, 200, 2))
    del sizes["prints"]
    assert max(sizes.values()) < 0.6 * sum(len(text) for _, text in source)


def test_parities_never_tell_alike_sets_apart():
    pick = np.random.default_rng(15)
    sizes = (0, 1, 2, 31, 32, 33, 500, 620, 5000, 40_000)
    both = pick.integers(0, 1 << 64, 50_000, dtype=np.uint64)
    found = [both[at : at + n] for n in sizes for at in (0, n // 20, n // 9)]
    bits = np.array([simhash.parities(values) for values in found], dtype=object)
    assert max(map(len, bits)) == simhash.PARITIES // 8
    first, second = np.triu_indices(len(found), 1)
    apart = simhash.parities_apart(bits, first, second)
    differing = [len(np.setxor1d(found[i], found[j])) for i, j in zip(first, second)]
    assert (apart <= differing).all()
    near = [(a, d) for a, d, i, j in zip(apart, differing, first, second) if len(found[i]) == len(found[j]) == 500]
    assert all(a > 0.8 * d for a, d in near) and len(near) == 3


@pytest.mark.parametrize("run", [50, 20_000])
def test_a_family_of_texts_that_are_not_alike_is_not_paired(spark, monkeypatch, run):
    """80 variants of a text, alike by 0.7, share hundreds of keys and have 3,160 pairs."""
    pick, pairs = random.Random(14), []
    base = [f"w{pick.randint(0, 10**6)}" for _ in range(400)]
    source = []
    for i in range(80):
        words = list(base)
        for at in pick.sample(range(4, 396), 8):
            words[at] = f"v{pick.randint(0, 10**6)}"
        source.append((i, " ".join(words)))
    source += [(100 + i, source[i][1] + " added " * 3) for i in range(4)]
    write = simhash.Scratch.written

    def written(self, rows, name):
        table = write(self, rows, name)
        pairs.extend([table.count()] * (name == "pairs"))
        return table

    monkeypatch.setattr(simhash.Scratch, "written", written)
    monkeypatch.setattr(simhash, "RUN", run)
    docs = spark.createDataFrame(source, "doc_id long, text string")
    check_similar(simhash.near_groups(docs, simhash.SIMILAR, 0.8).collect(), source)
    assert len(pairs) == 2 and pairs[1] < len(source)


def test_near_copies_go_by_id_and_text(spark):
    def copies(name):
        words = [f"{name}{i}" for i in range(100)]
        return " ".join(words), " ".join(words + ["more"])

    one, two, three, four = map(copies, "abcd")
    source = [
        (1, one[0]), (None, one[1]),  # no id, and a near copy that has one
        (2, two[0]), (2, two[1]), (3, "a text of id three"), (3, one[1]),  # ids that repeat
        (None, three[0]), (None, three[1]),  # near copies without ids
        (None, four[0]), (None, "a clean text without an id"),
    ]
    docs = spark.createDataFrame(source, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect())
    sure = {(1, one[0]): 1, (3, "a text of id three"): 1, (None, four[0]): 1, (None, "a clean text without an id"): 1}
    assert {row: kept.pop(row, 0) for row in sure} == sure
    assert sum(kept[2, text] for text in two) == 1
    assert sum(kept[None, text] for text in three) == 1
    assert sum(kept.values()) == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (300, 299)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)} | {299: 299, 300: 299}
    assert {r.node: r.root for r in found} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Languages


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    found = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(
        docs.select("doc_id", "lang"), "doc_id"
    ).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "zu und der die" if zlib.crc32(str(i).encode()) % 5 else "zq xq", "de") for i in range(50)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "zu" in model.rows[0] and "zq" not in model.rows[0] and model.languages == ["de"]


def test_unseen_words_fall_back_to_shorter_grams(spark):
    rows = [(i, "singing ringing bringing", "en") for i in range(40)]
    rows += [(100 + i, "zeitung leitung heizung", "de") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("swinging")[0] == "en" and model.predict("Beratung!")[0] == "de"
    assert model.words(["zeitung"])[0, 0] > model.words(["zeitung"])[0, 1]
    for text in ("", "123 ... ²", "\n"):
        assert model.predict(text) == ("und", 0.0)


def brute_prediction(model, text):
    total, n = np.zeros(len(model.languages)), 0
    for word in language_id.LETTERS.findall(text.lower()):
        n += 1
        if word in model.rows[0]:
            total += model.scores[0][model.rows[0][word]]
            continue
        for length in range(language_id.LONGEST, 0, -1):
            rows = [model.rows[length][g] for g in language_id.grams(word, length) if g in model.rows[length]]
            if rows:
                weight = language_id.BACKOFF ** (language_id.LONGEST - length)
                total += weight * model.scores[length][rows].mean(axis=0)
                break
    if not n:
        return "und", 0.0
    chances = np.exp(total - total.max())
    return model.languages[int(total.argmax())], chances.max() / chances.sum()


def test_predictions_agree_with_brute_force(spark, monkeypatch):
    docs = queries.table(spark, FOLDER, "documents")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.collect()] + ["", "!", "zug a", "ein " * 5000 + "xyzzy"]
    want = [brute_prediction(model, text) for text in texts]
    for remembered, step in ((700_000, 200_000), (300, 70)):
        monkeypatch.setattr(language_id, "REMEMBERED", remembered)
        monkeypatch.setattr(language_id, "STEP", step)
        model.tokens, model.sums = {}, None
        found = [model.predict(text) for text in texts]
        assert [name for name, _ in found] == [name for name, _ in want]
        assert np.allclose([score for _, score in found], [score for _, score in want])
    assert model.predict_all(texts) == found


def test_odd_rows_have_a_language(spark, odd, empty):
    model = language_id.fit(odd)
    found = language_id.predicted(odd, model).collect()
    assert len(found) == len(odd_rows())
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predicted(odd, nothing).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0
    flags = odd.select(language_id.is_held_out().alias("h")).collect()
    assert all(r.h is not None for r in flags)


def test_the_sample_is_bounded(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    assert 400 < language_id.sample(rows, 500).count() < 600
    assert language_id.sample(rows, 5000).count() == 4000

"""HTML extraction and the pipeline, stage by stage, against brute force."""

import random
import re
from collections import Counter
from html import unescape

import corpus_pipeline
import numpy as np
import pytest
from lexitally.llm import boosting, dom, html_extraction, queries
from test_table_operators import WORD, brute_counts, odd_rows
from test_text_operators import check_packing, sets

FOLDER = "/root/testdata/sf0.01"


# Pages


def article_text(source):
    body = source[source.index("<article>") : source.index("</article>")]
    blocks = re.split("</?p>|</?h1>|<article>", body)
    lines = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r for r in queries.table(spark, FOLDER, "pages").collect()}
    found = queries.op1_html_extraction(spark, FOLDER).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text) == (pages[r.page_id].url, article_text(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def trees(spark):
    return html_extraction.fit(queries.table(spark, FOLDER, "pages"))


@pytest.fixture(scope="module")
def layouts(spark):
    rows = queries.table(spark, FOLDER, "pages").limit(50).collect()
    return html_extraction.Layouts(html_extraction.sentences([r.html for r in rows]), seed=123)


def test_layouts_that_were_not_learned_from(trees, layouts):
    exact = 0
    for _ in range(150):
        source = layouts.page()
        marked = [t for t in dom.parse(source).texts if layouts.MARK in t]
        want = "\n".join(marked).replace(layouts.MARK, "")
        exact += html_extraction.main_texts([source.replace(layouts.MARK, "")], trees) == [want]
    assert exact >= 0.95 * 150


PROSE = (
    "The house stood in the middle of a field, and nobody knew who had built it. "
    "Some said that a farmer lived there long ago; others were not so sure."
)
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>x</p>";</script></head>
<body><div id="cookie-banner"><p>We use cookies to improve this site. <button>OK</button></p></div>
<header class="site-header"><a href="/">Home</a><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav></header>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/x">Another story</a></li><li><a href="/y">More</a></li></ul></div>
<main><article class="post"><h1>A  house</h1><p>{PROSE}</p>
<div class="advertisement">Buy a house now.</div>
<p>Caf&eacute; &amp; bar &#8212; <b>bold</b>
 words, and more of them on a line.<ul><li>One thing to know.</li><li>Another thing to know.</li></ul>
<blockquote><p>{PROSE}</p></blockquote></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, thank you.</p></div></section></main>
<form action="/s"><label>Subscribe</label><input></form>
<footer><p>&copy; 2024 Example. All rights reserved.</p></footer></body></html>"""


def test_a_page_of_another_make(trees):
    assert html_extraction.main_texts([PAGE], trees)[0].split("\n") == [
        "A house", PROSE, "Café & bar — bold words, and more of them on a line.",
        "One thing to know.", "Another thing to know.", PROSE,
    ]


def test_chosen_elements_lie_in_chosen_ones():
    pick = random.Random(1)
    for _ in range(300):
        n = pick.randint(1, 9)
        page = dom.Page(parents=[-1] + [pick.randrange(i) for i in range(1, n)])
        scores = np.array([pick.choice((-3.0, -1.0, 1.0, 2.0)) for _ in range(n)])
        keep = html_extraction.chosen(page, scores)
        best = -np.inf
        for bits in range(1 << n):
            some = [i == 0 or bool(bits >> i & 1) for i in range(n)]
            if all(some[page.parents[i]] or not some[i] for i in range(1, n)):
                best = max(best, sum(s for s, k in zip(scores, some) if k))
        assert all(keep[page.parents[i]] or not keep[i] for i in range(1, n))
        assert sum(s for s, k in zip(scores, keep) if k) == best


@pytest.mark.parametrize(
    "source, texts",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("a <b>b</b>c<br>d", ["a bc d"]),
        ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<p title='a>b'>x</p><!-- <p>no</p> -->y", ["x", "y"]),
        ("<script>if (a < b) '<p>no</p>'</script>x<style>p{}</style>", ["x"]),
        ("x < y &lt; z &amp;amp; <", ["x < y < z &amp; <"]),
        ("<td>a<td>b", ["a", "b"]),
        ("</p></div>x", ["x"]),
        ("<textarea><p>no</textarea>x<select><option>no</select>", ["x"]),
        ("", []),
        ("<p>&nbsp;\n</p>", []),
        ("<p>open <a href=x", ["open"]),
        # The head ends where something else begins; its tags and the body's may be left out.
        ("<html><head><title>T</title><p>Hello there<p>Second", ["Hello there", "Second"]),
        ("<html><head><meta charset=utf-8><link rel=x><div>content</div></html>", ["content"]),
        ("<html><head><title>T</title>text <b>goes</b> on", ["text goes on"]),
        ("<head><title>T</title><b>bold</b> text", ["bold text"]),
        ("<!doctype html><title>T</title><p>Hello", ["Hello"]),
        ("<head><noscript><p>no</noscript></head><body><p>x", ["x"]),
        # What stands inside a line does not end it, seen or not.
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be", ["Let x=1 be"]),
        ("<p>one <script>no</script>line <svg><title>no</title><text>no</text></svg>here</p>", ["one line here"]),
        ("<p>a <button>no</button> b <math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>", ["a b y"]),
        # Comments, however they end.
        ("<!-->a<p>b", ["a", "b"]),
        ("<!--->a<!-- no --!>b<!-- -- no -->c", ["abc"]),
    ],
)
def test_blocks(source, texts):
    assert dom.parse(source).texts == texts


STORY = "The mill by the river was built long ago and has ground the corn of the valley ever since. "


def a_page(title: str, before: str = "", after: str = "") -> str:
    story = "".join(f"<p>{STORY * n}</p>" for n in (3, 2, 4, 3))
    return f"<html><body>{before}<article>{title}{story}</article>{after}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6)) + "</ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        a_page("<header><h1>Mill title</h1></header>"),
        a_page("<header><h1>Mill title</h1></header>", MENU, "<footer>&copy; The mill</footer>"),
        a_page(f"<header>{MENU}<h1>Mill title</h1></header>"),
        a_page("<h1>Mill title</h1>", "<header><h1><a href=/>The mill times</a></h1></header>" + MENU),
    ],
)
def test_the_title_of_an_article_stays(trees, page):
    (text,) = html_extraction.main_texts([page], trees)
    lines = text.split("\n")
    assert lines[0] == "Mill title"
    assert lines[1:] == [(STORY * n).strip() for n in (3, 2, 4, 3)]


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", "<div>", '<a b="', "</p>", "<li>", "&", "<p>x", "<div></p>"])
def test_long_broken_pages(trees, piece):
    page = dom.parse(piece * 50_000)
    assert len(page.parents) == len(page.ends) == len(page.tags)
    html_extraction.main_texts([piece * 300], trees)


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", PAGE, "x"), (3, "u", PAGE, None), (3, "u", PAGE, None),
            (4, "u", "<p>" + "word " * 200_000, "x"), (5, "u", "plain", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extraction.extracted(pages).collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter((r[0], r[1]) for r in rows)
    assert all(r.text == "" for r in found if r.page_id in (1, 2))
    assert len({r.text for r in found if r.page_id == 3}) == 1
    assert html_extraction.extracted(pages.where("false")).count() == 0


def test_trees_learn_a_rule_of_two_features():
    table = np.random.default_rng(0).random((4000, 5)).astype(np.float32)
    labels = ((table[:, 1] > 0.5) ^ (table[:, 3] > 0.3)).astype(float)
    trees = boosting.fit(table[:3000], labels[:3000], trees=40)
    assert ((trees.scores(table[3000:]) > 0) == labels[3000:]).mean() > 0.95


# Pipeline


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents before the first stage and after each, written and read as Spark does."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, tables[-1], FOLDER).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_columns_of_the_stages(kept):
    assert all(table.columns == kept[0].columns for table in kept[:-1])
    assert {len(texts_of(t)) for t in kept[:-1]} and kept[-1].count() > 0


def test_rejected_documents_go(kept):
    before, after = texts_of(kept[0]), texts_of(kept[1])
    for doc_id, text in before.items():
        counts = brute_counts(text)
        failed = counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]
        symbols = counts["n_symbols"] > 0.1 * counts["n_words"]
        if doc_id in after:
            assert not failed and not symbols
        elif not failed and not symbols:
            words = WORD.findall(text)
            assert len(words) >= 50 and counts["n_dup_lines"] <= 0.5 * counts["n_lines"]


def test_the_largest_id_of_each_text_stays(kept):
    before, after = texts_of(kept[1]), texts_of(kept[2])
    last = {}
    for doc_id in sorted(before):
        last[before[doc_id]] = doc_id
    assert after == {doc_id: text for text, doc_id in last.items()}


def test_one_of_each_near_group_stays(kept):
    before, after = texts_of(kept[2]), texts_of(kept[3])
    found = {i: sets(text) for i, text in before.items()}
    ids = sorted(found)
    holders = {}
    for i in ids:
        for shingle in found[i]:
            holders.setdefault(shingle, []).append(i)
    pairs = Counter((a, b) for held in holders.values() if len(held) > 1 for b in held for a in held if a < b)
    alike = [(a, b) for (a, b), n in pairs.items() if n >= 0.8 * (len(found[a]) + len(found[b]) - n)]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for one, other in alike:
        low, high = sorted((find(one), find(other)))
        root[high] = low
    assert len(alike) > 0
    # The smallest id of each component stays, and nothing else.
    assert set(after) == {i for i in ids if find(i) == i}


def test_the_mixture_is_drawn(spark, kept):
    before, after = texts_of(kept[3]), texts_of(kept[4])
    drawn = queries.mixture(kept[3]).select("row.doc_id", "kept").collect()
    assert set(after) == {r.doc_id for r in drawn if r.kept}
    assert 0 < len(after) < len(before)


def test_all_drawn_documents_are_packed(spark, kept):
    from lexitally.llm import packing

    found = packing.pack(kept[4], queries.TOKENIZER).collect()
    check_packing(found, list(texts_of(kept[4]).items()))
    digest = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(found) == digest(kept[5].collect())
    assert digest(corpus_pipeline.run(spark, FOLDER).collect()) == digest(found)


def test_stages_stand_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r[0], r[1], r[2], r[3], None) for r in odd_rows()]
    docs = spark.createDataFrame(rows, schema)
    ids = Counter(r[0] for r in rows)
    found = {name: Counter(r.doc_id for r in stage(spark, docs, FOLDER).collect()) for name, stage in corpus_pipeline.STAGES[:-1]}
    # All are too short, but for one that repeats itself.
    assert found["quality_rules"] == Counter()
    # Null and empty are equal; a row without an id goes before one with; of a repeated row one stays.
    assert found["exact_dedup"] == Counter([1, 2, 3, 5, 6, 7, 8])
    # Texts without a word are alike; rows that repeat id and text stay together.
    assert found["simhash_near_dedup"] == Counter([0, 3, 4, 4, 4, 6, 7, 8])
    assert all(found["mixing"][i] in (0, n) for i, n in ids.items()) and set(found["mixing"]) <= set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == ids
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0

"""Main text of web pages: boosted trees over the elements, decoded along the page's tree.

Every block element of a page has features: its tag, the tokens of its class, id and role and
those of its ancestors, how much text and how many elements its subtree has, the share of
links, depth, position and siblings. Gradient-boosted trees give the log odds that an element
holds main text. Elements are then chosen together: of all choices in which no chosen element
lies in one that is not, the one with the largest sum of log odds. Blocks of the chosen
elements are the text.

Nobody has labelled the pages, so the trees are fitted to pages that are put together here,
of which it is known what is what: layouts of many kinds, filled with the words of a bounded
sample of the given pages (``SAMPLE`` pages, ``SAMPLE_CHARS`` characters of each).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitally.llm import boosting
from lexitally.llm.dom import Page, parse

SAMPLE = 100
SAMPLE_CHARS = 20_000
# Pages put together for the fit, and the seed of the generator.
PAGES = 600
SEED = 7
# Characters of pages whose elements are scored together.
BATCH = 4 << 20

# Tokens of class, id and role, by what they say of an element.
HINTS = {
    "content": "article post entry content story text body main page blog news prose copy doc document",
    "title": "title headline heading",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav subnav tabs pagination pager toc skip",
    "header": "header masthead banner topbar logo branding toolbar",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more complementary secondary",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay dialog announcement privacy warning disclaimer",
    "comment": "comment comments reply replies respond disqus discussion commentlist reader feedback",
    "form": "form login signup register subscribe subscription newsletter search searchbox contact",
    "share": "share sharing social tools follow like tweet print",
    "meta": "meta byline author date time tags tag category published posted",
}
HINTS = {kind: frozenset(words.split()) for kind, words in HINTS.items()}
KINDS = list(HINTS)
BAD = [KINDS.index(kind) for kind in KINDS if kind not in ("content", "title", "meta")]
TAGS = (
    "article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td "
    "blockquote pre figure figcaption dl dd fieldset body html address details dialog"
).split()
BAD_TAGS = "nav header footer aside form dialog".split()
TAG_CODES = {tag: i for i, tag in enumerate(TAGS)}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)")
_CAMEL = re.compile(r"[^a-z]+")


@lru_cache(maxsize=100_000)
def hints(attributes: str) -> tuple[int, ...]:
    """For each kind, whether the attributes (in small letters) have a token of it."""
    values = " ".join(value for _, value in _ATTRIBUTE.findall(attributes))
    tokens = set(_CAMEL.split(values))
    return tuple(int(bool(words & tokens)) for words in HINTS.values())


def table(pages: list[Page]) -> np.ndarray:
    """One row of features per element, of all pages one after the other."""
    sizes = np.array([len(page.tags) for page in pages])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum())
    base = np.repeat(first, sizes)
    top = np.arange(n) == base
    parent = np.fromiter((x for page in pages for x in page.parents), np.int64, n)
    parent = np.where(top, np.arange(n), parent + base)
    end = np.fromiter((x for page in pages for x in page.ends), np.int64, n) + base
    tag = np.fromiter(
        (TAG_CODES.get(x, len(TAGS)) for page in pages for x in page.tags), np.int64, n
    )
    hint = np.array([hints(x) for page in pages for x in page.attributes], dtype=np.int8)

    blocks = sum(len(page.texts) for page in pages)
    owner = np.fromiter(
        (x + f for page, f in zip(pages, first) for x in page.owners), np.int64, blocks
    )
    facts = np.array(
        [
            (len(text), linked, text.count(" ") + 1, text.count(". ") + text.count(", ")
             + (text[-1] in ".!?:;\""), text[-1] in ".!?")
            for page in pages for text, linked in zip(page.texts, page.linked)
        ],
        dtype=np.float64,
    ).reshape(blocks, 5)
    own = np.zeros((n, 5))
    np.add.at(own, owner, facts)
    counts = np.column_stack([own, np.bincount(owner, minlength=n), np.ones(n)])
    sums = np.vstack([np.zeros(counts.shape[1]), np.cumsum(counts, axis=0)])
    inside = sums[end] - sums[np.arange(n)]
    before = sums[np.arange(n)] - sums[base]
    whole = inside[base]

    depth = np.zeros(n)
    above = np.zeros((n, len(KINDS)), dtype=np.int8)
    over = np.zeros((n, len(TAGS) + 1), dtype=np.int8)
    # Level by level: parents are known when their children are reached.
    level = np.flatnonzero(top)
    children = np.argsort(parent, kind="stable")
    children = children[~top[children]]
    starts = np.searchsorted(parent[children], np.arange(n), side="left")
    stops = np.searchsorted(parent[children], np.arange(n), side="right")
    number = np.zeros(n)
    number[children] = np.arange(len(children)) - starts[parent[children]]
    of = np.where(top, 1, stops[parent] - starts[parent])
    codes = np.eye(len(TAGS) + 1, dtype=np.int8)
    while len(level):
        spans = stops[level] - starts[level]
        within = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        level = children[np.repeat(starts[level], spans) + within]
        up = parent[level]
        depth[level] = depth[up] + 1
        above[level] = above[up] | hint[up]
        over[level] = over[up] | codes[tag[up]]

    chars, links, words, marks, closed, texts, elements = inside.T
    share = lambda a, b: a / np.maximum(b, 1)
    log = np.log1p
    place = (starts[parent] + number).astype(np.int64)
    sides = np.concatenate([[-1], children, [-1]])
    previous = np.where(~top & (number > 0), sides[np.where(top, 0, place)], -1)
    following = np.where(~top & (number + 1 < of), sides[np.where(top, 0, place + 2)], -1)
    near = lambda values, at: np.where(at >= 0, values[at], -1)
    bad_tags = [TAG_CODES[t] for t in BAD_TAGS]
    bad = codes[tag][:, bad_tags].any(axis=1) | hint[:, BAD].any(axis=1)
    under_bad = over[:, bad_tags].any(axis=1) | above[:, BAD].any(axis=1)
    good_tags = [TAG_CODES["article"], TAG_CODES["main"]]
    in_good = over[:, good_tags].any(axis=1) | (above[:, 0] > 0)
    picked = [TAG_CODES[t] for t in "article main nav header footer aside form table li blockquote".split()]
    return np.column_stack(
        [
            tag == TAG_CODES["p"], (tag >= TAG_CODES["h1"]) & (tag <= TAG_CODES["h4"]),
            *[tag == TAG_CODES[t] for t in (
                "article main section div ul ol li nav header footer aside form table blockquote "
                "pre figure figcaption body html dialog"
            ).split()],
            over[:, picked], hint, above,
            bad, under_bad, bad | under_bad, in_good,
            depth, number, share(number, of - 1), of,
            log(chars), log(own[:, 0]), log(words), log(texts), log(elements),
            share(chars, elements), share(chars, texts), share(links, chars), share(marks, words),
            share(chars, words), share(closed, texts), share(own[:, 1], own[:, 0]),
            share(chars, whole[:, 0]), share(before[:, 0], whole[:, 0]),
            share(chars, inside[parent, 0]), share(links, chars)[parent],
            log(near(chars, previous).clip(0)), log(near(chars, following).clip(0)),
            near(share(links, chars), previous), near(share(links, chars), following),
            near(tag == tag[previous], previous), near(tag == tag[following], following),
            log(inside[parent, 0]), share(marks, words)[parent], share(closed, texts)[parent],
        ]
    ).astype(np.float32)


def chosen(page: Page, scores: np.ndarray) -> list[bool]:
    """The best choice of elements in which the parent of every chosen one is chosen."""
    sums = scores.tolist()
    parents = page.parents
    # Children stand behind their parents.
    for i in range(len(sums) - 1, 0, -1):
        if sums[i] > 0:
            sums[parents[i]] += sums[i]
    keep = [True] * len(sums)
    for i in range(1, len(sums)):
        keep[i] = sums[i] > 0 and keep[parents[i]]
    return keep


def main_texts(sources: list[str], trees: boosting.Trees) -> list[str]:
    pages = [parse(source) for source in sources]
    scores = trees.scores(table(pages)) if pages else np.zeros(0)
    found, at = [], 0
    for page in pages:
        keep = chosen(page, scores[at : at + len(page.tags)])
        at += len(page.tags)
        found.append("\n".join(t for o, t in zip(page.owners, page.texts) if keep[o]))
    return found


class Layouts:
    """Makes pages of which the main text is known: it is marked with ``MARK``."""

    MARK = "\ue000"

    def __init__(self, sentences: list[str], seed: int = SEED) -> None:
        self.random = random.Random(seed)
        self.sentences = sentences

    def chance(self, share: float) -> bool:
        return self.random.random() < share

    def some(self, low: int, high: int) -> range:
        return range(self.random.randint(low, high))

    def sentence(self) -> str:
        return self.random.choice(self.sentences)

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in self.some(low, high))

    def phrase(self, high: int = 5) -> str:
        words = self.sentence().strip(".").split()
        return " ".join(words[: self.random.randint(1, high)]) or "a"

    def link(self, high: int = 4) -> str:
        return f'<a href="/{self.random.randint(1, 999)}">{self.phrase(high)}</a>'

    def named(self, kinds: str, tags: str, plain: float = 0.15) -> tuple[str, str]:
        """An opening and closing tag whose class or id has a token of one of the kinds."""
        tag = self.random.choice(tags.split())
        if self.chance(plain):
            return f"<{tag}>", f"</{tag}>"
        word = self.random.choice(sorted(HINTS[self.random.choice(kinds.split())]))
        form = self.random.choice(("{0}", "{0}", "site-{0}", "{0}-wrap", "{0}-box", "js-{0} block", "c_{0}", "{0} clearfix", "{0}1"))
        key = self.random.choice(("class", "class", "class", "id", "role"))
        return f'<{tag} {key}="{form.format(word)}">', f"</{tag}>"

    def main(self, text: str) -> str:
        return self.MARK + text

    def paragraph(self) -> str:
        text = self.prose(1, 8) if self.chance(0.85) else self.sentence()
        if self.chance(0.15):
            text = text.replace(" ", f" {self.link(3)} ", 1)
        if self.chance(0.15):
            return f"<p><b>{self.main(text)}<br>"
        if self.chance(0.1):
            text = f"<em>{text}</em>"
        extra = ' class="lead"' if self.chance(0.1) else ""
        return f"<p{extra}>{self.main(text)}" + ("</p>" if self.chance(0.9) else "")

    def piece(self) -> str:
        r = self.random.random()
        if r < 0.72:
            return self.paragraph()
        if r < 0.80:
            level = self.random.choice("234")
            return f"<h{level}>{self.main(self.phrase(9))}</h{level}>"
        if r < 0.87:
            tag = self.random.choice(("ul", "ol"))
            rows = "".join(f"<li>{self.main(self.prose(1, 2))}</li>" for _ in self.some(2, 6))
            return f"<{tag}>{rows}</{tag}>"
        if r < 0.91:
            return f"<blockquote><p>{self.main(self.prose(1, 3))}</p></blockquote>"
        if r < 0.93:
            return f"<pre>{self.main(self.prose(1, 3))}</pre>"
        if r < 0.96:
            rows = "".join(
                "<tr>" + "".join(f"<td>{self.main(self.phrase(4))}</td>" for _ in range(3)) + "</tr>"
                for _ in self.some(2, 5)
            )
            return f"<table>{rows}</table>"
        if r < 0.98:
            return f"<figure><img src=x.png><figcaption>{self.main(self.sentence())}</figcaption></figure>"
        return f"<div>{self.main(self.prose(1, 4))}</div>"

    def links(self, kinds: str, tags: str, plain: float = 0.15) -> str:
        begin, end = self.named(kinds, tags, plain)
        rows = "".join(f"<li>{self.link()}</li>" for _ in self.some(2, 10))
        if self.chance(0.25):
            return begin + " ".join(self.link() for _ in self.some(2, 8)) + end
        head = f"<h3>{self.phrase(3)}</h3>" if self.chance(0.4) else ""
        return f"{begin}{head}<ul>{rows}</ul>{end}"

    def menu(self) -> str:
        return self.links("menu", "nav nav div ul")

    def header(self) -> str:
        begin, end = self.named("header", "header header div", 0.3)
        if begin == "<div>":
            begin, end = "<header>", "</header>"
        parts = [f"<h1>{self.link(3)}</h1>", f"<p>{self.phrase(6)}</p>", self.menu(), self.form()]
        if self.chance(0.3):
            parts.append(f"<p>{self.sentence()}</p>")
        self.random.shuffle(parts)
        return begin + "".join(parts[: self.random.randint(1, 4)]) + end

    def footer(self) -> str:
        begin, end = self.named("footer", "footer footer div", 0.3)
        if begin == "<div>":
            begin, end = "<footer>", "</footer>"
        text = f"&copy; {self.phrase(3)} &middot; {self.sentence() if self.chance(0.6) else self.phrase(5)}"
        if self.chance(0.4):
            text = f"<p>{text}</p>"
        return begin + text + (self.links("footer menu", "div ul") if self.chance(0.4) else "") + end

    def side(self) -> str:
        begin, end = self.named("side", "aside aside div section", 0.2)
        if begin in ("<div>", "<section>"):
            begin, end = "<aside>", "</aside>"
        parts = []
        for _ in self.some(1, 3):
            parts.append(
                self.random.choice((
                    lambda: f"<h3>{self.phrase(3)}</h3><p>{self.prose(1, 3)}</p>",
                    lambda: self.links("side menu", "div section ul"),
                    lambda: f"<p>{self.prose(1, 4)}</p>",
                    lambda: self.prose(1, 2),
                ))()
            )
        return begin + "".join(parts) + end

    def advert(self) -> str:
        begin, end = self.named("advert", "div div aside section p", 0.0)
        text = self.prose(1, 4) if self.chance(0.7) else self.link()
        return begin + (text if self.chance(0.6) or "<p" in begin else f"<p>{text}</p>") + end

    def notice(self) -> str:
        begin, end = self.named("notice", "div div section dialog", 0.0)
        button = "<button>OK</button>" if self.chance(0.5) else self.link(2)
        text = self.prose(1, 3)
        return begin + (f"<p>{text}</p>" if self.chance(0.6) else text) + button + end

    def form(self) -> str:
        begin, end = self.named("form", "form form div", 0.4)
        if begin == "<div>":
            begin, end = "<form>", "</form>"
        label = f"<label>{self.phrase(3)}</label>" if self.chance(0.7) else f"<p>{self.sentence()}</p>"
        return f'{begin}{label}<input type="text"><button>{self.phrase(2)}</button>{end}'

    def comments(self) -> str:
        begin, end = self.named("comment", "section div div ol", 0.0)
        rows = []
        for _ in self.some(1, 6):
            one, other = self.named("comment", "div li article", 0.3)
            who = f"<b>{self.phrase(2)}</b>" if self.chance(0.5) else f"<p>{self.phrase(2)}</p>"
            rows.append(f"{one}{who}<p>{self.prose(1, 4)}</p>{other}")
        head = f"<h2>{self.phrase(2)}</h2>" if self.chance(0.6) else ""
        return begin + head + "".join(rows) + (self.form() if self.chance(0.4) else "") + end

    def share(self) -> str:
        return self.links("share", "div ul p", 0.0)

    def article(self) -> str:
        parts = [self.piece() for _ in self.some(1, 3 if self.chance(0.3) else 12)]
        for make, share in (
            (self.advert, 0.2), (self.side, 0.12), (self.share, 0.12), (self.notice, 0.06),
            (self.form, 0.1), (self.comments, 0.1), (self.menu, 0.06),
        ):
            if self.chance(share):
                parts.insert(self.random.randint(0, len(parts)), make())
        title = f"<h1>{self.main(self.phrase(12))}</h1>" if self.chance(0.8) else ""
        if title and self.chance(0.3):
            title = self.title_header(title)
        return title + "".join(parts)

    def title_header(self, title: str) -> str:
        """The header of an article, which unlike a page's holds its title."""
        begin = self.random.choice(("<header>", "<header>", '<header class="entry-header">', '<div class="title">'))
        around = [f"<p>{self.phrase(5)}</p>"] * self.chance(0.3) + [self.menu()] * self.chance(0.25)
        parts = [title, *around]
        self.random.shuffle(parts)
        return begin + "".join(parts) + ("</div>" if begin.startswith("<div") else "</header>")

    def page(self) -> str:
        body = self.article()
        r = self.random.random()
        if r < 0.4:
            begin, end = self.named("content", "article", 0.6)
        elif r < 0.55:
            begin, end = self.named("content", "main", 0.6)
        elif r < 0.9:
            begin, end = self.named("content", "div section", 0.1)
        else:
            begin = end = ""
        body = begin + body + end
        for _ in self.some(0, 2):
            one, other = self.named("content", "div main section", 0.6)
            after = self.comments() if self.chance(0.15) else ""
            body = one + body + after + other
        front, back = [], []
        for make, share, place in (
            (self.notice, 0.25, front), (self.header, 0.5, front), (self.menu, 0.65, front),
            (self.advert, 0.35, front), (self.form, 0.1, front), (self.side, 0.2, front),
            (self.side, 0.35, back), (self.comments, 0.3, back), (self.advert, 0.25, back),
            (self.menu, 0.15, back), (self.form, 0.15, back), (self.share, 0.1, back),
            (self.footer, 0.75, back), (self.notice, 0.15, back),
        ):
            if self.chance(share):
                place.append(make())
        head = f"<head><title>{self.phrase(8)}</title><style>p{{margin:0}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(front)}{body}{''.join(back)}</body></html>"


def labelled(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements that hold text; marked text is main."""
    pages = [parse(source) for source in sources]
    labels = []
    for page in pages:
        main = np.zeros(len(page.tags) + 1)
        texts = np.zeros(len(page.tags) + 1)
        for owner, text in zip(page.owners, page.texts):
            main[owner + 1] += Layouts.MARK in text
            texts[owner + 1] += 1
        ends = np.array(page.ends)
        main, texts = np.cumsum(main), np.cumsum(texts)
        at = np.arange(len(page.tags))
        has_text = texts[ends] > texts[at]
        labels.append(np.where(has_text, (main[ends] > main[at]).astype(float), np.nan))
        page.texts = [text.replace(Layouts.MARK, "") or "a" for text in page.texts]
    found = np.concatenate(labels)
    known = ~np.isnan(found)
    return table(pages)[known], found[known]


def sentences(sources: list[str]) -> list[str]:
    found = []
    for source in sources:
        for text in parse(source).texts:
            found += [part.strip(" .") + "." for part in text.split(". ") if 2 < len(part) < 300]
    return sorted(set(found))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> boosting.Trees | None:
    """Trees fitted to layouts with words of a sample of the pages; none if they have no text."""
    order = F.xxhash64(F.lit("html"), F.col(id_col).cast("string"))
    filled = pages.where(F.col(html_col).isNotNull())
    # Places first, as every task sends as many rows as are wanted; then only their pages.
    places = filled.select(order.alias("place")).orderBy("place").limit(SAMPLE).collect()
    chosen = filled.where(order.isin([row["place"] for row in places])) if places else filled.limit(0)
    rows = chosen.groupBy(order.alias("place")).agg(
        F.min(F.substring(html_col, 1, SAMPLE_CHARS)).alias("source")
    ).orderBy("place").collect()
    found = sentences([row["source"] for row in rows])
    if not found:
        return None
    layouts = Layouts(found)
    return boosting.fit(*labelled([layouts.page() for _ in range(PAGES)]))


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text`` of every row, repeated ones too.

    A null page, or one without main text, has an empty text. Blocks stand in page order,
    one to a line; white space inside a block (a ``br`` too) is one blank. An empty table
    gives no rows. Other columns are not read.
    """
    trees = fit(pages, id_col, html_col)
    named = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    schema = T.StructType(
        [named.schema["page_id"], named.schema["url"], T.StructField("text", T.StringType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            held: list[str] = []
            size = 0
            for source in batch.column("html").to_pylist():
                held.append(source)
                size += len(source)
                if size > BATCH:
                    found += main_texts(held, trees) if trees else [""] * len(held)
                    held, size = [], 0
            found += main_texts(held, trees) if trees else [""] * len(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())],
                names=schema.names,
            )

    return named.mapInArrow(work, schema)

"""A page as a forest of block elements, with the runs of text between their borders."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements that hold no text of the page. But for the head they may stand inside a line of text,
# which goes on behind them.
SILENT = frozenset(
    "head title script style template noscript iframe object svg annotation annotation-xml "
    "select textarea button datalist audio video canvas".split()
)
# What may stand in the head; anything else ends it.
IN_HEAD = frozenset(
    "head base basefont bgsound link meta title noscript script style template noframes".split()
)
# Of these the content is not markup.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
# Elements that stand inside a line of text. All others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map "
    "mark meter nobr output picture progress q ruby rp rt s samp small source span strike "
    "strong sub sup time tt u var wbr input math mi mn mo ms mtext mspace mrow mfrac msqrt mroot "
    "msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle merror "
    "mpadded mphantom menclose semantics".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements that a start tag of the second kind closes, up to the nearest of the third.
CLOSED_BY = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
CLOSED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSED_BY.items()}
# Block elements that may stand in a paragraph's place but not in it.
NO_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
    "section table ul li dt dd".split()
)

TOKEN = re.compile(
    r"<!--(?:-?>|(?:(?!--!?>).)*+(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|))*+)(?:>|\Z)",
    re.DOTALL,
)


@dataclass
class Page:
    """Elements in page order, each with its parent (-1: none) and the end of its subtree."""

    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    # Blocks in page order: the element that each stands in, its text, characters in links.
    owners: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE)


_RAW_ENDS = {name: _raw_end(name) for name in RAW}


def parse(source: str) -> Page:
    """The page of some HTML, however broken, in time linear in its length."""
    page = Page()
    # The first element stands for the page itself.
    page.tags.append("")
    page.attributes.append("")
    page.parents.append(-1)
    page.ends.append(0)
    # Open block elements, innermost last.
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter[str] = Counter()
    line: list[str] = []
    links = silent = linked = 0

    def block() -> None:
        nonlocal linked
        if line:
            if text := " ".join("".join(line).split()):
                page.owners.append(stack[-1][1])
                page.texts.append(text)
                page.linked.append(linked)
            line.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal silent
        for name, node in stack[depth:]:
            page.ends[node] = len(page.tags)
            silent -= name in SILENT
            opened[name] -= 1
        del stack[depth:]

    def end_head() -> None:
        if stack[-1][0] == "head":
            close(len(stack) - 1)

    def words(text: str) -> None:
        nonlocal linked
        if text and not text.isspace():
            end_head()
        if not silent and text:
            text = html.unescape(text) if "&" in text else text
            line.append(text)
            if links:
                linked += len(text)

    at, size = 0, len(source)
    while at < size:
        begin = source.find("<", at)
        if begin < 0:
            begin = size
        words(source[at:begin])
        if begin == size:
            break
        match = TOKEN.match(source, begin)
        if match is None:
            words("<")
            at = begin + 1
            continue
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name in INLINE:
                if name == "a":
                    links = 0
                continue
            for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    if name not in SILENT and not silent:
                        block()
                        links = 0
                    close(depth)
                    break
            continue
        if name not in IN_HEAD:
            end_head()
        if name in INLINE:
            if name == "br":
                line.append(" ")
            elif name == "a":
                links = 1
            continue
        if name not in SILENT and not silent:
            block()
        # Elements that this one closes.
        if name in NO_PARAGRAPH and stack[-1][0] == "p":
            close(len(stack) - 1)
        rule = CLOSED_BY.get(name)
        if rule and any(opened[other] for other in rule[0]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in rule[1]:
                    break
                if stack[depth][0] in rule[0]:
                    close(depth)
        page.tags.append(name)
        page.attributes.append(match["attributes"].strip().lower())
        page.parents.append(stack[-1][1])
        page.ends.append(len(page.tags))
        if name in VOID:
            continue
        stack.append((name, len(page.tags) - 1))
        opened[name] += 1
        silent += name in SILENT
        if name in RAW:
            end = _RAW_ENDS[name].search(source, at)
            stop = end.start() if end else size
            if name not in SILENT and not silent:
                words(source[at:stop])
            at = stop
    block()
    close(0)
    return page

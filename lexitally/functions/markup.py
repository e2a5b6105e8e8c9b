"""Product descriptions out of HTML pages and XML item documents.

Patterns are linear in the page, and loops over tags and attributes are possessive, which Java
runs without recursion. Quoted values belong to a tag whatever they hold, and an unclosed
comment, script or tag takes the rest of the page, as it does in a browser.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitally.functions.once import let

# Elements whose start ends an open paragraph (HTML standard, 4.4.1).
PARAGRAPH_ENDERS = (
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre search section table ul li dd dt"
).split()
# What may stand in a tag after its name; unrolled, so that matching it does not recurse for
# every character. Then the pieces of a page: tags, text, and signs that begin no tag.
INSIDE = r"""[^"'<>]*+(?:"[^"]*+"[^"'<>]*+|'[^']*+'[^"'<>]*+)*+"""
PIECE = rf"<[a-zA-Z/!?]{INSIDE}>|[^<]++|<"
# The attributes of a tag up to the first that is named ``id``, one after the other: a name with
# its value, if it has one, or a sign that belongs to no attribute.
ATTRIBUTE = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?+"""
BEFORE_ID = rf"""(?:[\s/=]++|(?!(?i:id)[\s"'<>/=]){ATTRIBUTE}|"[^"]*+"|'[^']*+')*+"""
# The pieces of an XML document; what is not closed takes the rest of it.
XML_PIECE = (
    r"(?s)<!\[CDATA\[(?:.*?\]\]>|.*+)|<!--(?:.*?-->|.*+)|<\?(?:.*?\?>|.*+)"
    rf"|<[/!]?[A-Za-z_:]{INSIDE}>|[^<]++|<"
)
# The named entities of the HTML standard that end in a semicolon.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# Id of the element that holds a page's description, and, in an item document,
# the label of the description and the list of reviews that it is in.
DESCRIPTION_ID = "productDescription"
REVIEW_LABEL = "Product Description"
REVIEW_LIST = "EditorialReviews"


def _without_raw_text(html: Column) -> Column:
    """The page without comments, scripts, styles and text fields."""
    raw = "|".join(f"<{t}\\b(?:.*?</{t}\\s*+>|.*+)" for t in ("script", "style", "textarea"))
    return F.regexp_replace(html, rf"(?is)<!--(?:.*?-->|.*+)|{raw}", "")


def _kept_length(pieces: Column, tag: Column) -> Column:
    """Length of the pieces up to the end of the element they begin in.

    Pieces count while more elements of that name were opened than closed.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def step(acc: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z][^\s/>]*+)", 1))
        opens = name == tag
        closes = name == F.concat(F.lit("/"), tag)
        change = F.when(closes, -1).when(opens, 1).otherwise(0)
        depth = F.when(acc.depth > 0, acc.depth + change).otherwise(0)
        kept = acc.kept + F.when(depth > 0, F.length(piece)).otherwise(0)
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    return F.aggregate(pieces, start, step, lambda acc: acc.kept)


def _element_body(found: Column) -> Column:
    """Of ``struct(tag, rest)``, the rest up to the end of the element; NULL if no tag."""
    tag, rest = found["tag"], found["rest"]
    pieces = F.regexp_extract_all(rest, F.lit(PIECE), F.lit(0))
    body = F.substring(rest, F.lit(1), _kept_length(pieces, tag))
    return F.when(tag != "", body)


def _resolve_entities(text: Column) -> Column:
    """Numeric and named entities as the characters they stand for, each once."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def character(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.regexp_extract(name, "^#[xX]?0*+([0-9a-fA-F]*+)$", 1)
        # More digits than these are no character; leading zeros do not count.
        fits = F.length(digits).between(1, 7)
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        # Code points are written as four bytes; halves of pairs are none.
        valid = fits & (code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        numeric = F.when(valid, char)
        return F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(names, name))

    def resolved(piece: Column, at: Column) -> Column:
        pattern = "^(#(?:[0-9]++|[xX][0-9a-fA-F]++)|[A-Za-z][A-Za-z0-9]*+);"
        name = F.regexp_extract(piece, pattern, 1)
        rest = F.substr(piece, F.length(name) + 2)
        char = F.when(name != "", character(name))
        return (
            F.when(at == 0, piece)
            .when(char.isNotNull(), F.concat(char, rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def pieces(t: Column) -> Column:
        joined = F.array_join(F.transform(F.split(t, "&"), resolved), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, pieces)


def _paragraph_text(body: Column) -> Column:
    """Text of the first paragraph; NULL if the body has none."""
    # The start of the paragraph is kept to tell an empty paragraph from none.
    start = F.regexp_extract(body, rf"(?is)(<p(?:\s{INSIDE})?>.*)", 1)
    enders = "|".join(PARAGRAPH_ENDERS)

    def text_of(paragraph: Column) -> Column:
        inner = F.regexp_replace(paragraph, f"^<{INSIDE}>", "")
        text = F.split(inner, rf"(?i)</p\s*>|<(?:{enders})(?=[\s/>])", 2)[0]
        text = F.regexp_replace(text, rf"(?i)<br(?=[\s/>]){INSIDE}>", " ")
        text = F.regexp_replace(text, f"<[a-zA-Z/!?]{INSIDE}>", "")
        text = _resolve_entities(text)
        return F.when(paragraph != "", F.trim(F.regexp_replace(text, r"\s+", " ")))

    return let(start, text_of)


def first_paragraph(
    html: Column, element_id: str | None = DESCRIPTION_ID, element: str = r"[a-z][a-z0-9]*"
) -> Column:
    """Text of the first ``p`` inside the element with that id; NULL if there is none.

    With ``element_id=None`` the scope is the first element named ``element``.
    """
    if element_id is None:
        opening = rf"(?is)<({element})(?=[\s>]){INSIDE}>(.*)"
    else:
        # The name of the attribute may be written in any case, its value not.
        name = re.escape(element_id)
        value = rf"""(?:"{name}"|'{name}'|{name}(?=[\s>]))"""
        opening = rf"(?s)<((?i:{element}))(?=[\s/]){BEFORE_ID}(?i:id)\s*+=\s*+{value}{INSIDE}>(.*)"

    def open_element(page: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(page, opening, 1)).alias("tag"),
            F.regexp_extract(page, opening, 2).alias("rest"),
        )

    found = let(_without_raw_text(html), open_element)
    return _paragraph_text(let(found, _element_body))


# Where a walk through the pieces is: before the list, in it, past its end, or past an error.
BEFORE, INSIDE_LIST, AFTER, BROKEN = 0, 1, 2, 3


# What is known after some pieces, with its first value: the index of the next piece, the stage,
# the depth in the list, the names of the open review and its child, how many children there
# were, the text of the first one and if it is the label, if the present one has text and where
# it began, and the found text's first piece and the piece after it.
KNOWN = {
    "i": 0, "stage": BEFORE, "depth": 0, "review": "", "child": "", "children": 0, "first": "",
    "labelled": False, "filled": False, "from": 0, "begin": -1, "end": -1,
}


def _review_place(pieces: Column, label: str) -> Column:
    """Index of the first piece of the review's text and of the piece after it, as
    ``begin, end``; both are -1 if there is no such review."""

    def step(acc: Column, piece: Column) -> Column:
        # Named once: every mention of a field is a call to the JVM while the plan is made.
        now = {name: acc[name] for name in KNOWN}
        same = {name: value.alias(name) for name, value in now.items()}
        same["i"] = (now["i"] + 1).alias("i")

        def with_(**new: Column) -> Column:
            changed = {name.rstrip("_"): value for name, value in new.items()}
            changed = {name: value.alias(name) for name, value in changed.items()}
            return F.struct(*(same | changed).values())

        depth, children, stage = now["depth"], now["children"], now["stage"]
        inside, higher, going = stage == INSIDE_LIST, with_(depth=depth - 1), with_()
        broken = with_(stage=F.lit(BROKEN))

        def after_text() -> Column:
            # No more of the first child's text is kept than tells it from the label.
            grows = (children == 1) & (F.length(now["first"]) <= len(label))
            text = _plain_text(piece)
            first = F.when(grows, F.concat(now["first"], text)).otherwise(now["first"])
            return with_(first=first, filled=(children == 2) & (now["filled"] | (text != "")))

        def after_start(name: Column, empty: Column) -> Column:
            deeper = depth + F.when(empty, 0).otherwise(1)
            child = with_(
                depth=deeper, child=name, children=children + 1, filled=F.lit(False), from_=now["i"] + 1
            )
            review = with_(
                depth=deeper, review=name, children=F.lit(0), first=F.lit(""), labelled=F.lit(False)
            )
            return F.when(depth == 1, child).when(depth == 0, review).otherwise(with_(depth=deeper))

        def after_end(name: Column) -> Column:
            opened = F.when(depth == 0, REVIEW_LIST).when(depth == 1, now["review"])
            opened = opened.when(depth == 2, now["child"]).otherwise(name)
            found = (children == 2) & now["labelled"] & now["filled"] & (now["begin"] < 0)
            first = with_(depth=depth - 1, labelled=now["first"] == label)
            second = with_(depth=depth - 1, begin=now["from"], end=now["i"])
            return (
                F.when(opened != name, broken)
                .when(depth == 0, with_(stage=F.lit(AFTER)))
                .when((depth == 2) & (children == 1), first)
                .when((depth == 2) & found, second)
                .otherwise(higher)
            )

        def after_tag(name: Column) -> Column:
            empty, ends = F.endswith(piece, F.lit("/>")), F.startswith(piece, F.lit("</"))
            opened = with_(stage=F.when(empty, AFTER).otherwise(INSIDE_LIST))
            return (
                F.when(inside & ends, after_end(name))
                .when(inside, after_start(name, empty))
                .when(~ends & (name == REVIEW_LIST), opened)
                .otherwise(going)
            )

        name = F.regexp_extract(piece, r"^</?([A-Za-z_:][^\s/>]*+)", 1)
        return (
            F.when(stage > INSIDE_LIST, acc)
            .when(inside & (piece == "<"), broken)
            .when(F.rlike(piece, F.lit("^<[^!?]")), let(name, after_tag))
            .when(depth >= 2, after_text())
            .otherwise(going)
        )

    def place(acc: Column) -> Column:
        whole = acc["stage"] == AFTER
        return F.struct(*[F.when(whole, acc[name]).otherwise(-1).alias(name) for name in ("begin", "end")])

    start = F.struct(*[F.lit(value).alias(name) for name, value in KNOWN.items()])
    return F.aggregate(pieces, start, step, place)


def _plain_text(piece: Column) -> Column:
    """The characters of a piece of a document, empty for tags and comments."""
    cdata = F.startswith(piece, F.lit("<![CDATA["))
    inner = F.when(cdata, F.substr(piece, F.lit(10), F.length(piece) - 12))
    return inner.when(F.startswith(piece, F.lit("<")), "").otherwise(piece)


def _xml_text(piece: Column) -> Column:
    """The text that a piece of a document stands for."""
    text = F.regexp_replace(_plain_text(piece), "\r\n?", "\n")
    resolves = F.contains(piece, F.lit("&")) & ~F.startswith(piece, F.lit("<"))
    return F.when(resolves, _resolve_entities(text)).otherwise(text)


def editorial_review(xml: Column, label: str = REVIEW_LABEL) -> Column:
    """The review with the given label in the first review list of an item document.

    Of a review's children the first is its label and the second its text, whatever they are
    named; white space and comments between them do not count. The first review whose label
    fits, without entities, and whose text is not empty is taken, with tags and comments in it left out, its
    entities resolved and its CDATA as it stands.

    The document is gone through once, piece by piece, so comments and CDATA may hold anything.
    Only the list must be well formed (its tags, those of its reviews and of their children),
    whatever stands before or after it. NULL if there is no such review, or the list is broken.
    """

    def text_of(pieces: Column) -> Column:
        def inside(place: Column) -> Column:
            kept = F.slice(pieces, place["begin"] + 1, place["end"] - place["begin"])
            text = F.array_join(F.transform(kept, _xml_text), "")
            return F.when(place["begin"] >= 0, text)

        return let(_review_place(pieces, label), inside)

    found = F.when(F.contains(xml, F.lit(f"<{REVIEW_LIST}")), xml)
    return let(F.regexp_extract_all(found, F.lit(XML_PIECE), F.lit(0)), text_of)

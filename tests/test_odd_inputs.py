"""Requests without times, times without a zone, and pages and documents of odd make."""

import itertools
import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from lexitally.functions import markup
from lexitally.operators import keyset, requests
from pyspark.sql import functions as F

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]
# The hour that clocks leave out in New York lies in between.
TIMES = [None] + [datetime(2024, 3, 10, 1, 30) + timedelta(minutes=30 * i) for i in range(5)]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def order_of(row, *place):
    return [(row[i] is not None, row[i] if row[i] is not None else 0) for i in place]


def minutes(at):
    return None if at is None else (at - datetime(2024, 1, 1)).total_seconds()


KEYED = [
    (key, at, number, f"v{n}")
    for n, (key, at, number) in enumerate(itertools.product("abcdefgh", TIMES, [None, -(2**63), -1, 0, 2**63 - 1]))
]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_first_wins_with_nulls(spark, zone, kind):
    random.seed(4)
    rows = [row for row in KEYED if random.random() < 0.25] + [("z", None, None, "only")]
    if kind == "timestamp":
        # A time with a zone cannot be in the gap of a clock.
        rows = [row for row in rows if row[1] is None or row[1].hour != 2]
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    frame = spark.createDataFrame(rows, "k string, at timestamp_ntz, id bigint, v string")
    frame = frame.withColumn("ts", F.col("at").cast(kind)).repartition(3)
    want, last = {}, {}
    for key, own in groups.items():
        least = min(own, key=lambda row: order_of((minutes(row[1]), row[2]), 0, 1))
        most = max(own, key=lambda row: order_of((minutes(row[1]), row[2]), 0, 1))
        want[key], last[key] = (key, least[1], least[2], len(own)), (key, most[3])
    found = keyset.first_wins(frame, "k", ["ts", "id"])
    assert "HashAggregate" in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()} == set(want.values())
    full = keyset.first_wins(frame, "k", ["ts", "id"], ["v"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(r.k, r.ts, r.id, r.n) for r in full.collect()} == set(want.values())
    assert full.count() == len(groups)
    assert {tuple(r) for r in keyset.put_overwrite(frame, "k", "v", ["ts", "id"]).collect()} == set(last.values())


@pytest.mark.parametrize("kind", ["date", "int", "timestamp_ntz"])
def test_first_wins_by_one_column(spark, kind):
    rows = [("a", None), ("a", 5), ("b", 7), ("b", -3), ("c", None)]
    at = {"date": F.date_add(F.lit("1970-01-01").cast("date"), F.col("n")), "int": F.col("n")}
    at["timestamp_ntz"] = at["date"].cast("timestamp_ntz")
    frame = spark.createDataFrame(rows, "k string, n int").withColumn("at", at[kind])
    found = {r.k: r.at for r in keyset.first_wins(frame, "k", ["at"]).collect()}
    b = frame.where("n = -3").first().at
    assert found == {"a": None, "b": b, "c": None}


def asked(spark, rows):
    """Requests ``id, time, product`` or, for a product of several pages, ``P/page``."""
    urls = [(i, at, f"http%3A%2F%2Fwww.amazon.com%2Fproduct%2F{p.replace('/', '%2F')}") for i, at, p in rows]
    return spark.createDataFrame(urls, "request_id bigint, ts timestamp_ntz, url string")


def test_one_request_of_each_product_is_first(spark, zone):
    random.seed(7)
    rows = [
        (random.choice([None, n]), random.choice(TIMES), f"P{random.randrange(12)}/{n}") for n in range(150)
    ]
    rows += [(None, None, "Q/1"), (None, None, "Q/2"), (3, TIMES[3], "R/1"), (3, TIMES[3], "R/2"), (5, None, "S/1")]
    texts = spark.createDataFrame([(f"P{i}", "t") for i in range(10)] + [(p, "t") for p in "QRS"], "product_id string, text string")
    frame = asked(spark, rows).repartition(4)
    outcomes = requests.request_outcome(frame, texts).collect()
    status = defaultdict(list)
    for row in outcomes:
        status[row.product_id].append(row)
    described = {f"P{i}" for i in range(10)} | set("QRS")
    groups = defaultdict(list)
    for i, at, page in rows:
        groups[page.split("/")[0]].append((minutes(at), i, at))
    for product, own in groups.items():
        created = [r for r in status[product] if r.status == 201]
        assert len(created) == (product in described)
        assert len(status[product]) == len(own)
        for row in created:
            least = min(own, key=lambda r: order_of(r, 0, 1))
            assert (row.ts, row.request_id) == (least[2], least[1])
    accepted = requests.accepted_descriptions(frame, texts).collect()
    won = {(r.product_id, r.ts, r.request_id) for r in outcomes if r.status == 201}
    assert {(r.product_id, r.ts, r.request_id) for r in accepted} == won and len(accepted) == len(won)


# Pages


def paragraphs(spark, pages, *scope):
    frame = spark.createDataFrame([(n, page) for n, page in enumerate(pages)], "n int, html string").coalesce(1)
    found = frame.select("n", markup.first_paragraph(F.col("html"), *scope).alias("text"))
    return [row.text for row in sorted(found.collect())]


ID = f'id="{markup.DESCRIPTION_ID}"'
MANY = " ".join(f'a{i}="v{i}"' for i in range(100_000))
# Pages with what is found by the id, and in the first div.
PAGES = [
    (f"<div {MANY} {ID}><p>x</p></div>", "x", "x"),
    (f"<div {ID} {MANY}><p>x</p></div>", "x", "x"),
    (f"<div {MANY}><p>no</p></div><b {ID}><p>x</p></b>", "x", "no"),
    (f"<div {'a=b ' * 100_000}{ID}><p>x</p></div>", "x", "x"),
    (f"<div {'a ' * 100_000}{ID}><p>x</p></div>", "x", "x"),
    (f"<div {'/' * 100_000}{ID}><p>x</p></div>", "x", "x"),
    (f"<div {'= ' * 100_000}{ID}><p>x</p></div>", "x", "x"),
    (f"<div {chr(34) * 200_000} {ID}><p>x</p></div>", "x", "x"),
    ("<div>" * 30_000 + f"<div {ID}>" + "<div>" * 30_000 + "<p>x</p>", "x", "x"),
    (f"<i {MANY}" * 3 + f"><b {ID}><p>x</p></b>", "x", None),
    ("<div " + "'<a" * 100_000, None, None),
    ("<" * 100_000 + f"<div {ID}><p>x", "x", "x"),
    # Only an attribute of that name counts, and of several the first.
    (f"""<div a='{ID}' b="id='productDescription'"><p>no</p></div>""", None, "no"),
    (f'<div id="other" {ID}><p>no</p></div>', None, "no"),
    ('<div data-id="productDescription"><p>no</p></div>', None, "no"),
    ('<div xid=productDescription id><p>no</p></div>', None, "no"),
    ("<div id = productDescription ><p>x</p></div>", "x", "x"),
    ("<DIV class=c ID='productDescription'/><p>x</p></DIV>", "x", "x"),
    (f'<div a="b"{ID}><p>x</p></div>', "x", "x"),
]


@pytest.mark.parametrize("scope", [(), (None, "div")])
def test_no_page_ends_the_job(spark, scope):
    paragraphs(spark, ["<div><p>warm"], *scope)
    found = paragraphs(spark, [page for page, _, _ in PAGES], *scope)
    want = [by_name if scope else by_id for _, by_id, by_name in PAGES]
    wrong = [(page[:40], w, f) for (page, _, _), w, f in zip(PAGES, want, found) if w != f]
    assert wrong == []


def test_many_attributes_take_no_time(spark):
    pages = [page for page, _, _ in PAGES[:3]]
    paragraphs(spark, pages[:1])
    begin = time.perf_counter()
    assert paragraphs(spark, pages) == ["x", "x", "x"]
    assert time.perf_counter() - begin < 2 * len(pages)


# Item documents

LABEL = markup.REVIEW_LABEL


def review(text, label=LABEL):
    return f"<EditorialReview><Source>{label}</Source>{text}</EditorialReview>"


def listed(reviews):
    return f"<r><EditorialReviews>{reviews}</EditorialReviews></r>"


DOCUMENTS = [
    (listed(review("<Content><![CDATA[a <!-- b --> c]]></Content>")), "a <!-- b --> c"),
    (listed(review("<Content><![CDATA[x </EditorialReviews> &amp; y]]></Content>")), "x </EditorialReviews> &amp; y"),
    (f"<r><n><![CDATA[<EditorialReviews>no</EditorialReviews>]]></n>{listed(review('<C>t</C>'))}</r>", "t"),
    (f"<r><!-- <EditorialReviews>no</EditorialReviews> -->{listed(review('<C>t</C>'))}</r>", "t"),
    (f"<r a='<EditorialReviews>'>{listed(review('<C>t</C>'))}</r>", "t"),
    # Children count by place, not by name.
    (listed("<EditorialReview><Name>Product Description</Name><Text>hello</Text></EditorialReview>"), "hello"),
    (listed("<X><Content>hello</Content><Source>Product Description</Source></X>"), None),
    (listed(review("<Content>q</Content><More>z</More>")), "q"),
    (listed(f"\n <X>\n <!-- a --><Y>{LABEL}</Y>\n<?b?> <Z>hello</Z></X>\n"), "hello"),
    (listed(review("<C>no</C>", "Other") + "text" + review("<C>t</C>")), "t"),
    (listed("<a/><b></b><c><d/></c>" + review("<C/>") + review("<C><!-- no --></C>") + review("<C> </C>")), " "),
    (listed(review("<C>a&amp;b &#65;<b>x</b>\r\n c</C>")), "a&b Ax\n c"),
    (listed(review("<C>t</C>", "Product <![CDATA[Descr]]>iption")), "t"),
    # Broken lists, and what does not belong to the list.
    (listed(review("<C>a</D>")), None),
    (listed(review("<C>a < b</C>")), None),
    ("<EditorialReviews>" + review("<C>t</C>"), None),
    (listed(review("<C>t</C>") + "<X><Y></X>"), None),
    ("<EditorialReviews/>" + listed(review("<C>t</C>")), None),
    ("<EditorialReviewsX/><a><b></a>" + listed(review("<C>t</C>")) + "<![CDATA[", "t"),
    ("<![CDATA[ " + listed(review("<C>t</C>")), None),
    # Large ones.
    (listed(review("<C>" + "<i>" * 20_000 + "deep" + "</i>" * 20_000 + "</C>")), "deep"),
    (listed(review("<C>" + "a<!--x-->" * 50_000 + "</C>")), "a" * 50_000),
    (listed(review("<C>no</C>", "Other" * 1000) * 5000 + review("<C>far</C>")), "far"),
    (None, None),
    ("", None),
]


def test_item_documents(spark):
    frame = spark.createDataFrame([(n, xml) for n, (xml, _) in enumerate(DOCUMENTS)], "n int, xml string")
    found = frame.select("n", markup.editorial_review(F.col("xml")).alias("text")).collect()
    wrong = [(xml, want, row.text) for (xml, want), row in zip(DOCUMENTS, sorted(found)) if row.text != want]
    assert [(str(xml)[:80], want, text) for xml, want, text in wrong] == []

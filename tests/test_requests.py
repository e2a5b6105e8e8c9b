"""URLs, markup, addresses, key sets and request outcomes."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lexitally.functions import addresses, markup, urls
from lexitally.operators import keyset, requests

LOCATORS = [
    ("http://www.amazon.com/gp/product/B00SMBFZNG", ("B00SMBFZNG", "www.amazon.com")),
    ("http%3A%2F%2Fwww.amazon.com%2Fgp%2Fproduct%2FP1", ("P1", "www.amazon.com")),
    ("http://www.amazon.co.uk/gp/product/B1?ref=x", ("B1?ref=x", "www.amazon.co.uk")),
    ("http://www.amazon.com/gp/product/", None),
    ("http://www.amazon.com/gp/product//B1", ("", "www.amazon.com")),
    ("http://www.amazon.com/dp/B1", ("http:", "www.amazon.com")),
    ("http://www.example.com/gp/product/B1", None),
    ("%zz", None),
    ("///", None),
    ("", None),
    (None, None),
    ("amazon", ("amazon", "amazon")),
    ("/amazon", ("", "amazon")),
    ("amazonproduct/x/y", ("x", "amazonproduct")),
    ("http://a+b.amazon.de/product/q+r", ("q r", "a b.amazon.de")),
]

# Requests of a load trace by product, and the bit address of each.
TRACE = {
    "B00TSUGXKE": (20, 760, 622819482),
    "B00VVOCSOU": (14, 128, 2125490396),
    "B00SMBFZNG": (14, 928, 2064897856),
    "B00KRMMCFM": (14, 890, 528896931),
    "B00HUGXOAU": (14, 43, 157571008),
    "B00VVOCQHE": (13, 212, 816433406),
    "B00SMBESTI": (13, 447, 1137389177),
    "B00TRQPVKM": (9, 435, 1067865076),
    "B00CBNIXHQ": (9, 892, 751287659),
}


def locate_by_hand(url):
    """The rules on a list of parts."""
    parts = url.rstrip("/").split("/") if url.strip("/") or not url else []
    hosts = [p for p in parts if "amazon" in p]
    marked = [i for i, p in enumerate(parts) if "product" in p]
    at = marked[0] + 1 if marked else 0
    return (parts[at], hosts[0]) if hosts and at < len(parts) else None


def trace(spark):
    ids = [k for k, (n, _, _) in TRACE.items() for _ in range(n)]
    random.Random(7).shuffle(ids)
    rows = [(i, f"http%3A%2F%2Fwww.amazon.com%2Fgp%2Fproduct%2F{k}") for i, k in enumerate(ids)]
    return spark.createDataFrame(rows, "request_id bigint, url string").select(
        "request_id", F.timestamp_micros("request_id").alias("ts"), "url"
    )


def texts(spark, ids):
    return spark.createDataFrame([(i, f"text of {i}") for i in ids], "product_id string, text string")


def statuses(outcomes):
    return {r["status"]: r["count"] for r in outcomes.groupBy("status").count().collect()}


def test_locators(spark):
    frame = spark.createDataFrame([(u,) for u, _ in LOCATORS], "url string")
    found = frame.select(urls.product_locator(F.col("url")).alias("l")).collect()
    assert [None if r.l is None else tuple(r.l) for r in found] == [w for _, w in LOCATORS]


def test_locators_of_made_up_urls(spark):
    rng = random.Random(11)
    pieces = ["amazon", "product", "/", "/", "x", "//", "B1", "."]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(3000)]
    frame = spark.createDataFrame([(u,) for u in made], "url string")
    found = frame.select(urls.product_locator(F.col("url")).alias("l")).collect()
    assert [None if r.l is None else tuple(r.l) for r in found] == [locate_by_hand(u) for u in made]


def test_locate_agrees_with_the_column_function(spark):
    frame = spark.createDataFrame([(u,) for u, _ in LOCATORS], "url string")
    rows = requests.locate(frame).collect()
    found = {r.url: None if r.product_id is None else (r.product_id, r.host) for r in rows}
    assert found == dict(LOCATORS)


def test_split_path(spark):
    given = ["a//b/", "/a", "///", "", "a"]
    frame = spark.createDataFrame([(u,) for u in given], "u string")
    found = [r[0] for r in frame.select(urls.split_path(F.col("u"))).collect()]
    assert found == [["a", "", "b"], ["", "a"], [], [""], ["a"]]


def test_marketplace(spark):
    given = ["www.amazon.co.uk", "www.amazon.de", "amazon.com", "amazon.org", "uk.amazon.x", None]
    frame = spark.createDataFrame([(u,) for u in given], "h string")
    both = frame.select(
        urls.marketplace(F.col("h")).alias("a"), urls.marketplace(F.col("h"), False).alias("b")
    ).collect()
    assert [r.a for r in both] == ["uk", "de", "com", "com", "uk", None]
    assert [r.b for r in both] == ["com"] * 5 + [None]


def test_first_paragraph(spark):
    page = (
        "<html><div id='x'><p>no</p></div><div class=a id=\"productDescription\">"
        "<!-- <p>c</p> --><div><script>var a='<p>s</p>'</script></div><div><div>a</div><b>"
        "<p class=z>Hello<br/>wide <i>w</i>orld &amp;lt; &copy;<div>x</div></div></div></div>"
        "<p>after</p>"
    )
    given = [
        (page, "Hello wide world &lt; ©"),
        ("<div id='productDescription'><div>a</div></div><p>after</p>", None),
        ("<div id=productDescription><p>one<p>two</div>", "one"),
        ("<section id='productDescription'><p></p></section>", ""),
        ("<p>x</p>", None),
        (
            "<div id=productDescription><p>&#39;a&#x2019; &#8364;&#x1F600; &#38;lt; &#; &#xD800;"
            " &#99999999; &#0; &#000000065; &#x0000041;</div>",
            "'a’ €😀 &lt; &#; &#xD800; &#99999999; &#0; A A",
        ),
        (
            "<p id=productDescription><div id=productDescription><p>caf&eacute; Kindle&trade;"
            " it&rsquo;s &mdash; new &nosuch; &amp;amp; a & b</p></div>",
            "café Kindle™ it’s — new &nosuch; &amp; a & b",
        ),
        ('<div id="productdescription"><p>x</p></div>', None),
        ("<div title=' id=\"productDescription\" '><p>x</p></div>", None),
        ('<div data-x="a>b" ID="productDescription"><p title="a>b">text</p></div>', "text"),
        ('<div id="productDescription"><img alt="</div>"><p>in</p></div>', "in"),
        ("<div id='productDescription'><textarea><p>no</p></textarea><p>yes</p></div>", "yes"),
        ("<div id='productDescription'><p>one<li>two</li></div>", "one"),
        ("<div id='productDescription'><p>one<dd>two</div>", "one"),
        (None, None),
    ]
    frame = spark.createDataFrame([(h,) for h, _ in given], "h string")
    found = [r[0] for r in frame.select(markup.first_paragraph(F.col("h"))).collect()]
    assert found == [want for _, want in given]


def review(source, content):
    return f"<EditorialReview><Source>{source}</Source>{content}</EditorialReview>"


def test_element_id_with_signs_of_patterns(spark):
    frame = spark.createDataFrame([('<div id="axb"><p>no</p></div><div id="a.b"><p>x</p></div>',)], "h string")
    assert frame.select(markup.first_paragraph(F.col("h"), "a.b")).first()[0] == "x"


def test_editorial_review(spark):
    label = "Product Description"
    text = "<Content>a &lt;b&gt; &amp; c</Content>"
    given = [
        ("<r><EditorialReviews>" + review(label, text) + "</EditorialReviews></r>", "a <b> & c"),
        ("<r><EditorialReviews>" + review("Other", text) + "</EditorialReviews></r>", None),
        # A review without text is passed over; the next one counts.
        (
            "<r><EditorialReviews>" + review(label, "<Content/>") + review(label, text)
            + "</EditorialReviews></r>",
            "a <b> & c",
        ),
        # Only the first list counts.
        (
            "<r><i><EditorialReviews/></i><i><EditorialReviews>" + review(label, text)
            + "</EditorialReviews></i></r>",
            None,
        ),
        ("<r><unclosed></r>", None),
        ("no xml", None),
        # What stands around the list cannot fail the job.
        ("<r><EditorialReviews>" + review(label, text) + "</EditorialReviews></r>junk", "a <b> & c"),
        ("<r><EditorialReviews>" + review(label, text) + "</EditorialReviews></r><r/>", "a <b> & c"),
        ("\ufeff<r><EditorialReviews>" + review(label, text) + "</EditorialReviews></r>", "a <b> & c"),
        ("<!DOCTYPE r><r><EditorialReviews>" + review(label, text) + "</EditorialReviews></r>", "a <b> & c"),
        ("<r><EditorialReviews><EditorialReview><Source></EditorialReviews></r>", None),
        (None, None),
    ]
    frame = spark.createDataFrame([(x,) for x, _ in given], "x string")
    found = [r[0] for r in frame.select(markup.editorial_review(F.col("x"))).collect()]
    assert found == [want for _, want in given]


def test_addresses(spark):
    want = {k: (b, o) for k, (_, b, o) in TRACE.items()}
    want |= {"P0": (42, 487177401), "P42": (560, 1134793980)}
    frame = spark.createDataFrame([(k,) for k in want], "k string")
    rows = frame.select(
        "k", addresses.key_uuid(F.col("k")).alias("u"), addresses.key_address(F.col("k")).alias("a")
    ).collect()
    assert {r.k: tuple(r.a) for r in rows} == want
    assert {r.u for r in rows if r.k == "P0"} == {"e30d89e4fe04355db4352cb685cfc7d6"}


def test_fold_of_the_most_negative_number(spark):
    uuid = "80000000" + "0" * 24
    frame = spark.createDataFrame([(uuid,)], "u string")
    assert tuple(frame.select(addresses.address_of(F.col("u"))).first()[0]) == (0, 2**31)


def test_trace_all_found(spark):
    outcomes = requests.request_outcome(trace(spark), texts(spark, TRACE))
    assert statuses(outcomes) == {201: 9, 200: 111}


def test_trace_with_a_missing_product(spark):
    known = [k for k in TRACE if k != "B00TSUGXKE"]
    asked, found = trace(spark), texts(spark, known)
    outcomes = requests.request_outcome(asked, found)
    assert statuses(outcomes) == {201: 8, 200: 92, 404: 20}
    # A table of described keys does as well as one with the texts.
    assert statuses(requests.request_outcome(asked, found.select("product_id"))) == {
        201: 8, 200: 92, 404: 20,
    }
    located = requests.locate(asked).select("request_id", "product_id")
    fetched = requests.fetch_join(located, found).collect()
    assert len(fetched) == 120 and sum(r.text is None for r in fetched) == 20
    missing = requests.missing_requests(located, found)
    assert {r.product_id for r in missing.collect()} == {"B00TSUGXKE"}
    assert missing.count() == 20


def test_stored_products_are_duplicates_even_without_a_description(spark):
    seen = spark.createDataFrame([("B00TSUGXKE",)], "product_id string")
    outcomes = requests.request_outcome(trace(spark), texts(spark, []), seen)
    assert statuses(outcomes) == {200: 20, 404: 100}


def test_messages(spark):
    rows = [(1, "amazon/product/A"), (2, "amazon/product/A"), (3, "amazon/product/B"), (4, "x"), (5, None)]
    asked = spark.createDataFrame(rows, "request_id bigint, url string").withColumn(
        "ts", F.timestamp_micros("request_id")
    )
    outcomes = requests.request_outcome(asked, texts(spark, ["A"]))
    assert [r.message for r in outcomes.orderBy("request_id").collect()] == [
        "Description of product A has been successfully processed",
        "Product A description digest is already present, no fetching/processing required",
        "Product B description is missing on amazon",
        "Product URL x is invalid",
        "Could not extract product URL from the request form Map()",
    ]


def test_more_duplicates_change_nothing(spark):
    asked = trace(spark)
    again = asked.withColumn("request_id", F.col("request_id") + 1000).withColumn(
        "ts", F.timestamp_micros("request_id")
    )
    found = texts(spark, TRACE)
    once = requests.accepted_descriptions(asked, found).collect()
    twice = requests.accepted_descriptions(asked.unionByName(again), found).collect()
    assert sorted(once) == sorted(twice) and len(once) == 9


SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


def test_rows_of_one_key_land_in_many_tasks(spark):
    # Nothing but the key, so that no column tells the rows apart.
    keys = spark.range(0, 200_000, 1, 16).select(
        F.when(F.col("id") % 20 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    stored = spark.createDataFrame([("hot",), ("20",)], "k string")
    for name, value in SKEWED.items():
        spark.conf.set(name, value)
    try:
        found = keyset.contains(keys, stored, "k").where("k = 'hot'")
        tasks = found.select(F.spark_partition_id().alias("task")).collect()
    finally:
        for name in SKEWED:
            spark.conf.unset(name)
    assert len(tasks) == 190_000 and len({r.task for r in tasks}) > 1


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue().split("\n\n\n")[0]


def test_first_and_last_wins_need_no_sort(spark):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("product_id"), F.col("id").alias("request_id"),
        F.timestamp_micros("id").alias("ts"), F.col("id").cast("double").alias("v"),
    )
    order = ["ts", "request_id"]
    for frame in (
        keyset.first_wins(rows, "product_id", order),
        keyset.put_overwrite(rows, "product_id", "v", order),
    ):
        text = plan(frame)
        assert "HashAggregate" in text and "Sort" not in text
    # Only a join may sort here, and only the winners.
    text = plan(requests.accepted_descriptions(trace(spark), texts(spark, TRACE)))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_first_wins_over_odd_numbers(spark):
    rows = [
        ("a", -(2**62), 2**63 - 1, "x"), ("a", -(2**62), -(2**63), "y"), ("a", 5, 0, "z"),
        ("b", 253_402_300_799_999_999, 7, "p"), ("b", 253_402_300_799_999_998, 9, "q"), (None, 1, 1, "n"),
    ]
    frame = spark.createDataFrame(rows, "k string, at bigint, id bigint, v string").withColumn(
        "ts", F.timestamp_micros(F.greatest("at", F.lit(-(10**16)))).cast("timestamp_ntz")
    )
    plain = keyset.first_wins(frame, "k", ["ts", "id"]).collect()
    assert {(r.k, r.id, r.n) for r in plain} == {("a", -(2**63), 3), ("b", 9, 2)}
    full = keyset.first_wins(frame, "k", ["ts", "id"], ["v"]).collect()
    assert {(r.k, r.ts, r.id, r.v) for r in full} == {
        (r.k, r.ts, r.id, "y" if r.k == "a" else "q") for r in plain
    }


def test_put_overwrite_and_remove(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 9), ("b", 3, 5)], "k string, o int, v int")
    assert {tuple(r) for r in keyset.put_overwrite(rows, "k", "v", ["o"]).collect()} == {
        ("a", 9), ("b", 5),
    }
    left = keyset.batch_remove(rows, spark.createDataFrame([("a",)], "k string"), "k")
    assert [r.k for r in left.collect()] == ["b"]


def test_duplicate_flag(spark):
    rows = [("a", 1), ("b", 1), ("a", 2), ("c", 2), ("d", 3), ("d", 3), ("e", 4)]
    frame = spark.createDataFrame(rows, "k string, batch int")
    flags = {
        r.batch: (r.duplicate, r.duplicate_strict)
        for r in keyset.duplicate_flag(frame, "k", "batch").collect()
    }
    assert flags == {1: (False, False), 2: (True, True), 3: (False, True), 4: (False, False)}


def test_bit_sets(spark):
    keys = spark.createDataFrame([(f"P{i}",) for i in range(500)], "k string")
    probes = spark.createDataFrame([(f"P{i}",) for i in range(490, 510)] + [(None,)], "k string")
    bits = keyset.seen_bits(keys, "k")
    assert keyset.seen_bitmaps(bits).agg(F.sum("n")).first()[0] == bits.count() == 500
    flags = {r.k: r.contained for r in keyset.maybe_contains(probes, bits, "k").collect()}
    assert flags == {f"P{i}": i < 500 for i in range(490, 510)} | {None: False}
    exact = {r.k: r.contained for r in keyset.contains(probes, keys, "k").collect()}
    assert exact == flags
    # Bits of two batches put together give each row once.
    twice = keyset.maybe_contains(probes, bits.unionByName(bits), "k")
    assert twice.count() == probes.count()


def test_bitmaps_batch_by_batch(spark):
    keys = [[f"P{i}" for i in range(a, b)] + [None, f"P{a}"] for a, b in ((0, 300), (200, 500), (0, 10))]
    pages, known = None, set()
    for some in keys:
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(some)], "k string, i int")
        pages = keyset.no_bitmaps(rows) if pages is None else pages
        answered, pages = keyset.set_and_report(rows, pages, "k")
        found = answered.collect()
        assert sorted((r.i, r.k) for r in found if r.k) == [(i, k) for i, k in enumerate(some) if k]
        # These keys share no bit.
        assert {r.k: r.was_set for r in found} == {k: k in known for k in some}
        known |= {k for k in some if k}
    once = keyset.seen_bitmaps(keyset.seen_bits(spark.createDataFrame([(k,) for k in known], "k string"), "k"))
    assert sorted(map(str, pages.collect())) == sorted(map(str, once.select(pages.columns).collect()))
    bits = spark.range(8).agg(F.bitmap_construct_agg(F.col("id") * 3).alias("m"))
    flags = bits.select(*[keyset.bit_is_set(F.col("m"), F.lit(p)).alias(f"p{p}") for p in range(24)]).first()
    assert [p for p in range(24) if flags[p]] == list(range(0, 24, 3))

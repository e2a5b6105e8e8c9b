"""Every registered query against its DuckDB answer, and the plans of the main ones."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as entry
import compare
import pytest
from lexitally.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.fixture(scope="module")
def answers(spark):
    return oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, answers, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, answers[name]) == ""


# Products are asked for again and again only in the larger tables.
REPEATED = "request_outcome outcome_summary stream_request_outcome accepted_descriptions first_wins"


@pytest.mark.parametrize("name", REPEATED.split())
def test_query_with_repeated_requests(spark, answers, name):
    folder = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, folder)
    assert compare.differences(found, compare.connect(folder), answers[name]) == ""
    if name == "request_outcome":
        assert found.where("status = 200").count() > 0


def test_every_query_has_an_answer(answers):
    assert set(answers) == set(QUERIES)


def test_the_entry_has_all_queries(answers):
    assert set(entry.queries()) >= set(QUERIES)
    assert entry.oracle_sql().items() >= answers.items()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 26))


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    top = plan(QUERIES["top_k"](spark, FOLDER))
    assert "TakeOrderedAndProject" in top
    assert "partial_count" in top
    # Only the text is read of a document.
    assert "ReadSchema: struct<text:string>" in top
    # Rows of a node or batch are cut to the first ones before the shuffle.
    assert "WindowGroupLimit" in plan(QUERIES["top_k_per_batch"](spark, FOLDER))


@pytest.mark.parametrize("name", ["end_to_end", "request_outcome", "tokenize", "top_k_per_batch"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_golden_words(spark):
    rows = QUERIES["top_k"](spark, FOLDER).collect()
    assert [tuple(r) for r in rows[:5]] == [
        ("la", 679), ("en", 621), ("der", 591), ("er", 461), ("le", 459),
    ]

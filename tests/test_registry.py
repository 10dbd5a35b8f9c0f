"""Every registered query against its SQL twin, and the shape of the plans."""

import pytest

import __spark_entry__ as E
import compare
from narrprep.plans.oracle import ORACLE
from narrprep.plans.queries import QUERIES



@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLE) == set() and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert compare.canonical(got) == compare.canonical(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_pairwise_joins(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name", ["clean_text", "merge_short", "narration_chunks", "narration_markers", "chapter_text", "headings", "sentences", "html_text", "text_export"]
)
def test_text_work_does_not_shuffle(spark, small, name):
    # The only exchange is the spreading of a small scan over the cores.
    text = plan(QUERIES[name](spark, small))
    assert "hashpartitioning" not in text and "SinglePartition" not in text and "rangepartitioning" not in text


def test_scans_read_only_what_they_need(spark, small):
    text = plan(QUERIES["job_timings"](spark, small))
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "props" not in schema and "value" not in schema and "event_type" in schema


def test_pages_drop_rows_before_the_shuffle(spark, small):
    text = plan(QUERIES["jobs_page"](spark, small))
    assert "Partial" in text and "WindowGroupLimit" in text


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "detected", "clean"] and df.count() == 200


@pytest.mark.parametrize("name", ["narration_chunks", "narration_markers", "merge_short", "sentences", "headings", "chapter_spans", "pack_chunks"])
def test_arrays_are_computed_once(spark, small, name):
    # An inferred filter on the size of an array would compute the array again.
    assert "Filter (size(" not in plan(QUERIES[name](spark, small)).replace("((", "(")

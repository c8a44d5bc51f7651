"""Every registered query that SQL can express, against its SQL over whole tables."""

import compare
import pytest

from pageloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = compare.rows(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert got == want and got


def test_documents_partition_once(spark):
    """The chain from blocks to merge groups shuffles blocks by document, once."""
    from pageloom.operators import layout, merge
    from pageloom.plans import fixtures

    frame = merge.merge_groups(layout.reading_order(fixtures.blocks(spark, SF)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parts_grow_with_the_text(spark, tmp_path):
    """A task of the layout chain has a bounded part of the documents, so more text makes more tasks."""
    from pageloom.plans import fixtures

    spark.range(200).selectExpr("id as doc_id", r"repeat('a line of words of some length.\n', 6000) as text").write.parquet(f"{tmp_path}/documents.parquet")
    frame = fixtures.blocks(spark, str(tmp_path))
    rows = frame.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(rows) == 200 * 6001 + len(fixtures.LITERAL)
    assert len(rows) >= 200 * 6000 * 32 // fixtures.TASK_BYTES

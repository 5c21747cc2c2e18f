"""What keeps queries in proportion to their tables: tasks, work done once, and rows that no step makes."""

import pytest

from tessera.catalogue_queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["parsed_documents", "document_errors", "structured_documents"])
def test_documents_dealt(spark, sf, name):
    """Texts made of a table of one split are parsed by several tasks, and each by one parse: no filter repeats it."""
    df = QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() == 4
    assert plan_of(df).count("first_object") == 1

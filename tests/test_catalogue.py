import pytest
from compare import duck_rows, spark_rows

import folioflow.plans.ingest_queries
import folioflow.plans.search_queries
import folioflow.plans.stream_queries
import folioflow.plans.text_queries  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert spark_rows(df) == duck_rows(ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

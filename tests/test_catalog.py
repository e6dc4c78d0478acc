"""Every registered query that SQL can express, against DuckDB on the same tables."""

import pytest
from oracle import duck, spark_rows

from weirgate.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    want_columns, want = duck(SF, catalog.SQL[name])
    columns, got = spark_rows(catalog.QUERIES[name](spark, SF))
    assert columns == want_columns
    assert len(got) == len(want)
    # whole numbers may be floats on one side
    assert [[x.removesuffix(".000000") for x in r] for r in got] == [[x.removesuffix(".000000") for x in r] for r in want]


def test_entry_and_queries_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1

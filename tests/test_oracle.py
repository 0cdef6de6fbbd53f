"""Every query of the catalogue against its DuckDB counterpart, on the smallest tables."""

import pytest

from tessella.plans import catalogue
from tests.conftest import SMALL, same_rows

ORACLE = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["cell", "date", "lag_v", "region_v", "share", "tier"] and df.count() > 0

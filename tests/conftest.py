import os
import shutil

import duckdb
import pytest

from tessella.session import LOCAL_CHECKPOINTS, get_spark

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = get_spark(8, partitions=4, app="tests")
    yield session
    session.stop()
    shutil.rmtree(LOCAL_CHECKPOINTS, ignore_errors=True)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{SMALL}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    """A value as both engines give it."""
    if v is None or v != v:
        return None
    if hasattr(v, "date") and hasattr(v, "hour"):
        return v.date()
    return round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same_rows(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())

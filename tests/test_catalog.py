"""Every query of the catalog against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from tessera import catalog, documents, drafts, extracts, inductions, keeping, lifecycle, models, profiles, readings, registry, stores, streams  # noqa: F401  these register their queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or isinstance(value, str):
        return str(value)
    try:
        return round(float(value), 4)
    except (TypeError, ValueError):
        return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DIR)
    theirs = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0

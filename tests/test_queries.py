"""Every query with SQL against DuckDB on the same tables."""

import datetime as dt
import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import windrow.more_queries  # noqa: F401  adds to the catalogue
from windrow import queries
from windrow.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_module="/root/testdata/sf0.001"):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_module}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name, tables", [("win_range", ["orders"]), ("set_union_all", ["events"]), ("agg_subquery", ["events"])])
def test_a_query_stores_the_tables_that_it_names(spark, sf, monkeypatch, name, tables):
    monkeypatch.setattr(queries, "_databases", {})
    QUERIES[name](spark, sf)
    [db] = queries._databases.values()
    assert sorted(f.name for f in Path(db.root.removeprefix("file:")).iterdir()) == tables


@pytest.mark.parametrize("own", [None, "32m"])
def test_tasks_of_a_query_are_bounded_unless_the_session_says_otherwise(spark, sf, own):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(name)
    try:
        if own:
            spark.conf.set(name, own)
        QUERIES["win_range"](spark, sf)
        assert spark.conf.get(name) == (own or str(8 << 20))
    finally:
        spark.conf.unset(name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["p", "row_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_part():
    top = Path(entry.__file__).parent
    files = [f for f in (top / "windrow").rglob("*.py") if "llm" not in f.parts]
    assert not [f for f in files if re.search(r"\bllm\b", f.read_text())]

"""Every registered query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from grainline.plans.registry import ORACLE_SQL, QUERIES

from .conftest import SF

duck = duckdb.connect()
duck.sql("SET TimeZone = 'UTC'")
for _file in os.listdir(SF):
    duck.sql(f"CREATE VIEW {_file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{_file}')")


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.8g}") if value == value else None
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    relation = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(relation.columns)
    theirs = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    ours = [tuple(r) for r in rows.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted((plain(r) for r in ours), key=repr) == sorted((plain(r) for r in theirs), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_a_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "dense_rank", "lex_rank", "rrf", "rank"]

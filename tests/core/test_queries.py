"""Every query with SQL gives that SQL's rows, by DuckDB, over the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if n in entry.queries()]


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name: str) -> None:  # noqa: ANN001
    found = entry.queries()[name](spark, SF)
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(wanted.fetchall(), wanted.columns)


def test_entry(spark) -> None:  # noqa: ANN001
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query() -> None:
    assert set(entry.oracle_sql()) <= set(entry.queries())

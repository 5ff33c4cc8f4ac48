"""Every catalog query runs on the smallest tables, and gives what its SQL gives in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quantloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert cols
        return
    r = db.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry_needs_no_session_and_names_agree():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_stay_native(spark):
    """The flagship reads four columns of one table, and no Python runs."""
    plan = QUERIES["carry_flagship"](spark, SF)._jdf.queryExecution().toString()
    read = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "props" not in read and "Python" not in plan and "InPandas" not in plan

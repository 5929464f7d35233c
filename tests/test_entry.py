"""Every query of the core runs on the smallest tables and agrees with its SQL."""

import datetime
import decimal
import glob
import os
from pathlib import Path

import pytest

from spanlake.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        path = f + "/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want


@needs_data
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_does_not_import_the_subpackage():
    root = Path(__file__).resolve().parents[1] / "spanlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "spanlake.llm" not in p.read_text()

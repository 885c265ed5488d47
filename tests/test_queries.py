"""Every domain query against its SQL, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from hydrostrata.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    order = [rel.columns.index(c) for c in df.columns]
    want = [tuple(plain(r[k]) for k in order) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not bad, f"{len(bad)} of {len(rows)}: {bad[:3]}"

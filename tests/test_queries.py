"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as spec

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return repr(v + 0.0) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


PANEL = [n for n in spec.oracle_sql() if not n.startswith("op")]


@pytest.mark.parametrize("name", PANEL)
def test_query_matches_sql(name, spark, sf, duck):
    got = spec.queries()[name](spark, sf)
    want = duck.execute(spec.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if x != y] == []


def test_entry_has_rows(spark):
    assert spec.entry(spark).limit(1).count() == 1


def test_every_panel_query_is_registered():
    found = set(spec.queries())
    assert {"triple_barrier", "fundamental_tilt", "feature_matrix", "gbt_cpcv"} <= found and os.path.exists("/root/testdata")

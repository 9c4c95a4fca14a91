"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import importlib
import math
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from lodestone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_contract(spark):
    q = contract.queries()
    assert set(contract.oracle_sql()) <= set(q) and set(QUERIES) <= set(q) and len(QUERIES) >= 70
    assert contract.entry(spark).count() == 4


def test_contract_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lodestone.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")

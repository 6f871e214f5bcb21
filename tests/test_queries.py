"""Every query of the library that SQL can express, against DuckDB; and what holds for the whole library."""

import ast
import importlib
import os
from pathlib import Path

import duckdb
import pytest

from flowmill.plans import MODULES

DATA = "/root/testdata/sf0.001"
PLANS = [importlib.import_module(f"flowmill.plans.{m}") for m in MODULES]
SQL = {k: (m.QUERIES[k], v) for m in PLANS for k, v in m.SQL.items()}
ROWS = {k: q for m in PLANS for k, q in m.QUERIES.items() if k not in m.SQL}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    query, sql = SQL[name]
    df = query(spark, DATA)
    got = [tuple(r) for r in df.collect()]
    ran = duck.execute(sql)
    names = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain([tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in ran.fetchall()], names)


@pytest.mark.parametrize("name", ["score_batch", "importance_groups", "heldout_config"])
def test_models_give_rows(spark, name):
    assert ROWS[name](spark, DATA).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    for p in Path(importlib.import_module("flowmill").__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith(("flowmill.llm", "corpus_pipeline")) for n in names), p


def test_features_use_no_python_and_hold_on_mirrored_addresses(spark):
    from flowmill.operators.flows import FEATURES, features_all

    rows = [("c", i, float(i * i), "ESP" if i % 5 else "IKE", i % 2, "AB"[i % 2], 100 + i, i // 2, False) for i in range(40)]
    schema = "capture_id string, frame_index long, ts_s double, proto string, spi_int int, src string, length long, seq long, udp_encapsulated boolean"
    df = features_all(spark.createDataFrame(rows, schema))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    mirrored = features_all(spark.createDataFrame([(*r[:5], "BA"[r[5] == "B"], *r[6:]) for r in rows], schema))
    assert df.columns == ["capture_id", *FEATURES] and df.collect() == mirrored.collect()
    none = features_all(spark.createDataFrame([(*r[:3], "IKE", *r[4:]) for r in rows[:1]], schema)).first()
    assert none["esp_packets"] == none["esp_len_std"] == none["esp_iat_mean_s"] == 0.0

"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tributary import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


def canonical(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rel = duck.execute(catalog.ORACLE_SQL[name])
    cols, want = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted(tuple(canonical(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(canonical(r[cols.index(c)]) for c in order) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_transfer_entropy_of_all_users(spark, tmp_path):
    """More users than te_pairs and te_event_pairs take; every pair by the dense computation, and the strongest of all."""
    import numpy as np
    import pandas as pd

    from tributary.operators.influence import dense, te

    rng = np.random.default_rng(5)
    rows = []
    for u in range(14):  # users 12 and 13 are the least active, 13 follows 12
        at = rng.choice(240, 30 - u, replace=False) if u < 13 else [b + 1 for b in rows_12]
        rows_12 = [int(b) for b in at if b < 239]
        rows += [(u, int(b), kind) for b in rows_12 for kind in (["view", "purchase"] if u % 2 else ["purchase", "view"])]
    start = pd.Timestamp("2024-01-01")
    pd.DataFrame({
        "event_id": range(len(rows)), "ts": [start + pd.Timedelta(seconds=10_800 * b + 60) for _, b, _ in rows], "user_id": [u for u, *_ in rows],
        "event_type": [k for *_, k in rows], "value": 1.0, "props": '{"k": 5}',
    }).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    series = {str(u): dense([b for v, b, _ in rows if v == u], 240) for u in range(14)}
    got = {(r["src"], r["dst"], r["delay"]): r["value"] for r in catalog.QUERIES["te_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(a, b, k): pytest.approx(te(series[a], series[b], k), abs=1e-6) for a in series for b in series if a != b for k in (1, 2, 3)}
    assert catalog.QUERIES["te_all_event_pairs"](spark, str(tmp_path)).select("src", "dst").distinct().count() == 14 * 13
    best = catalog.QUERIES["te_top"](spark, str(tmp_path)).orderBy("rank").first()
    assert (best["src"], best["dst"]) == ("12", "13")


def test_entry(spark):
    assert catalog.entry(spark).count() > 0


def test_entry_module_lists_all():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

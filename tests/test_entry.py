"""The driver contract: entry(), queries() and oracle_sql()."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def contract():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark, contract):
    df = contract.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[0] == "period"


def test_every_oracle_has_a_query(contract):
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


@pytest.mark.parametrize("name", ["q_basic_metrics", "q_series_week_mon", "q_anomaly_top8", "q_forecast",
                                  "q_insights", "q_clean_money", "q_role_assignment"])
def test_selected_queries_match_oracle(spark, contract, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "customer", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = contract.queries()[name](spark, sf)
    res = con.sql(contract.oracle_sql()[name])

    def norm(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(repr(r[i]) for i in order) for r in rows)
    assert sorted(sdf.columns) == sorted(res.columns)
    assert norm(sdf.columns, [tuple(r) for r in sdf.collect()]) == norm(res.columns, res.fetchall())

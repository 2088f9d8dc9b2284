"""The registry: names, SQL twins, and a few pairs run side by side at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    from pooltide import catalog

    queries, oracle = catalog.queries(), catalog.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert set(queries) <= set(entry.queries()) and set(oracle) <= set(entry.oracle_sql())
    assert set(queries) - set(oracle) == {"covering_systems", "similar_team_names", "odds_filled_from_events"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "grid_metrics", "leg_predictions", "coupon_features", "backtest_summary", "strategy_recommendations", "sliding_weights",
    "type_statistics", "stable_correlations", "threshold_effects", "generated_grids", "covering_guarantees", "ledger_balances",
    "season_cut", "season_csv_rows", "distribution_page_legs",
])
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.toArrow()
    con.register("got", got)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    ref = entry.oracle_sql()[name]
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ref}")
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchall()[0][0] == 0


def test_python_functions_travel_by_value():
    """Executors need no installed copy of the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from pooltide.operators import covering

    code = "import pickle, sys; print(pickle.load(sys.stdin.buffer)([['1', 'N'], ['2']], [(0, 1.0)]))"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(covering._cover), cwd="/",
                         env={"PATH": "/usr/bin:/usr/local/bin"}, capture_output=True, timeout=120)
    assert out.stdout.decode().strip() == "['12', 'N2']", out.stderr.decode()

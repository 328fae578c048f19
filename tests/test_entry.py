"""Driver contract: entry runs, every query has a twin with the same column names (sf0.001)."""

import duckdb

from conftest import SF

TABLES = ["documents", "labels", "embeddings", "events", "pages", "nation", "customer", "conversations", "benchmark"]


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert df.columns == ["section", "name", "metric", "value"]
    assert {r.section for r in rows} == {"overall", "type", "curve", "best"}


def test_every_query_matches_its_twin_columns(spark):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["tokenise", "mean_probs", "type_counts", "threshold_curve", "window", "split_random",
                 "detect_patterns", "running_best"]:
        s = sorted(qs[name](spark, SF).columns)
        o = sorted(con.sql(sqls[name]).columns)
        assert s == o, name

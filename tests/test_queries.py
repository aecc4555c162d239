"""Registered queries against their SQL on the smallest tables, one or more per family."""

import os

import duckdb
import pytest

from tapeloom.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = (
    "w04_rsi", "w20_max_drawdown", "a06_sentiment_summary", "a27_correlations", "j10_max_pain", "k01_top_opportunities", "q07_bar_anomalies", "s09_snapshot_upsert",
    "f05_symbol_headlines", "g13_combined_signal", "t07_similar_vectors", "x18_scenario_tree", "m15_ks_drift", "u02_distinct_items", "r02_fold",
)


def test_registry_lists_unique_keys_without_a_session():
    found = all_queries()
    assert len(found) > 280
    assert all(q.oracle() is None or q.oracle().startswith("WITH ") for q in found.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, key):
    q = all_queries()[key]
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.run(spark, SF)
    cur = con.execute(q.oracle())
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(repr(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(repr(v) for v in r) for r in df.collect()) == want

"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import vector_index as vx
from tapeloom.operators import vectors as vc


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall_with_ids_divisible_by_50(spark, table, metric):
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    ix = vx.fit(table, metric=metric)
    hits = vx.search(queries, vx.assign(table, ix), ix, 5)
    exact = vc.similar(queries, table, 5, metric)
    found = vx.recall(hits, exact).first()
    assert found.queries == 40 and found.recall >= 0.9
    both = hits.join(exact.select("query_id", "vec_id", F.col("score").alias("s")), ["query_id", "vec_id"])
    assert both.where("abs(score - s) > 1e-9").isEmpty()


def test_all_lists_and_all_rows_are_the_exact_search(spark, table, monkeypatch):
    small = table.where("vec_id % 7 = 0")
    queries = small.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    ix = vx.fit(small, lists=12, sample=100)
    monkeypatch.setattr(vx, "VECTORS", 10)
    monkeypatch.setattr(vx, "QUERIES", 3)
    hits = vx.search(queries, vx.assign(small, ix), ix, 4, probe=1.0, deep=1000)
    want = vc.similar(queries, small, 4)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in hits.collect()} == {(r.query_id, r.vec_id, r["rank"]) for r in want.collect()}


def test_every_row_is_indexed_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist() if i % 10 else [0.0] * 6) for i in range(90)] + [(90, None)] + [(91 + i, [1.0] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for metric in ("l2", "cosine"):
        ix = vx.fit(df, sample=50, metric=metric)
        coded = vx.assign(df, ix)
        assert coded.count() == 120
        hits = vx.search(df.where("vec_id in (1, 95)").withColumnRenamed("vec_id", "query_id"), coded, ix, 3, probe=1.0)
        assert hits.count() == 6
    none = df.where("false")
    ix = vx.fit(none)
    assert vx.search(none.withColumnRenamed("vec_id", "query_id"), vx.assign(none, ix), ix, 3).count() == 0

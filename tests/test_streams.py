"""Streams that stop and go on: the result equals the batch operator over all rows; null values and empty inputs have a result."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import quality as ql
from tapeloom.plans import on_streams
from tapeloom.streaming import streams as st

DAY = dt.datetime(2024, 1, 1)
SCORES = "model string, sample_id bigint, ts timestamp_ntz, actual double, predicted double"
BARS = "symbol string, ts timestamp_ntz, close double, volume double"
CHAIN = "contract_id bigint, chain_date int, open_interest bigint"


def _in_two_runs(spark, tmp_path, rows, schema, run):
    """Lands half of the rows in two files, runs, lands the rest, runs again with the same place."""
    place = st.Place(str(tmp_path / "out"), str(tmp_path / "mark"))
    folder, got, n = str(tmp_path / "in"), None, (len(rows) + 3) // 4
    for i in range(4):
        spark.createDataFrame(rows[i * n:(i + 1) * n], schema).coalesce(1).write.mode("append").parquet(folder)
        if i % 2:
            got = run(st.read_files(spark, folder, schema), place)
    return got


def test_scores_go_on_after_a_stop(spark, tmp_path):
    rows = [("m" if i % 3 else None, i if i % 11 else None, DAY + dt.timedelta(minutes=i) if i % 13 else None, float(i % 5), None if i % 17 == 0 else 2.0) for i in range(400)]
    got = _in_two_runs(spark, tmp_path, rows, SCORES, lambda s, to: st.track_scores(s, to, 230, salts=4))
    d = spark.createDataFrame(rows, SCORES).withColumn("score", st.outcome_score(F.col("actual"), F.col("predicted")))
    counts = {r["model"]: r["n"] for r in d.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {r["model"]: r for r in got.collect()}
    assert {m: r["total_predictions"] for m, r in out.items() if m} == {m: n for m, n in counts.items() if m}
    want = {r["model"]: r for r in st.score_stats(st.last_scores(d, 230)).collect()}["m"]
    assert want["performance_drop"] is not None
    for c in ("kept", "mean_score", "performance_drop"):
        assert out["m"][c] == pytest.approx(want[c], abs=1e-12)


def test_anomalies_go_on_after_a_stop(spark, tmp_path):
    rows = [(s, DAY + dt.timedelta(days=i), 100.0 + i * 7 % 5 + (300 if i % 17 == 0 else 0), None if i % 19 == 0 else 10.0 + (200 if i % 14 == 3 else 0)) for i in range(60) for s in ("A", None)]
    got = _in_two_runs(spark, tmp_path, rows, BARS, lambda s, to: st.anomaly_stream(s, to))
    key = lambda df: sorted(repr((r["symbol"], r["ts"], r["type"], round(r["confidence"], 9))) for r in df.collect())
    want = key(ql.bar_anomalies(spark.createDataFrame(rows, BARS)))
    assert want and key(got) == want


def test_open_interest_changes_go_on_after_a_stop(spark, tmp_path):
    rows = [(c, d, None if (c + d) % 7 == 0 else c * 10 + d * d) for d in range(8) for c in range(5)]
    got = _in_two_runs(spark, tmp_path, rows, CHAIN, lambda s, to: st.drain(st.oi_changes(s), to))
    oi = {(c, d): v for c, d, v in rows}
    want = {(c, d): (v - oi[c, d - 1] if d and v is not None and oi[c, d - 1] is not None else None) for (c, d), v in oi.items()}
    assert {(r["contract_id"], r["chain_date"]): r["oi_change"] for r in got.collect()} == want


def test_a_running_fold_goes_on_after_a_stop(spark, tmp_path):
    rows = [(i % 3, i, i) for i in range(40)]
    got = _in_two_runs(spark, tmp_path, rows, CHAIN, lambda s, to: st.fold(s, ["contract_id"], [F.sum("open_interest").alias("total")], to))
    assert {r["contract_id"]: r["total"] for r in got.collect()} == {k: sum(range(k, 40, 3)) for k in range(3)}


def test_an_empty_stream_has_an_empty_result(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCORES).write.parquet(folder)
    s = st.read_files(spark, folder, SCORES)
    assert st.track_scores(s, st.Place(str(tmp_path / "a"), str(tmp_path / "b"))).count() == 0
    assert st.count_triggers(s, {"x": 5}, st.Place(str(tmp_path / "c"), str(tmp_path / "d"))).count() == 0


def test_contracts_of_a_bucket_keep_apart(spark, tmp_path):
    rows = [(c if c else None, day, None if (c + day) % 5 == 0 else c * 100 + day * day) for day in range(8) for c in range(1 if day else 0, 30)]
    got = _in_two_runs(spark, tmp_path, rows, CHAIN, lambda s, to: st.drain(st.oi_changes(s, buckets=2), to))
    before = F.lag("open_interest").over(Window.partitionBy("contract_id").orderBy("chain_date"))
    want = spark.createDataFrame(rows, CHAIN).select("contract_id", "chain_date", F.col("open_interest") - before)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))


def test_symbols_of_a_bucket_keep_apart(spark, tmp_path):
    rows = [(s, DAY + dt.timedelta(days=i), 100.0 + (i * 7 + k) % 5 + (60 if i % 31 == 30 else 0), None if i % 17 == 3 else 10.0 + (900 if i % 23 == 22 else i % 3)) for i in range(120) for k, s in enumerate(("a", "b", "c", "d", None))]
    one, many = (_in_two_runs(spark, tmp_path / str(n), rows, BARS, lambda s, to, n=n: st.anomaly_stream(s, to, 9, buckets=n)) for n in (1, 512))
    assert one.count() > 20 and {r.symbol for r in one.collect()} == {"a", "b", "c", "d", None}
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_a_large_part_lands_as_files_of_one_trigger(spark):
    rows = spark.createDataFrame([(i, 1 if i < 150 else 2) for i in range(200)], "id bigint, day int")
    stream = on_streams.landed(spark, rows, "day", file_rows=40)
    got = st.changes(stream.groupBy("day").agg(F.count(F.lit(1)).alias("n")), st.Place.fresh(spark, "landed-test"))
    assert {(r.day, r.n) for r in got.collect()} == {(1, 150), (2, 50)}  # no part is split between triggers

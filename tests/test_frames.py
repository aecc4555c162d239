"""The chunk layout gives the same values as windows over whole symbols, also when one symbol holds most rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.operators import indicators as ind


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(7)
    rows = []
    for sym, n in (("HOT", 400), ("B", 30), ("C", 3)):
        day = dt.datetime(2020, 1, 1)
        for _ in range(n):
            day += dt.timedelta(days=rng.randint(1, 9))
            c = round(rng.uniform(50, 150), 2)
            rows.append((sym, day, c, c + rng.random(), c - rng.random(), c, float(rng.randint(1, 50))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").cache()


def _same(a, b, cols):
    x = [tuple(r) for r in a.select("symbol", "ts", *cols).orderBy("symbol", "ts").collect()]
    y = [tuple(r) for r in b.select("symbol", "ts", *cols).orderBy("symbol", "ts").collect()]
    assert len(x) == len(y)
    for p, q in zip(x, y):
        assert p[:2] == q[:2]
        for u, v in zip(p[2:], q[2:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_small_chunks_equal_whole_symbol_windows(bars):
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = bars.withColumns({"m": F.avg("close").over(w.rowsBetween(-9, 0)), "n": F.lead("close", 3).over(w), "p": F.row_number().over(w)})
    s = fr.segment(bars, lookback=10, lookahead=3, rows=16)
    assert s.select("_chunk").distinct().count() > 10
    cut = fr.own(s.withColumns({"m": F.avg("close").over(fr.last_n(10)), "n": F.lead("close", 3).over(fr.over())}))
    _same(cut, whole, ["m", "n"])
    pos = fr.own(fr.segment(bars, rows=16).withColumn("p", fr.position()))
    _same(pos, whole, ["p"])


def test_carried_totals_and_tail(bars):
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = bars.withColumns({"s": F.sum("volume").over(w), "x": F.max("close").over(w)})
    c = fr.carried(bars, {"v": (F.sum, F.col("volume")), "m": (F.max, F.col("close"))})
    c = c.withColumns({"s": fr.running_sum("v", F.col("volume")), "x": fr.running_max("m", F.col("close"))})
    _same(c, whole, ["s", "x"])
    t = fr.tail(bars, 5)
    assert {r["symbol"]: r["count"] for r in t.groupBy("symbol").count().collect()} == {"HOT": 5, "B": 5, "C": 3}
    last = bars.groupBy("symbol").agg(F.max("ts").alias("ts"))
    assert t.filter("_back = 1").join(last, ["symbol", "ts"]).count() == 3


@pytest.mark.parametrize("q", [0.05, 0.5, 0.9])
def test_exact_quantile(bars, q):
    got = {r["symbol"]: r["v"] for r in fr.exact_quantile(bars, ["symbol"], "close", q, "v").collect()}
    for sym in ("HOT", "B", "C"):
        xs = [r["close"] for r in bars.filter(F.col("symbol") == sym).collect()]
        assert got[sym] == pytest.approx(float(np.quantile(xs, q)), abs=1e-9)


@pytest.mark.parametrize("accuracy", [20, 10000])
def test_quantiles_of_narrow_wide_and_tied_values(spark, accuracy):
    """Nearly constant, very wide and much repeated columns, nulls, a key with one value and one with none, in one call."""
    rng = np.random.default_rng(3)
    x = {"narrow": 1 + rng.normal(size=3000) * 1e-9, "wide": 10 ** rng.uniform(-200, 200, 3000), "tied": rng.integers(0, 3, 3000).astype(float)}
    rows = [("a", *(float(v[i]) for v in x.values())) for i in range(3000)] + [("a", None, None, None), ("one", 5.0, 5.0, 5.0), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "k string, narrow double, wide double, tied double").repartition(7)
    got = {(r.k, r.column_name): r.quantiles for r in fr.exact_quantiles(df, ["k"], list(x), [0.0, 0.05, 0.5, 0.75, 1.0], accuracy).collect()}
    assert got.keys() == {(k, c) for k in ("a", "one") for c in x}
    for c in x:
        assert got["a", c] == pytest.approx(np.quantile(x[c], [0.0, 0.05, 0.5, 0.75, 1.0]).tolist(), rel=1e-12)
        assert got["one", c] == [5.0] * 5


def test_ema_equals_pandas(bars):
    got = ind.ema(bars, (12,)).toPandas().sort_values(["symbol", "ts"])
    want = got.groupby("symbol")["close"].transform(lambda s: s.ewm(span=12).mean())
    assert np.allclose(got["ema_12"], want, rtol=1e-12)


def test_rsi_first_value_and_no_loss(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(20)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")
    r = [x["rsi_14"] for x in ind.rsi(b, (14,)).orderBy("ts").collect()]
    assert r[:13] == [None] * 13 and r[13:] == [100.0] * 7


@pytest.fixture(scope="module")
def dense(spark):
    start, rng = dt.datetime(2024, 3, 1), random.Random(3)
    rows = [(None if i % 3 == 0 else "S", start + dt.timedelta(minutes=i), rng.uniform(50, 150)) for i in range(20_000)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").cache()


def test_ema_stays_finite_on_minute_bars_of_one_month(dense):
    own = ind.ema(dense, (12,)).where("symbol = 'S'").orderBy("ts").toPandas()
    want = own["close"].ewm(span=12, adjust=True).mean()
    assert own["ema_12"].notna().all() and np.allclose(own["ema_12"], want, rtol=1e-9)


def test_dense_blocks_are_not_copied_and_null_symbols_stay(dense):
    laid = fr.segment(dense, lookback=480, rows=512)
    assert laid.count() == 20_000 and fr.own(laid).count() == 20_000
    day = F.dayofyear("ts")
    fine = fr.segment(dense, lookback=480, lookahead=5, rows=512, block=day)
    assert fr.segment(dense, lookback=480, rows=512, block=day).count() <= 2.5 * 20_000
    assert fine.count() <= 3 * 20_000 and fr.own(fine).count() == 20_000  # its own chunk, one before it and one after
    w = Window.partitionBy("symbol").orderBy("ts")
    whole = dense.withColumns({"m": F.avg("close").over(w.rowsBetween(-479, 0)), "n": F.lead("close", 5).over(w)})
    cut = fr.own(fine.withColumns({"m": F.avg("close").over(fr.last_n(480)), "n": F.lead("close", 5).over(fr.over())}))
    a, b = (x.orderBy(F.col("symbol").asc_nulls_first(), "ts").select("m", "n").toPandas() for x in (whole, cut))
    assert np.allclose(a, b, equal_nan=True)


def test_trend_of_flat_frames_is_null(spark):
    at = dt.datetime(2024, 1, 1)
    scores = [0.5] * 15 + [0.1 * i for i in range(10)]
    rows = [(i, "U", at + dt.timedelta(minutes=i), x) for i, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "event_id long, symbol string, ts timestamp_ntz, score double")
    got = [r.sentiment_trend for r in ind.sentiment_features(df).orderBy("event_id").collect()]
    assert got[:15] == [None] * 15 and got[24] == pytest.approx(1.0) and got[20] == pytest.approx(np.corrcoef(range(10), scores[11:21])[0, 1])
    got = [r.trend_strength for r in ind.trend_strength(df.withColumnRenamed("score", "close")).orderBy("ts").collect()]
    assert got[:15] == [None] * 15 and got[24] == pytest.approx(1.0)


@pytest.mark.parametrize("make", [ind.ema, ind.macd, ind.indicator_flags])
def test_exponential_means_share_a_sort(bars, make):
    plan = make(bars)._jdf.queryExecution().executedPlan().toString()
    final = [x for x in plan.split("\n") if "Sort [" in x and "_chunk" in x]
    assert 0 < len(final) <= 2, plan


def test_ema_of_short_and_long_spans_and_no_copies_of_short_symbols(bars):
    got = ind.ema(bars, (2, 200)).toPandas().sort_values(["symbol", "ts"])
    for n in (2, 200):
        want = got.groupby("symbol")["close"].transform(lambda s, n=n: s.ewm(span=n).mean())
        assert np.allclose(got[f"ema_{n}"], want, rtol=1e-12)
    long = bars.where("symbol = 'HOT'").unionByName(bars.where("symbol = 'HOT'").withColumn("ts", F.col("ts") + F.expr("interval 20 years")))
    assert np.allclose(ind.macd(long).orderBy("ts").toPandas()["macd"], (lambda c: c.ewm(span=12).mean() - c.ewm(span=26).mean())(long.orderBy("ts").toPandas()["close"]), atol=1e-9)


def test_rolling_statistics_across_chunks_batches_and_gaps(spark):
    rng = np.random.default_rng(4)
    n = 700
    close = pd.Series(rng.lognormal(size=3 * n)).where(rng.random(3 * n) > 0.01)
    close[100:170] = 5.0
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], n), "ts": np.tile(pd.date_range("2019-01-01", periods=n).date, 3), "close": close})
    d = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = ind.rolling_statistics(d)
        got = out.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "skewness" not in out._jdf.queryExecution().toString()  # no window goes through its rows for each measure
    for k in (5, 20, 50):
        r = pdf.groupby("symbol")["close"].rolling(k)
        for name, want in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max()), ("skew", r.skew()), ("kurt", r.kurt())):
            want = want.to_numpy()
            if name in ("skew", "kurt"):
                want = np.where(r.max().to_numpy() > r.min().to_numpy(), want, np.nan)
            assert np.allclose(got[f"{name}_{k}"].to_numpy(float), want, rtol=1e-6, atol=1e-6, equal_nan=True), (name, k)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.operators import indicators, risk


def long(spark, x, names=None):
    t, k = x.shape
    names = names or [f"S{i}" for i in range(k)]
    ts = pd.date_range("2020-01-01", periods=t).date
    rows = pd.DataFrame({"symbol": np.repeat(names, t), "ts": np.tile(ts, k), "r": x.T.ravel()})
    return spark.createDataFrame(rows.dropna())


def test_covariance_of_small_moves_keeps_its_digits(spark):
    rng = np.random.default_rng(1)
    x = 1e6 * (1 + 1e-6 * rng.standard_normal((300, 5)))
    y = x.astype(np.longdouble)
    want = (y - y.mean(0)).T @ (y - y.mean(0)) / 299
    for tiles in (1, 3):
        m = risk.pairwise_moments(long(spark, x), "r", tiles=tiles, blocks=4).collect()
        assert len(m) == 15
        for r in m:
            got = (r.sxy - r.sx * r.sy / r.n) / (r.n - 1)
            assert got == pytest.approx(float(want[int(r.a[1:]), int(r.b[1:])]), rel=1e-8, abs=1e-9)


def test_correlations_pairwise_complete_repeated_rows_and_flat_series(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 4))
    x[:, 1] += x[:, 0]
    x[::7, 2] = np.nan
    x[:, 3] = 12345.678
    d = long(spark, x)
    want = pd.DataFrame(x).corr().to_numpy()
    got = {(r.a, r.b): r for r in risk.correlations(d.unionByName(d), "r", tiles=2).collect()}
    assert len(got) == 6 and got["S0", "S2"].n == 80 - len(range(0, 80, 7))
    for (a, b), r in got.items():
        if "S3" in (a, b):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want[int(a[1]), int(b[1])], abs=1e-12)
    assert [(r.a, r.b) for r in risk.correlations(d, "r", least=0.5).collect()] == [("S0", "S1")]
    top = {(r.a, r.b) for r in risk.correlations(d, "r", most=1).collect()}
    best = max((p for p in got if "S2" in p and "S3" not in p), key=lambda p: abs(got[p].correlation))
    assert top == {("S0", "S1"), best}
    assert risk.correlations(d.limit(0), "r").count() == 0


def test_drawdown_joins_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, (400, 3))
    x[0, 1] = -0.5  # a fall on the first day has no peak before it
    got = {r.symbol: r.max_drawdown for r in risk.return_drawdown(long(spark, x)).collect()}
    fine = {r.symbol: r.max_drawdown for r in risk.return_drawdown(long(spark, x), block=F.col("ts")).collect()}
    for i in range(3):
        c = np.cumprod(1 + x[:, i])
        want = abs((c / np.maximum.accumulate(c) - 1).min())
        assert got[f"S{i}"] == pytest.approx(want, rel=1e-9) and fine[f"S{i}"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("accuracy", [10, 10000])
def test_tail_measures_against_numpy(spark, accuracy, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_t(3, (500, 2)) * 0.01
    x[:, 1] = np.round(x[:, 1], 2)  # many ties
    x[20:, 1] = np.nan if accuracy == 10000 else x[20:, 1]
    whole = fr.tails
    monkeypatch.setattr(fr, "tails", lambda *a: whole(*a, accuracy=accuracy))
    for q in (0.05, 0.4):
        for r in risk.tail_measures(long(spark, x), ["symbol"], q=q, carry=[F.max("r").alias("top")]).collect():
            v = x[:, int(r.symbol[1])]
            v = v[~np.isnan(v)]
            quantile = np.quantile(v, q)
            var = 0.0 if len(v) < 30 else min(v.mean() - risk.Z95 * v.std(ddof=1), quantile)
            assert r.n_returns == len(v) and r.top == v.max() and r["quantile"] == pytest.approx(quantile, abs=1e-15)
            assert r["var"] == pytest.approx(var, abs=1e-12) and r.n_tail == (v <= var).sum()
            assert r.expected_shortfall == pytest.approx(v[v <= var].mean()) and r.quantile_mean == pytest.approx(v[v <= r["quantile"]].mean())


def test_dense_block_is_cut(spark):
    """A million ticks of one symbol in one month, half of them in one hour: no chunk takes more than twice its rows."""
    n, rows = 1_000_000, 65536
    at = F.when(F.col("id") % 2 == 0, F.col("id") * 3000).otherwise(F.col("id") * 2_500_000)
    ticks = spark.range(n).select(F.lit("A").alias("symbol"), F.timestamp_micros(at + 1_700_000_000_000_000).alias("ts"), (F.col("id") % 997).cast("double").alias("close"))
    cut = fr.cut_dense(ticks, rows=rows)
    laid = fr.segment(cut, 19, rows=rows)
    sizes = [r["count"] for r in laid.groupBy("_chunk").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2 * rows
    s = laid.withColumn("m", fr.mean_n(F.col("close"), 20)).select("symbol", "ts", "close", "m", "_own", "_chunk", "_off", "_n")
    got = fr.own(s).agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("m"), F.sum("m").alias("s")).first()
    p = ticks.orderBy("ts").toPandas()["close"].rolling(20).mean()
    assert (got.n, got.m) == (n, n - 19) and got.s == pytest.approx(p.sum(), rel=1e-9)


def test_cut_table_gives_the_same_indicator(spark):
    x = 100 + np.random.default_rng(5).standard_normal((300, 2)).cumsum(0)
    bars = long(spark, x).withColumnRenamed("r", "close")
    cut = fr.cut_dense(bars, rows=5)
    assert cut.select(fr.FINE).distinct().count() > bars.select(fr.month_block()).distinct().count()
    a, b = (sorted(map(tuple, indicators.sma(d).drop(fr.FINE).collect())) for d in (bars, cut))
    assert len(a) == 600 and repr(a) == repr(b)


def test_pairs_are_emitted_once_and_not_shuffled(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 30))
    x[::3, 4] = np.nan
    d = long(spark, x).unionByName(long(spark, x).limit(1).withColumn("ts", F.lit(None).cast("date")))
    m = risk.pairwise_moments(d, "r", tiles=12, blocks=5)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow"), plan
    rows = m.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == 30 * 31 // 2 and all(r.a <= r.b for r in rows)
    want = pd.DataFrame(x, columns=[f"S{i}" for i in range(30)]).cov()
    for r in rows:
        if r.n == 40:
            assert (r.sxy - r.sx * r.sy / r.n) / (r.n - 1) == pytest.approx(want[r.a][r.b], abs=1e-12)
        else:
            assert "S4" in (r.a, r.b) and r.n == 26


def test_quantiles_of_short_keys_keep_few_values(spark):
    d = long(spark, np.random.default_rng(9).standard_normal((600, 6)))
    cut = F.avg("r") - F.stddev_samp("r")
    for counts in (fr.tail_counts(d, ["symbol"], "r", 0.05, cut), fr.quantile_counts(d, ["symbol"], ["r"], [0.05])):
        assert counts.count() < 0.06 * 3600


def test_cells_are_written_once_however_many_tiles(spark):
    """a27: a cell was sent once for each tile that its own one meets."""
    x = np.random.default_rng(10).standard_normal((60, 24))
    x[::5, 3] = np.nan
    d = long(spark, x)
    got = risk.correlations(d.unionByName(d.withColumn("symbol", F.lit(None).cast("string"))), "r", tiles=9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and "Aggregate" not in plan, plan
    want = pd.DataFrame(x, columns=[f"S{i}" for i in range(24)]).corr()
    rows = got.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == 24 * 23 // 2 and all(r.a < r.b for r in rows)
    for r in rows:
        assert r.correlation == pytest.approx(want[r.a][r.b], abs=1e-12) and r.n == (48 if "S3" in (r.a, r.b) else 60)


def test_pieces_of_tiles_and_times_give_every_pair_once(spark, monkeypatch):
    for name, v in (("STRIP", 5), ("SPAN", 7), ("NAMES", 12), ("CELLS", 300)):
        monkeypatch.setattr(risk, name, v)
    x = np.random.default_rng(11).standard_normal((40, 33))
    x[:9, 4] = np.nan
    want = pd.DataFrame(x, columns=[f"S{i}" for i in range(33)]).cov()
    rows = risk.pairwise_moments(long(spark, x), "r").collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == 33 * 34 // 2 and all(r.a <= r.b for r in rows)
    for r in rows:
        assert r.n == (31 if "S4" in (r.a, r.b) else 40)
        assert (r.sxy - r.sx * r.sy / r.n) / (r.n - 1) == pytest.approx(want[r.a][r.b], abs=1e-12)


def test_long_series_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(12).standard_normal((50, 6))
    d = long(spark, x)
    holdings = spark.createDataFrame([(f"S{i}", float(i + 1)) for i in range(6)], "symbol string, market_value double")
    views = spark.createDataFrame([("S1", 0.3)], "symbol string, view double")

    def found():
        frames = (risk.correlations(d, "r"), risk.covariance(d), risk.shrunk_covariance(d), risk.equilibrium_returns(risk.covariance(d, blocks=True), holdings, views))
        return [sorted(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in f.collect()) for f in frames]

    short = found()
    monkeypatch.setattr(risk, "LONG", 0)
    assert [len(f) for f in short] == [15, 21, 21, 6] and found() == short


def numbered(spark, d):
    """The rows of ``d`` and the number of times a row of it was computed."""
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    return d.select("symbol", "ts", F.udf(noted, "double")("r").alias("r")), seen


def test_covariance_computes_its_returns_once(spark):
    """a28: rows, dates and symbols were counted over returns computed anew each time."""
    x = np.random.default_rng(13).standard_normal((35, 4))
    d, seen = numbered(spark, long(spark, x))
    got = {(r.a, r.b): r.covariance for r in risk.covariance(d, tiles=3).collect()}
    want = np.cov(x.T)
    assert len(got) == 10 and seen.value == 140
    for (a, b), c in got.items():
        assert c == pytest.approx(want[int(a[1]), int(b[1])], abs=1e-12)


def test_shrunk_covariance_computes_its_returns_once(spark):
    """a29: the totals took the pairs anew, from returns computed anew."""
    x = np.random.default_rng(14).standard_normal((40, 5)) * [1, 2, 3, 4, 5]
    d, seen = numbered(spark, long(spark, x))
    rows = risk.shrunk_covariance(d, tiles=2).collect()
    y = x - x.mean(0)
    s = y.T @ y / 40
    mu, p = np.trace(s) / 5, 5
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((y**2).sum(1) ** 2).sum() / 40 - (s**2).sum(), delta * p * 40) / (p * 40)
    assert len(rows) == 15 and seen.value == 200
    for r in rows:
        i, j = int(r.a[1]), int(r.b[1])
        assert r.shrinkage == pytest.approx(beta / delta, rel=1e-9)
        assert r.covariance == pytest.approx((1 - beta / delta) * s[i, j] + (beta / delta * mu if i == j else 0), abs=1e-12)


def test_equilibrium_returns_of_blocks(spark):
    """g23: pairs were rows that met their weights one at a time; a matrix meets them as a vector."""
    x = np.random.default_rng(15).standard_normal((40, 30))
    held = [(f"S{i}", float(i)) for i in range(28)] + [("S5", 7.0), ("S6", None), (None, 3.0), ("other", 2.0), ("S28", None)]
    holdings = spark.createDataFrame(held, "symbol string, market_value double")
    views = spark.createDataFrame([("S1", 0.3), ("S29", None)], "symbol string, view double")
    d = long(spark, x)
    got = risk.equilibrium_returns(risk.covariance(d, tiles=4, blocks=True), holdings, views)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan, plan
    rows = {r.symbol: r for r in got.collect()}
    w = np.array([i + 7.0 * (i == 5) if i < 28 else 0.0 for i in range(30)])
    want = 3 * np.cov(x.T) @ (w / (w.sum() + 5.0))
    assert len(rows) == 30
    for s, r in rows.items():
        i = int(s[1:])
        assert r.equilibrium_return == pytest.approx(want[i], rel=1e-9, abs=1e-12)
        assert r.expected_return == pytest.approx(0.5 * want[i] + 0.15 if i == 1 else want[i], rel=1e-9, abs=1e-12)
    by_pair = {r.symbol: r for r in risk.equilibrium_returns(risk.covariance(d), holdings, views).collect()}
    assert {s: f"{r.equilibrium_return:.9g}" for s, r in by_pair.items()} == {s: f"{r.equilibrium_return:.9g}" for s, r in rows.items()}
    none = spark.createDataFrame([("S0", None), ("S1", None)], "symbol string, market_value double")
    assert {r.equilibrium_return for r in risk.equilibrium_returns(risk.covariance(d, tiles=4, blocks=True), none, views).collect()} == {None}
    assert risk.equilibrium_returns(risk.covariance(d.limit(20), blocks=True), holdings, views).count() == 0

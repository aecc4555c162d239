"""Price and volume indicators. Every ``add_*`` works on a segmented frame; the public operators lay out,
compute and trim."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div, guarded, lag, last_n, max_n, mean_n, min_n, over, own, pct_change, segment, std_n
from tapeloom.functions.special import EMA_ROWS, ema_reach, ewm_mean, ewm_stretch, span_alpha

YEAR = math.sqrt(252.0)


def close() -> Column:
    return F.col("close")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


def open_() -> Column:
    return F.col("open")


def vol() -> Column:
    return F.col("volume")


def zero() -> Column:
    return F.lit(0.0)


def returns(bars: DataFrame, ks=(1, 5, 20)) -> DataFrame:
    """Simple and log returns over k bars."""
    s = segment(bars, lookback=max(ks))
    for k in ks:
        s = s.withColumn(f"return_{k}", pct_change(close(), k)).withColumn(f"log_return_{k}", F.ln(div(close(), lag(close(), k))))
    return own(s)


def add_sma(s: DataFrame, ns) -> DataFrame:
    for n in ns:
        s = s.withColumn(f"sma_{n}", mean_n(close(), n)).withColumn(f"price_to_sma_{n}", div(close(), F.col(f"sma_{n}")))
    return s


def sma(bars: DataFrame, ns=(5, 10, 20, 50)) -> DataFrame:
    return own(add_sma(segment(bars, lookback=max(ns)), ns))


def ema(bars: DataFrame, spans=(12, 26)) -> DataFrame:
    """Exponential mean with pandas ``adjust=True`` weights."""
    reach = max(ema_reach(span_alpha(n)) for n in spans)
    s = ewm_stretch(segment(bars, lookback=reach, rows=max(EMA_ROWS, reach)), reach)
    for n in spans:
        s = s.withColumn(f"ema_{n}", ewm_mean(close(), span_alpha(n), reach))
    return own(s).drop("_k", "_e")


MACD_STRETCH = ema_reach(span_alpha(26))
MACD_REACH = MACD_STRETCH + ema_reach(span_alpha(9))


def add_macd(s: DataFrame) -> DataFrame:
    """Works on a frame of `ewm_stretch` with stretches of `MACD_STRETCH`."""
    e = lambda c, span: ewm_mean(c, span_alpha(span), MACD_STRETCH)
    s = s.withColumn("macd", e(close(), 12) - e(close(), 26))
    s = s.withColumn("macd_signal", e(F.col("macd"), 9))
    return s.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def macd(bars: DataFrame) -> DataFrame:
    return own(add_macd(ewm_stretch(segment(bars, lookback=MACD_REACH, rows=EMA_ROWS), MACD_STRETCH))).drop("_k", "_e")


def _rsi_of(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain/loss): 100 without losses, null without any move."""
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(100 - div(F.lit(100.0), 1 + div(gain, loss)))


def add_rsi(s: DataFrame, n: int = 14, out: str = "rsi", price: str = "close") -> DataFrame:
    """Simple-mean RSI; the first bar counts as no change, so values start at bar ``n``."""
    s = s.withColumn("_d", F.col(price) - F.lag(price, 1).over(over()))
    s = s.withColumn("_g", F.when(F.col("_d") > 0, F.col("_d")).otherwise(zero()))
    s = s.withColumn("_l", F.when(F.col("_d") < 0, -F.col("_d")).otherwise(zero()))
    return s.withColumn(out, _rsi_of(mean_n(F.col("_g"), n), mean_n(F.col("_l"), n))).drop("_d", "_g", "_l")


def rsi(bars: DataFrame, ns=(14, 21)) -> DataFrame:
    s = segment(bars, lookback=max(ns) + 1)
    for n in ns:
        s = add_rsi(s, n, f"rsi_{n}")
    return own(s)


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder-smoothed RSI: seed is the mean of the first ``n`` changes, then alpha = 1/n."""
    a = 1.0 / n
    # Chunks short enough for weighted running sums, numbered from their first row.
    s = segment(bars, lookback=ema_reach(a) + 1, rows=512).withColumn("_k", F.row_number().over(over())).withColumn("_pos", fr.position())
    s = s.withColumn("_d", close() - lag(close()))
    rel = F.col("_k") - 1
    # A change before the seed point (bar n + 1) counts with the weight it has there: 1/n.
    origin = F.when(F.col("_pos") <= n + 1, F.lit(a) * F.pow(F.lit(1 / (1 - a)), (n + F.col("_k") - F.col("_pos")).cast("double"))).otherwise(
        F.lit(a) * F.pow(F.lit(1 / (1 - a)), rel.cast("double"))
    )
    w = over().rowsBetween(Window.unboundedPreceding, 0)
    fade = F.pow(F.lit(1 - a), rel.cast("double"))
    for name, x in (("_g", F.greatest(F.col("_d"), zero())), ("_l", F.greatest(-F.col("_d"), zero()))):
        s = s.withColumn(name, F.sum(F.coalesce(x, zero()) * origin).over(w) * fade)
    g, l = F.col("_g"), F.col("_l")
    value = F.when(g + l == 0, zero()).otherwise(100 * div(g, g + l))
    return own(s.withColumn("rsi_wilder", F.when(F.col("_pos") > n, value))).drop("_k", "_d", "_g", "_l", "_pos")


def add_bollinger(s: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    s = s.withColumn("bb_mid", mean_n(close(), n)).withColumn("_sd", std_n(close(), n))
    m, sd = F.col("bb_mid"), F.col("_sd")
    return (
        s.withColumn("bb_upper", m + k * sd).withColumn("bb_lower", m - k * sd)
        .withColumn("bb_width", F.col("bb_upper") - F.col("bb_lower"))
        .withColumn("bb_width_rel", div(F.col("bb_width"), m))
        .withColumn("bb_position", div(close() - F.col("bb_lower"), F.col("bb_width")))
        .drop("_sd")
    )


def bollinger(bars: DataFrame, n: int = 20) -> DataFrame:
    return own(add_bollinger(segment(bars, lookback=n), n))


def add_atr(s: DataFrame, n: int = 14) -> DataFrame:
    pc = lag(close())
    s = s.withColumn("true_range", F.greatest(high() - low(), F.abs(high() - pc), F.abs(low() - pc)))
    return s.withColumn("atr", mean_n(F.col("true_range"), n)).withColumn("atr_ratio", div(F.col("atr"), close()))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return own(add_atr(segment(bars, lookback=n + 1), n))


def add_adx(s: DataFrame, n: int = 14) -> DataFrame:
    up, down = high() - lag(high()), lag(low()) - low()
    s = add_atr(s, n)
    s = s.withColumn("_up", up).withColumn("_dn", down)
    u, d = F.col("_up"), F.col("_dn")
    s = s.withColumn("_pdm", F.when((u > d) & (u > 0), u).otherwise(zero()))
    s = s.withColumn("_mdm", F.when((d > u) & (d > 0), d).otherwise(zero()))
    s = s.withColumn("plus_di", 100 * div(mean_n(F.col("_pdm"), n), F.col("atr")))
    s = s.withColumn("minus_di", 100 * div(mean_n(F.col("_mdm"), n), F.col("atr")))
    p, m = F.col("plus_di"), F.col("minus_di")
    s = s.withColumn("_dx", 100 * div(F.abs(p - m), p + m))
    return s.withColumn("adx", mean_n(F.col("_dx"), n)).drop("_up", "_dn", "_pdm", "_mdm", "_dx")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return own(add_adx(segment(bars, lookback=2 * n + 1), n))


def stochastic(bars: DataFrame, n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    s = segment(bars, lookback=n + smooth_k + smooth_d)
    lo, hi = min_n(low(), n), max_n(high(), n)
    s = s.withColumn("_fast", F.when(hi == lo, zero()).otherwise(100 * div(close() - lo, hi - lo)))
    s = s.withColumn("stoch_k_raw", mean_n(F.col("_fast"), smooth_k))
    s = s.withColumn("stoch_d", mean_n(F.col("stoch_k_raw"), smooth_d))
    # %K is reported from the bar on which %D exists.
    return own(s.withColumn("stoch_k", F.when(F.col("stoch_d").isNotNull(), F.col("stoch_k_raw")))).drop("_fast", "stoch_k_raw")


def williams_r(bars: DataFrame, ns=(14, 21)) -> DataFrame:
    s = segment(bars, lookback=max(ns))
    for n in ns:
        hi, lo = max_n(high(), n), min_n(low(), n)
        s = s.withColumn(f"williams_r_{n}", div(-100 * (hi - close()), hi - lo))
    return own(s)


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    s = segment(bars, lookback=n).withColumn("_tp", (high() + low() + close()) / 3)
    s = s.withColumn("_m", mean_n(F.col("_tp"), n)).withColumn("_xs", F.collect_list("_tp").over(last_n(n)))
    mad = F.aggregate("_xs", zero(), lambda acc, x: acc + F.abs(x - F.col("_m"))) / n
    dev = F.col("_tp") - F.col("_m")
    # A window whose deviations are only rounding noise is flat: 0.
    flat = mad <= F.abs(F.col("_m")) * 1e-12
    value = F.when(F.col("_m").isNotNull(), F.when(flat, zero()).otherwise(div(dev, 0.015 * mad)))
    return own(s.withColumn("cci", value)).drop("_tp", "_m", "_xs")


def rate_of_change(bars: DataFrame, ns=(5, 10, 20)) -> DataFrame:
    s = segment(bars, lookback=max(ns))
    for n in ns:
        s = s.withColumn(f"roc_{n}", pct_change(close(), n) * 100)
    return own(s)


def add_volatility(s: DataFrame, ns, annualise: bool = True) -> DataFrame:
    s = s.withColumn("_r", pct_change(close()))
    for n in ns:
        s = s.withColumn(f"volatility_{n}", std_n(F.col("_r"), n) * (YEAR if annualise else 1.0))
    return s.drop("_r")


def volatility(bars: DataFrame, ns=(5, 10, 20, 60), annualise: bool = True) -> DataFrame:
    s = add_volatility(segment(bars, lookback=max(ns) + 1), ns, annualise)
    s = s.withColumn("volatility_ratio_20_60", div(F.col("volatility_20"), F.col("volatility_60")))
    return own(s.withColumn("volatility_ratio_5_20", div(F.col("volatility_5"), F.col("volatility_20"))))


def realized_volatility(bars: DataFrame, ns=(5, 20)) -> DataFrame:
    s = segment(bars, lookback=max(ns) + 1).withColumn("_r", F.ln(div(close(), lag(close()))))
    for n in ns:
        s = s.withColumn(f"realized_vol_{n}", guarded(F.stddev_pop, F.col("_r"), n) * YEAR)
    return own(s).drop("_r")


def volatility_regime(bars: DataFrame) -> DataFrame:
    v = F.col("realized_vol_20")
    return realized_volatility(bars, (20,)).withColumn(
        "vol_regime", F.when(v < 0.15, "low").when(v < 0.30, "normal").when(v.isNotNull(), "high")
    )


def _log_returns(bars: DataFrame) -> DataFrame:
    return own(segment(bars, lookback=1).withColumn("r", F.ln(div(close(), lag(close())))))


def ewma_volatility(bars: DataFrame, lam: float = 0.94) -> DataFrame:
    """Newest return weighs most. The weight decays with the distance from the last bar, so the sum is a plain
    aggregate over rows whose distance is known from block counts."""
    s = segment(bars, lookback=1).withColumn("r", F.ln(div(close(), lag(close())))).withColumn("_pos", fr.position())
    s = s.filter((F.col("_chunk") == F.col("_own")) & F.col("r").isNotNull())
    wt = F.pow(F.lit(lam), (F.col("_n") - F.col("_pos")).cast("double"))
    g = s.groupBy("symbol").agg(F.sum(wt * F.col("r") ** 2).alias("_a"), F.sum(wt).alias("_w"), F.count("r").alias("n_returns"))
    return g.select(
        "symbol", "n_returns", F.when(F.col("n_returns") >= 9, F.sqrt(F.col("_a") / F.col("_w") * 252)).alias("ewma_vol")
    )


def garch_volatility(bars: DataFrame, alpha: float = 0.06, beta: float = 0.92, steps: int = 20) -> DataFrame:
    """Closed form of the variance recursion over the last ``steps`` returns, started from the whole-series variance."""
    s = segment(bars, lookback=1).withColumn("r", F.ln(div(close(), lag(close())))).withColumn("_pos", fr.position())
    s = s.filter((F.col("_chunk") == F.col("_own")) & F.col("r").isNotNull())
    back = F.col("_n") - F.col("_pos")
    shock = F.when(back < steps, F.pow(F.lit(beta), back.cast("double")) * alpha * F.col("r") ** 2)
    g = s.groupBy("symbol").agg(F.var_pop("r").alias("_v"), F.sum(shock).alias("_s"), F.count("r").alias("n_returns"))
    bn = beta**steps
    sigma2 = F.col("_v") * (1 - alpha - beta) * ((1 - bn) / (1 - beta)) + F.col("_s") + bn * F.col("_v")
    return g.select("symbol", "n_returns", F.when(F.col("n_returns") >= 29, F.sqrt(sigma2 * 252)).alias("garch_vol"))


def high_low_distance(bars: DataFrame, n: int = 20) -> DataFrame:
    s = segment(bars, lookback=n)
    s = s.withColumn("distance_from_high", div(max_n(high(), n) - close(), close()))
    return own(s.withColumn("distance_from_low", div(close() - min_n(low(), n), close())))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Deepest fall of the close below its running maximum, per symbol."""
    b = fr.carried(bars, {"peak": (F.max, close())})
    b = b.withColumn("_dd", div(close() - fr.running_max("peak", close()), fr.running_max("peak", close())))
    return b.groupBy("symbol").agg(F.abs(F.min("_dd")).alias("max_drawdown"))


def risk_ratios(bars: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Sharpe and Sortino from log returns, population deviations."""
    r = _log_returns(bars).filter(F.col("r").isNotNull())
    ex = F.col("r") - risk_free / 252
    g = r.groupBy("symbol").agg(
        F.avg(ex).alias("_m"), F.stddev_pop("r").alias("_s"), F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("_ds"),
        F.count("r").alias("n_returns"),
    )
    return g.select(
        "symbol", "n_returns",
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * YEAR).alias("sharpe"),
        F.when(F.col("_ds") > 0, F.col("_m") / F.col("_ds") * YEAR).alias("sortino"),
    )


def historical_var(bars: DataFrame, confidence: float = 0.95, horizon: int = 1) -> DataFrame:
    """Empirical return quantile scaled by the square root of the horizon."""
    r = _log_returns(bars).filter(F.col("r").isNotNull())
    q = fr.exact_quantile(r, ["symbol"], "r", round(1 - confidence, 10), "var")
    return q.withColumn("var", F.abs(F.col("var") * math.sqrt(horizon)))


def volume_features(bars: DataFrame) -> DataFrame:
    s = segment(bars, lookback=20)
    s = s.withColumn("volume_sma", mean_n(vol(), 20)).withColumn("volume_ratio", div(vol(), F.col("volume_sma")))
    s = s.withColumn("volume_trend", div(mean_n(vol(), 5), F.col("volume_sma")))
    return own(s.withColumn("dollar_volume", close() * vol()))


def momentum(bars: DataFrame) -> DataFrame:
    s = segment(bars, lookback=20)
    s = s.withColumn("momentum_5", pct_change(close(), 5)).withColumn("momentum_20", pct_change(close(), 20))
    return own(s.withColumn("momentum_acceleration", F.col("momentum_5") - F.col("momentum_20")))


def candle_shape(bars: DataFrame) -> DataFrame:
    return bars.select(
        "symbol", "ts",
        div(high() - low(), close()).alias("spread"),
        div(F.abs(close() - open_()), close()).alias("body_size"),
        div(high() - F.greatest(open_(), close()), close()).alias("upper_shadow"),
        div(F.least(open_(), close()) - low(), close()).alias("lower_shadow"),
        div(high(), low()).alias("high_low_ratio"),
        div(close() - low(), high() - low()).alias("close_position"),
    )


def local_extremes(bars: DataFrame, half: int = 2) -> DataFrame:
    """Flags where the close is the extreme of a centred frame; false where the frame is incomplete."""
    s = segment(bars, lookback=half, lookahead=half)
    w = over().rowsBetween(-half, half)
    full = F.count(close()).over(w) == 2 * half + 1
    s = s.withColumn("local_max", full & (F.max(close()).over(w) == close()))
    return own(s.withColumn("local_min", full & (F.min(close()).over(w) == close())))


def _corr(x: Column, y: Column, w) -> Column:
    """Correlation over a frame, null where either side is flat. `F.corr` is computed on every frame, also on those a condition
    around it leaves out, and its division by zero there is an error."""
    return div(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def add_trend_strength(s: DataFrame, n: int = 10, c: str = "close", out: str = "trend_strength") -> DataFrame:
    """Correlation of the value with its position in the frame."""
    c = F.col(c)
    s = s.withColumn("_i", F.row_number().over(over()).cast("double"))
    w = last_n(n)
    ok = (F.count(c).over(w) >= n) & (F.max(c).over(w) > F.min(c).over(w))
    return s.withColumn(out, F.when(ok, _corr(F.col("_i"), c, w))).drop("_i")


def trend_strength(bars: DataFrame, n: int = 10) -> DataFrame:
    return own(add_trend_strength(segment(bars, lookback=n), n))


def rolling_statistics(bars: DataFrame, ns=(5, 10, 20, 50), c: str = "close") -> DataFrame:
    """Rolling mean, std, min, max and bias-corrected skew and kurtosis, as doubles; null until n values are present.

    The windows of a batch of rows are rows of an array: a sliding window of Spark would go through each of its rows anew for every measure.
    """
    cols, names = bars.columns, [f"{k}_{n}" for n in ns for k in ("mean", "std", "min", "max", "skew", "kurt")]
    s = segment(bars, lookback=max(ns)).withColumns({"_at": F.row_number().over(over()), "_x": F.col(c).cast("double")})

    def measures(w: np.ndarray, n: int) -> list[tuple]:
        with np.errstate(all="ignore"):
            odd = np.isnan(w)
            least, most = np.fmin.reduce(w, axis=1), w.max(axis=1)  # NaN is the largest value
            varied = np.where(odd.any(axis=1), ~odd.all(axis=1), most > least)
            mean = w.sum(axis=1) / n
            d = w - mean[:, None]
            d2 = d * d
            m2, m3, m4 = d2.sum(axis=1), (d2 * d).sum(axis=1), (d2 * d2).sum(axis=1)
            skew = math.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2) * (math.sqrt(n * (n - 1)) / (n - 2))
            kurt = ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
            varied &= m2 != 0
            return [(mean, True), (np.sqrt(m2 / (n - 1)), True), (least, True), (most, True), (skew, varied), (kurt, varied)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = max(ns) - 1
        x, known = np.zeros(reach), np.zeros(reach, bool)
        for b in batches:
            col = b.column("_x")
            x = np.concatenate([x[len(x) - reach:], pc.fill_null(col, 0.0).to_numpy(zero_copy_only=False)])
            known = np.concatenate([known[len(known) - reach:], pc.is_valid(col).to_numpy(zero_copy_only=False)])
            mine = np.flatnonzero(b.column("_own").to_numpy(zero_copy_only=False) == b.column("_chunk").to_numpy(zero_copy_only=False))
            at, out = b.column("_at").to_numpy(zero_copy_only=False)[mine], []
            for n in ns:
                full = np.lib.stride_tricks.sliding_window_view(known, n)[mine + reach - n + 1].all(axis=1) & (at >= n)
                for v, ok in measures(np.lib.stride_tricks.sliding_window_view(x, n)[mine + reach - n + 1], n):
                    out.append(pa.array(v, pa.float64(), mask=~(full & ok)))
            kept = b.select(cols).take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns, *out], names=[*cols, *names])

    fields = [*bars.schema.fields, *(T.StructField(name, T.DoubleType()) for name in names)]
    return s.select(*cols, "_own", "_chunk", "_at", "_x").mapInArrow(work, T.StructType(fields))


def lag_features(bars: DataFrame, c: str = "close") -> DataFrame:
    x = F.col(c)
    s = segment(bars, lookback=50)
    for k in (1, 2, 3, 5, 10):
        s = s.withColumn(f"lag_{k}", lag(x, k))
    s = s.withColumn("diff_1", x - lag(x, 1)).withColumn("diff_2", x - lag(x, 2)).withColumn("pct_change_1", pct_change(x))
    for n in (20, 50):
        s = s.withColumn(f"zscore_{n}", div(x - mean_n(x, n), std_n(x, n)))
    return own(s)


def rolling_loose(bars: DataFrame, n: int = 20, c: str = "close") -> DataFrame:
    """Rolling mean/std/sum/min/max from the first row on (``min_periods=1``)."""
    x, w = F.col(c), last_n(n)
    s = segment(bars, lookback=n)
    for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("sum", F.sum), ("min", F.min), ("max", F.max)):
        s = s.withColumn(f"{c}_{name}", fn(x).over(w))
    return own(s)


def add_targets(s: DataFrame, horizons=(1, 5, 10, 20)) -> DataFrame:
    s = s.withColumn("_r", pct_change(close()))
    for h in horizons:
        fut = F.lead(close(), h).over(over())
        s = s.withColumn(f"target_return_{h}", div(fut, close()) - 1)
        # A missing future compares as not greater: 0, never null.
        s = s.withColumn(f"target_direction_{h}", F.coalesce((F.col(f"target_return_{h}") > 0).cast("int"), F.lit(0)))
        if h > 1:
            w = over().rowsBetween(1, h)
            s = s.withColumn(f"target_volatility_{h}", F.when(F.count("_r").over(w) >= h, F.stddev_samp("_r").over(w)))
    return s.drop("_r")


def targets(bars: DataFrame, horizons=(1, 5, 10, 20)) -> DataFrame:
    return own(add_targets(segment(bars, lookback=1, lookahead=max(horizons)), horizons))


def regime_per_bar(bars: DataFrame) -> DataFrame:
    """Regime from the 20 bars before each bar: trending when they moved more than 10 percent, else normal."""
    s = segment(bars, lookback=20)
    w = over().rowsBetween(-20, -1)
    move = div(F.last(close()).over(w), F.first(close()).over(w)) - 1
    trending = (F.count(close()).over(w) == 20) & (F.abs(move) > 0.1)
    return own(s.withColumn("regime", F.when(trending, "trending").otherwise("normal")))


def volume_flow(bars: DataFrame) -> DataFrame:
    """On-balance volume and accumulation / distribution, as running sums over blocks."""
    s = own(segment(bars, lookback=1).withColumn("_pc", lag(close())))
    signed = F.when(F.col("_pc").isNull(), vol()).when(close() > F.col("_pc"), vol()).when(close() < F.col("_pc"), -vol()).otherwise(zero())
    mf = F.when(high() == low(), zero()).otherwise(div((close() - low()) - (high() - close()), high() - low()) * vol())
    s = s.withColumn("_sv", signed).withColumn("_mf", mf)
    s = fr.carried(s, {"obv": (F.sum, F.col("_sv")), "ad": (F.sum, F.col("_mf"))})
    s = s.withColumn("obv", fr.running_sum("obv", F.col("_sv"))).withColumn("ad", fr.running_sum("ad", F.col("_mf")))
    return fr.drop_layout(s).drop("_pc", "_sv", "_mf")


def indicator_flags(bars: DataFrame) -> DataFrame:
    """Threshold and crossing flags on RSI, MACD, bands and moving averages."""
    s = add_bollinger(add_sma(add_rsi(segment(bars, lookback=MACD_REACH + 2, rows=EMA_ROWS)), (20, 50)))
    s = s.withColumn("rsi_divergence", F.col("rsi") - lag("rsi"))
    s = add_macd(ewm_stretch(s, MACD_STRETCH))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    s = s.withColumn("rsi_oversold", flag(F.col("rsi") < 30)).withColumn("rsi_overbought", flag(F.col("rsi") > 70))
    s = s.withColumn("macd_cross", flag(F.col("macd") > F.col("macd_signal")))
    s = s.withColumn("macd_divergence", F.col("macd_histogram") - F.lag("macd_histogram").over(over(order=("_e", *fr.ORDER))))
    s = s.withColumn("bb_breakout_up", flag(close() > F.col("bb_upper"))).withColumn("bb_breakout_down", flag(close() < F.col("bb_lower")))
    return own(s.withColumn("sma_cross", flag(F.col("sma_20") > F.col("sma_50")))).drop("_k", "_e")


def historical_volatility(bars: DataFrame, default: float = 0.25) -> DataFrame:
    """Annualised sample deviation of all log returns; symbols with under 20 bars get the default."""
    r = _log_returns(bars)
    return r.groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) >= 20, F.stddev_samp("r") * YEAR).otherwise(F.lit(default)).alias("hist_vol")
    )


def sequences(bars: DataFrame, n: int = 20, features=("close", "volume")) -> DataFrame:
    """Sliding feature windows of the ``n`` bars before each bar with the bar's close as aligned target."""
    s = segment(bars, lookback=n)
    w = over().rowsBetween(-n, -1)
    s = s.withColumn("window", F.collect_list(F.struct(*features)).over(w))
    return own(s.filter(F.size("window") == n)).select("symbol", "ts", "window", F.col("close").alias("target"))


def history_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars of a date range with returns and their 20-bar annualised volatility (the filter reaches the scan)."""
    b = bars.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    s = segment(b, lookback=21).withColumn("daily_return", pct_change(close()))
    return own(s.withColumn("volatility_20", std_n(F.col("daily_return"), 20) * YEAR))


def symbol_regime(bars: DataFrame) -> DataFrame:
    """Regime per symbol at its last bar: recent against long volatility, then the 20-bar move."""
    r = own(segment(bars, lookback=1).withColumn("r", pct_change(close())))
    long = r.groupBy("symbol").agg(F.stddev_samp("r").alias("_long"), F.count(F.lit(1)).alias("n_bars"))
    recent = fr.tail(r, 20).groupBy("symbol").agg(
        F.stddev_samp("r").alias("_recent"),
        (div(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("_move"),
    )
    j = long.join(recent, "symbol")
    return j.select(
        "symbol",
        F.when(F.col("n_bars") < 20, "normal")
        .when(F.col("_recent") > F.col("_long") * 1.5, "volatile")
        .when(F.abs("_move") > 0.1, "trending")
        .when(F.col("_recent") < F.col("_long") * 0.7, "sideways")
        .otherwise("normal").alias("regime"),
    )


def fill_missing(df: DataFrame, c: str, keys=("symbol",), order=("ts",), block: Column | None = None, out: str = "filled") -> DataFrame:
    """Forward fill, then backward fill from the first known value of the key."""
    first = df.filter(F.col(c).isNotNull()).groupBy(*keys).agg(F.min_by(c, F.struct(*order)).alias("_first"))
    b = fr.carried(df, {"seen": (lambda x: F.max(x), F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))},
                   keys, order, block)
    here = F.last(c, ignorenulls=True).over(fr.in_block(keys, order))
    b = b.join(first, list(keys), "left").withColumn(out, F.coalesce(here, F.col("_carry_seen._v"), F.col("_first")))
    return fr.drop_layout(b).drop("_first")


def change_between_snapshots(df: DataFrame, cols, keys, order, block) -> DataFrame:
    """Difference of each column to the previous row of its key."""
    s = segment(df, 1, keys=keys, order=order, block=block)
    for c in cols:
        s = s.withColumn(f"{c}_change", F.col(c) - F.lag(c, 1).over(over(keys, order)))
    return own(s)


def fill_median_mode(df: DataFrame, number: str, category: str) -> DataFrame:
    """Fill a numeric column with its exact median and a category with its most frequent value."""
    med = fr.exact_quantile(df, [], number, 0.5, "_median")
    top = (
        df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias("_mode"))
    )
    # Both sides are single rows.
    return df.select(
        "*",
        F.coalesce(F.col(number), med.scalar()).alias(f"{number}_filled"),
        F.coalesce(F.col(category), top.scalar()).alias(f"{category}_filled"),
    )


def metric_pack(bars: DataFrame) -> DataFrame:
    """Per symbol: latest price and change, volume ratio, volatilities, SMA, RSI and a completeness score."""
    r = own(segment(bars, lookback=1).withColumn("r", pct_change(close())).withColumn("d", close() - lag(close())))
    whole = r.groupBy("symbol").agg(
        F.avg("volume").alias("avg_volume"), F.stddev_samp("r").alias("volatility_1d"),
        F.count("r").alias("_nr"), F.count(F.lit(1)).alias("_bars"),
    )
    b = F.col("_back")
    at = lambda k, c: F.max(F.when(b == k, F.col(c)))
    recent = fr.tail(r, 50).groupBy("symbol").agg(
        at(1, "close").alias("price"), at(2, "close").alias("_prev"), at(1, "volume").alias("volume"),
        F.stddev_samp(F.when(b <= 20, F.col("r"))).alias("_sd20"),
        F.avg(F.when(b <= 20, close())).alias("_s20"), F.avg(close()).alias("_s50"),
        (F.sum(F.when(b <= 14, F.greatest("d", zero()))) / 14).alias("_g"),
        (F.sum(F.when(b <= 14, F.greatest(-F.col("d"), zero()))) / 14).alias("_l"),
    )
    n = F.col("_bars")
    m = whole.join(recent, "symbol").select(
        "symbol", "price", (F.col("price") - F.col("_prev")).alias("price_change"),
        ((div(F.col("price"), F.col("_prev")) - 1) * 100).alias("price_change_percent"), "volume", "avg_volume",
        div(F.col("volume"), F.col("avg_volume")).alias("volume_ratio"), "volatility_1d",
        F.when(F.col("_nr") >= 20, F.col("_sd20") * YEAR).alias("volatility_30d"),
        F.when(n >= 20, F.col("_s20")).alias("sma_20"), F.when(n >= 50, F.col("_s50")).alias("sma_50"),
        F.when(n >= 20, _rsi_of(F.col("_g"), F.col("_l"))).alias("rsi_14"),
    )
    present = lambda *cs: sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0))
    score = (
        F.when(F.col("price") > 0, 40).otherwise(0) + F.when(F.col("volume") > 0, 20).otherwise(0)
        + F.when(F.col("price_change").isNotNull(), 15).otherwise(0) + present("rsi_14", "sma_20", "volatility_1d") / 3.0 * 10
    )
    return m.withColumn("data_quality_score", F.round(score, 1))


def price_feature_pack(bars: DataFrame, window: int = 30) -> DataFrame:
    """Features of the last ``window`` bars per symbol, with fallbacks for short histories."""
    t = fr.tail(bars, window)
    t = t.withColumn("_p", lag(close())).withColumn("_d", close() - F.col("_p")).withColumn("_r", div(close(), F.col("_p")) - 1)
    b = F.col("_back")
    wt = F.pow(F.lit(1 - span_alpha(12)), b.cast("double"))
    g = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_m"), F.max_by("close", "ts").alias("current_price"), F.min_by("close", "ts").alias("_c0"),
        F.stddev_samp("_r").alias("volatility"), F.avg("volume").alias("avg_volume"), F.max_by("volume", "ts").alias("current_volume"),
        (F.sum(F.when(b <= 14, F.greatest("_d", zero()))) / 14).alias("_g"),
        (F.sum(F.when(b <= 14, F.greatest(-F.col("_d"), zero()))) / 14).alias("_l"),
        F.avg(F.when(b <= 20, close())).alias("_s20"), (F.sum(close() * wt) / F.sum(wt)).alias("_ema"),
    )
    m, cur = F.col("_m"), F.col("current_price")
    return g.select(
        "symbol", "current_price", (div(cur, F.col("_c0")) - 1).alias("price_change_pct"), "volatility", "avg_volume",
        "current_volume", F.coalesce(div(F.col("current_volume"), F.col("avg_volume")), F.lit(1.0)).alias("volume_ratio"),
        F.when(m > 14, _rsi_of(F.col("_g"), F.col("_l"))).otherwise(50.0).alias("rsi"),
        F.when(m >= 20, F.col("_s20")).otherwise(cur).alias("sma_20"),
        F.when(m >= 12, F.col("_ema")).otherwise(cur).alias("ema_12"),
    )


def hour_block(c: str = "ts") -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)


def sentiment_features(readings: DataFrame) -> DataFrame:
    """Change, 5-row deviation and 10-row trend of the sentiment score per symbol; hourly blocks."""
    order = ("ts", "event_id")
    s = segment(readings, 10, order=order, block=hour_block())
    w = over(order=order)
    s = s.withColumn("sentiment_momentum", F.col("score") - F.lag("score", 1).over(w))
    s = s.withColumn("sentiment_volatility", guarded(F.stddev_samp, F.col("score"), 5, w.rowsBetween(-4, 0)))
    s = s.withColumn("_i", F.row_number().over(w).cast("double"))
    f = w.rowsBetween(-9, 0)
    ok = (F.count("score").over(f) >= 10) & (F.max("score").over(f) > F.min("score").over(f))
    return own(s.withColumn("sentiment_trend", F.when(ok, _corr(F.col("_i"), F.col("score"), f)))).drop("_i")


def iv_rank(series: DataFrame, days: int = 252) -> DataFrame:
    """Rank of the latest volatility inside its trailing year: position in the range, and share of lower values."""
    t = fr.tail(series.filter(F.col("iv").isNotNull()), days)
    cur = t.filter(F.col("_back") == 1).select("symbol", F.col("iv").alias("_cur"))
    g = t.join(cur, "symbol").groupBy("symbol").agg(
        F.max("_cur").alias("iv"), F.min("iv").alias("_lo"), F.max("iv").alias("_hi"),
        F.count_if(F.col("iv") < F.col("_cur")).alias("_below"), F.count("iv").alias("_m"),
    )
    return g.select(
        "symbol", "iv",
        F.coalesce(div(F.col("iv") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100, F.lit(50.0)).alias("iv_rank"),
        F.coalesce(div(100.0 * F.col("_below"), F.col("_m") - 1), F.lit(50.0)).alias("iv_percentile"),
    )

"""Window operators over bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.operators import indicators as ind
from tapeloom.plans.fragments import P, RET, ewm_list, frame, lagged, roll
from tapeloom.plans.registry import Query

Y = repr(math.sqrt(252.0))
QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


def simple(key, fn, cols: dict[str, tuple[str, str]], src="bars"):
    """One bar-level query: output name -> (rounding, SQL expression)."""
    out = "symbol ts " + " ".join(f"{c}:{d}" for c, (d, _) in cols.items())
    q(key, lambda t: fn(t.bars()), out, f"SELECT symbol, ts, {', '.join(f'{e} AS {c}' for c, (_, e) in cols.items())} FROM {src}")


simple("w01_returns", ind.returns, {
    **{f"return_{k}": ("6", f"close / {lagged('close', k)} - 1") for k in (1, 5, 20)},
    **{f"log_return_{k}": ("6", f"ln(close / {lagged('close', k)})") for k in (1, 5, 20)}})
simple("w02_sma", ind.sma, {
    **{f"sma_{n}": ("3", roll("avg", "close", n)) for n in (5, 10, 20, 50)},
    **{f"price_to_sma_{n}": ("6", f"close / ({roll('avg', 'close', n)})") for n in (5, 10, 20, 50)}})

A12, A26, A9 = 2 / 13, 2 / 27, 2 / 10
q("w03_ema", lambda t: ind.ema(t.bars()), "symbol ts ema_12:3 ema_26:3",
  f"SELECT symbol, ts, {ewm_list('a', A12)} AS ema_12, {ewm_list('b', A26)} AS ema_26 FROM "
  f"(SELECT symbol, ts, list(close) OVER {frame(230)} AS a, list(close) OVER {frame(480)} AS b FROM bars) x")
RSI_CTE = f"SELECT symbol, ts, greatest(coalesce(d, 0e0), 0e0) AS g, greatest(coalesce(-d, 0e0), 0e0) AS l FROM (SELECT symbol, ts, close - {lagged()} AS d FROM bars) z"


def rsi_sql(n):
    g, l = roll("avg", "g", n), roll("avg", "l", n)
    return f"CASE WHEN ({l}) <= 1e-12 THEN CASE WHEN ({g}) > 1e-12 THEN 100e0 END ELSE 100 - 100 / (1 + ({g}) / ({l})) END"


simple("w04_rsi", ind.rsi, {"rsi_14": ("4", rsi_sql(14)), "rsi_21": ("4", rsi_sql(21))}, f"({RSI_CTE}) y")
q("w05_rsi_wilder", lambda t: ind.rsi_wilder(t.bars()), "symbol ts rsi_wilder:4", f"""
WITH RECURSIVE d AS (SELECT symbol, ts, row_number() OVER ({P}) AS pos, close - {lagged()} AS d FROM bars),
seed AS (SELECT symbol, sum(greatest(d, 0)) / 14 AS g, sum(greatest(-d, 0)) / 14 AS l, count(d) AS m FROM d
         WHERE pos BETWEEN 2 AND 15 GROUP BY symbol),
w AS (SELECT symbol, CAST(15 AS BIGINT) AS pos, g, l FROM seed WHERE m = 14
      UNION ALL SELECT w.symbol, w.pos + 1, (w.g * 13 + greatest(d.d, 0)) / 14, (w.l * 13 + greatest(-d.d, 0)) / 14
      FROM w JOIN d ON d.symbol = w.symbol AND d.pos = w.pos + 1)
SELECT d.symbol, d.ts, CASE WHEN w.g + w.l = 0 THEN 0 ELSE 100 * w.g / (w.g + w.l) END AS rsi_wilder
FROM d LEFT JOIN w ON d.symbol = w.symbol AND d.pos = w.pos""")
MACD_SQL = f"""SELECT symbol, ts, macd, sig FROM (SELECT symbol, ts, macd, {ewm_list('m', A9)} AS sig FROM (
  SELECT symbol, ts, macd, list(macd) OVER {frame(180)} AS m FROM (
    SELECT symbol, ts, {ewm_list('a', A12)} - {ewm_list('b', A26)} AS macd FROM
    (SELECT symbol, ts, list(close) OVER {frame(230)} AS a, list(close) OVER {frame(480)} AS b FROM bars) x) y) z) u"""
q("w06_macd", lambda t: ind.macd(t.bars()), "symbol ts macd:3 macd_signal:3 macd_histogram:3",
  f"SELECT symbol, ts, macd, sig AS macd_signal, macd - sig AS macd_histogram FROM ({MACD_SQL}) v")
BB = f"SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd FROM bars"
simple("w07_bollinger", ind.bollinger, {
    "bb_upper": ("3", "m + 2 * sd"), "bb_lower": ("3", "m - 2 * sd"), "bb_width": ("3", "4 * sd"),
    "bb_width_rel": ("6", "4 * sd / m"), "bb_position": ("6", "(close - (m - 2 * sd)) / nullif(4 * sd, 0)")}, f"({BB}) b")
TR = f"SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, {lagged()} AS pc FROM bars) b"
simple("w08_atr", ind.atr, {"atr": ("3", roll("avg", "tr", 14)), "atr_ratio": ("6", f"({roll('avg', 'tr', 14)}) / close")}, f"({TR}) x")
ADX = f"""SELECT symbol, ts, pdi, mdi, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM (
 SELECT symbol, ts, 100 * ({roll('avg', 'pdm', 14)}) / nullif(({roll('avg', 'tr', 14)}), 0) AS pdi,
        100 * ({roll('avg', 'mdm', 14)}) / nullif(({roll('avg', 'tr', 14)}), 0) AS mdi FROM (
  SELECT symbol, ts, tr, CASE WHEN u > d AND u > 0 THEN u ELSE 0e0 END AS pdm, CASE WHEN d > u AND d > 0 THEN d ELSE 0e0 END AS mdm
  FROM (SELECT *, high - {lagged('high')} AS u, {lagged('low')} - low AS d FROM ({TR}) t) a) b) c"""
simple("w09_adx", ind.adx, {"plus_di": ("4", "pdi"), "minus_di": ("4", "mdi"), "adx": ("4", roll("avg", "dx", 14))}, f"({ADX}) e")
STO = f"SELECT symbol, ts, CASE WHEN hi = lo THEN 0e0 ELSE 100 * (close - lo) / (hi - lo) END AS f FROM (SELECT symbol, ts, close, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars) a"
q("w10_stochastic", lambda t: ind.stochastic(t.bars()), "symbol ts stoch_k:4 stoch_d:4",
  f"SELECT symbol, ts, CASE WHEN d IS NOT NULL THEN k END AS stoch_k, d AS stoch_d FROM (SELECT symbol, ts, k, {roll('avg', 'k', 3)} AS d FROM (SELECT symbol, ts, {roll('avg', 'f', 3)} AS k FROM ({STO}) b) c) e")
simple("w11_williams_r", ind.williams_r, {
    f"williams_r_{n}": ("4", f"-100 * (({roll('max', 'high', n)}) - close) / nullif(({roll('max', 'high', n)}) - ({roll('min', 'low', n)}), 0)") for n in (14, 21)})
TP = f"SELECT symbol, ts, tp, {roll('avg', 'tp', 20)} AS m, list(tp) OVER {frame(20)} AS xs FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars) a"
simple("w12_cci", ind.cci, {"cci": ("4", "CASE WHEN m IS NULL THEN NULL WHEN mad = 0 THEN 0 ELSE (tp - m) / (0.015 * mad) END")},
       f"(SELECT symbol, ts, tp, m, list_sum(list_transform(xs, lambda x: abs(x - m))) / 20 AS mad FROM ({TP}) b) c")
simple("w13_rate_of_change", ind.rate_of_change, {f"roc_{n}": ("4", f"(close / {lagged('close', n)} - 1) * 100") for n in (5, 10, 20)})
simple("w14_volatility", ind.volatility, {
    **{f"volatility_{n}": ("6", f"({roll('stddev_samp', 'r', n)}) * {Y}") for n in (5, 10, 20, 60)},
    "volatility_ratio_20_60": ("6", f"({roll('stddev_samp', 'r', 20)}) / nullif(({roll('stddev_samp', 'r', 60)}), 0)"),
    "volatility_ratio_5_20": ("6", f"({roll('stddev_samp', 'r', 5)}) / nullif(({roll('stddev_samp', 'r', 20)}), 0)")}, f"({RET}) x")
simple("w15_realized_volatility", ind.realized_volatility, {
    f"realized_vol_{n}": ("6", f"({roll('stddev_pop', 'lr', n)}) * {Y}") for n in (5, 20)}, f"({RET}) x")
q("w16_ewma_volatility", lambda t: ind.ewma_volatility(t.bars()), "symbol n_returns:l ewma_vol:6",
  f"SELECT symbol, count(lr) AS n_returns, CASE WHEN count(lr) >= 9 THEN sqrt(252 * sum(pow(0.94e0, n - pos) * lr * lr) / sum(pow(0.94e0, n - pos))) END AS ewma_vol FROM ({RET}) x WHERE lr IS NOT NULL GROUP BY symbol")
q("w17_garch_volatility", lambda t: ind.garch_volatility(t.bars()), "symbol n_returns:l garch_vol:6", f"""
WITH RECURSIVE r AS (SELECT symbol, lr, n - pos AS back FROM ({RET}) x WHERE lr IS NOT NULL),
v AS (SELECT symbol, var_pop(lr) AS v, count(*) AS n_returns FROM r GROUP BY symbol),
g AS (SELECT symbol, CAST(20 AS BIGINT) AS back, v, v AS s2, n_returns FROM v
      UNION ALL SELECT g.symbol, g.back - 1, g.v, g.v * (1e0 - 0.06e0 - 0.92e0) + 0.06e0 * r.lr * r.lr + 0.92e0 * g.s2, g.n_returns
      FROM g JOIN r ON r.symbol = g.symbol AND r.back = g.back - 1)
SELECT symbol, n_returns, CASE WHEN n_returns >= 29 THEN sqrt(s2 * 252) END AS garch_vol FROM g WHERE back = 0""")
RV20 = f"SELECT symbol, ts, ({roll('stddev_pop', 'lr', 20)}) * {Y} AS v FROM ({RET}) x"
q("w18_volatility_regime", lambda t: ind.volatility_regime(t.bars()), "symbol ts vol_regime",
  f"SELECT symbol, ts, CASE WHEN v < 0.15 THEN 'low' WHEN v < 0.30 THEN 'normal' WHEN v IS NOT NULL THEN 'high' END AS vol_regime FROM ({RV20}) y")
simple("w19_high_low_distance", ind.high_low_distance, {
    "distance_from_high": ("6", f"(({roll('max', 'high', 20)}) - close) / close"),
    "distance_from_low": ("6", f"(close - ({roll('min', 'low', 20)})) / close")})
q("w20_max_drawdown", lambda t: ind.max_drawdown(t.bars()), "symbol max_drawdown:6",
  f"SELECT symbol, abs(min((close - pk) / pk)) AS max_drawdown FROM (SELECT symbol, close, max(close) OVER ({P}) AS pk FROM bars) x GROUP BY symbol")
q("w21_risk_ratios", lambda t: ind.risk_ratios(t.bars()), "symbol n_returns:l sharpe:6 sortino:6", f"""
SELECT symbol, count(lr) AS n_returns,
 (avg(lr) * 252 - 0.02) / nullif(stddev_pop(lr) * {Y}, 0) AS sharpe,
 (avg(lr) * 252 - 0.02) / nullif(stddev_pop(CASE WHEN lr < 0 THEN lr END) * {Y}, 0) AS sortino
FROM ({RET}) x WHERE lr IS NOT NULL GROUP BY symbol""")
q("w22_historical_var", lambda t: ind.historical_var(t.bars(), horizon=10), "symbol var:6",
  f"SELECT symbol, abs(quantile_cont(lr, 0.05) * sqrt(10e0)) AS var FROM ({RET}) x WHERE lr IS NOT NULL GROUP BY symbol")
simple("w23_volume_features", ind.volume_features, {
    "volume_sma": ("4", roll("avg", "volume", 20)), "volume_ratio": ("6", f"volume / ({roll('avg', 'volume', 20)})"),
    "volume_trend": ("6", f"({roll('avg', 'volume', 5)}) / ({roll('avg', 'volume', 20)})"), "dollar_volume": ("2", "close * volume")})
simple("w24_momentum", ind.momentum, {
    "momentum_5": ("6", f"close / {lagged('close', 5)} - 1"), "momentum_20": ("6", f"close / {lagged('close', 20)} - 1"),
    "momentum_acceleration": ("6", f"close / {lagged('close', 5)} - close / {lagged('close', 20)}")})
simple("w25_candle_shape", ind.candle_shape, {
    "spread": ("6", "(high - low) / close"), "body_size": ("6", "abs(close - open) / close"),
    "upper_shadow": ("6", "(high - greatest(open, close)) / close"), "lower_shadow": ("6", "(least(open, close) - low) / close"),
    "high_low_ratio": ("6", "high / low"), "close_position": ("6", "(close - low) / nullif(high - low, 0)")})
CEN = f"({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
simple("w26_local_extremes", ind.local_extremes, {
    "local_max": ("b", f"count(close) OVER {CEN} = 5 AND max(close) OVER {CEN} = close"),
    "local_min": ("b", f"count(close) OVER {CEN} = 5 AND min(close) OVER {CEN} = close")})
simple("w27_trend_strength", ind.trend_strength, {
    "trend_strength": ("6", f"CASE WHEN count(close) OVER {frame(10)} >= 10 AND max(close) OVER {frame(10)} > min(close) OVER {frame(10)} THEN corr(pos, close) OVER {frame(10)} END")}, f"({RET}) x")


def moment(kind, n):
    f = frame(n)
    return f"CASE WHEN count(close) OVER {f} >= {n} AND max(close) OVER {f} > min(close) OVER {f} THEN {kind}(close) OVER {f} END"


simple("w28_rolling_statistics", ind.rolling_statistics, {
    k: v for n in (5, 10, 20, 50) for k, v in {
        f"mean_{n}": ("3", roll("avg", "close", n)), f"std_{n}": ("3", roll("stddev_samp", "close", n)),
        f"min_{n}": ("4", roll("min", "close", n)), f"max_{n}": ("4", roll("max", "close", n)),
        f"skew_{n}": ("4", moment("skewness", n)), f"kurt_{n}": ("4", moment("kurtosis", n))}.items()})
simple("w29_lag_features", ind.lag_features, {
    **{f"lag_{k}": ("4", lagged("close", k)) for k in (1, 2, 3, 5, 10)},
    "diff_1": ("4", f"close - {lagged()}"), "diff_2": ("4", f"close - {lagged('close', 2)}"), "pct_change_1": ("6", f"close / {lagged()} - 1"),
    **{f"zscore_{n}": ("6", f"(close - ({roll('avg', 'close', n)})) / nullif(({roll('stddev_samp', 'close', n)}), 0)") for n in (20, 50)}})
simple("w30_rolling_loose", ind.rolling_loose, {
    f"close_{k}": ("3", f"{a}(close) OVER {frame(20)}") for k, a in (("mean", "avg"), ("std", "stddev_samp"), ("sum", "sum"), ("min", "min"), ("max", "max"))})
TGT = {}
for h in (1, 5, 10, 20):
    lead = f"lead(close, {h}) OVER ({P})"
    TGT[f"target_return_{h}"] = ("6", f"{lead} / close - 1")
    TGT[f"target_direction_{h}"] = ("l", f"CASE WHEN {lead} > close THEN 1 ELSE 0 END")
    if h > 1:
        f = f"({P} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        TGT[f"target_volatility_{h}"] = ("6", f"CASE WHEN count(r) OVER {f} >= {h} THEN stddev_samp(r) OVER {f} END")
simple("w31_targets", ind.targets, TGT, f"({RET}) x")
q("w32_symbol_regime", lambda t: ind.symbol_regime(t.bars()), "symbol regime", f"""
SELECT a.symbol, CASE WHEN n < 20 THEN 'normal' WHEN rv > lv * 1.5 THEN 'volatile' WHEN abs(c1 / c0 - 1) > 0.1 THEN 'trending'
  WHEN rv < lv * 0.7 THEN 'sideways' ELSE 'normal' END AS regime
FROM (SELECT symbol, max(n) AS n, stddev_samp(r) AS lv, stddev_samp(CASE WHEN pos > n - 20 THEN r END) AS rv,
      max(CASE WHEN pos = n THEN close END) AS c1, max(CASE WHEN pos = n - 19 THEN close END) AS c0 FROM ({RET}) x GROUP BY symbol) a""")
PRE = f"({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
simple("w33_regime_per_bar", ind.regime_per_bar, {
    "regime": ("s", f"CASE WHEN count(close) OVER {PRE} = 20 AND abs(last_value(close) OVER {PRE} / first_value(close) OVER {PRE} - 1) > 0.1 THEN 'trending' ELSE 'normal' END")})
simple("w34_volume_flow", ind.volume_flow, {
    "obv": ("2", f"sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({P})"),
    "ad": ("3", f"sum(CASE WHEN high = low THEN 0e0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) OVER ({P})")},
    f"(SELECT *, {lagged()} AS pc FROM bars) x")
q("w35_fill_missing", lambda t: ind.fill_missing(
    t.quotes().withColumn("filled_in", F.col("price")), "price", order=("ts", "quote_id")),
  "quote_id symbol filled:4", """
SELECT quote_id, symbol, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, quote_id),
  first_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, quote_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled
FROM quotes""")
q("w35_fill_median_mode", lambda t: ind.fill_median_mode(t.quotes(), "price", "source"), "quote_id price_filled:4 source_filled", """
SELECT quote_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM quotes)) AS price_filled,
  coalesce(source, (SELECT source FROM quotes WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)) AS source_filled
FROM quotes""")
q("w36_metric_pack", lambda t: ind.metric_pack(t.bars()),
  "symbol price:4 price_change:4 price_change_percent:6 volume:2 avg_volume:4 volume_ratio:6 volatility_1d:6 volatility_30d:6 sma_20:3 sma_50:3 rsi_14:4 data_quality_score:1", f"""
SELECT symbol, price, price - prev AS price_change, (price / prev - 1) * 100 AS price_change_percent, volume, avg_volume,
 volume / avg_volume AS volume_ratio, sd AS volatility_1d, CASE WHEN nr >= 20 THEN sd20 * {Y} END AS volatility_30d,
 CASE WHEN n >= 20 THEN sma20 END AS sma_20, CASE WHEN n >= 50 THEN sma50 END AS sma_50,
 CASE WHEN n >= 20 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE 100 - 100 / (1 + g / l) END END AS rsi_14,
 40 + 20 + CASE WHEN prev IS NOT NULL THEN 15 ELSE 0 END
   + ((CASE WHEN n >= 20 AND (g > 0 OR l > 0) THEN 1 ELSE 0 END) + (CASE WHEN n >= 20 THEN 1 ELSE 0 END) + (CASE WHEN sd IS NOT NULL THEN 1 ELSE 0 END)) / 3e0 * 10 AS data_quality_score
FROM (SELECT symbol, max(n) AS n, max(CASE WHEN pos = n THEN close END) AS price, max(CASE WHEN pos = n - 1 THEN close END) AS prev,
   max(CASE WHEN pos = n THEN volume END) AS volume, avg(volume) AS avg_volume, stddev_samp(r) AS sd, count(r) AS nr,
   stddev_samp(CASE WHEN pos > n - 20 THEN r END) AS sd20, avg(CASE WHEN pos > n - 20 THEN close END) AS sma20,
   avg(CASE WHEN pos > n - 50 THEN close END) AS sma50,
   sum(CASE WHEN pos > n - 14 THEN greatest(d, 0) END) / 14 AS g, sum(CASE WHEN pos > n - 14 THEN greatest(-d, 0) END) / 14 AS l
 FROM (SELECT *, close - {lagged()} AS d FROM ({RET}) x) y GROUP BY symbol) z""")
q("w37_price_feature_pack", lambda t: ind.price_feature_pack(t.bars()),
  "symbol current_price:4 price_change_pct:6 volatility:6 avg_volume:4 current_volume:2 volume_ratio:6 rsi:4 sma_20:3 ema_12:3", f"""
SELECT symbol, c1 AS current_price, c1 / c0 - 1 AS price_change_pct, sd AS volatility, av AS avg_volume, v1 AS current_volume,
 v1 / av AS volume_ratio, CASE WHEN m > 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 END ELSE 100 - 100 / (1 + g / l) END ELSE 50 END AS rsi,
 CASE WHEN m >= 20 THEN s20 ELSE c1 END AS sma_20, CASE WHEN m >= 12 THEN ema ELSE c1 END AS ema_12
FROM (SELECT symbol, count(*) AS m, max(CASE WHEN back = 1 THEN close END) AS c1, arg_max(close, back) AS c0, avg(volume) AS av,
   max(CASE WHEN back = 1 THEN volume END) AS v1, stddev_samp(rr) AS sd, avg(CASE WHEN back <= 20 THEN close END) AS s20,
   sum(close * pow({1 - A12!r}, back)) / sum(pow({1 - A12!r}, back)) AS ema,
   sum(CASE WHEN back <= 14 THEN greatest(d, 0) END) / 14 AS g, sum(CASE WHEN back <= 14 THEN greatest(-d, 0) END) / 14 AS l
 FROM (SELECT symbol, ts, close, volume, n - pos + 1 AS back, CASE WHEN n - pos + 1 < least(n, 30) THEN r END AS rr,
        CASE WHEN n - pos + 1 < least(n, 30) THEN close - pc END AS d FROM (SELECT *, {lagged()} AS pc FROM ({RET}) x) y) z
 WHERE back <= 30 GROUP BY symbol) w""")
SP = "PARTITION BY symbol ORDER BY ts, event_id"
SF = lambda n: f"({SP} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
q("w38_sentiment_features", lambda t: ind.sentiment_features(t.sentiments()),
  "event_id symbol sentiment_momentum:6 sentiment_volatility:6 sentiment_trend:6", f"""
SELECT event_id, symbol, score - lag(score) OVER ({SP}) AS sentiment_momentum,
 CASE WHEN count(score) OVER {SF(5)} >= 5 THEN stddev_samp(score) OVER {SF(5)} END AS sentiment_volatility,
 CASE WHEN count(score) OVER {SF(10)} >= 10 AND max(score) OVER {SF(10)} > min(score) OVER {SF(10)} THEN corr(pos, score) OVER {SF(10)} END AS sentiment_trend
FROM (SELECT *, row_number() OVER ({SP}) AS pos FROM sentiments) x""")
q("w40_indicator_flags", lambda t: ind.indicator_flags(t.bars()),
  "symbol ts rsi_oversold:l rsi_overbought:l rsi_divergence:3 macd_cross:l macd_divergence:3 bb_breakout_up:l bb_breakout_down:l sma_cross:l", f"""
WITH a AS (SELECT symbol, ts, {rsi_sql(14)} AS rsi FROM ({RSI_CTE}) y),
m AS (SELECT symbol, ts, macd - sig AS h FROM ({MACD_SQL}) v),
b AS (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 50)} AS m50, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)
SELECT b.symbol, b.ts, CASE WHEN rsi < 30 THEN 1 ELSE 0 END AS rsi_oversold, CASE WHEN rsi > 70 THEN 1 ELSE 0 END AS rsi_overbought,
 rsi - lag(rsi) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS rsi_divergence, CASE WHEN h > 0 THEN 1 ELSE 0 END AS macd_cross,
 h - lag(h) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS macd_divergence,
 CASE WHEN close > m20 + 2 * sd THEN 1 ELSE 0 END AS bb_breakout_up, CASE WHEN close < m20 - 2 * sd THEN 1 ELSE 0 END AS bb_breakout_down,
 CASE WHEN m20 > m50 THEN 1 ELSE 0 END AS sma_cross
FROM b JOIN a ON a.symbol = b.symbol AND a.ts = b.ts JOIN m ON m.symbol = b.symbol AND m.ts = b.ts""")
q("w41_historical_volatility", lambda t: ind.historical_volatility(t.bars()), "symbol hist_vol:6",
  f"SELECT symbol, CASE WHEN count(*) >= 20 THEN stddev_samp(lr) * {Y} ELSE 0.25 END AS hist_vol FROM ({RET}) x GROUP BY symbol")
q("w42_iv_rank", lambda t: ind.iv_rank(ind.realized_volatility(t.bars(), (20,)).withColumnRenamed("realized_vol_20", "iv")),
  "symbol iv:6 iv_rank:4 iv_percentile:4", f"""
SELECT symbol, max(CASE WHEN back = 1 THEN v END) AS iv,
 coalesce((max(CASE WHEN back = 1 THEN v END) - min(v)) / nullif(max(v) - min(v), 0) * 100, 50) AS iv_rank,
 coalesce(100e0 * count(CASE WHEN v < cur THEN 1 END) / nullif(count(v) - 1, 0), 50) AS iv_percentile
FROM (SELECT *, max(CASE WHEN back = 1 THEN v END) OVER (PARTITION BY symbol) AS cur FROM
  (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM ({RV20}) y WHERE v IS NOT NULL) z) u
WHERE back <= 252 GROUP BY symbol""")
PRE20 = f"({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
q("w43_sequences", lambda t: ind.sequences(t.bars()).select(
    "symbol", "ts", "target", F.element_at("window", 1)["close"].alias("first_close"),
    F.element_at("window", -1)["close"].alias("last_close"),
    F.aggregate("window", F.lit(0.0), lambda a, x: a + x["volume"]).alias("total_volume"), F.size("window").alias("steps")),
  "symbol ts target:4 first_close:4 last_close:4 total_volume:2 steps:l", f"""
SELECT * FROM (SELECT symbol, ts, close AS target, first_value(close) OVER {PRE20} AS first_close, last_value(close) OVER {PRE20} AS last_close,
 sum(volume) OVER {PRE20} AS total_volume, count(*) OVER {PRE20} AS steps FROM bars) x WHERE steps = 20""")
q("w44_history_range", lambda t: ind.history_range(t.bars(), "1996-01-01", "1998-12-31"),
  "symbol ts close:4 daily_return:6 volatility_20:6",
  f"SELECT symbol, ts, close, r AS daily_return, ({roll('stddev_samp', 'r', 20)}) * {Y} AS volatility_20 FROM (SELECT *, close / {lagged()} - 1 AS r FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') x")

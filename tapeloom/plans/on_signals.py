"""Signals, scores, sizes, decisions and the summaries over recommendations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.operators import aggregates as ag
from tapeloom.operators import chain as ch
from tapeloom.operators import signals as sg
from tapeloom.plans.fragments import P, ewm_list, frame, lagged, phi, roll
from tapeloom.plans.on_chain import MIS, MIV, SCORE
from tapeloom.plans.on_windows import ADX, MACD_SQL, RSI_CTE, rsi_sql
from tapeloom.plans.registry import Query

QUERIES: list[Query] = []
Y = repr(math.sqrt(252.0))


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


LAST = "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"
q("g01_technical_signals", lambda t: sg.technical_signals(t.bars()),
  "symbol rsi:4 macd_signal:3 moving_avg_signal:2 bollinger_signal:5 volume_signal:5 support_resistance_signal:5 momentum_score:5 trend_strength:4 volatility_regime", f"""
WITH a AS (SELECT symbol, ts, {rsi_sql(14)} AS rsi FROM ({RSI_CTE}) y), m AS (SELECT symbol, ts, sig FROM ({MACD_SQL}) v), x AS (SELECT symbol, ts, {roll('avg', 'dx', 14)} AS adx FROM ({ADX}) e),
r AS (SELECT symbol, ts, close / {lagged()} - 1 AS r FROM bars), v AS (SELECT symbol, ts, ({roll('stddev_samp', 'r', 20)}) * {Y} AS vol FROM r),
b AS (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 50)} AS m50, {roll('stddev_samp', 'close', 20)} AS sd, volume / (avg(volume) OVER {frame(20)}) AS vr,
 max(high) OVER {frame(20)} AS hi, min(low) OVER {frame(20)} AS lo, close / {lagged('close', 5)} - 1 AS r5, close / {lagged('close', 20)} - 1 AS r20, {LAST} AS back FROM bars)
SELECT b.symbol, rsi, sig AS macd_signal, CASE WHEN close > m20 THEN 0.5 ELSE 0 END + CASE WHEN close > coalesce(m50, m20) THEN 0.5 ELSE 0 END AS moving_avg_signal, (close - (m20 - 2 * sd)) / (4 * sd) AS bollinger_signal,
 least(2, vr) - 1 AS volume_signal, (close - lo) / (hi - lo) AS support_resistance_signal, (r5 + r20) / 2 AS momentum_score, coalesce(adx, 0) AS trend_strength,
 CASE WHEN vol < 0.15 THEN 'low' WHEN vol > 0.3 THEN 'high' ELSE 'normal' END AS volatility_regime
FROM b JOIN a ON a.symbol = b.symbol AND a.ts = b.ts JOIN m ON m.symbol = b.symbol AND m.ts = b.ts JOIN x ON x.symbol = b.symbol AND x.ts = b.ts JOIN v ON v.symbol = b.symbol AND v.ts = b.ts WHERE back = 1""")
q("g02_market_structure", lambda t: sg.market_structure_signals(t.bars()), "symbol volatility:4 volume_ratio:5 gex_level:2 dex_level:2 max_pain_distance:3 vix_regime", f"""
SELECT symbol, v AS volatility, vr AS volume_ratio, g AS gex_level, g / 2 AS dex_level, mp AS max_pain_distance, CASE WHEN v < 15 THEN 'low' WHEN v > 35 THEN 'crisis' WHEN v > 25 THEN 'elevated' ELSE 'normal' END AS vix_regime FROM (
 SELECT *, least(10000, greatest(-10000, -100 * v)) AS g FROM (SELECT symbol, stddev_samp(CASE WHEN back < 24 THEN r END) * 100 AS v, avg(CASE WHEN back <= 24 THEN volume END) / avg(volume) AS vr,
  abs(max(CASE WHEN back = 1 THEN close END) - avg(CASE WHEN back <= 24 THEN close END)) AS mp FROM (SELECT *, close / {lagged()} - 1 AS r, {LAST} AS back FROM bars) a GROUP BY symbol) b) c""")
QUAL = "(CASE WHEN rsi <> 50 THEN 0.8e0 ELSE 0.5e0 END + least(1, unusual_activity_score + volume_oi_ratio) + CASE WHEN sentiment <> 0 THEN 0.8e0 ELSE 0.3e0 END + CASE WHEN gex_level <> 0 THEN 0.7e0 ELSE 0.4e0 END) / 4"
PROB = "least(1, greatest(0, 0.5e0 + CASE WHEN rsi < 30 THEN 0.1e0 WHEN rsi > 70 THEN -0.1e0 ELSE 0e0 END + CASE WHEN macd_signal > 0 THEN 0.05e0 ELSE 0e0 END + sentiment * 0.1e0 + CASE WHEN put_call_ratio < 0.8e0 THEN 0.05e0 WHEN put_call_ratio > 1.2e0 THEN -0.05e0 ELSE 0e0 END + valuation_score * 0.1e0))"
q("g03_signal_quality", lambda t: t.feats().withColumn("quality", sg.signal_quality()), "event_id:l quality:5", f"SELECT event_id, {QUAL} AS quality FROM feats")
q("g04_rule_probability", lambda t: t.feats().withColumn("probability", sg.rule_probability()), "event_id:l probability:5", f"SELECT event_id, {PROB} AS probability FROM feats")
SP = f"""SELECT *, CASE WHEN er > 0 THEN p ELSE 1 - p END AS pp, least(100e0, (abs(p - 0.5e0) * 2 * 0.4e0 + least(1, abs(er) * 2) * 0.4e0 + qq * 0.2e0) * 100) AS sc, (p + CASE WHEN qq > 1 THEN qq / 100 ELSE qq END) / 2 AS band FROM (
 SELECT *, iv * sqrt(t) * (p - 0.5e0) * 2 * (1 + momentum_score) AS er FROM (SELECT *, {PROB} AS p, {QUAL} AS qq FROM feats) a) b"""
q("g05_score_predictions", lambda t: sg.score_predictions(t.feats().withColumn("probability", sg.rule_probability()).withColumn("quality", sg.signal_quality())).withColumn("drivers", F.array_join("drivers", "|")),
  "event_id:l expected_return:6 opportunity_score:4 confidence prob_profit:5 expected_value:4 sharpe_like:5 time_decay_risk:4 recommendation drivers", f"""
SELECT event_id, er AS expected_return, sc AS opportunity_score, c AS confidence, pp AS prob_profit, ev AS expected_value, ev / greatest(premium, 0.01) AS sharpe_like, abs(theta) * 30 AS time_decay_risk,
 CASE WHEN sc >= 80 AND c = 'high' THEN 'strong_buy' WHEN sc >= 65 AND c IN ('high', 'medium') THEN 'buy' WHEN sc >= 50 THEN 'hold' ELSE 'avoid' END AS recommendation,
 array_to_string(list_filter([CASE WHEN rsi < 30 THEN 'Oversold RSI condition' WHEN rsi > 70 THEN 'Overbought RSI condition' END, CASE WHEN macd_signal > 0.01e0 THEN 'Positive MACD signal' END,
  CASE WHEN sentiment > 0.3e0 THEN 'Positive sentiment momentum' WHEN sentiment < -0.3e0 THEN 'Negative sentiment momentum' END, CASE WHEN unusual_activity_score > 0.5 THEN 'Unusual options activity detected' END,
  CASE WHEN smart_money_indicator > 0.6e0 THEN 'Smart money positioning' END, CASE WHEN valuation_score > 0.2e0 THEN 'Options mispricing opportunity' END], lambda x: x IS NOT NULL)[1:5], '|') AS drivers
FROM (SELECT *, CASE WHEN band > 0.8e0 THEN 'high' WHEN band > 0.6e0 THEN 'medium' ELSE 'low' END AS c, pp * abs(er) * premium - (1 - pp) * premium AS ev FROM ({SP}) x) y""")
REC = f"""SELECT *, least(100, vs * 0.4e0 + 15 + least(100, abs(ratio) * 200) * 0.3e0) AS sc FROM (SELECT *, {SCORE} AS vs FROM ({MIV}) a) b WHERE vs >= 60 AND least(100, vs * 0.4e0 + 15 + least(100, abs(ratio) * 200) * 0.3e0) >= 60"""
CF = "((0.5e0 + conf / 100) / 2)"
SIZE = f"least(0.05e0 * sc / 100 * {CF}, greatest(0, least(0.25, ({CF} - (1 - {CF})) * 0.25)), 0.05e0)"
recs = lambda t: sg.trade_rows(ch.mispricing(t.chain(), t.vols()), 60.0)
q("g06_composite_score", lambda t: recs(t), "contract_id:l opportunity_score:4", f"SELECT contract_id, sc AS opportunity_score FROM ({REC}) r")
TGT = "CASE WHEN put_call = 'call' THEN greatest(underlying * (1 + abs(ratio)) - strike, 0) ELSE greatest(strike - underlying * (1 - abs(ratio)), 0) END"
q("g07_trade_rows", lambda t: recs(t).select("contract_id", "strategy", "trade.entry_price", "trade.target_price", "trade.stop_loss", "risk.risk_reward", "risk.breakeven", "trade.max_contracts",
                                          F.array_join("analysis.risk_factors", "|").alias("risks")),
  "contract_id:l strategy entry_price:3 target_price:3 stop_loss:3 risk_reward:3 breakeven:3 max_contracts:l risks", f"""
SELECT contract_id, CASE WHEN put_call = 'call' THEN 'long_call' ELSE 'long_put' END AS strategy, mp AS entry_price, {TGT} AS target_price, mp * 0.7e0 AS stop_loss, ({TGT} - mp) / (mp * 0.3e0) AS risk_reward, be AS breakeven,
 CAST(trunc({SIZE} * 10000 / (mp * 100)) AS BIGINT) AS max_contracts,
 concat_ws('|', CASE WHEN t < 0.08 THEN 'High time decay risk' END, CASE WHEN iv > 0.5 THEN 'High volatility' END, CASE WHEN volume <> 0 AND volume < 500 THEN 'Lower liquidity' END) AS risks FROM ({REC}) r""")
q("g08_position_size", lambda t: recs(t).select("contract_id", "trade.position_size"), "contract_id:l position_size:6", f"SELECT contract_id, {SIZE} AS position_size FROM ({REC}) r")
ENH = """least(100, greatest(0, (confidence * 0.6e0 + least(1, abs(prediction) * 2) * 0.4e0) * 100 * 0.4e0
 + least(100, 50 + CASE WHEN rsi < 30 THEN 15 WHEN rsi > 70 THEN 10 ELSE 0 END + CASE WHEN macd > macd_signal THEN 10 ELSE 0 END + CASE WHEN bollinger_position < 0.2e0 THEN 10 WHEN bollinger_position > 0.8e0 THEN 5 ELSE 0 END) * 0.3e0
 + least(100, 50 + CASE volatility_regime WHEN 'low' THEN 20 WHEN 'normal' THEN 10 ELSE 0 END + CASE WHEN volatility_ratio > 1.2e0 THEN 15 ELSE 0 END) * 0.2e0
 + least(100, 50 + CASE WHEN sharpe_ratio > 1 THEN 25 WHEN sharpe_ratio > 0.5 THEN 15 ELSE 0 END + CASE WHEN max_drawdown < 0.1e0 THEN 15 ELSE 0 END) * 0.1e0))"""
q("g09_enhanced_score", lambda t: t.feats().withColumn("score", sg.enhanced_score()), "event_id:l score:4", f"SELECT event_id, {ENH} AS score FROM feats")
KEL = "least(greatest(0, least(0.25e0, (od * wp - (1 - wp)) / od * 0.5e0)), 0.05e0)"
IDEA = f"""SELECT *, greatest(0.01e0, CASE WHEN kind = 'CALL' THEN close * n1 - dk * n2 ELSE dk * (1 - n2) - close * (1 - n1) END) AS px FROM (SELECT *, {phi('d1')} AS n1, {phi('d1 - sd')} AS n2 FROM (
 SELECT *, (ln(close / k) + (0.04e0 + 0.5e0 * vv * vv) * 30 / 365e0) / (vv * sqrt(30 / 365e0)) AS d1, vv * sqrt(30 / 365e0) AS sd, k * exp(-0.04e0 * 30 / 365e0) AS dk FROM (
  SELECT f.*, kind, close * m AS k, coalesce(nullif(realized_vol_20, 0), 0.25) AS vv, (confidence + sc / 100) / 2 AS wp, greatest(1, abs(prediction) * 2) AS od FROM (SELECT *, {ENH} AS sc FROM feats) f,
   (SELECT * FROM (VALUES ('CALL', 1.05e0), ('PUT', 0.95e0)) v(kind, m)) s WHERE sc >= 55) a) b) c"""
TP = "px * (1 + CASE WHEN kind = 'CALL' THEN abs(prediction) ELSE abs(prediction) * 0.8e0 END)"
q("g10_enhanced_ideas", lambda t: sg.enhanced_ideas(t.feats(), 55.0), "event_id:l kind strike:4 entry_price:4 target_price:4 position_size:6 max_contracts:l risk_reward:4 breakeven:4", f"""
SELECT event_id, kind, k AS strike, px AS entry_price, {TP} AS target_price, {KEL} AS position_size, greatest(1, CAST(trunc({KEL} * 10000 / (px * 100)) AS BIGINT)) AS max_contracts, ({TP} - px) / (px * 0.3e0) AS risk_reward,
 CASE WHEN kind = 'CALL' THEN k + px ELSE k - px END AS breakeven FROM ({IDEA}) x""")
q("g11_kelly_size", lambda t: t.feats().withColumn("size", sg.kelly_size(F.col("confidence"), F.col("prediction"), F.col("rsi"), tolerance="aggressive")), "event_id:l size:6", """
SELECT event_id, least(greatest(0, least(0.25e0, (od * wp - (1 - wp)) / od * 0.5e0)) * 1.5e0, 0.05e0) AS size FROM (SELECT event_id, (confidence + rsi / 100) / 2 AS wp, greatest(1, abs(prediction) * 2) AS od FROM feats) a""")


def reasons(t):
    f = t.feats().withColumn("kind", F.when(F.col("event_id") % 2 == 0, "CALL").otherwise("PUT"))
    return f.select("event_id", F.array_join(sg.key_reasons(F.col("kind")), "|").alias("reasons"), F.array_join(sg.risk_factors(F.col("kind")), "|").alias("risks"), F.array_join(sg.entry_signals(), "|").alias("entries"))


pick = lambda items, n: "array_to_string(list_filter([" + ", ".join(items) + f"], lambda x: x IS NOT NULL)[1:{n}], '|')"
CALL = "event_id % 2 = 0"
q("g12_reason_texts", reasons, "event_id:l reasons risks entries", "SELECT event_id, " + pick([
    "CASE WHEN confidence > 0.7e0 THEN printf('High ML confidence: %.1f%%', confidence * 100) END", f"CASE WHEN {CALL} AND rsi < 35 THEN printf('RSI oversold: %.1f', rsi) END", f"CASE WHEN NOT {CALL} AND rsi > 65 THEN printf('RSI overbought: %.1f', rsi) END",
    "CASE WHEN volatility_regime = 'low' THEN 'Low volatility environment favorable for long options' END", "CASE WHEN volatility_ratio > 1.2e0 THEN 'Rising short-term volatility' END", "CASE WHEN iv_rank < 30 THEN printf('Low IV rank: %.0f', iv_rank) END",
    "CASE WHEN sharpe_ratio > 1 THEN printf('Strong risk-adjusted returns: Sharpe %.2f', sharpe_ratio) END"], 5) + " AS reasons, " + pick([
    "CASE WHEN volatility_regime = 'high' THEN 'High volatility environment increases risk' END", "'Time decay accelerates closer to expiration'", f"CASE WHEN {CALL} AND rsi > 75 THEN 'Overbought conditions may limit upside' END",
    f"CASE WHEN NOT {CALL} AND rsi < 25 THEN 'Oversold conditions may limit downside' END", "CASE WHEN max_drawdown > 0.2e0 THEN 'High historical drawdown indicates volatility' END", "'Options can expire worthless'"], 4) + " AS risks, " + pick([
    "CASE WHEN macd > macd_signal THEN 'MACD bullish crossover' END", "CASE WHEN bollinger_position < 0.25e0 THEN 'Price near lower Bollinger band' WHEN bollinger_position > 0.75e0 THEN 'Price near upper Bollinger band' END",
    "CASE WHEN volatility_ratio > 1.3e0 THEN 'Volatility expansion signal' END"], 3) + " AS entries FROM feats")
COMB = """SELECT *, 0e0 + (CASE WHEN tt > 0.3e0 THEN 1 WHEN tt < -0.3e0 THEN -1 ELSE 0 END) * least(1e0, abs(tt)) * 0.3e0 + (CASE WHEN sentiment > 0.2e0 AND sentiment_confidence > 0.6e0 THEN 1 WHEN sentiment < -0.2e0 AND sentiment_confidence > 0.6e0 THEN -1 ELSE 0 END) * (abs(sentiment) * sentiment_confidence) * 0.2e0
 + (CASE WHEN direction > 0.7e0 AND direction_confidence > 0.6e0 THEN 1 WHEN direction < 0.3e0 AND direction_confidence > 0.6e0 THEN -1 ELSE 0 END) * (direction_confidence * abs(direction - 0.5e0) * 2) * 0.5e0 AS x
FROM (SELECT *, (CASE WHEN close > sma_20 AND sma_20 > s5 THEN 1 WHEN close < sma_20 AND sma_20 < s5 THEN -1 ELSE 0 END + CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) / 2e0 AS tt FROM (SELECT *, coalesce(sma_50, sma_20) AS s5 FROM feats) a) b"""
q("g13_combined_signal", lambda t: sg.combined_signal(t.feats()), "event_id:l technical_signal combined_score:5 signal signal_confidence:5", f"""
SELECT event_id, CASE WHEN tt > 0.3e0 THEN 'BUY' WHEN tt < -0.3e0 THEN 'SELL' ELSE 'HOLD' END AS technical_signal, x AS combined_score, CASE WHEN x > 0.3e0 THEN 'BUY' WHEN x < -0.3e0 THEN 'SELL' ELSE 'HOLD' END AS signal, least(1, abs(x)) AS signal_confidence FROM ({COMB}) c""")
RISK = """list_avg(list_filter([least(1e0, historical_vol * 50), uncertainty, CASE WHEN vol_confidence > 0.5 THEN least(1e0, vol_prediction * 2) END,
 CASE WHEN uncertainty IS NOT NULL THEN CASE regime WHEN 'normal' THEN 0.3e0 WHEN 'volatile' THEN 0.8e0 WHEN 'trending' THEN 0.4e0 ELSE 0.5e0 END END], lambda z: z IS NOT NULL))"""
q("g14_risk_and_size", lambda t: t.feats().withColumn("risk", sg.risk_score()).withColumn("size", sg.size_factor(F.col("confidence"), F.col("risk"))), "event_id:l risk:5 size:5", f"""
SELECT event_id, risk, greatest(0.1, least(2, confidence * (1 - risk) * CASE WHEN vol_confidence > 0.5 THEN greatest(0.5, 1 - vol_prediction) ELSE 1 END)) AS size FROM (
 SELECT *, coalesce({RISK}, 0.5) AS risk FROM (SELECT * REPLACE (CASE WHEN historical_vol IS NULL THEN NULL ELSE historical_vol END AS historical_vol) FROM feats) a) b""".replace("least(1e0, historical_vol * 50)", "CASE WHEN historical_vol IS NOT NULL THEN least(1e0, historical_vol * 50) END"))
q("g15_data_quality", lambda t: t.feats().select("event_id", F.col("unusual_activity_score").alias("completeness"), (F.col("event_id") % 80).alias("depth"), F.col("uncertainty").alias("prediction_quality"), "sentiment_confidence").withColumn("quality", sg.signal_data_quality()),
  "event_id:l quality:5", "SELECT event_id, list_avg(list_filter([unusual_activity_score, least(1, event_id % 80 / 50e0), uncertainty, sentiment_confidence], lambda z: z IS NOT NULL)) AS quality FROM feats")
q("g16_sizes", lambda t: sg.sizes(t.feats()), "event_id:l kelly_size:6 confidence_size:6 volatility_size:6 parity_size:6", """
SELECT event_id, k AS kelly_size, c AS confidence_size, CASE WHEN volatility > 0 THEN least(c * 0.15 / volatility, 0.1) ELSE c END AS volatility_size, CASE WHEN volatility > 0 THEN least(0.02 / volatility, 0.1) ELSE 0 END AS parity_size FROM (
 SELECT *, least(k * greatest(0.1, least(2, confidence)), 0.1) AS c FROM (SELECT *, CASE WHEN volatility > 0 THEN least(abs(expected_return / (volatility * volatility) * 0.25), 0.1) ELSE 0.05 END AS k FROM feats) a) b""")
q("g17_final_decision", lambda t: sg.final_decision(t.feats()), "event_id:l action reason", """
SELECT event_id, CASE WHEN violations > 0 OR confidence < 0.6e0 THEN 'hold' WHEN prediction > 0.02e0 THEN 'buy' WHEN prediction < -0.02e0 THEN 'sell' ELSE 'hold' END AS action,
 CASE WHEN violations > 0 THEN 'risk_limits' WHEN confidence < 0.6e0 THEN 'low_confidence' WHEN prediction > 0.02e0 THEN 'positive' WHEN prediction < -0.02e0 THEN 'negative' ELSE 'neutral' END AS reason FROM feats""")
GATES = {"volume": 500, "ratio": 1.0, "notional": 5_000_000}
q("g18_sweep_signals", lambda t: sg.sweep_signals(ch.unusual_sweeps(t.chain(), 0.5).withColumn("current_price", F.col("current_price") * 10), gates=GATES), "contract_id:l probability:5 institutional_size:l share_volume:l action confidence:5", """
SELECT contract_id, p AS probability, CAST(trunc(n * 0.35e0) AS BIGINT) AS institutional_size, CAST(trunc(n * 0.35e0 / px) AS BIGINT) AS share_volume, CASE WHEN put_call = 'call' THEN 'BUY' ELSE 'SELL' END AS action, p * 0.65e0 AS confidence FROM (
 SELECT *, least(0.95, greatest(0.4, least(volume / 200000e0, 1) * 0.35e0 + least(rt / 10, 1) * 0.4e0 + least(n / 5e7, 1) * 0.25e0)) AS p FROM (SELECT *, volume * 100 * px AS n FROM (SELECT *, round(underlying, 2) * 10 AS px, round(volume / greatest(open_interest, 1), 2) AS rt FROM chain
  WHERE strike >= underlying - underlying * 0.5e0 AND strike <= underlying + underlying * 0.5e0 AND volume > greatest(open_interest * 2, 1000)) a) b WHERE rt >= 1 AND n >= 5000000) c""")
q("g19_direction_call", lambda t: sg.direction_call(t.feats()), "event_id:l direction confidence:2 predicted_volatility:4", """
SELECT event_id, CASE WHEN a THEN 'bullish' WHEN b THEN 'bearish' WHEN c THEN 'bullish' WHEN d THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN a OR b THEN 0.7 WHEN c OR d THEN 0.8 ELSE 0.4 END AS confidence, volatility * 0.8 AS predicted_volatility FROM (
 SELECT *, rsi < 30 AND price_change_pct < -0.02e0 AS a, rsi > 70 AND price_change_pct > 0.02e0 AS b, price_change_pct > 0.01e0 AND volume_ratio > 1.2e0 AS c, price_change_pct < -0.01e0 AND volume_ratio > 1.2e0 AS d FROM feats) x""")
q("g20_trend_fallback", lambda t: sg.trend_fallback(t.bars()), "symbol direction:2 direction_confidence:2 target:5 target_confidence:2", f"""
SELECT symbol, CASE WHEN c > m THEN 1 ELSE 0 END AS direction, 0.6 AS direction_confidence, (c / m - 1) * 0.5 AS target, 0.5 AS target_confidence FROM (
 SELECT symbol, max(CASE WHEN b = 1 THEN close END) AS c, avg(close) AS m FROM (SELECT *, {LAST} AS b FROM bars) a WHERE b <= 20 GROUP BY symbol) x""")
q("x12_interactions", lambda t: sg.interaction_products(t.feats()), "event_id:l rsi_sentiment:4 vol_vega_exposure:5 vol_gamma_risk:6 flow_structure_signal:5 momentum_sentiment_align:5 decay_vol_premium:5", """
SELECT event_id, rsi * sentiment AS rsi_sentiment, volatility * vega AS vol_vega_exposure, volatility_ratio * gamma AS vol_gamma_risk, volume_oi_ratio * sign(gex_level) AS flow_structure_signal, momentum_score * sentiment_change AS momentum_sentiment_align, time_decay_factor * iv_rank AS decay_vol_premium FROM feats""")
COLS = ("rsi", "macd", "sentiment", "iv", "volatility", "momentum_score", "premium")
pairs = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1:]]
q("x13_pairwise_features", lambda t: sg.pairwise_features(t.feats(), COLS), "event_id:l " + " ".join(f"{a}_x_{b}:5 {a}_div_{b}:3 {a}_ratio_{b}:2" for a, b in pairs),
  "SELECT event_id, " + ", ".join(f"{a} * {b} AS {a}_x_{b}, {a} / nullif({b}, 0) AS {a}_div_{b}, {a} / nullif({a} + {b} + 1e-8, 0) AS {a}_ratio_{b}" for a, b in pairs) + " FROM feats")
q("x14_polynomial_features", lambda t: sg.polynomial_features(t.feats(), COLS).withColumnsRenamed({f"poly_{a} {b}": f"poly_{a}_{b}" for a in COLS for b in COLS}),
  "event_id:l " + " ".join(f"poly_{a}_{b}:5" for a, b in pairs), "SELECT event_id, " + ", ".join(f"{a} * {b} AS poly_{a}_{b}" for a, b in pairs) + " FROM feats")
q("x15_structure_features", lambda t: sg.structure_features(t.feats().select("event_id", F.col("gex_level").alias("call_gex"), F.when(F.col("event_id") % 2 == 0, F.col("gex_level") * -0.5).alias("put_gex"), F.when(F.col("event_id") % 3 == 0, F.col("rsi")).alias("vix"))),
  "event_id:l call_gex:2 put_gex:2 gex_tilt:5 vix:3 percent_above_200ma:2", """
SELECT event_id, gex_level AS call_gex, coalesce(pg, 0) AS put_gex, gex_level / nullif(coalesce(pg, 0) + 1, 0) AS gex_tilt, coalesce(CASE WHEN event_id % 3 = 0 THEN rsi END, 20) AS vix, 50 AS percent_above_200ma FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN gex_level * -0.5 END AS pg FROM feats) a""")

# Summaries over recommendations ------------------------------------------------------------------------------------
RECS = f"SELECT contract_id, symbol, CASE WHEN put_call = 'call' THEN 'long_call' ELSE 'long_put' END AS strategy, CASE WHEN dte <= 30 THEN 'near' ELSE 'far' END AS horizon, sc AS opportunity_score, 0.5e0 AS confidence FROM ({REC}) r"
q("a24_scan_summary", lambda t: ag.scan_summary(recs(t)), "contract_id:l symbol opportunity_score:4 symbols:l opportunities:l",
  f"WITH r AS ({RECS}) SELECT contract_id, symbol, opportunity_score, (SELECT count(DISTINCT symbol) FROM r) AS symbols, (SELECT count(*) FROM r) AS opportunities FROM r ORDER BY opportunity_score DESC, contract_id LIMIT 10")
q("a25_score_insights", lambda t: ag.score_insights(recs(t)), "mean:4 median:4 std:4 min:4 max:4 average_confidence:4",
  f"SELECT avg(opportunity_score) AS mean, quantile_cont(opportunity_score, 0.5) AS median, stddev_pop(opportunity_score) AS std, min(opportunity_score) AS min, max(opportunity_score) AS max, avg(confidence) AS average_confidence FROM ({RECS}) r")
q("a25_category_counts", lambda t: ag.category_counts(recs(t).withColumn("horizon", F.when(F.col("contract.dte") <= 30, "near").otherwise("far")), ["strategy", "horizon"]), "category name n:l",
  f"WITH r AS ({RECS}) SELECT 'strategy' AS category, strategy AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'horizon', horizon, count(*) FROM r GROUP BY 2")
q("a26_recommendation_stats", lambda t: ag.recommendation_stats(recs(t)), "symbol recommendations:l total_recommendations:l avg_opportunity_score:4 avg_ml_confidence:4", f"""
WITH r AS ({RECS}) SELECT symbol, count(*) AS recommendations, (SELECT count(*) FROM r) AS total_recommendations, (SELECT avg(opportunity_score) FROM r) AS avg_opportunity_score, (SELECT avg(confidence) FROM r) AS avg_ml_confidence FROM r GROUP BY symbol ORDER BY 2 DESC, 1 LIMIT 10""")

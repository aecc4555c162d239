"""Signals, scores, position sizes and decisions over feature rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div
from tapeloom.functions.special import ewm_stretch
from tapeloom.operators import chain as ch
from tapeloom.operators import indicators as ind
from tapeloom.operators.aggregates import clamp

YEAR = math.sqrt(252.0)


def _c(name: str) -> Column:
    return F.col(name)


def _add(*terms: tuple[Column, float]) -> Column:
    """Sum of the values whose condition holds."""
    return sum((F.when(cond, F.lit(float(v))).otherwise(0.0) for cond, v in terms), F.lit(0.0))


def _texts(limit: int, *pairs: tuple[Column, Column | str]) -> Column:
    """Texts whose condition holds, in order, at most ``limit``."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in pairs]))
    return F.slice(found, 1, limit)


def technical_signals(bars: DataFrame) -> DataFrame:
    """Signals at the last bar of every symbol, from the tail the longest indicator needs."""
    t = fr.tail(bars, ind.MACD_REACH + 2)
    t = ind.add_adx(ind.add_volatility(ind.add_bollinger(ind.add_sma(ind.add_rsi(t), (20, 50))), (20,)))
    close, w20 = _c("close"), fr.last_n(20)
    hi, lo = F.max("high").over(w20), F.min("low").over(w20)
    t = t.withColumns({"_v20": F.avg("volume").over(w20), "_hi": hi, "_lo": lo, "_r5": fr.pct_change(close, 5), "_r20": fr.pct_change(close, 20)})
    t = ind.add_macd(ewm_stretch(t, ind.MACD_STRETCH))
    t = t.filter(_c("_back") == 1)
    vol = _c("volatility_20")
    long_mean = F.coalesce("sma_50", "sma_20")
    return t.select(
        "symbol", "rsi", "macd_signal", _add((close > _c("sma_20"), 0.5), (close > long_mean, 0.5)).alias("moving_avg_signal"),
        _c("bb_position").alias("bollinger_signal"), (F.least(F.lit(2.0), div(_c("volume"), _c("_v20"))) - 1).alias("volume_signal"),
        div(close - _c("_lo"), _c("_hi") - _c("_lo")).alias("support_resistance_signal"), ((_c("_r5") + _c("_r20")) / 2).alias("momentum_score"),
        F.coalesce("adx", F.lit(0.0)).alias("trend_strength"), F.when(vol < 0.15, "low").when(vol > 0.30, "high").otherwise("normal").alias("volatility_regime"),
    )


def market_structure_signals(bars: DataFrame, rows: int = 24) -> DataFrame:
    """Scaled volatility, volume ratio, distance from the mean and regime of the last rows of every symbol."""
    t = fr.tail(bars, rows)
    t = t.withColumn("_r", div(_c("close"), fr.lag("close")) - 1)
    g = t.groupBy("symbol").agg(
        (F.stddev_samp("_r") * 100).alias("_v"), F.avg("volume").alias("_rv"), F.max_by("close", "ts").alias("_c"), F.avg("close").alias("_m"), F.count(F.lit(1)).alias("_k"),
        F.max("_n").alias("_n"),
    )
    whole = bars.groupBy("symbol").agg(F.avg("volume").alias("_av"))
    g = g.join(whole, "symbol").withColumn("volatility", F.when(_c("_k") > 1, _c("_v")).otherwise(20.0))
    v = _c("volatility")
    gex = F.least(F.greatest(v * -100, F.lit(-10000.0)), F.lit(10000.0))
    return g.select(
        "symbol", "volatility", F.when(_c("_n") > _c("_k"), div(_c("_rv"), _c("_av"))).otherwise(1.0).alias("volume_ratio"), gex.alias("gex_level"), (gex * 0.5).alias("dex_level"),
        F.abs(_c("_c") - _c("_m")).alias("max_pain_distance"),
        F.when(v < 15, "low").when(v > 35, "crisis").when(v > 25, "elevated").otherwise("normal").alias("vix_regime"),
    )


def signal_quality() -> Column:
    """Mean of four part scores."""
    return (
        F.when(_c("rsi") != 50, 0.8).otherwise(0.5) + F.least(F.lit(1.0), _c("unusual_activity_score") + _c("volume_oi_ratio"))
        + F.when(_c("sentiment") != 0, 0.8).otherwise(0.3) + F.when(_c("gex_level") != 0, 0.7).otherwise(0.4)
    ) / 4


def rule_probability() -> Column:
    rsi, pc = _c("rsi"), _c("put_call_ratio")
    p = (
        0.5 + F.when(rsi < 30, 0.1).when(rsi > 70, -0.1).otherwise(0.0) + F.when(_c("macd_signal") > 0, 0.05).otherwise(0.0)
        + F.coalesce("sentiment", F.lit(0.0)) * 0.1 + F.when(pc < 0.8, 0.05).when(pc > 1.2, -0.05).otherwise(0.0) + F.coalesce("valuation_score", F.lit(0.0)) * 0.1
    )
    return clamp(p, 0.0, 1.0)


def score_predictions(rows: DataFrame) -> DataFrame:
    """Expected return, edge score, confidence band, risk measures, recommendation and drivers from probability and quality."""
    p, q = _c("probability"), _c("quality")
    r = rows.withColumn("expected_return", F.coalesce("iv", F.lit(0.3)) * F.sqrt("t") * (p - 0.5) * 2 * (1 + F.coalesce("momentum_score", F.lit(0.0))))
    er, prem = _c("expected_return"), _c("premium")
    band = (p + F.when(q > 1, q / 100).otherwise(q)) / 2
    r = r.withColumns({
        "opportunity_score": F.least(F.lit(100.0), (F.abs(p - 0.5) * 2 * 0.4 + F.least(F.lit(1.0), F.abs(er) * 2) * 0.4 + q * 0.2) * 100),
        "confidence": F.when(band > 0.8, "high").when(band > 0.6, "medium").otherwise("low"),
        "prob_profit": F.when(er > 0, p).otherwise(1 - p),
    })
    s, conf, pp = _c("opportunity_score"), _c("confidence"), _c("prob_profit")
    r = r.withColumn("expected_value", pp * F.abs(er) * prem - (1 - pp) * prem)
    drivers = _texts(
        5, (_c("rsi") < 30, "Oversold RSI condition"), (_c("rsi") > 70, "Overbought RSI condition"), (_c("macd_signal") > 0.01, "Positive MACD signal"),
        (_c("sentiment") > 0.3, "Positive sentiment momentum"), (_c("sentiment") < -0.3, "Negative sentiment momentum"),
        (_c("unusual_activity_score") > 0.5, "Unusual options activity detected"), (_c("smart_money_indicator") > 0.6, "Smart money positioning"),
        (_c("valuation_score") > 0.2, "Options mispricing opportunity"),
    )
    return r.withColumns({
        "max_loss": prem, "sharpe_like": _c("expected_value") / F.greatest(prem, F.lit(0.01)), "time_decay_risk": F.abs(F.coalesce("theta", F.lit(-0.05))) * 30,
        "recommendation": F.when((s >= 80) & (conf == "high"), "strong_buy").when((s >= 65) & conf.isin("high", "medium"), "buy").when(s >= 50, "hold").otherwise("avoid"),
        "drivers": drivers,
    })


def composite_score(valuation: Column, ml_confidence: Column, expected_return: Column) -> Column:
    return F.least(F.lit(100.0), valuation * 0.4 + ml_confidence * 100 * 0.3 + F.least(F.lit(100.0), F.abs(expected_return) * 200) * 0.3)


# Share of the base size per risk tolerance.
TOLERANCE = {"conservative": 0.5, "moderate": 1.0, "aggressive": 1.5}


def position_size(score: Column, ml_confidence: Column, valuation_confidence: Column, base: float = 0.05, tolerance: str = "moderate") -> Column:
    """Base size scaled by score and confidence, capped by a quarter Kelly fraction and the base."""
    b = base * TOLERANCE[tolerance]
    cf = (ml_confidence + valuation_confidence / 100) / 2
    return F.least(b * score / 100 * cf, clamp((cf - (1 - cf)) * 0.25, 0.0, 0.25), F.lit(b))


def trade_rows(valued: DataFrame, least: float = 70.0, tolerance: str = "moderate") -> DataFrame:
    """Recommendations from a valued chain as nested rows: contract, scores, trade, risk, analysis.

    ``ml_confidence`` and ``expected_return`` columns are used when present; else 0.5 and the mispricing ratio.
    """
    v = ch.add_valuation_score(valued).withColumnRenamed("opportunity_score", "valuation_score")
    if "ml_confidence" not in v.columns:
        v = v.withColumn("ml_confidence", F.lit(0.5))
    if "expected_return" not in v.columns:
        v = v.withColumn("expected_return", _c("mispricing_ratio"))
    ml, er = _c("ml_confidence"), _c("expected_return")
    v = v.withColumn("opportunity_score", composite_score(_c("valuation_score"), ml, er))
    v = fr.keep(v, (_c("valuation_score") >= least) & (_c("opportunity_score") >= least))
    v = v.withColumn("position_size", position_size(_c("opportunity_score"), ml, _c("confidence_score"), tolerance=tolerance))
    entry, size, call = _c("market_price"), _c("position_size"), ch.is_call()
    s, k = _c("underlying"), _c("strike")
    target = F.when(call, F.greatest(s * (1 + F.abs(er)) - k, F.lit(0.0))).otherwise(F.greatest(k - s * (1 - F.abs(er)), F.lit(0.0)))
    reasons = _texts(5, (_c("undervalued"), F.format_string("Undervalued by %.1f%%", _c("mispricing_ratio") * 100)), (ml > 0.7, F.format_string("High ML confidence: %.1f%%", ml * 100)))
    risks = _texts(5, (_c("t") < 0.08, "High time decay risk"), (_c("iv") > 0.5, "High volatility"), ((_c("volume") != 0) & (_c("volume") < 500), "Lower liquidity"))
    return v.withColumn("_target", target).select(
        "contract_id", "symbol", F.when(call, "long_call").otherwise("long_put").alias("strategy"), "opportunity_score", ml.alias("confidence"),
        F.struct("put_call", "strike", "dte", "bid", "ask", "last", "volume", "open_interest", "underlying").alias("contract"),
        F.struct("opportunity_score", "ml_confidence", "mispricing_ratio").alias("scores"),
        F.struct(entry.alias("entry_price"), _c("_target").alias("target_price"), (entry * 0.7).alias("stop_loss"), "position_size",
                 (size * 10000 / (entry * 100)).cast("bigint").alias("max_contracts")).alias("trade"),
        F.struct((entry * size).alias("max_loss"), "expected_return", ml.alias("probability_of_profit"), div(_c("_target") - entry, entry * 0.3).alias("risk_reward"),
                 F.when(call, k + entry).otherwise(k - entry).alias("breakeven")).alias("risk"),
        F.struct(reasons.alias("key_reasons"), risks.alias("risk_factors")).alias("analysis"), _c("confidence_score").alias("data_quality"),
    )


def enhanced_score() -> Column:
    """Model 40, technical 30, volatility 20, risk 10."""
    conf, pred = _c("confidence"), F.abs(_c("prediction"))
    ml = (conf * 0.6 + F.least(F.lit(1.0), pred * 2) * 0.4) * 100
    rsi, bb = _c("rsi"), _c("bollinger_position")
    tech = 50 + F.when(rsi < 30, 15).when(rsi > 70, 10).otherwise(0) + _add((_c("macd") > _c("macd_signal"), 10)) + F.when(bb < 0.2, 10).when(bb > 0.8, 5).otherwise(0)
    regime = _c("volatility_regime")
    vol = 50 + F.when(regime == "low", 20).when(regime == "normal", 10).otherwise(0) + _add((_c("volatility_ratio") > 1.2, 15))
    sh = _c("sharpe_ratio")
    risk = 50 + F.when(sh > 1.0, 25).when(sh > 0.5, 15).otherwise(0) + _add((_c("max_drawdown") < 0.1, 15))
    cap = lambda x: F.least(F.lit(100.0), x)
    return clamp(ml * 0.4 + cap(tech) * 0.3 + cap(vol) * 0.2 + cap(risk) * 0.1, 0.0, 100.0)


def kelly_size(confidence: Column, expected_return: Column, score: Column, cap: float = 0.05, tolerance: str = "moderate") -> Column:
    win = (confidence + score / 100) / 2
    odds = F.greatest(F.lit(1.0), F.abs(expected_return) * 2)
    k = clamp((odds * win - (1 - win)) / odds * 0.5, 0.0, 0.25) * TOLERANCE[tolerance]
    return F.least(k, F.lit(cap))


def key_reasons(kind: Column) -> Column:
    rsi, call = _c("rsi"), kind == "CALL"
    return _texts(
        5, (_c("confidence") > 0.7, F.format_string("High ML confidence: %.1f%%", _c("confidence") * 100)),
        (call & (rsi < 35), F.format_string("RSI oversold: %.1f", rsi)), (~call & (rsi > 65), F.format_string("RSI overbought: %.1f", rsi)),
        (_c("volatility_regime") == "low", "Low volatility environment favorable for long options"), (_c("volatility_ratio") > 1.2, "Rising short-term volatility"),
        (_c("iv_rank") < 30, F.format_string("Low IV rank: %.0f", _c("iv_rank"))),
        (_c("sharpe_ratio") > 1.0, F.format_string("Strong risk-adjusted returns: Sharpe %.2f", _c("sharpe_ratio"))),
    )


def risk_factors(kind: Column) -> Column:
    rsi, call = _c("rsi"), kind == "CALL"
    always = F.lit(True)
    return _texts(
        4, (_c("volatility_regime") == "high", "High volatility environment increases risk"), (always, "Time decay accelerates closer to expiration"),
        (call & (rsi > 75), "Overbought conditions may limit upside"), (~call & (rsi < 25), "Oversold conditions may limit downside"),
        (_c("max_drawdown") > 0.2, "High historical drawdown indicates volatility"), (always, "Options can expire worthless"),
    )


def entry_signals() -> Column:
    bb = _c("bollinger_position")
    return _texts(
        3, ((_c("macd") > _c("macd_signal")) & (_c("macd") - _c("macd_signal") > 0), "MACD bullish crossover"), (bb < 0.25, "Price near lower Bollinger band"),
        (bb > 0.75, "Price near upper Bollinger band"), (_c("volatility_ratio") > 1.3, "Volatility expansion signal"),
    )


def enhanced_ideas(features: DataFrame, least: float = 70.0, rate: float = 0.04) -> DataFrame:
    """A 30-day call at +5% and put at -5% for every feature row that scores enough, priced and sized."""
    f = fr.keep(features.withColumn("opportunity_score", enhanced_score()), _c("opportunity_score") >= least)
    sides = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(m).alias("m")) for n, m in (("CALL", 1.05), ("PUT", 0.95))])
    f = f.withColumn("_s", F.explode(sides))
    f = f.withColumns({"kind": _c("_s.kind"), "strike": _c("close") * _c("_s.m"), "underlying": _c("close"), "t": F.lit(30 / 365.0), "put_call": F.lower("_s.kind"),
                       "_vol": F.coalesce(F.nullif("realized_vol_20", F.lit(0.0)), F.lit(0.25))})
    f = ch.add_price(f, "_vol", "_px", rate).withColumn("entry_price", F.greatest(F.lit(0.01), _c("_px")))
    entry, pred = _c("entry_price"), F.abs("prediction")
    f = f.withColumn("target_price", entry * (1 + F.when(_c("kind") == "CALL", pred).otherwise(pred * 0.8)))
    f = f.withColumn("position_size", kelly_size(_c("confidence"), pred, _c("opportunity_score")))
    size = _c("position_size")
    return f.withColumns({
        "stop_loss": entry * 0.7, "max_contracts": F.greatest(F.lit(1), (size * 10000 / (entry * 100)).cast("bigint")), "max_loss": entry * size,
        "expected_return": _c("target_price") / entry - 1, "risk_reward": (_c("target_price") - entry) / (entry * 0.3),
        "breakeven": F.when(_c("kind") == "CALL", _c("strike") + entry).otherwise(_c("strike") - entry),
        "reasons": key_reasons(_c("kind")), "risks": risk_factors(_c("kind")), "entry_signals": entry_signals(),
    }).drop("_s", "_vol", "_px")


# Weights of the three signal parts.
PART_WEIGHTS = {"technical": 0.3, "sentiment": 0.2, "ml": 0.5}


def combined_signal(rows: DataFrame) -> DataFrame:
    """BUY / SELL / HOLD per part and combined from close, averages, RSI, sentiment and model columns."""
    close, s20, s50, rsi = (_c(x) for x in ("close", "sma_20", "sma_50", "rsi"))
    s50 = F.coalesce(s50, s20)
    trend = F.when((close > s20) & (s20 > s50), 1).when((close < s20) & (s20 < s50), -1).otherwise(0)
    osc = F.when(rsi < 30, 1).when(rsi > 70, -1).otherwise(0)
    tech = (trend + osc) / 2.0
    sent, sc = _c("sentiment"), _c("sentiment_confidence")
    pred, conf = _c("direction"), _c("direction_confidence")
    r = rows.withColumn("_t", tech)
    t = _c("_t")
    parts = {
        "technical": (F.when(t > 0.3, 1).when(t < -0.3, -1).otherwise(0), F.least(F.lit(1.0), F.abs(t))),
        "sentiment": (F.when((sent > 0.2) & (sc > 0.6), 1).when((sent < -0.2) & (sc > 0.6), -1).otherwise(0), F.abs(sent) * sc),
        "ml": (F.when((pred > 0.7) & (conf > 0.6), 1).when((pred < 0.3) & (conf > 0.6), -1).otherwise(0), conf * F.abs(pred - 0.5) * 2),
    }
    total = sum((side * strength * PART_WEIGHTS[n] for n, (side, strength) in parts.items()), F.lit(0.0))
    names = lambda x: F.when(x > 0, "BUY").when(x < 0, "SELL").otherwise("HOLD")
    r = r.withColumns({f"{n}_signal": names(side) for n, (side, _) in parts.items()}).withColumn("combined_score", total).drop("_t")
    x = _c("combined_score")
    return r.withColumns({"signal": F.when(x > 0.3, "BUY").when(x < -0.3, "SELL").otherwise("HOLD"), "signal_confidence": F.least(F.lit(1.0), F.abs(x))})


# Risk of a market regime.
REGIME_RISK = {"normal": 0.3, "volatile": 0.8, "trending": 0.4, "sideways": 0.5}


def _mean_known(*xs: Column, default: float) -> Column:
    known = F.array_compact(F.array(*xs))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(default)


def risk_score() -> Column:
    """Mean of the known risk factors: volatility, uncertainty, predicted volatility, regime."""
    regime = F.lit(0.5)
    for name, v in REGIME_RISK.items():
        regime = F.when(_c("regime") == name, v).otherwise(regime)
    has = _c("uncertainty").isNotNull()
    return _mean_known(
        F.when(_c("historical_vol").isNotNull(), F.least(F.lit(1.0), _c("historical_vol") * 50)), _c("uncertainty"),
        F.when(_c("vol_confidence") > 0.5, F.least(F.lit(1.0), _c("vol_prediction") * 2)), F.when(has, regime), default=0.5,
    )


def size_factor(confidence: Column, risk: Column, low: float = 0.1, high: float = 2.0) -> Column:
    damp = F.when(_c("vol_confidence") > 0.5, F.greatest(F.lit(0.5), 1.0 - _c("vol_prediction"))).otherwise(1.0)
    return clamp(confidence * (1.0 - risk) * damp, low, high)


def signal_data_quality() -> Column:
    """Mean of completeness, depth of 50 rows, prediction quality and sentiment confidence, where known."""
    return _mean_known(_c("completeness"), F.least(F.lit(1.0), _c("depth") / 50.0), _c("prediction_quality"), _c("sentiment_confidence"), default=0.0)


def sizes(rows: DataFrame, cap: float = 0.1, target_vol: float = 0.15, target_risk: float = 0.02) -> DataFrame:
    """Kelly, confidence-scaled, volatility-scaled and risk-parity sizes from expected return, volatility and confidence."""
    mu, vol, conf = _c("expected_return"), _c("volatility"), _c("confidence")
    lim = F.lit(cap)
    kelly = F.when(vol > 0, F.least(F.abs(mu / (vol * vol) * 0.25), lim)).otherwise(0.05)
    r = rows.withColumn("kelly_size", kelly)
    r = r.withColumn("confidence_size", F.least(_c("kelly_size") * clamp(conf, 0.1, 2.0), lim))
    scaled = F.when(vol > 0, F.least(_c("confidence_size") * target_vol / vol, lim)).otherwise(_c("confidence_size"))
    return r.withColumn("volatility_size", scaled).withColumn("parity_size", F.when(vol > 0, F.least(target_risk / vol, lim)).otherwise(0.0))


def final_decision(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Hold when limits are broken or confidence is low, else by a two percent prediction."""
    p, c, n = _c("prediction"), _c("confidence"), _c("violations")
    r = rows.withColumn("action", F.when(n > 0, "hold").when(c < least, "hold").when(p > 0.02, "buy").when(p < -0.02, "sell").otherwise("hold"))
    reason = F.when(n > 0, "risk_limits").when(c < least, "low_confidence").when(p > 0.02, "positive").when(p < -0.02, "negative").otherwise("neutral")
    return r.withColumn("reason", reason)


# Gates and weights of the synthetic dark-pool signal.
SWEEP_GATES = {"volume": 50_000, "ratio": 3.0, "notional": 5_000_000}


def sweep_signals(sweeps: DataFrame, multiplier: float = 0.65, gates: dict[str, float] = SWEEP_GATES) -> DataFrame:
    """Institutional signal of large fresh sweeps: probability, size, side."""
    v, ratio, px = _c("volume"), _c("volume_oi_ratio"), _c("current_price")
    s = sweeps.withColumn("notional", v * 100 * px).filter((v >= gates["volume"]) & (ratio >= gates["ratio"]) & (_c("notional") >= gates["notional"]))
    one = F.lit(1.0)
    p = F.least(v / 200000.0, one) * 0.35 + F.least(ratio / 10.0, one) * 0.40 + F.least(_c("notional") / 50_000_000.0, one) * 0.25
    side = F.upper("direction")
    s = s.withColumn("probability", clamp(p, 0.4, 0.95)).withColumn("institutional_size", (_c("notional") * 0.35).cast("bigint"))
    return s.withColumns({
        "share_volume": F.when(px > 0, (_c("notional") * 0.35 / px).cast("bigint")).otherwise(0), "action": F.when(side == "CALL", "BUY").when(side == "PUT", "SELL").otherwise("UNKNOWN"),
        "confidence": _c("probability") * multiplier,
    })


def direction_call(rows: DataFrame) -> DataFrame:
    """Direction from RSI, price change and volume ratio; volatility call at 80 percent of the current one."""
    rsi, chg, vr = F.coalesce("rsi", F.lit(50.0)), _c("price_change_pct"), _c("volume_ratio")
    sold, bought = (rsi < 30) & (chg < -0.02), (rsi > 70) & (chg > 0.02)
    up, down = (chg > 0.01) & (vr > 1.2), (chg < -0.01) & (vr > 1.2)
    return rows.withColumns({
        "direction": F.when(sold, "bullish").when(bought, "bearish").when(up, "bullish").when(down, "bearish").otherwise("neutral"),
        "confidence": F.when(sold | bought, 0.7).when(up | down, 0.8).otherwise(0.4), "predicted_volatility": _c("volatility") * 0.8,
    })


def trend_fallback(bars: DataFrame) -> DataFrame:
    """Direction and dampened target from the last close against its 20-bar mean."""
    t = fr.tail(bars, 20).groupBy("symbol").agg(F.max_by("close", "ts").alias("_c"), F.avg("close").alias("_m"), F.count(F.lit(1)).alias("_k"))
    m = F.when(_c("_k") >= 20, _c("_m"))
    return t.select(
        "symbol", F.when(_c("_c") > m, 1.0).otherwise(0.0).alias("direction"), F.lit(0.6).alias("direction_confidence"),
        ((div(_c("_c"), m) - 1) * 0.5).alias("target"), F.lit(0.5).alias("target_confidence"),
    )


# Feature products ----------------------------------------------------------------------------------------------

def interaction_products(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "rsi_sentiment": _c("rsi") * _c("sentiment"), "vol_vega_exposure": _c("volatility") * _c("vega"), "vol_gamma_risk": _c("volatility_ratio") * _c("gamma"),
        "flow_structure_signal": _c("volume_oi_ratio") * F.signum("gex_level"), "momentum_sentiment_align": _c("momentum_score") * _c("sentiment_change"),
        "decay_vol_premium": _c("time_decay_factor") * _c("iv_rank"),
    })


def pairwise_features(df: DataFrame, cols: Sequence[str], most: int | None = None, most_columns: int | None = None) -> DataFrame:
    """Product, quotient and share of every column pair, in loop order.

    All pairs, unless ``most_columns`` keeps only the first columns or ``most`` ends the loop once so many new columns exist
    (10 and 50 give the short form).
    """
    out: dict[str, Column] = {}
    cols = list(cols)[:most_columns]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            if most is not None and len(out) >= most:
                break
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            out.update({f"{a}_x_{b}": x * y, f"{a}_div_{b}": div(x, y), f"{a}_ratio_{b}": div(x, x + y + 1e-8)})
    return df.withColumns(out)


def polynomial_features(df: DataFrame, cols: Sequence[str], most_columns: int | None = None) -> DataFrame:
    """Interaction-only products of degree two over all columns, or the first ``most_columns`` (5 gives the short form); nulls count 0."""
    cols = list(cols)[:most_columns]
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns({f"poly_{a} {b}": z(a) * z(b) for i, a in enumerate(cols) for b in cols[i + 1:]})


# Defaults of missing market-structure inputs.
STRUCTURE_DEFAULTS = {
    "total_gex": 0.0, "call_gex": 0.0, "put_gex": 0.0, "max_pain": 0.0, "distance_from_max_pain": 0.0, "dark_pool_volume": 0.0, "dark_pool_ratio": 0.0,
    "dark_pool_sentiment": 0.0, "advance_decline_ratio": 1.0, "new_highs_lows_ratio": 1.0, "percent_above_200ma": 50.0, "vix": 20.0, "vix_percentile": 50.0,
    "vix9d_vix_ratio": 1.0, "correlation_spy": 0.5, "sector_dispersion": 0.0,
}


def structure_features(rows: DataFrame) -> DataFrame:
    """Market-structure inputs with defaults, and the tilt of call to put exposure."""
    have = set(rows.columns)
    r = rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d) for c, d in STRUCTURE_DEFAULTS.items()})
    return r.withColumn("gex_tilt", div(F.col("call_gex"), F.col("put_gex") + 1))

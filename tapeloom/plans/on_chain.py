"""Option chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import chain as ch
from tapeloom.plans.fragments import phi
from tapeloom.plans.registry import Query

QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


MP = "CASE WHEN coalesce(bid, 0) <> 0 AND coalesce(ask, 0) <> 0 THEN (bid + ask) / 2 ELSE last END"
CV = f"SELECT c.*, coalesce(hist_vol, 0.25) AS v, {MP} AS mp FROM chain c LEFT JOIN vols o ON c.symbol = o.symbol"


def greek_sql(src: str, vol: str = "v", keep: str = "x.*") -> str:
    """Value and Greeks over a source with underlying, strike, t and a volatility column; the source alias is x."""
    return f"""SELECT x.*, CASE WHEN put_call = 'call' THEN underlying * n1 - dk * n2 ELSE dk * (1 - n2) - underlying * (1 - n1) END AS bs,
  CASE WHEN put_call = 'call' THEN n1 ELSE n1 - 1 END AS delta, pdf / (underlying * {vol} * sqrt(t)) AS gamma, underlying * pdf * sqrt(t) / 100 AS vega,
  (-underlying * pdf * {vol} / (2 * sqrt(t)) + CASE WHEN put_call = 'call' THEN -0.05e0 * dk * n2 ELSE 0.05e0 * dk * (1 - n2) END) / 365 AS theta,
  CASE WHEN put_call = 'call' THEN t * dk * n2 ELSE -t * dk * (1 - n2) END / 100 AS rho
 FROM (SELECT y.*, {phi('d1')} AS n1, {phi('d1 - sd')} AS n2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM (
   SELECT z.*, {vol} * sqrt(t) AS sd, strike * exp(-0.05e0 * t) AS dk, (ln(underlying / strike) + (0.05e0 + 0.5e0 * {vol} * {vol}) * t) / ({vol} * sqrt(t)) AS d1 FROM ({src}) z) y) x"""


G = greek_sql(CV)


def bs_at(v: str) -> str:
    d1 = f"((ln(underlying / strike) + (0.05e0 + 0.5e0 * ({v}) * ({v})) * t) / (({v}) * sqrt(t)))"
    d2 = f"({d1} - ({v}) * sqrt(t))"
    return f"(underlying * {phi(d1)} - strike * exp(-0.05e0 * t) * {phi(d2)} - CASE WHEN put_call = 'call' THEN 0 ELSE underlying - strike * exp(-0.05e0 * t) END)"


def iv_sql(src: str, price: str) -> str:
    """Every row of the source with its implied volatility, by recursive bisection."""
    return f"""(WITH RECURSIVE i0 AS ({src}),
 ok AS (SELECT contract_id, underlying, strike, t, put_call, {price} AS px FROM i0 WHERE {price} IS NOT NULL
   AND {price} >= CASE WHEN put_call = 'call' THEN greatest(underlying - strike * exp(-0.05e0 * t), 0) ELSE greatest(strike * exp(-0.05e0 * t) - underlying, 0) END - 1e-12
   AND {price} <= CASE WHEN put_call = 'call' THEN underlying ELSE strike * exp(-0.05e0 * t) END + 1e-12),
 b AS (SELECT *, 1 AS step, 1e-6::DOUBLE AS lo, 5e0 AS hi FROM ok
   UNION ALL SELECT contract_id, underlying, strike, t, put_call, px, step + 1, CASE WHEN f <= px THEN mid ELSE lo END, CASE WHEN f <= px THEN hi ELSE mid END
   FROM (SELECT *, {bs_at('mid')} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE step <= 45) m) n)
 SELECT i0.*, b.lo AS iv FROM i0 LEFT JOIN (SELECT * FROM b WHERE step = 46) b ON i0.contract_id = b.contract_id)"""


def lattice_sql(src: str, steps: int, american: bool) -> str:
    early = "greatest(w, CASE WHEN put_call = 'call' THEN underlying * pow(u, i - 1 - 2 * (j - 1)) - strike ELSE strike - underlying * pow(u, i - 1 - 2 * (j - 1)) END)" if american else "w"
    step = "k * (p * val[j] + (1 - p) * val[j + 1])"
    return f"""(WITH RECURSIVE l0 AS MATERIALIZED (SELECT x.*, exp(v * sqrt(t / {steps}e0)) AS u, exp(-0.05e0 * t / {steps}e0) AS k FROM ({src}) x),
 l1 AS (SELECT *, (exp(0.05e0 * t / {steps}e0) - 1 / u) / (u - 1 / u) AS p FROM l0),
 l2 AS (SELECT contract_id, put_call, underlying, strike, u, k, p, {steps} AS i, list_transform(range(0, {steps + 1}), lambda j: greatest(CASE WHEN put_call = 'call' THEN 1 ELSE -1 END
     * (underlying * pow(u, {steps}e0 - 2 * j) - strike), 0e0)) AS val FROM l1
   UNION ALL SELECT contract_id, put_call, underlying, strike, u, k, p, i - 1, list_transform(range(1, i + 1), lambda j: {early.replace('w', f'({step})', 1) if american else step}) FROM l2 WHERE i > 0)
 SELECT l0.*, l2.val[1] AS lat FROM l0 JOIN l2 ON l0.contract_id = l2.contract_id WHERE l2.i = 0)"""


valued = lambda t, **kw: ch.mispricing(t.chain(), t.vols(), **kw)
with_vol = lambda t: t.chain().join(t.vols(), "symbol")
q("v01_bs_price", lambda t: ch.add_price(with_vol(t)), "contract_id:l bs_value:4", f"SELECT contract_id, bs AS bs_value FROM ({G}) g")
q("v02_greeks", lambda t: ch.add_greeks(with_vol(t)), "contract_id:l delta:6 gamma:8 vega:5 theta:5 rho:5", f"SELECT * FROM ({G}) g")
IV = iv_sql(f"SELECT *, {MP} AS mp FROM chain", "mp")
q("v03_implied_vol", lambda t: ch.add_implied_vol(t.chain()), "contract_id:l market_price:4 iv:4", f"SELECT contract_id, mp AS market_price, iv FROM {IV} v")
q("v04_lattice_american", lambda t: ch.add_lattice(with_vol(t), steps=100), "contract_id:l lattice_value:3", f"SELECT contract_id, lat AS lattice_value FROM {lattice_sql(CV, 100, True)} l")
q("v04_lattice_european", lambda t: ch.add_lattice(with_vol(t), steps=100, american=False), "contract_id:l lattice_value:3", f"SELECT contract_id, lat AS lattice_value FROM {lattice_sql(CV, 100, False)} l")
CONF = """greatest(0, least(100, 100 - {dis} - CASE WHEN volume < 10 THEN 20 ELSE 0 END - CASE WHEN open_interest < 100 THEN 15 ELSE 0 END
 - CASE WHEN coalesce(bid, 0) <> 0 AND coalesce(ask, 0) > 0 THEN least(20, (ask - bid) / ask * 100) ELSE 0 END - CASE WHEN t < 0.02 THEN 25 ELSE 0 END))"""
SKEW = "CASE WHEN put_call = 'put' AND strike / underlying < 0.95 THEN 0.1 * (1 - strike / underlying) WHEN put_call = 'call' AND strike / underlying > 1.05 THEN -0.1 * (strike / underlying - 1) ELSE 0 END"
IVV = f"SELECT w.*, coalesce(hist_vol, w.iv, 0.25) AS v FROM {IV} w LEFT JOIN vols o ON w.symbol = o.symbol WHERE w.mp <> 0"
FAIR = f"SELECT b.*, {0.4 / 0.7!r} * bs + {0.3 / 0.7!r} * lat AS fair, CASE WHEN bs + lat > 0 THEN least(30, abs(bs - lat) / (bs + lat) * 100) ELSE 0 END AS dis FROM ({greek_sql(lattice_sql(IVV, 100, True)[1:-1])}) b"
MIS = f"SELECT g.*, fair - mp AS mis, (fair - mp) / mp AS ratio, (fair - mp) / mp > 0.05 AS under, {CONF.format(dis='dis')} AS conf, {SKEW} AS skew FROM ({FAIR}) g"
q("v05_mispricing", lambda t: valued(t), "contract_id:l fair_value:4 mispricing:4 mispricing_ratio:5 undervalued:b confidence_score:4 iv_skew:6 iv:4 delta:6",
  f"SELECT contract_id, fair AS fair_value, mis AS mispricing, ratio AS mispricing_ratio, under AS undervalued, conf AS confidence_score, skew AS iv_skew, coalesce(iv, 0.25) AS iv, delta FROM ({MIS}) m")
q("v06_consensus_value", lambda t: valued(t, with_iv=False), "contract_id:l bs_value:4 lattice_value:3 fair_value:3", f"SELECT contract_id, bs AS bs_value, lat AS lattice_value, fair AS fair_value FROM ({FAIR}) x")
q("v07_valuation_confidence", lambda t: valued(t, with_iv=False), "contract_id:l confidence_score:3", f"SELECT contract_id, conf AS confidence_score FROM ({MIS}) x")
q("v08_iv_surface", lambda t: ch.iv_surface(t.chain()), "contract_id:l strike:4 dte:l implied_vol:4 moneyness:6 t:6", f"SELECT contract_id, strike, dte, coalesce(iv, 0.25) AS implied_vol, strike / underlying AS moneyness, t FROM {IV} v WHERE mp <> 0")
q("v09_iv_skew", lambda t: t.chain().withColumn("iv_skew", ch.iv_skew()), "contract_id:l iv_skew:6", f"SELECT contract_id, {SKEW} AS iv_skew FROM chain")
MIV = f"SELECT m.* REPLACE (coalesce(iv, 0.25) AS iv), CASE WHEN put_call = 'call' THEN strike + mp ELSE strike - mp END AS be FROM ({MIS}) m"
D2 = "(ln(underlying / be) + (0.05e0 + 0.5e0 * iv * iv) * t) / (iv * sqrt(t)) - iv * sqrt(t)"
EXP = f"""SELECT e.*, CASE WHEN be > 0 THEN CASE WHEN put_call = 'call' THEN {phi('d2')} ELSE 1 - {phi('d2')} END END AS pp FROM (
 SELECT w.*, ((CASE WHEN put_call = 'call' THEN greatest(underlying * 1.05e0 - strike, 0) ELSE greatest(strike - underlying * 1.05e0, 0) END) - mp) / mp AS er,
  CASE WHEN be > 0 THEN {D2} END AS d2 FROM ({MIV}) w) e"""
q("v10_expected_returns", lambda t: ch.expected_returns(valued(t)), "contract_id:l expected_return:5 breakeven:4 prob_profit:4", f"SELECT contract_id, er AS expected_return, be AS breakeven, pp AS prob_profit FROM ({EXP}) x")
OPP = f"""SELECT o.*, least(0.1, greatest(0.01, 0.25 * CASE WHEN put_call = 'call' THEN pp ELSE pp - (1 - pp) / nullif((strike - mp) / mp, 0) END)) AS ks FROM ({EXP}) o WHERE under"""
q("v11_opportunity_analysis", lambda t: ch.opportunity_analysis(valued(t)).withColumns({c: F.concat_ws("|", c) for c in ("key_risks",)}),
  "contract_id:l breakeven:4 max_loss:4 max_gain:4 risk_reward:4 kelly_size:4 confidence_level key_risks", f"""
SELECT contract_id, be AS breakeven, mp AS max_loss, CASE WHEN put_call = 'put' THEN strike - mp END AS max_gain, CASE WHEN put_call = 'put' THEN (strike - mp) / mp END AS risk_reward, ks AS kelly_size,
 CASE WHEN conf >= 80 THEN 'high' WHEN conf >= 60 THEN 'medium' ELSE 'low' END AS confidence_level,
 concat_ws('|', CASE WHEN t < 0.08 THEN 'High time decay risk' END, CASE WHEN iv > 0.5 THEN 'High volatility risk' END, CASE WHEN volume <> 0 AND volume < 100 THEN 'Low liquidity' END) AS key_risks FROM ({OPP}) x""")
SCORE = "least(100, CASE WHEN under THEN least(40, ratio * 100) ELSE 0 END + conf * 0.3 + CASE WHEN volume <> 0 AND open_interest <> 0 THEN least(volume / 100e0, 1) * 10 + least(open_interest / 1000e0, 1) * 10 ELSE 0 END + least(10, abs(delta) * 10))"
q("v12_valuation_score", lambda t: ch.add_valuation_score(valued(t, with_iv=False)), "contract_id:l opportunity_score:4", f"SELECT contract_id, {SCORE} AS opportunity_score FROM ({MIS}) m")
q("k01_top_opportunities", lambda t: ch.top_opportunities(ch.mispricing(ch.filter_contracts(t.chain()), t.vols(), with_iv=False)), "contract_id:l symbol opportunity_score:4", f"""
SELECT contract_id, symbol, {SCORE} AS opportunity_score FROM ({MIS}) m WHERE t * 365 BETWEEN 3 AND 120 AND volume >= 50 AND open_interest >= 200 AND (bid IS NULL OR (ask - bid) / ask <= 0.1)
ORDER BY opportunity_score DESC, contract_id LIMIT 20""")
q("k03_scan", lambda t: ch.scan(valued(t), 60.0), "contract_id:l opportunity_score:4 prob_profit:4", f"SELECT contract_id, {SCORE} AS opportunity_score, pp AS prob_profit FROM ({OPP}) o WHERE {SCORE} >= 60")
REASON = f"""CASE WHEN {MP} IS NULL THEN 'no_market_price' WHEN t * 365 < 3 THEN 'too_soon_expiry' WHEN t * 365 > 100 THEN 'too_far_expiry' WHEN volume < 50 THEN 'low_volume' WHEN open_interest < 200 THEN 'low_open_interest'
 WHEN coalesce(bid, 0) <> 0 AND coalesce(ask, 0) <> 0 AND (ask - bid) / ask > 0.1 THEN 'wide_spread' END"""
q("f02_contract_filter", lambda t: ch.filter_contracts(t.chain(), max_days=100), "contract_id:l symbol strike:4", f"SELECT contract_id, symbol, strike FROM chain WHERE {REASON} IS NULL")
q("f02_contract_filter_counts", lambda t: ch.filter_counts(t.chain(), max_days=100), "reason contracts:l", f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS contracts FROM chain GROUP BY 1")
q("f03_nearest_strikes", lambda t: ch.nearest_strikes(t.chain(), 8), "contract_id:l symbol strike:4", """
SELECT contract_id, symbol, strike FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(strike - underlying), strike, put_call, contract_id) AS rn FROM chain) x WHERE rn <= 8""")
q("f04_unusual_sweeps", lambda t: ch.unusual_sweeps(t.chain()), "contract_id:l symbol direction strike:4 volume:l open_interest:l current_price:2 moneyness:2 volume_oi_ratio:2", """
SELECT contract_id, symbol, CASE WHEN put_call = 'call' THEN 'Call' ELSE 'Put' END AS direction, strike, volume, open_interest, round(underlying, 2) AS current_price,
 round(CASE WHEN put_call = 'call' THEN strike - underlying ELSE underlying - strike END / underlying * 100, 2) AS moneyness, round(volume / greatest(open_interest, 1), 2) AS volume_oi_ratio
FROM chain WHERE strike >= underlying - underlying * 0.1e0 AND strike <= underlying + underlying * 0.1e0 AND volume > greatest(open_interest * 2, 1000)""")
q("k05_nearest_expiry", lambda t: ch.nearest_expiry(t.chain(), 40), "contract_id:l symbol dte:l", """
SELECT contract_id, symbol, dte FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY abs(dte - 40), dte) AS r FROM chain) x WHERE r = 1""")
q("x10_time_to_expiry", lambda t: ch.time_to_expiry(t.raw("orders"), "o_orderdate", F.lit("1997-06-30 18:30:00").cast("timestamp_ntz")), "o_orderkey:l days_to_expiry:6 years_to_expiry:6", """
SELECT o_orderkey, greatest(epoch(o_orderdate) - epoch(TIMESTAMP '1997-06-30 18:30:00'), 0) / 86400e0 AS days_to_expiry,
 greatest(epoch(o_orderdate) - epoch(TIMESTAMP '1997-06-30 18:30:00'), 0) / 31557600e0 AS years_to_expiry FROM orders""")
q("x11_chain_features", lambda t: ch.chain_features(ch.add_greeks(with_vol(t))), "contract_id:l moneyness:6 distance_from_strike:6 time_decay_factor:6 theta_decay_rate:5 volume_oi_ratio:6 bid_ask_spread:4 spread_ratio:6", f"""
SELECT contract_id, strike / underlying AS moneyness, (underlying - strike) / strike AS distance_from_strike, 1e0 / (1 + dte) AS time_decay_factor, theta / (1 + dte) AS theta_decay_rate,
 volume / (open_interest + 1) AS volume_oi_ratio, ask - bid AS bid_ask_spread, (ask - bid) / ((ask + bid) / 2 + 0.01e0) AS spread_ratio FROM ({G}) g""")
q("x11_put_call_features", lambda t: ch.put_call_features(t.chain()), "symbol put_call_volume_ratio:6 put_call_oi_ratio:6", """
SELECT symbol, sum(CASE WHEN put_call = 'put' THEN volume ELSE 0 END) / (sum(CASE WHEN put_call = 'call' THEN volume ELSE 0 END) + 1) AS put_call_volume_ratio,
 sum(CASE WHEN put_call = 'put' THEN open_interest ELSE 0 END) / (sum(CASE WHEN put_call = 'call' THEN open_interest ELSE 0 END) + 1) AS put_call_oi_ratio FROM chain GROUP BY symbol""")
CELL = "SELECT symbol, put_call, strike, chain_date, arg_max(open_interest, contract_id) AS oi FROM chain_snapshots GROUP BY 1, 2, 3, 4"
OID = f"""SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.put_call, b.put_call) AS put_call, coalesce(a.strike, b.strike) AS strike, coalesce(a.oi, 0) - coalesce(b.oi, 0) AS oi_delta
FROM (SELECT * FROM ({CELL}) x WHERE chain_date = 2) a FULL OUTER JOIN (SELECT * FROM ({CELL}) y WHERE chain_date = 1) b ON a.symbol = b.symbol AND a.put_call = b.put_call AND a.strike = b.strike"""
q("j02_oi_delta", lambda t: ch.oi_delta(t.chain_snapshots()), "symbol put_call strike:4 oi_delta:l", OID)
PAIN = """SELECT {k}, p.strike, sum(CASE WHEN c.put_call = 'call' THEN greatest(p.strike - c.strike, 0) ELSE greatest(c.strike - p.strike, 0) END * c.open_interest * 100) AS pain
FROM (SELECT DISTINCT {k0}, strike FROM chain) p JOIN chain c ON {on} GROUP BY {k}, p.strike"""
PAIN1 = PAIN.format(k="p.symbol", k0="symbol", on="p.symbol = c.symbol")
PAIN2 = PAIN.format(k="p.symbol, p.dte", k0="symbol, dte", on="p.symbol = c.symbol AND p.dte = c.dte")
q("j10_max_pain", lambda t: ch.max_pain(t.chain()), "symbol max_pain_strike:4 pain:1", f"""
SELECT symbol, strike AS max_pain_strike, pain FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(pain, 4), strike) AS rn FROM ({PAIN1}) x) y WHERE rn = 1""")
GIV = greek_sql(f"SELECT * FROM {IV} w WHERE iv IS NOT NULL", "iv")
q("a04_gamma_exposure", lambda t: ch.gamma_exposure(ch.add_greeks(with_vol(t))), "symbol total_gamma_exposure:1 call_gex:1 put_gex:1", f"""
SELECT symbol, sum(gamma * 100 * underlying * underlying * open_interest) AS total_gamma_exposure, sum(CASE WHEN put_call = 'call' THEN gamma * 100 * underlying * underlying * open_interest ELSE 0 END) AS call_gex,
 sum(CASE WHEN put_call = 'put' THEN gamma * 100 * underlying * underlying * open_interest ELSE 0 END) AS put_gex FROM ({G}) g GROUP BY symbol""")
q("v13_chain_analytics", lambda t: ch.chain_analytics(t.chain()), "symbol dte:l contracts:l iv_count:l mean_iv:4 total_delta:4 max_pain_strike:4 pain:1", f"""
SELECT c.symbol, c.dte, contracts, coalesce(iv_count, 0) AS iv_count, mean_iv, total_delta, mp.strike AS max_pain_strike, mp.pain
FROM (SELECT symbol, dte, count(*) AS contracts FROM chain GROUP BY 1, 2) c
LEFT JOIN (SELECT symbol, dte, count(*) AS iv_count, avg(iv) AS mean_iv, sum(delta) AS total_delta FROM ({GIV}) g GROUP BY 1, 2) g ON c.symbol = g.symbol AND c.dte = g.dte
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, dte ORDER BY round(pain, 4), strike) AS rn FROM ({PAIN2}) x) mp ON c.symbol = mp.symbol AND c.dte = mp.dte AND rn = 1""")
q("j11_monitor_positions", lambda t: ch.monitor_positions(t.positions(), t.chain().filter("contract_id % 10 <> 3")), "contract_id:l current_price:4 pnl_percent:4 pnl_dollar:4 action", f"""
SELECT contract_id, px AS current_price, (px - entry_price) / entry_price * 100 AS pnl_percent, (px - entry_price) * quantity AS pnl_dollar,
 CASE WHEN (px - entry_price) / entry_price * 100 > 50 THEN 'take_profit' WHEN (px - entry_price) / entry_price * 100 < -20 THEN 'stop_loss' WHEN (px - entry_price) / entry_price * 100 > 30 THEN 'consider_exit' ELSE 'hold' END AS action
FROM (SELECT p.*, coalesce(c.mp, p.entry_price) AS px FROM positions p LEFT JOIN (SELECT contract_id, {MP} AS mp FROM chain WHERE contract_id % 10 <> 3) c ON p.contract_id = c.contract_id) x""")


def dated(t):
    s = t.chain_snapshots().select("contract_id", "chain_date", "open_interest")
    return s.join(t.chain().select("contract_id", "put_call", "underlying", "strike", "dte"), "contract_id").withColumn("t", (F.col("dte") + 2 - F.col("chain_date")) / 365.0)


DATED = "SELECT s.contract_id, s.chain_date, c.put_call, c.underlying, c.strike, (c.dte + 2 - s.chain_date) / 365e0 AS t, 0.3e0 AS v FROM chain_snapshots s JOIN chain c ON s.contract_id = c.contract_id"
q("w39_greeks_change", lambda t: ch.greeks_change(dated(t)), "contract_id:l chain_date:l delta_change:6 gamma_change:8", f"""
SELECT contract_id, chain_date, delta - lag(delta) OVER (PARTITION BY contract_id ORDER BY chain_date) AS delta_change, gamma - lag(gamma) OVER (PARTITION BY contract_id ORDER BY chain_date) AS gamma_change
FROM ({greek_sql(DATED)}) g""")

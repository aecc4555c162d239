"""Grouped summaries and risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.operators import aggregates as ag
from tapeloom.operators import risk
from tapeloom.plans.fragments import P
from tapeloom.plans.registry import Query

Y = repr(math.sqrt(252.0))
QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
LINE_SQL = ", ".join(LINE)
q("a01_group_stats", lambda t: ag.group_stats(
    t.raw("lineitem"), ["l_returnflag", "l_linestatus"],
    {"l_quantity": ["mean", "sum", "count", "min", "max", "std", "var", "first", "last"], "l_extendedprice": ["mean", "sum"], "absent": ["sum"]}, LINE),
  "l_returnflag l_linestatus l_quantity_mean:6 l_quantity_sum:2 l_quantity_count:l l_quantity_min:2 l_quantity_max:2 l_quantity_std:6 l_quantity_var:6 l_quantity_first:2 l_quantity_last:2 l_extendedprice_mean:3 l_extendedprice_sum:1", f"""
SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean, sum(l_quantity) AS l_quantity_sum, count(l_quantity) AS l_quantity_count,
 min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, stddev_samp(l_quantity) AS l_quantity_std, var_samp(l_quantity) AS l_quantity_var,
 first(l_quantity ORDER BY {LINE_SQL}) AS l_quantity_first, last(l_quantity ORDER BY {LINE_SQL}) AS l_quantity_last,
 avg(l_extendedprice) AS l_extendedprice_mean, sum(l_extendedprice) AS l_extendedprice_sum FROM lineitem GROUP BY l_returnflag, l_linestatus""")


def priced_quotes(t):
    k = F.col("quote_id")
    return t.quotes().select(
        "source", "volume", (F.col("price") * 1000).alias("market_cap"), (k % 40).alias("pe_ratio"), (k % 11 - 5).alias("change_percent"))


q("a02_portfolio_metrics", lambda t: ag.portfolio_metrics(priced_quotes(t), ["source"]),
  "source total_symbols:l total_market_cap:1 total_volume:l avg_pe_ratio:6 avg_price_change:6 price_change_volatility:6", """
SELECT source, count(*) AS total_symbols, sum(price * 1000) AS total_market_cap, sum(volume) AS total_volume, avg(nullif(quote_id % 40, 0)) AS avg_pe_ratio,
 avg(nullif(quote_id % 11 - 5, 0)) AS avg_price_change, stddev_pop(nullif(quote_id % 11 - 5, 0)) AS price_change_volatility FROM quotes GROUP BY source""")
q("a03_chain_flow", lambda t: ag.chain_flow(t.chain()),
  "symbol put_call_ratio:6 put_call_oi_ratio:6 volume_oi_ratio:6 unusual_activity_score:6 large_block_ratio:6 smart_money_indicator:6 sweep_score:6", """
SELECT symbol, sum(CASE WHEN put_call = 'put' THEN volume ELSE 0 END) / greatest(sum(CASE WHEN put_call = 'call' THEN volume ELSE 0 END), 1) AS put_call_ratio,
 sum(CASE WHEN put_call = 'put' THEN open_interest ELSE 0 END) / greatest(sum(CASE WHEN put_call = 'call' THEN open_interest ELSE 0 END), 1) AS put_call_oi_ratio,
 sum(volume) / greatest(sum(open_interest), 1) AS volume_oi_ratio, avg(CASE WHEN volume > 3 * m THEN 1e0 ELSE 0e0 END) AS unusual_activity_score,
 avg(CASE WHEN volume > 1000 THEN 1e0 ELSE 0e0 END) AS large_block_ratio,
 avg(CASE WHEN open_interest > 0 AND volume > 0.5 * open_interest THEN 1e0 ELSE 0e0 END) AS smart_money_indicator,
 avg(CASE WHEN volume > 500 THEN 1e0 ELSE 0e0 END) AS sweep_score
FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS m FROM chain) c GROUP BY symbol""")
q("a05_weighted_sentiment", lambda t: ag.weighted_sentiment(t.sentiments(), ["symbol"]), "symbol sentiment_score:6 confidence:6",
  "SELECT symbol, sum(score * confidence) / sum(confidence) AS sentiment_score, avg(confidence) AS confidence FROM sentiments GROUP BY symbol")
SUMMARY = """
SELECT symbol, sum(score * confidence) / sum(confidence) AS s, avg(confidence) AS c, count(*) AS n, count(CASE WHEN score > 0.1 THEN 1 END) AS up,
 count(CASE WHEN score < -0.1 THEN 1 END) AS down, count(DISTINCT source) AS sources, stddev_pop(CASE WHEN abs(score) > 0.01 THEN score END) AS sd,
 avg(text_len) AS tl FROM sentiments GROUP BY symbol"""
q("a06_sentiment_summary", lambda t: ag.sentiment_summary(t.sentiments()).drop("quality_score"),
  "symbol overall_sentiment:6 confidence:6 sample_size:l bullish_mentions:l bearish_mentions:l neutral_mentions:l",
  f"SELECT symbol, s AS overall_sentiment, c AS confidence, n AS sample_size, up AS bullish_mentions, down AS bearish_mentions, n - up - down AS neutral_mentions FROM ({SUMMARY}) x")
q("a07_summary_quality", lambda t: ag.sentiment_summary(t.sentiments()), "symbol quality_score:4", f"""
SELECT symbol, least(100, greatest(0, least(40, c * 40) + least(20, sources * 4) + least(15, n * 1.5) + greatest(0, 15 * (1 - least(1, sd * 2)))
 + least(10, greatest(0, (tl - 50) / 5)))) AS quality_score FROM ({SUMMARY}) x""")
q("a08_trend_label", lambda t: ag.sentiment_summary(t.sentiments()), "symbol trend", f"""
SELECT symbol, CASE WHEN c < 0.3 THEN 'uncertain' WHEN s > 0.2 AND up > down THEN 'bullish' WHEN s < -0.2 AND down > up THEN 'bearish' ELSE 'neutral' END AS trend FROM ({SUMMARY}) x""")
q("a09_source_signals", lambda t: ag.source_signals(t.sentiments(), ["view", "click"], ["purchase", "sign"]),
  "symbol overall_sentiment:6 sentiment_confidence:6 news_sentiment:6 social_sentiment:6 retail_interest:6", """
SELECT symbol, avg(score) AS overall_sentiment, avg(confidence) AS sentiment_confidence, max(CASE WHEN source IN ('view', 'click') THEN score END) AS news_sentiment,
 max(CASE WHEN source IN ('purchase', 'signup') THEN score END) AS social_sentiment,
 sum(CASE WHEN source IN ('purchase', 'signup') THEN confidence ELSE 0 END) / count(*) AS retail_interest FROM sentiments GROUP BY symbol""")
q("a10_two_level_sentiment", lambda t: ag.two_level_sentiment(t.sentiments()), "overall_sentiment:6 confidence:6 quality_score:4 tickers:l", """
SELECT avg(s) AS overall_sentiment, avg(c) AS confidence, avg(c * 100) AS quality_score, count(*) AS tickers
FROM (SELECT symbol, avg(score) AS s, avg(confidence) AS c FROM sentiments GROUP BY symbol) x""")
for key, size, share in (("a11_headline_sentiment", 25.0, 0.7), ("a11_headline_sentiment_yahoo_blend", 30.0, 0.65)):
    q(key.replace("_yahoo", "_second"), lambda t, size=size, share=share: ag.headline_sentiment(t.sentiments(), size, share),
      "symbol sentiment_score:6 variance:6 n:l confidence:6 quality:4", f"""
SELECT symbol, m AS sentiment_score, v AS variance, n, c AS confidence, (c * {share} + sz * {round(1 - share, 2)}) * 100 AS quality FROM (
 SELECT *, least(0.9, greatest(0.1, sz * (1 - least(0.6, v)))) AS c FROM (
  SELECT symbol, avg(score) AS m, var_pop(score) AS v, count(score) AS n, least(1e0, count(score) / {size}e0) AS sz FROM sentiments GROUP BY symbol) a) b""")


def venues(t):
    return t.raw("lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("venue")
    ).agg(F.sum("l_quantity").alias("ats_volume"), F.sum(F.col("l_quantity") * (F.col("l_linenumber") + 5)).alias("total_volume"))


VENUES = """SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, concat(l_returnflag, '-', l_linestatus) AS venue, sum(l_quantity) AS ats_volume,
 sum(l_quantity * (l_linenumber + 5)) AS total_volume FROM lineitem GROUP BY 1, 2"""
ATS = f"SELECT symbol, sum(ats_volume) AS a, sum(total_volume) AS v, sum(ats_volume) / sum(total_volume) * 100 AS share FROM ({VENUES}) x GROUP BY symbol"
q("a13_ats_activity", lambda t: ag.ats_activity(venues(t)).withColumn("top_venues", F.concat_ws("|", "top_venues")),
  "symbol total_ats_volume:l total_market_volume:l share_pct:4 top_venues", f"""
SELECT a.symbol, a AS total_ats_volume, v AS total_market_volume, share AS share_pct, top_venues FROM ({ATS}) a JOIN (
 SELECT symbol, string_agg(venue, '|' ORDER BY rn) AS top_venues FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ats_volume DESC, venue) AS rn FROM ({VENUES}) y) z
 WHERE rn <= 3 GROUP BY symbol) b ON a.symbol = b.symbol""")
q("a14_ats_signal", lambda t: ag.ats_activity(venues(t)), "symbol signal confidence:2", f"""
SELECT symbol, CASE WHEN share >= 15 AND a > 1000000 THEN 'high_institutional_activity' WHEN share >= 12 AND a > 500000 THEN 'elevated_institutional_activity'
 WHEN share >= 10 THEN 'moderate_institutional_activity' WHEN share >= 7 THEN 'normal_activity' ELSE 'low_institutional_activity' END AS signal,
 CASE WHEN share >= 15 AND a > 1000000 THEN 0.85 WHEN share >= 12 AND a > 500000 THEN 0.7 WHEN share >= 10 THEN 0.55 WHEN share >= 7 THEN 0.4 ELSE 0.25 END AS confidence FROM ({ATS}) x""")


def daily_ticks(t):
    return t.ticks().groupBy("symbol", F.to_date("ts").alias("ts")).agg(
        F.sum("size").alias("volume"), F.max_by("price", F.struct("ts", "event_id")).alias("close"))


def five_minutes(t):
    return t.ticks().groupBy("symbol", F.window("ts", "5 minutes")["start"].alias("bar")).agg(F.sum("size").alias("volume"))


DARK = """
SELECT d.symbol, av, rv, px, rv / av AS ratio, coalesce(lg, 0) AS lg, least((rv / av - 1) * 0.5 + coalesce(lg, 0) / 78e0 * 0.3 + 0.2, 1) AS p,
 greatest(CAST(trunc((rv - av) * 0.15) AS BIGINT), 5000) AS block
FROM (SELECT symbol, avg(volume) AS av, arg_max(volume, d) AS rv, arg_max(close, d) AS px, max(d) AS dd FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM (
     SELECT symbol, CAST(ts AS DATE) AS d, sum(size) AS volume, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2) a) b WHERE rn <= 30 GROUP BY symbol) d
LEFT JOIN (SELECT i.symbol, count(CASE WHEN i.volume > 0.01 * m.av THEN 1 END) AS lg FROM (
   SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS b, sum(size) AS volume FROM ticks GROUP BY 1, 2) i
  JOIN (SELECT symbol, avg(volume) AS av, max(d) AS dd FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM (
     SELECT symbol, CAST(ts AS DATE) AS d, sum(size) AS volume FROM ticks GROUP BY 1, 2) a) b WHERE rn <= 30 GROUP BY symbol) m
  ON i.symbol = m.symbol AND CAST(i.b AS DATE) = m.dd GROUP BY i.symbol) l ON d.symbol = l.symbol"""
q("a15_darkpool_proxy", lambda t: ag.darkpool_proxy(daily_ticks(t), five_minutes(t)),
  "symbol avg_volume:4 recent_volume:l price:4 volume_ratio:6 large_trades:l probability:6 block_size:l signal", f"""
SELECT symbol, av AS avg_volume, rv AS recent_volume, px AS price, ratio AS volume_ratio, lg AS large_trades, p AS probability, block AS block_size,
 CASE WHEN p > 0.7 THEN 'high_institutional_activity' WHEN p > 0.5 THEN 'elevated_institutional_activity' ELSE 'possible_institutional_activity' END AS signal
FROM ({DARK}) x WHERE ratio > 1.3 OR p > 0.4""")
q("a16_darkpool_strict", lambda t: ag.darkpool_proxy_strict(daily_ticks(t), five_minutes(t)), "symbol volume_ratio:6 large_trades:l probability:6 signal", f"""
SELECT symbol, ratio AS volume_ratio, lg AS large_trades, p AS probability, CASE WHEN p > 0.6 THEN 'possible_institutional_activity' ELSE 'elevated_volume' END AS signal
FROM ({DARK}) x WHERE p > 0.4""")
q("a17_insider_net", lambda t: ag.insider_net(t.quotes().select("symbol", (F.col("quote_id") % 201 - 100).alias("change"))),
  "symbol net_buying:l transactions:l sentiment", """
SELECT symbol, sum(c) AS net_buying, count(*) AS transactions, CASE WHEN sum(c) > 0 THEN 'bullish' WHEN sum(c) < 0 THEN 'bearish' ELSE 'neutral' END AS sentiment
FROM (SELECT symbol, quote_id % 201 - 100 AS c FROM quotes) x GROUP BY symbol""")
TXMAP = {"1-URGENT": "P-Purchase", "2-HIGH": "M-Exempt", "3-MEDIUM": "S-Sale", "5-LOW": "S-Sale"}
q("a18_insider_transactions", lambda t: ag.insider_transactions(t.quotes().replace(TXMAP, subset=["source"]).withColumnRenamed("source", "transaction_type")),
  "symbol recent_buys:l recent_sells:l total_transactions:l net_sentiment", """
SELECT symbol, b AS recent_buys, s AS recent_sells, n AS total_transactions, CASE WHEN b > s THEN 'bullish' WHEN s > b THEN 'bearish' ELSE 'neutral' END AS net_sentiment FROM (
 SELECT symbol, count(CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN 1 END) AS b, count(CASE WHEN source IN ('3-MEDIUM', '5-LOW') THEN 1 END) AS s, count(*) AS n
 FROM quotes GROUP BY symbol) x""")


def qid():
    return F.col("quote_id")


q("a19_analyst_consensus", lambda t: ag.analyst_consensus(t.quotes().select(
    "quote_id", (qid() % 7).alias("buy"), (qid() % 3).alias("strong_buy"), (qid() % 5).alias("sell"), (qid() % 4).alias("strong_sell"), (qid() % 6).alias("hold"))),
  "quote_id consensus", """
SELECT quote_id, CASE WHEN b > s + h THEN 'strong_buy' WHEN b > s THEN 'buy' WHEN s > b + h THEN 'strong_sell' WHEN s > b THEN 'sell' ELSE 'hold' END AS consensus
FROM (SELECT quote_id, quote_id % 7 + 2 * (quote_id % 3) AS b, quote_id % 5 + 2 * (quote_id % 4) AS s, quote_id % 6 AS h FROM quotes) x""")
q("a20_top_holders", lambda t: ag.top_holders(
    t.quotes().select("symbol", "ts", "quote_id", F.concat(F.lit("H"), qid().cast("string")).alias("holder"), F.col("volume").alias("shares")), ["ts", "quote_id"]
  ).withColumn("top_holders", F.concat_ws("|", "top_holders")),
  "symbol top_holders top_shares:l total_holders:l", """
SELECT symbol, string_agg(CASE WHEN rn <= 5 THEN concat('H', CAST(quote_id AS VARCHAR)) END, '|' ORDER BY rn) AS top_holders,
 sum(CASE WHEN rn <= 5 THEN coalesce(volume, 0) ELSE 0 END) AS top_shares, count(*) AS total_holders
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, quote_id) AS rn FROM quotes) x GROUP BY symbol""")
q("a21_latest_estimate", lambda t: ag.latest_row(t.quotes(), ["symbol"], ["ts", "quote_id"]).withColumn("gap", F.col("price") - F.col("volume") / 10.0),
  "symbol ts quote_id:l price:4 gap:4", """
SELECT symbol, ts, quote_id, price, price - volume / 10e0 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, quote_id DESC) AS rn FROM quotes) x WHERE rn = 1""")
q("a22_source_quality", lambda t: ag.source_quality(t.runs().select(
    F.col("model").alias("source"), "ts", F.col("run_id").alias("call_id"), "success", "latency", (F.col("accuracy") * 100).alias("quality"),
    F.concat(F.lit("m"), F.col("run_id").cast("string")).alias("message"))).withColumn("issues", F.concat_ws("|", "issues")),
  "source quality_score:4 latency_ms:4 success_rate:6 issues", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY model, success ORDER BY ts DESC, run_id DESC) AS rn FROM runs)
SELECT model AS source, avg(CASE WHEN success AND rn <= 100 THEN accuracy * 100 END) AS quality_score, avg(latency) AS latency_ms,
 avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS success_rate, string_agg(CASE WHEN NOT success AND rn <= 5 THEN concat('m', CAST(run_id AS VARCHAR)) END, '|' ORDER BY ts, run_id) AS issues
FROM c GROUP BY model""")
q("a23_component_metrics", lambda t: ag.component_metrics(t.runs().select(F.col("template").alias("component"), "success", F.col("latency").alias("seconds")), 51.0, 100.0),
  "component total_calls:l successful_calls:l min_time:4 max_time:4 average_time:4 success_rate:6 level", """
SELECT template AS component, n AS total_calls, ok AS successful_calls, mn AS min_time, mx AS max_time, av AS average_time, ok / n AS success_rate,
 CASE WHEN av = 0 THEN 'optimal' WHEN av > 100 THEN 'critical' WHEN av > 51 THEN 'degraded' WHEN ok / n >= 0.95 THEN 'optimal' WHEN ok / n >= 0.85 THEN 'acceptable'
  WHEN ok / n >= 0.7 THEN 'degraded' ELSE 'critical' END AS level
FROM (SELECT template, count(*) AS n, count(CASE WHEN success THEN 1 END) AS ok, min(latency) AS mn, max(latency) AS mx, avg(latency) AS av FROM runs GROUP BY template) x""")
q("a27_correlations", lambda t: risk.correlations(t.bars()), "a b n:l correlation:5", """
SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop(x.close) > 0 AND var_pop(y.close) > 0 THEN corr(x.close, y.close) END AS correlation
FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2""")


def two_years():
    return F.floor(F.col("ts") / 24)


PRET = f"SELECT symbol, ts, r FROM (SELECT symbol, ts, close / lag(close) OVER ({P}) - 1 AS r FROM periods) p WHERE r IS NOT NULL"
FULL = f"SELECT * FROM ({PRET}) p WHERE ts IN (SELECT ts FROM ({PRET}) z GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ({PRET}) u))"
q("j04_aligned_returns", lambda t: risk.complete_rows(risk.simple_returns(t.periods(), two_years())), "symbol ts:l r:6", FULL)
COV = f"SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, covar_samp(x.r, y.r) AS covariance, covar_pop(x.r, y.r) AS c FROM ({FULL}) x JOIN ({FULL}) y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY 1, 2 HAVING count(*) >= 30"
q("a28_covariance", lambda t: risk.covariance(risk.simple_returns(t.periods(), two_years())), "a b n:l covariance:5", COV)
q("a29_shrunk_covariance", lambda t: risk.shrunk_covariance(risk.simple_returns(t.periods(), two_years())), "a b covariance:5 shrinkage:6", f"""
WITH c AS ({COV}), f AS ({FULL}),
tot AS (SELECT sum(CASE WHEN a = b THEN c END) AS tr, count(CASE WHEN a = b THEN 1 END) AS p, max(n) AS n, sum(CASE WHEN a = b THEN c * c ELSE 2 * c * c END) AS dl FROM c),
bt AS (SELECT sum(s * s) AS bt FROM (SELECT ts, sum((r - m) * (r - m)) AS s FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM f) y GROUP BY ts) z),
s AS (SELECT tr / p AS mu, least((bt / n - dl) / (p * n), (dl - 2 * tr * tr / p + tr * tr / p) / p) / ((dl - 2 * tr * tr / p + tr * tr / p) / p) AS sh FROM tot, bt)
SELECT a, b, (1 - sh) * c + CASE WHEN a = b THEN sh * mu ELSE 0 END AS covariance, sh AS shrinkage FROM c, s""")
VAR = "SELECT symbol, count(r) AS n, CASE WHEN count(r) < 30 THEN 0 ELSE least(avg(r) - 1.6448536269514722e0 * stddev_samp(r), quantile_cont(r, 0.05)) END AS v FROM strategy GROUP BY symbol"
q("a30_value_at_risk", lambda t: risk.value_at_risk(t.strategy(), ["symbol"]), "symbol n_returns:l var:6", f"SELECT symbol, n AS n_returns, v AS var FROM ({VAR}) x")
q("a31_expected_shortfall", lambda t: risk.expected_shortfall(t.strategy(), ["symbol"]), "symbol n_tail:l expected_shortfall:6", f"""
SELECT s.symbol, count(CASE WHEN r <= v THEN 1 END) AS n_tail, coalesce(avg(CASE WHEN r <= v THEN r END), max(v)) AS expected_shortfall
FROM strategy s JOIN ({VAR}) v ON s.symbol = v.symbol GROUP BY s.symbol""")
MKT = "SELECT ts, avg(r) AS m FROM strategy GROUP BY ts"
BETA = f"SELECT s.symbol, count(*) AS n, CASE WHEN count(*) >= 30 AND var_samp(m) > 0 THEN covar_samp(r, m) / var_samp(m) ELSE 1 END AS beta FROM strategy s JOIN ({MKT}) k ON s.ts = k.ts GROUP BY s.symbol"
q("j05_aligned_with_market", lambda t: risk.aligned_with_market(t.strategy(), risk.market_returns(t.strategy())), "symbol ts r:6 m:6",
  f"SELECT s.symbol, s.ts, r, m FROM strategy s JOIN ({MKT}) k ON s.ts = k.ts")
q("a32_beta", lambda t: risk.beta(t.strategy(), risk.market_returns(t.strategy())), "symbol n_aligned:l beta:6", f"SELECT symbol, n AS n_aligned, beta FROM ({BETA}) x")


def ddown(src, part):
    return f"""SELECT {part}, abs(min(exp(lc - pk) - 1)) AS mdd FROM (SELECT *, max(lc) OVER (PARTITION BY {part} ORDER BY ts) AS pk FROM (
  SELECT *, sum(ln(1 + r)) OVER (PARTITION BY {part} ORDER BY ts) AS lc FROM ({src}) a) b) c GROUP BY {part}"""


DDS = ddown("SELECT * FROM strategy", "symbol")
q("a33_position_risk", lambda t: risk.position_risk(t.holdings(), t.strategy()),
  "symbol position_size:6 market_value:2 daily_var:3 expected_return:5 volatility:6 beta:6 sharpe_ratio:5 max_drawdown:6 risk_contribution:8", f"""
WITH g AS (SELECT symbol, avg(r) * 252 AS er, stddev_samp(r) * {Y} AS vol FROM strategy GROUP BY symbol),
h AS (SELECT *, market_value / sum(market_value) OVER () AS w FROM holdings)
SELECT h.symbol, w AS position_size, market_value, coalesce(abs(v.v), 0.02) * market_value AS daily_var, coalesce(er, 0) AS expected_return, coalesce(vol, 0.2) AS volatility,
 coalesce(b.beta, 1) AS beta, CASE WHEN vol > 0 THEN (er - 0.02) / vol ELSE 0 END AS sharpe_ratio, coalesce(mdd, 0) AS max_drawdown, coalesce(w * w * vol * vol, 0) AS risk_contribution
FROM h LEFT JOIN g ON h.symbol = g.symbol LEFT JOIN ({VAR}) v ON h.symbol = v.symbol LEFT JOIN ({BETA}) b ON h.symbol = b.symbol LEFT JOIN ({DDS}) d ON h.symbol = d.symbol""")
PORT = """
WITH h AS (SELECT symbol, market_value, market_value / sum(market_value) OVER () AS w FROM holdings),
p AS (SELECT 'p' AS book, ts, sum(r * w) AS r FROM strategy s JOIN h ON s.symbol = h.symbol GROUP BY ts),
v AS (SELECT least(avg(r) - 1.6448536269514722e0 * stddev_samp(r), quantile_cont(r, 0.05)) AS v FROM p),
g AS (SELECT avg(r) * 252 AS er, stddev_samp(r) * %s AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) * %s AS dn, avg(CASE WHEN r <= (SELECT v FROM v) THEN r END) AS es FROM p),
t AS (SELECT sum(market_value) AS tv, sum(w * w) AS hh FROM h),
a AS (SELECT avg(coalesce(x.vol, 0.2)) AS av FROM h LEFT JOIN (SELECT symbol, stddev_samp(r) * %s AS vol FROM strategy GROUP BY symbol) x ON h.symbol = x.symbol),
d AS (%s)
SELECT tv AS total_value, abs(v) * tv AS daily_var, er AS expected_return, vol AS volatility, (er - 0.02) / vol AS sharpe_ratio, (er - 0.02) / dn AS sortino_ratio,
 mdd AS max_drawdown, er / mdd AS calmar_ratio, av / vol AS diversification_ratio, hh AS concentration_risk, abs(es) * tv AS tail_risk FROM g, v, t, a, d""" % (Y, Y, Y, ddown("SELECT * FROM p", "book"))
q("a34_portfolio_risk", lambda t: risk.portfolio_risk(t.holdings(), t.strategy()),
  "total_value:2 daily_var:2 expected_return:6 volatility:6 sharpe_ratio:5 sortino_ratio:5 max_drawdown:6 calmar_ratio:5 diversification_ratio:6 concentration_risk:8 tail_risk:2", PORT)
q("a35_risk_violations", lambda t: risk.risk_violations(risk.portfolio_risk(t.holdings(), t.strategy()), 0.002).withColumnRenamed("limit", "limit_"), "risk_score:l within_limits:b type current:3 limit_:3 severity", f"""
WITH x AS ({PORT}), v AS (
 SELECT 'var_limit' AS type, daily_var AS current, 0.002 * total_value AS "limit", 'high' AS severity FROM x WHERE daily_var > 0.002 * total_value
 UNION ALL SELECT 'concentration_risk', concentration_risk, 0.5, 'medium' FROM x WHERE concentration_risk > 0.5
 UNION ALL SELECT 'max_drawdown', max_drawdown, 0.15, 'high' FROM x WHERE max_drawdown > 0.15)
SELECT (SELECT count(*) FROM v) AS risk_score, (SELECT count(*) FROM v) = 0 AS within_limits, type, current, "limit", severity FROM (SELECT 1) o LEFT JOIN v ON true""".replace('"limit"', "limit_"))
q("a36_trading_metrics", lambda t: risk.trading_metrics(t.strategy()),
  "symbol total_return:5 annual_return:4 volatility:6 sharpe_ratio:4 sortino_ratio:4 max_drawdown:6 win_rate:6 profit_factor:5 calmar_ratio:4 var_95:6 expected_shortfall:6", f"""
WITH g AS (SELECT symbol, exp(sum(ln(1 + r))) - 1 AS tr, pow(1 + avg(r), 252e0) - 1 AS ar, stddev_samp(r) * {Y} AS vol, stddev_samp(CASE WHEN r < 0 THEN r END) * {Y} AS dn,
 avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS wr, sum(CASE WHEN r > 0 THEN r END) / abs(sum(CASE WHEN r < 0 THEN r END)) AS pf, quantile_cont(r, 0.05) AS q FROM strategy GROUP BY symbol),
e AS (SELECT s.symbol, avg(r) AS es FROM strategy s JOIN g ON s.symbol = g.symbol WHERE r <= q GROUP BY s.symbol)
SELECT g.symbol, tr AS total_return, ar AS annual_return, vol AS volatility, (ar - 0.02) / vol AS sharpe_ratio, (ar - 0.02) / dn AS sortino_ratio, mdd AS max_drawdown,
 wr AS win_rate, pf AS profit_factor, ar / mdd AS calmar_ratio, q AS var_95, es AS expected_shortfall FROM g JOIN e ON g.symbol = e.symbol JOIN ({DDS}) d ON g.symbol = d.symbol""")
q("j09_rebalance", lambda t: risk.rebalance(t.holdings(), t.raw("supplier").groupBy(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("symbol")).agg(
    (F.count(F.lit(1)) / t.raw("supplier").agg(F.count(F.lit(1))).scalar()).alias("weight")), 0.01),
  "symbol action current_weight:6 target_weight:6 deviation:6 amount:2", """
WITH c AS (SELECT symbol, market_value, market_value / sum(market_value) OVER () AS w FROM holdings),
t AS (SELECT concat('S', CAST(s_nationkey AS VARCHAR)) AS symbol, count(*) / (SELECT count(*) FROM supplier) AS w FROM supplier GROUP BY 1),
j AS (SELECT coalesce(c.symbol, t.symbol) AS symbol, coalesce(c.w, 0) AS cw, coalesce(t.w, 0) AS tw FROM c FULL OUTER JOIN t ON c.symbol = t.symbol)
SELECT symbol, CASE WHEN tw > cw THEN 'increase' ELSE 'decrease' END AS action, cw AS current_weight, tw AS target_weight, abs(cw - tw) AS deviation,
 abs(tw - cw) * (SELECT sum(market_value) FROM c) AS amount FROM j WHERE abs(cw - tw) > 0.01""")
q("g23_equilibrium_returns", lambda t: risk.equilibrium_returns(
    risk.covariance(risk.simple_returns(t.periods(), two_years()), blocks=True), t.holdings(),
    t.raw("supplier").filter("s_nationkey < 5").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_nationkey") / 10.0).alias("view"))),
  "symbol equilibrium_return:4 expected_return:4", f"""
WITH c AS ({COV}), f AS (SELECT a, b, covariance AS v FROM c UNION ALL SELECT b, a, covariance FROM c WHERE a <> b),
w AS (SELECT symbol, market_value / sum(market_value) OVER () AS w FROM holdings),
e AS (SELECT a AS symbol, 3 * sum(v * w) AS e FROM f JOIN w ON f.b = w.symbol GROUP BY a),
s AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS symbol, s_nationkey / 10e0 AS view_ FROM supplier WHERE s_nationkey < 5)
SELECT e.symbol, e AS equilibrium_return, CASE WHEN view_ IS NULL THEN e ELSE 0.5 * e + 0.5 * view_ END AS expected_return FROM e LEFT JOIN s ON e.symbol = s.symbol""")
q("a37_classification_metrics", lambda t: ag.classification_metrics(t.raw("labels").select(F.col("quality").alias("y_true"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).otherwise(F.col("quality")).alias("y_pred"))),
  "accuracy:6 precision:6 recall:6 f1_score:6", """
WITH l AS (SELECT quality AS y, CASE WHEN doc_id % 3 = 0 THEN toxic ELSE quality END AS p FROM labels),
k AS (SELECT v, (SELECT count(*) FROM l WHERE y = v) AS s, (SELECT count(*) FROM l WHERE p = v) AS g, (SELECT count(*) FROM l WHERE y = v AND p = v) AS tp FROM (SELECT DISTINCT y AS v FROM l) d),
m AS (SELECT s, tp, coalesce(tp / nullif(g, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re FROM k)
SELECT sum(tp) / sum(s) AS accuracy, sum(pr * s) / sum(s) AS precision, sum(re * s) / sum(s) AS recall, sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * s) / sum(s) AS f1_score FROM m""")
q("a38_regression_metrics", lambda t: ag.regression_metrics(t.predictions(), ["model"]), "model mse:3 rmse:5 mae:5 r2_score:6", """
SELECT model, avg((predicted - actual) * (predicted - actual)) AS mse, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) AS mae,
 1 - avg((predicted - actual) * (predicted - actual)) / var_pop(actual) AS r2_score FROM predictions GROUP BY model""")
q("a39_auc", lambda t: ag.auc(t.raw("labels").select(F.col("quality").alias("label"), ((F.col("doc_id") * 37 % 100) / 100.0 + F.col("quality") * 0.1).alias("score"))), "auc_roc:6", """
WITH s AS (SELECT quality AS y, ((doc_id * 37) % 100) / 100e0 + quality * 0.1e0 AS s FROM labels)
SELECT sum(CASE WHEN a.s > b.s THEN 1e0 WHEN a.s = b.s THEN 0.5e0 ELSE 0e0 END) / count(*) AS auc_roc FROM s a, s b WHERE a.y = 1 AND b.y = 0""")
RM = "SELECT model, avg(accuracy) AS accuracy, avg(sharpe_ratio) AS sharpe_ratio, avg(max_drawdown) AS max_drawdown FROM runs GROUP BY model"
rm = lambda t, k="model": t.runs().groupBy(F.col(k).alias("model")).agg(*[F.avg(c).alias(c) for c in ("accuracy", "sharpe_ratio", "max_drawdown")])
q("a40_compare_models", lambda t: ag.compare_models(rm(t)), "category model value:6", f"""
WITH m AS ({RM}) SELECT 'best_accuracy' AS category, arg_max(model, accuracy) AS model, max(accuracy) AS value FROM m UNION ALL
SELECT 'best_sharpe', arg_max(model, sharpe_ratio), max(sharpe_ratio) FROM m UNION ALL SELECT 'lowest_drawdown', arg_min(model, max_drawdown), min(max_drawdown) FROM m""")
single = lambda t: t.runs().select(F.concat("model", F.lit("-"), F.col("run_id").cast("string")).alias("model"), "accuracy", "sharpe_ratio", "max_drawdown")
q("a41_model_alerts", lambda t: ag.model_alerts(single(t)), "model type severity metric value:4", """
WITH m AS (SELECT concat(model, '-', CAST(run_id AS VARCHAR)) AS model, accuracy, sharpe_ratio, max_drawdown FROM runs)
SELECT model, 'performance' AS type, 'high' AS severity, 'accuracy' AS metric, accuracy AS value FROM m WHERE accuracy < 0.5 UNION ALL
SELECT model, 'risk', 'high', 'max_drawdown', max_drawdown FROM m WHERE max_drawdown > 0.2 UNION ALL SELECT model, 'performance', 'medium', 'sharpe_ratio', sharpe_ratio FROM m WHERE sharpe_ratio < 0.5""")
AS_OF = lambda df: df.agg(F.max("ts")).scalar()
RECENT = """SELECT model, avg(CASE WHEN (actual > 0) = (predicted > 0) THEN 1e0 ELSE 0e0 END) AS accuracy, avg(CASE WHEN actual = 0 THEN abs(predicted) ELSE abs(actual - predicted) / actual END) AS avg_error,
 avg(confidence) AS avg_confidence, count(*) AS count FROM predictions WHERE ts >= (SELECT max(ts) FROM predictions) - INTERVAL 7 DAYS GROUP BY model"""
q("a42_recent_performance", lambda t: ag.recent_performance(t.predictions(), AS_OF(t.predictions())), "model accuracy:6 avg_error:5 avg_confidence:6 count:l", RECENT)
q("a43_retrain_trigger", lambda t: ag.retrain_trigger(ag.recent_performance(t.predictions(), AS_OF(t.predictions()))), "model trigger", f"""
SELECT model, CASE WHEN accuracy < 0.4 AND count >= 10 THEN 'low_accuracy' WHEN avg_error > 0.5 AND count >= 10 THEN 'high_error' WHEN avg_confidence < 0.3 AND count >= 10 THEN 'low_confidence' END AS trigger FROM ({RECENT}) x""")
ROLL = "SELECT template, condition, strategy, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS success_rate, avg(latency) AS avg_latency, max(ts) AS last_used, 1 AS usage_count FROM runs GROUP BY 1, 2, 3"
q("a45_attempt_rollup", lambda t: ag.attempt_rollup(t.runs()), "template condition strategy success_rate:6 avg_latency:4 last_used usage_count:l", ROLL)


def daily_perf(t):
    return t.runs().groupBy("template", "condition", "strategy", F.to_date("ts").alias("day")).agg(
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("latency").alias("avg_latency"), F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("usage_count"))


q("a44_template_analytics", lambda t: ag.template_analytics(daily_perf(t), AS_OF(t.runs()), 14), "template condition strategy avg_success:6 avg_latency:4 total_usage:l", """
SELECT template, condition, strategy, avg(success_rate) AS avg_success, avg(avg_latency) AS avg_latency, sum(usage_count) AS total_usage FROM (
 SELECT template, condition, strategy, CAST(ts AS DATE) AS day, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS success_rate, avg(latency) AS avg_latency, max(ts) AS last_used, count(*) AS usage_count
 FROM runs GROUP BY 1, 2, 3, 4) d WHERE last_used >= (SELECT max(ts) FROM runs) - INTERVAL 14 DAYS GROUP BY 1, 2, 3""")
q("a46_signal_statistics", lambda t: ag.signal_statistics(t.runs().select(
    "ts", F.when(F.col("sharpe_ratio") > 1, "BUY").when(F.col("sharpe_ratio") < 0, "SELL").otherwise("HOLD").alias("signal"), F.col("accuracy").alias("confidence"),
    F.col("max_drawdown").alias("risk_score"), F.col("total_return").alias("size_factor")), AS_OF(t.runs())),
  "total_signals:l buy_signals:l sell_signals:l hold_signals:l average_confidence:6 average_risk_score:6 average_size_factor:6", """
SELECT count(*) AS total_signals, count(CASE WHEN sharpe_ratio > 1 THEN 1 END) AS buy_signals, count(CASE WHEN sharpe_ratio < 0 THEN 1 END) AS sell_signals,
 count(CASE WHEN sharpe_ratio BETWEEN 0 AND 1 THEN 1 END) AS hold_signals, avg(accuracy) AS average_confidence, avg(max_drawdown) AS average_risk_score, avg(total_return) AS average_size_factor
FROM runs WHERE ts > (SELECT max(ts) FROM runs) - INTERVAL 7 DAYS""")
q("a47_market_internals", lambda t: ag.market_internals(t.bars()),
  "avg_change:4 advancers:l decliners:l up_volume:l down_volume:l advance_decline_ratio:3 breadth_status trin:3 market_sentiment counted_advancers:l counted_decliners:l counted_up_volume:2 counted_down_volume:2", f"""
WITH t AS (SELECT symbol, close, volume, lag(close) OVER ({P}) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM bars),
c AS (SELECT volume AS v, coalesce((close - p) / p * 100, 0) AS chg FROM t WHERE b = 1),
g AS (SELECT avg(chg) AS a, count(CASE WHEN chg > 0 THEN 1 END) AS ca, count(CASE WHEN chg < 0 THEN 1 END) AS cd, sum(CASE WHEN chg > 0 THEN v ELSE 0 END) AS cu, sum(CASE WHEN chg < 0 THEN v ELSE 0 END) AS cv FROM c),
e AS (SELECT *, CAST(CASE WHEN a > 0.5 THEN 2800 + trunc(a * 200) WHEN a < -0.5 THEN 1800 + trunc(a * 150) ELSE 2300 END AS BIGINT) AS ad,
 CAST(CASE WHEN a > 0.5 THEN 1800 - trunc(a * 150) WHEN a < -0.5 THEN 2800 - trunc(a * 200) ELSE 2300 END AS BIGINT) AS de,
 CAST(trunc(CASE WHEN a > 0.5 THEN 2e9 + a * 5e8 WHEN a < -0.5 THEN 1.5e9 + a * 3e8 ELSE 175e7 END) AS BIGINT) AS uv,
 CAST(trunc(CASE WHEN a > 0.5 THEN 1.5e9 - a * 3e8 WHEN a < -0.5 THEN 2e9 - a * 5e8 ELSE 175e7 END) AS BIGINT) AS dv FROM g),
r AS (SELECT *, CASE WHEN de > 0 THEN ad / de ELSE 1e0 END AS ar, CASE WHEN dv > 0 THEN uv / dv ELSE 1e0 END AS vr FROM e)
SELECT a AS avg_change, greatest(0, ad) AS advancers, greatest(0, de) AS decliners, greatest(0, uv) AS up_volume, greatest(0, dv) AS down_volume, round(ar, 3) AS advance_decline_ratio,
 CASE WHEN a > 0.5 THEN 'positive' WHEN a < -0.5 THEN 'negative' ELSE 'neutral' END AS breadth_status, round(CASE WHEN ar > 0 THEN vr / ar ELSE 1 END, 3) AS trin,
 CASE WHEN a > 1 THEN 'bullish' WHEN a < -1 THEN 'bearish' ELSE 'neutral' END AS market_sentiment, ca AS counted_advancers, cd AS counted_decliners, cu AS counted_up_volume, cv AS counted_down_volume FROM r""")
q("a48_data_profile", lambda t: ag.data_profile(t.quotes()), "size:l dimensionality:l data_type sparsity:6 has_nulls:b is_time_series:b distribution_type", """
SELECT count(*) AS size, 6 AS dimensionality, 'time_series' AS data_type, (count(*) - count(price) + count(*) - count(volume)) / (count(*) * 6e0) AS sparsity,
 count(price) < count(*) OR count(volume) < count(*) AS has_nulls, false AS is_time_series,
 CASE WHEN abs(skewness(quote_id)) < 0.5 THEN 'normal' WHEN abs(skewness(quote_id)) > 1 THEN 'skewed' ELSE 'uniform' END AS distribution_type FROM quotes""")
q("a49_category_candidates", lambda t: ag.category_candidates(t.raw("customer")).withColumnRenamed("column", "column_"), "column_ distinct_values:l total:l share:6 convert:b", """
SELECT 'c_name' AS "column", count(DISTINCT c_name) AS distinct_values, count(*) AS total, count(DISTINCT c_name) / count(*) AS share, count(DISTINCT c_name) / count(*) < 0.5 AS convert FROM customer UNION ALL
SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*), count(DISTINCT c_mktsegment) / count(*), count(DISTINCT c_mktsegment) / count(*) < 0.5 FROM customer""".replace('"column"', "column_"))
q("a50_combine_chunks", lambda t: ag.combine_chunks(t.raw("lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("chunk")).agg(
    F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("rows"), F.sum("l_extendedprice").alias("total")), ["l_returnflag"]).withColumnRenamed("rows", "rows_"),
  "l_returnflag mean:6 rows_:l total:1", "SELECT l_returnflag, avg(l_quantity) AS mean, count(*) AS rows, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1".replace(" AS rows", " AS rows_"))
q("a51_quality_weighted_ensemble", lambda t: ag.quality_weighted_ensemble(t.predictions().withColumn("day", F.to_date("ts")), ["day"]),
  "day prediction:6 mean_confidence:6 prediction_range:4 lowest:4 highest:4", """
SELECT CAST(ts AS DATE) AS day, sum(predicted * confidence) / sum(confidence) AS prediction, avg(confidence) AS mean_confidence, max(predicted) - min(predicted) AS prediction_range,
 min(predicted) AS lowest, max(predicted) AS highest FROM predictions GROUP BY 1""")
RATIOS = {"1-URGENT": "profitability", "2-HIGH": "liquidity", "3-MEDIUM": "solvency", "4-NOT SPECIFIED": "efficiency", "5-LOW": "valuation"}
q("a52_latest_ratios", lambda t: ag.latest_ratios(t.quotes().replace(RATIOS, subset=["source"]).select("symbol", F.col("source").alias("ratio"), "ts", "quote_id", F.col("price").alias("value")), list(RATIOS.values()), ["ts", "quote_id"]),
  "symbol " + " ".join(f"{n}:4" for n in RATIOS.values()),
  "SELECT symbol, " + ", ".join(f"max(CASE WHEN source = '{k}' THEN price END) AS {n}" for k, n in RATIOS.items())
  + " FROM (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY ts DESC, quote_id DESC) AS rn FROM quotes) x WHERE rn = 1 GROUP BY symbol")
q("a53_signal_pack", lambda t: ag.signal_pack(t.bars()), "symbol close:4 volume:2 high:4 low:4 volatility:4", f"""
SELECT symbol, max(CASE WHEN b = 1 THEN close END) AS close, max(CASE WHEN b = 1 THEN volume END) AS volume, max(CASE WHEN b = 1 THEN high END) AS high, max(CASE WHEN b = 1 THEN low END) AS low,
 stddev_samp(CASE WHEN b < 30 THEN close / p - 1 END) * 100 AS volatility FROM (SELECT *, lag(close) OVER ({P}) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM bars) x WHERE b <= 30 GROUP BY symbol""")
METRICS = ("accuracy", "sharpe_ratio", "max_drawdown", "total_return", "latency")
q("a54_model_report", lambda t: ag.model_report(t.runs(), METRICS, AS_OF(t.runs()), 10), "model metric mean:5 std:5 min:4 max:4 latest:4 trend",
  "WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, run_id) AS pos FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL 10 DAYS)\n" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min, max({m}) AS max, arg_max({m}, pos) AS latest, "
    + (f"CASE WHEN regr_slope({m}, pos) > 0 THEN 'improving' ELSE 'declining' END" if m in ag.TREND_METRICS else "NULL") + " AS trend FROM r GROUP BY model" for m in METRICS))
q("a54_model_advice", lambda t: ag.model_advice(t.runs()).withColumn("advice", F.concat_ws("|", "advice")), "model advice", """
SELECT model, concat_ws('|', CASE WHEN accuracy < 0.6 THEN 'Consider retraining model - accuracy below 60%' END, CASE WHEN sharpe_ratio < 1 THEN 'Risk-adjusted returns are low - review strategy' END,
 CASE WHEN max_drawdown > 0.15 THEN 'High drawdown detected - implement risk controls' END) AS advice
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, run_id DESC) AS rn FROM runs) x WHERE rn = 1""")
q("a55_diagnostics_summary", lambda t: ag.diagnostics_summary(t.runs(), AS_OF(t.runs())), "model latest_accuracy:4 total_evaluations:l avg_accuracy:6 avg_latency_ms:4 last_hour_latency_ms:4", """
SELECT model, arg_max(accuracy, (ts, run_id)) AS latest_accuracy, count(*) AS total_evaluations, avg(accuracy) AS avg_accuracy, avg(latency) AS avg_latency_ms,
 coalesce(avg(CASE WHEN ts > (SELECT max(ts) FROM runs) - INTERVAL 1 HOUR THEN latency END), 0) AS last_hour_latency_ms FROM runs GROUP BY model""")
q("a56_run_log", lambda t: ag.run_log(t.runs(), AS_OF(t.runs())).withColumnRenamed("runs", "runs_"), "template runs_:l success_rate:6 avg_duration:4", """
SELECT template, count(*) AS runs_, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS success_rate, avg(latency) AS avg_duration FROM runs
WHERE ts >= (SELECT max(ts) FROM runs) - INTERVAL 7 DAYS GROUP BY GROUPING SETS ((template), ())""")


def trades(t):
    pct = (qid() % 101).cast("string")
    return t.quotes().select(F.col("symbol").alias("ticker"), F.create_map(
        F.lit("base_case"), F.concat(pct, F.lit("% - range holds")), F.lit("bull_case"), F.when(qid() % 4 == 0, "likely").otherwise(F.concat(F.lit(" "), (qid() % 50).cast("string"), F.lit(" % breakout"))),
        F.lit("bear_case"), F.concat((qid() % 30).cast("string"), F.lit("%"))).alias("scenario_tree"))


q("a57_scenario_probabilities", lambda t: ag.scenario_probabilities(trades(t)).withColumnRenamed("case", "case_"), "ticker case_ probability:l", """
SELECT symbol AS ticker, 'Base_Case' AS case_, quote_id % 101 AS probability FROM quotes UNION ALL SELECT symbol, 'Bull_Case', quote_id % 50 FROM quotes WHERE quote_id % 4 <> 0
UNION ALL SELECT symbol, 'Bear_Case', quote_id % 30 FROM quotes""")
q("a58_post_sentiment", lambda t: ag.post_sentiment(t.sentiments()), "symbol sentiment_score:6 variance:6 n:l confidence:6 quality:4", """
SELECT symbol, m AS sentiment_score, v AS variance, n, c AS confidence, (c * 0.7 + least(1, n / 20e0) * 0.3) * 100 AS quality FROM (
 SELECT symbol, avg(score) AS m, var_pop(score) AS v, count(score) AS n, least(0.95, greatest(0.1, 1 - var_pop(score))) AS c FROM sentiments GROUP BY symbol) x""")
q("a59_price_targets", lambda t: ag.price_targets(t.quotes().select("symbol", F.concat(
    F.lit('{"targetHigh": '), (qid() % 500 + 100).cast("string"), F.lit(', "targetLow": '), (qid() % 90).cast("string"), F.when(qid() % 9 != 0, F.concat(F.lit(', "targetMean": '), (qid() % 300).cast("string"))).otherwise(F.lit("")),
    F.lit(', "targetMedian": 7.5, "numberOfAnalysts": '), (qid() % 30).cast("string"), F.lit("}")).alias("body"))),
  "symbol target_high:2 target_low:2 target_mean:2 target_median:2 num_analysts:l",
  "SELECT symbol, quote_id % 500 + 100 AS target_high, quote_id % 90 AS target_low, quote_id % 300 AS target_mean, 7.5 AS target_median, quote_id % 30 AS num_analysts FROM quotes WHERE quote_id % 9 <> 0")

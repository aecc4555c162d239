"""Data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import quality as ql
from tapeloom.plans.fragments import P
from tapeloom.plans.registry import Query

QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


NOW = "2001-06-30 12:00:00"
SRC = ("YFINANCE", "TWELVE_DATA", "FMP", "OTHER")
ZONES = ("Z", "+00:00", "+0000", "+02:00", "")
OPT_SYM = "concat('ABC', '240119', CASE WHEN put_call = 'call' THEN 'C' ELSE 'P' END, lpad(CAST(contract_id AS VARCHAR), 8, CASE WHEN contract_id % 9 = 0 THEN 'x' ELSE '0' END))"


def dirty_bars(t):
    """Bars with a source, letters-only symbols and some broken rows, derived from the row's own values."""
    d = F.day("ts")
    b = t.bars()
    n = F.col("volume").cast("int")
    src = F.element_at(F.array(*[F.lit(s) for s in SRC]), n % 4 + 1)
    return b.select(
        F.when(d % 5 == 0, F.col("symbol")).otherwise(F.translate("symbol", "0123456789", "ABCDEFGHIJ")).alias("symbol"), "ts", "open",
        F.when(d % 13 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"), "low",
        F.when(d % 11 == 0, F.col("high") * 1.5).otherwise(F.col("close")).alias("close"),
        F.when(d % 7 == 0, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"), src.alias("source"), d.alias("d"), F.col("symbol").alias("key"))


DIRTY = f"""SELECT CASE WHEN day(ts) % 5 = 0 THEN symbol ELSE translate(symbol, '0123456789', 'ABCDEFGHIJ') END AS symbol, ts, open, CASE WHEN day(ts) % 13 = 0 THEN low * 0.9e0 ELSE high END AS high, low,
 CASE WHEN day(ts) % 11 = 0 THEN high * 1.5e0 ELSE close END AS close, CASE WHEN day(ts) % 7 = 0 THEN 0e0 ELSE volume END AS volume, [{', '.join(repr(s) for s in SRC)}][CAST(volume AS INT) % 4 + 1] AS source FROM bars"""
AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 3600e0"
q("q01_quote_quality", lambda t: ql.quote_quality(t.quotes().withColumns({
    "ts": F.when(F.col("quote_id") % 29 != 0, F.col("ts")), "day_low": F.when(F.col("quote_id") % 3 == 0, F.lit(50.0)), "day_high": F.lit(300.0)}),
    at("1999-01-01 00:00:00")).withColumn("issues", F.concat_ws("|", "issues")), "quote_id:l score:2 issues", """
SELECT quote_id, CASE WHEN bp THEN 60 ELSE 100 - CASE WHEN bv THEN 20 ELSE 0 END - CASE WHEN st THEN 20 WHEN ts IS NULL THEN 10 ELSE 0 END - CASE WHEN ox THEN 10 ELSE 0 END END AS score,
 CASE WHEN bp THEN 'Missing or invalid price' ELSE concat_ws('|', CASE WHEN bv THEN 'Missing or invalid volume' END, CASE WHEN st THEN 'Stale quote timestamp' END, CASE WHEN ts IS NULL THEN 'Missing timestamp' END, CASE WHEN ox THEN 'Price outside day range' END) END AS issues
FROM (SELECT *, coalesce(price, 0) <= 0 AS bp, coalesce(volume, 0) <= 0 AS bv, coalesce(ts < TIMESTAMP '1998-12-31 23:00:00', false) AS st, quote_id % 3 = 0 AND NOT (price BETWEEN 50 AND 300) AS ox
 FROM (SELECT quote_id, price, volume, CASE WHEN quote_id % 29 <> 0 THEN ts END AS ts FROM quotes) a) b""")
q("q02_table_quality", lambda t: ql.table_quality(t.quotes(), ["quote_id", "price", "volume"], t.quotes().columns).withColumn("outlier_columns", F.concat_ws("|", "outlier_columns")),
  "rows_:l missing_pct:4 outlier_columns score:2".replace("rows_:l ", ""), """
SELECT (count(*) - count(price) + count(*) - count(volume)) * 100e0 / (6 * count(*)) AS missing_pct,
 concat_ws('|', CASE WHEN greatest(max(quote_id) - avg(quote_id), avg(quote_id) - min(quote_id)) / stddev_samp(quote_id) > 5 THEN 'quote_id' END,
  CASE WHEN greatest(max(price) - avg(price), avg(price) - min(price)) / stddev_samp(price) > 5 THEN 'price' END) AS outlier_columns,
 CASE WHEN (count(*) - count(price) + count(*) - count(volume)) * 100e0 / (6 * count(*)) > 5 THEN 80 ELSE 100 END AS score FROM quotes""")
q("q02_table_quality_bars", lambda t: ql.table_quality(t.bars(), ["close", "volume"], ["symbol", "ts", "close", "volume"]).withColumn("outlier_columns", F.concat_ws("|", "outlier_columns")),
  "missing_pct:4 outlier_columns score:2", """
SELECT 0 AS missing_pct, concat_ws('|', CASE WHEN c > 5 THEN 'close' END, CASE WHEN v > 5 THEN 'volume' END) AS outlier_columns, 100 - CASE WHEN c > 5 OR v > 5 THEN 10 ELSE 0 END AS score
FROM (SELECT max(abs(close - cm) / cs) AS c, max(abs(volume - vm) / vs) AS v FROM bars, (SELECT avg(close) AS cm, stddev_samp(close) AS cs, avg(volume) AS vm, stddev_samp(volume) AS vs FROM bars) m) x""")
Z = "SELECT symbol, ts, z FROM (SELECT symbol, ts, abs(close - avg(close) OVER w) / nullif({sd}(close) OVER w, 0) AS z, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol)) x WHERE z > 3 AND n >= {n}"
q("q03_zscore_sample", lambda t: ql.zscore_anomalies(t.bars(), ["symbol"], "close"), "symbol ts z:5", Z.format(sd="stddev_samp", n=2))
q("q04_zscore_population", lambda t: ql.zscore_anomalies(t.bars(), ["symbol"], "close", population=True, least=3), "symbol ts z:5", Z.format(sd="stddev_pop", n=3))
W10 = f"({P} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
REL = "CASE source WHEN 'YFINANCE' THEN 0.9 WHEN 'TWELVE_DATA' THEN 0.8 WHEN 'FMP' THEN 0.7 WHEN 'FINNHUB' THEN 0.6 ELSE 0.5 END"
TIME = f"CASE WHEN {AGE} > 24 THEN 0.3 WHEN {AGE} > 12 THEN 0.6 WHEN {AGE} > 6 THEN 0.8 WHEN {AGE} > 1 THEN 0.9 ELSE 1 END"
OUTSIDE = "(open > high OR open < low OR close > high OR close < low)"
BARQ = f"""SELECT symbol, ts, 1e0 AS completeness, CASE WHEN low > high THEN 0 WHEN {OUTSIDE} THEN 0.7 ELSE 1 END * CASE WHEN volume = 0 THEN 0.8 ELSE 1 END AS consistency,
 CASE WHEN k >= 10 THEN CASE WHEN sd > 0 AND abs(close - m) / sd > 3 THEN 0.7 WHEN sd > 0 AND abs(close - m) / sd > 2 THEN 0.9 ELSE 1 END * CASE WHEN vm > 0 AND (volume / vm > 10 OR volume / vm < 0.1) THEN 0.8 ELSE 1 END ELSE 1 END AS accuracy,
 {TIME} AS timeliness, CASE WHEN regexp_full_match(symbol, '[A-Z]+') THEN 1 ELSE 0.5 END AS validity, {REL} AS reliability
FROM (SELECT *, avg(close) OVER {W10} AS m, stddev_samp(close) OVER {W10} AS sd, avg(volume) OVER {W10} AS vm, count(close) OVER {W10} AS k FROM ({DIRTY}) d) x"""
q("q05_bar_quality", lambda t: ql.bar_quality(dirty_bars(t), at(NOW)), "symbol ts completeness:4 consistency:4 accuracy:4 timeliness:4 validity:4 reliability:4 overall:5",
  f"SELECT *, 0.15e0 * completeness + 0.2e0 * consistency + 0.25e0 * accuracy + 0.15e0 * timeliness + 0.15e0 * validity + 0.1e0 * reliability AS overall FROM ({BARQ}) y")
W9 = f"({P} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)"
ODD = f"""SELECT symbol, ts, k = 9 AND (coalesce(sd > 0 AND abs(close - m) / sd > 3, false) OR coalesce(vm > 0 AND volume > vm * 5, false)) AS odd FROM (
 SELECT *, avg(close) OVER {W9} AS m, stddev_samp(close) OVER {W9} AS sd, avg(volume) OVER {W9} AS vm, count(close) OVER {W9} AS k FROM ({DIRTY}) d) x"""
q("q12_bar_advice", lambda t: ql.bar_quality(dirty_bars(t), at(NOW)).withColumn("advice", F.concat_ws("|", ql.advice(ql.BAR_ADVICE, F.size("findings") > 0))), "symbol ts advice", f"""
SELECT symbol, ts, concat_ws('|', CASE WHEN consistency < 0.7 THEN 'Verify data consistency with source provider' END, CASE WHEN timeliness < 0.6 THEN 'Consider using more recent data or real-time sources' END,
 CASE WHEN reliability < 0.7 THEN 'Consider using higher reliability data sources' END, CASE WHEN odd THEN 'Review detected anomalies before using data for trading decisions' END) AS advice FROM ({BARQ}) y JOIN ({ODD}) o USING (symbol, ts)""")


def dirty_chain(t):
    k = F.col("contract_id")
    return t.chain().withColumns({
        "bid": F.when(k % 23 == 0, F.col("ask") * 1.1).when(k % 19 == 0, F.col("bid") - F.col("underlying") * 0.3).otherwise(F.col("bid")),
        "iv": F.when(k % 6 != 0, k % 60 / 10.0 - 0.3), "option_symbol": F.expr(OPT_SYM.replace("VARCHAR", "STRING")),
        "expiry": F.make_date(F.when(k % 29 == 0, 1999).otherwise(2024), F.lit(1), F.lit(19))})


DCH = f"SELECT * REPLACE (CASE WHEN contract_id % 23 = 0 THEN ask * 1.1e0 WHEN contract_id % 19 = 0 THEN bid - underlying * 0.3e0 ELSE bid END AS bid), CASE WHEN contract_id % 6 <> 0 THEN contract_id % 60 / 10e0 - 0.3e0 END AS iv, {OPT_SYM} AS option_symbol, CASE WHEN contract_id % 29 = 0 THEN 1999 ELSE 2024 END AS expiry_year FROM chain"
OPQ = f"""SELECT contract_id, 0.7e0 + 0.3e0 * (7 - CASE WHEN bid IS NULL THEN 1 ELSE 0 END - CASE WHEN iv IS NULL THEN 1 ELSE 0 END) / 7 AS completeness,
 CASE WHEN bid >= ask THEN 0 WHEN (ask - bid) / underlying > 0.1 THEN 0.7 ELSE 1 END * CASE WHEN iv < 0 OR iv > 5 THEN 0.5 ELSE 1 END AS consistency, 0.8e0 AS accuracy,
 CASE WHEN regexp_full_match(option_symbol, '[A-Z]+\\d{{6}}[CP]\\d{{8}}') THEN 1 ELSE 0.5 END * CASE WHEN expiry_year < 2000 THEN 0.3 ELSE 1 END AS validity FROM ({DCH}) d"""
q("q06_option_quality", lambda t: ql.option_quality(dirty_chain(t)), "contract_id:l completeness:5 consistency:4 accuracy:4 validity:4 overall:5",
  f"SELECT *, 0.25e0 * completeness + 0.25e0 * consistency + 0.3e0 * accuracy + 0.2e0 * validity AS overall FROM ({OPQ}) x")
AN = f"SELECT symbol, ts, close, volume, avg(close) OVER {W9} AS m, stddev_samp(close) OVER {W9} AS sd, avg(volume) OVER {W9} AS vm, count(close) OVER {W9} AS k FROM bars"
BARAN = f"""SELECT symbol, ts, 'price_outlier' AS type, 'high' AS severity, least(0.95, abs(close - m) / sd / 5) AS confidence FROM ({AN}) x WHERE k = 9 AND sd > 0 AND abs(close - m) / sd > 3
UNION ALL SELECT symbol, ts, 'volume_spike', 'medium', 0.8 FROM ({AN}) x WHERE k = 9 AND vm > 0 AND volume > vm * 5"""
q("q07_bar_anomalies", lambda t: ql.bar_anomalies(t.bars()), "symbol ts type severity confidence:5", BARAN)
q("q08_spread_anomalies", lambda t: ql.spread_anomalies(dirty_chain(t)), "contract_id:l spread_share:5", f"SELECT contract_id, (ask - bid) / underlying AS spread_share FROM ({DCH}) d WHERE (ask - bid) / underlying > 0.2")
q("q09_bar_rules", lambda t: ql.bar_rules(lambda: at(NOW)).apply(dirty_bars(t)).withColumns({c: F.concat_ws("|", c) for c in ("errors", "warnings", "info")}),
  "symbol ts errors warnings info is_valid:b quality_score:5", f"""
SELECT *, errors = '' AS is_valid, pow(0.5e0, least(5, ne)) * pow(0.9e0, least(10, nw)) AS quality_score FROM (
 SELECT symbol, ts, concat_ws('|', CASE WHEN NOT regexp_full_match(symbol, '[A-Z]+') THEN 'symbol_format' END, CASE WHEN low > high THEN 'low_above_high' END) AS errors,
  concat_ws('|', CASE WHEN open > high OR open < low THEN 'open_outside_range' END, CASE WHEN close > high OR close < low THEN 'close_outside_range' END, CASE WHEN {AGE} > 24 THEN 'stale' END) AS warnings,
  CASE WHEN {REL} < 0.7 THEN 'unreliable_source' ELSE '' END AS info,
  CASE WHEN NOT regexp_full_match(symbol, '[A-Z]+') THEN 1 ELSE 0 END + CASE WHEN low > high THEN 1 ELSE 0 END AS ne,
  CASE WHEN open > high OR open < low THEN 1 ELSE 0 END + CASE WHEN close > high OR close < low THEN 1 ELSE 0 END + CASE WHEN {AGE} > 24 THEN 1 ELSE 0 END AS nw FROM ({DIRTY}) d) x""")
W10H = f"SELECT *, avg(close) OVER {W10} AS m, stddev_samp(close) OVER {W10} AS sd, avg(volume) OVER {W10} AS vm, count(close) OVER {W10} AS k FROM ({DIRTY}) d"
q("q09_strict_rules", lambda t: ql.bar_rules(lambda: at(NOW), strict=True).apply(ql.with_history(dirty_bars(t))).withColumn("warnings", F.concat_ws("|", "warnings")), "symbol ts warnings quality_score:5", f"""
SELECT symbol, ts, warnings, pow(0.5e0, ne) * pow(0.9e0, len(warnings) - len(replace(warnings, '|', '')) + CASE WHEN warnings = '' THEN 0 ELSE 1 END) AS quality_score FROM (
 SELECT symbol, ts, CASE WHEN NOT regexp_full_match(symbol, '[A-Z]+') THEN 1 ELSE 0 END + CASE WHEN low > high THEN 1 ELSE 0 END AS ne,
  concat_ws('|', CASE WHEN open > high OR open < low THEN 'open_outside_range' END, CASE WHEN close > high OR close < low THEN 'close_outside_range' END,
   CASE WHEN k = 10 AND sd > 0 AND abs(close - m) > sd * 3 THEN 'price_outlier' END, CASE WHEN k = 10 AND volume > vm * 5 THEN 'volume_anomaly' END, CASE WHEN {AGE} > 24 THEN 'stale' END) AS warnings FROM ({W10H}) h) x""")
q("q09_time_zone", lambda t: ql.RuleSet([ql.zone_rule(lambda: F.col("at_"))]).apply(t.quotes().withColumn("at_", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, ZONES)), (F.col("quote_id") % 5 + 1).cast("int")))))
  .withColumn("errors", F.concat_ws("|", "errors")), "quote_id:l errors is_valid:b quality_score:3", """
SELECT quote_id, CASE WHEN quote_id % 5 < 3 THEN '' ELSE 'time_zone' END AS errors, quote_id % 5 < 3 AS is_valid, CASE WHEN quote_id % 5 < 3 THEN 1 ELSE 0.5 END AS quality_score FROM quotes""")
q("q09_option_rules", lambda t: ql.option_rules(expiry=True).apply(dirty_chain(t)).withColumns({c: F.concat_ws("|", c) for c in ("errors", "warnings")}),
  "contract_id:l errors warnings quality_score:5", f"""
SELECT contract_id, errors, warnings, pow(0.5e0, len(errors) - len(replace(errors, '|', '')) + CASE WHEN errors = '' THEN 0 ELSE 1 END) * CASE WHEN warnings = '' THEN 1 ELSE 0.9 END AS quality_score FROM (
 SELECT contract_id, concat_ws('|', CASE WHEN NOT regexp_full_match(option_symbol, '[A-Z]+\\d{{6}}[CP]\\d{{8}}') THEN 'option_symbol_format' END, CASE WHEN bid <= 0 THEN 'bid_positive' END, CASE WHEN ask <= 0 THEN 'ask_positive' END,
  CASE WHEN last <= 0 THEN 'last_positive' END, CASE WHEN iv < 0 OR iv > 5 THEN 'iv_range' END, CASE WHEN ask - bid <= 0 THEN 'spread_not_positive' END, CASE WHEN expiry_year < 2000 THEN 'past_expiry' END) AS errors,
  CASE WHEN ask > bid AND (ask - bid) / underlying * 100 > 10 THEN 'wide_spread' ELSE '' END AS warnings FROM ({DCH}) d) x""")
FIELDS = (ql.FieldRule("symbol", True, pattern="^C[0-9]{1,3}$"), ql.FieldRule("price", True, 20.0, 400.0), ql.FieldRule("volume", False, 100.0))
q("q10_schema_quality", lambda t: ql.schema_quality(t.quotes(), FIELDS, "ts", at("2001-12-01 06:00:00")).withColumn("failed", F.concat_ws("|", "failed")),
  "quote_id:l completeness:4 accuracy:4 timeliness:4 failed overall:4", """
SELECT quote_id, completeness, accuracy, timeliness, failed, completeness * 0.3 + accuracy * 0.5 + timeliness * 0.2 AS overall FROM (
 SELECT quote_id, (1 + CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) / 2e0 * 100 AS completeness, (6 - f1 - f2 - f3 - f4 - f5) / 6e0 * 100 AS accuracy,
  CASE WHEN h < 1 THEN 100 WHEN h < 24 THEN greatest(80, 100 - (h - 1) * 2) ELSE greatest(20, 80 - (h - 24)) END AS timeliness,
  concat_ws('|', CASE WHEN f1 = 1 THEN 'symbol:pattern' END, CASE WHEN f2 = 1 THEN 'price:required' END, CASE WHEN f3 = 1 THEN 'price:min' END, CASE WHEN f4 = 1 THEN 'price:max' END, CASE WHEN f5 = 1 THEN 'volume:min' END) AS failed
 FROM (SELECT *, (epoch(TIMESTAMP '2001-12-01 06:00:00') - epoch(ts)) / 3600e0 AS h, CASE WHEN regexp_full_match(symbol, 'C[0-9]{1,3}') THEN 0 ELSE 1 END AS f1, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS f2,
   CASE WHEN price < 20 THEN 1 ELSE 0 END AS f3, CASE WHEN price > 400 THEN 1 ELSE 0 END AS f4, CASE WHEN volume < 100 THEN 1 ELSE 0 END AS f5 FROM quotes) a) b""")
q("q11_bar_multiplier", lambda t: dirty_bars(t).withColumn("multiplier", ql.bar_multiplier(at(NOW))), "symbol ts multiplier:5", f"""
SELECT symbol, ts, CASE WHEN volume = 0 THEN 0.8 ELSE 1 END * CASE WHEN low > high THEN 0.5 ELSE 1 END * CASE WHEN open > high OR open < low THEN 0.7 ELSE 1 END * CASE WHEN close > high OR close < low THEN 0.7 ELSE 1 END
 * CASE WHEN {AGE} > 1 THEN greatest(0.8, 1 - ({AGE} - 1) * 0.1) ELSE 1 END AS multiplier FROM ({DIRTY}) d""")
q("q11_option_multiplier", lambda t: dirty_chain(t).withColumn("multiplier", ql.option_multiplier()), "contract_id:l multiplier:5", f"""
SELECT contract_id, (3 - CASE WHEN bid IS NULL THEN 1 ELSE 0 END) / 3e0 * CASE WHEN ask - bid <= 0 THEN 0.5 WHEN ask - bid > underlying * 0.1e0 THEN 0.7 ELSE 1 END AS multiplier FROM ({DCH}) d""")
q("q12_option_advice", lambda t: ql.option_quality(dirty_chain(t)).withColumn("advice", F.concat_ws("|", ql.advice(ql.OPTION_ADVICE))), "contract_id:l advice",
  f"SELECT contract_id, CASE WHEN consistency < 0.7 THEN 'Verify option pricing consistency' ELSE '' END AS advice FROM ({OPQ}) x")
q("q13_cross_field", lambda t: ql.cross_field_checks(t.sentiments().select("event_id", (F.col("event_id") * 13 % 900).alias("volume"), (F.col("event_id") % 40).alias("avg_volume"),
    F.col("score").alias("sentiment_score"), "confidence", (F.col("event_id") % 50 / 1000.0).alias("price"))).withColumn("failed", F.concat_ws("|", "failed")), "event_id:l failed", """
SELECT event_id, concat_ws('|', CASE WHEN a <> 0 AND v <> 0 AND v / a > 100 THEN 'excessive_volume' END, CASE WHEN confidence <> 0 AND abs(score) > 0.5 AND confidence < 0.3 THEN 'unsupported_sentiment' END,
 CASE WHEN a > 0 AND v / a > 5 AND event_id % 50 < 10 THEN 'volume_without_price' END) AS failed FROM (SELECT *, event_id * 13 % 900 AS v, event_id % 40 AS a FROM sentiments) x""")

"""Market relations derived from the stored tables, once as Spark plans and once as SQL views.

Aggregates replace row numbers in the Spark plans so that a hot supplier is combined before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature rows: arithmetic over the event, written once and read by both engines.
FEATURES = (
    ("close", "value + 10e0"),
    ("rsi", "(event_id * 37 % 1000) / 10e0"),
    ("macd", "(event_id * 13 % 200) / 100e0 - 1e0"),
    ("macd_signal", "(event_id * 17 % 200) / 100e0 - 1e0"),
    ("sentiment", "(event_id * 7 % 200) / 100e0 - 1e0"),
    ("sentiment_confidence", "(event_id * 31 % 100) / 100e0"),
    ("put_call_ratio", "(event_id * 11 % 200) / 100e0"),
    ("valuation_score", "(event_id * 19 % 100) / 100e0 - 0.3e0"),
    ("momentum_score", "(event_id * 3 % 40) / 100e0 - 0.2e0"),
    ("iv", "(event_id * 23 % 90) / 100e0 + 0.1e0"),
    ("t", "(event_id % 200 + 1) / 365e0"),
    ("premium", "value / 10e0 + 0.1e0"),
    ("theta", "-(event_id % 50) / 1000e0"),
    ("confidence", "(event_id * 29 % 100) / 100e0"),
    ("prediction", "(event_id * 41 % 200) / 200e0 - 0.5e0"),
    ("bollinger_position", "(event_id * 43 % 120) / 100e0 - 0.1e0"),
    ("volatility_ratio", "(event_id * 47 % 200) / 100e0"),
    ("volatility_regime", "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' ELSE 'high' END"),
    ("sharpe_ratio", "(event_id * 53 % 300) / 100e0 - 1e0"),
    ("max_drawdown", "(event_id * 59 % 40) / 100e0"),
    ("iv_rank", "(event_id * 61 % 100) / 1e0"),
    ("realized_vol_20", "(event_id * 67 % 60) / 100e0"),
    ("unusual_activity_score", "(event_id * 71 % 100) / 100e0"),
    ("volume_oi_ratio", "(event_id * 73 % 150) / 100e0"),
    ("smart_money_indicator", "(event_id * 79 % 100) / 100e0"),
    ("gex_level", "(event_id * 83 % 5 - 2) * 100e0"),
    ("sma_20", "(value + 10e0) * (0.9e0 + (event_id % 20) / 100e0)"),
    ("sma_50", "CASE WHEN event_id % 9 <> 0 THEN (value + 10e0) * (0.92e0 + (event_id % 16) / 100e0) END"),
    ("direction", "(event_id * 89 % 100) / 100e0"),
    ("direction_confidence", "(event_id * 97 % 100) / 100e0"),
    ("uncertainty", "CASE WHEN event_id % 6 <> 0 THEN (event_id * 101 % 100) / 100e0 END"),
    ("historical_vol", "CASE WHEN event_id % 7 <> 0 THEN (event_id * 103 % 50) / 1000e0 END"),
    ("vol_prediction", "(event_id * 107 % 80) / 100e0"),
    ("vol_confidence", "(event_id * 109 % 100) / 100e0"),
    ("regime", "CASE event_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'volatile' WHEN 2 THEN 'trending' WHEN 3 THEN 'sideways' ELSE 'odd' END"),
    ("expected_return", "(event_id * 113 % 100) / 100e0 - 0.5e0"),
    ("volatility", "(event_id * 127 % 60) / 100e0"),
    ("violations", "CASE WHEN event_id % 4 = 0 THEN event_id % 3 ELSE 0 END"),
    ("vega", "(event_id * 131 % 100) / 50e0"),
    ("gamma", "(event_id * 137 % 100) / 5000e0"),
    ("sentiment_change", "(event_id * 139 % 100) / 100e0 - 0.5e0"),
    ("time_decay_factor", "1e0 / (1 + event_id % 60)"),
    ("price_change_pct", "(event_id * 149 % 100) / 1000e0 - 0.05e0"),
    ("volume_ratio", "(event_id * 151 % 200) / 100e0"),
)


class Tables:
    """Lazy readers of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bars(self) -> DataFrame:
        """One series per supplier: open and close by the full line key, so partial hash aggregation applies.

        A struct as ordering would force a sort aggregate; the key columns are packed into one decimal instead, most
        significant first: order, line, part, price in cents, quantity.
        """
        def digits(c, n):
            return c.cast(f"decimal({n},0)")

        line = digits(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 16) * F.lit(f"{10**22}").cast("decimal(23,0)") + digits(
            F.col("l_partkey"), 10
        ) * F.lit(f"{10**12}").cast("decimal(13,0)") + digits(F.round(F.col("l_extendedprice") * 100) * 100 + F.col("l_quantity"), 12)
        li = self.raw("lineitem").select(
            "l_suppkey", F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"), line.cast("decimal(38,0)").alias("line"),
        )
        g = li.groupBy("l_suppkey", "ts").agg(
            F.min_by("price", "line").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "line").alias("close"),
            F.sum("qty").alias("volume"),
        )
        return g.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "ts", "open", "high", "low", "close", "volume")

    def periods(self) -> DataFrame:
        """Last close of every two calendar months: series of all symbols share their dates."""
        period = F.floor((F.year("ts") * 12 + F.month("ts") - 1) / 2).cast("bigint")
        return self.bars().groupBy("symbol", period.alias("ts")).agg(F.max_by("close", "ts").alias("close"))

    def strategy(self) -> DataFrame:
        """Return series of a damped position in every symbol."""
        from tapeloom.functions.frames import lag, own, segment

        r = F.ln(F.col("close") / lag("close")) / 50.0
        return own(segment(self.bars(), 1).withColumn("r", r)).filter(F.col("r").isNotNull()).select("symbol", "ts", "r")

    def vols(self) -> DataFrame:
        """Annual volatility per symbol of the damped series."""
        return self.strategy().groupBy("symbol").agg((F.stddev_samp("r") * 252.0**0.5).alias("hist_vol"))

    def holdings(self) -> DataFrame:
        """One position per supplier account."""
        return self.raw("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
            F.abs("s_acctbal").alias("market_value"),
        )

    def runs(self) -> DataFrame:
        """One evaluation run per event."""
        e, u = F.col("event_id"), F.col("user_id")
        return self.raw("events").select(
            e.alias("run_id"), F.col("event_type").alias("model"), "ts",
            F.concat(F.lit("T"), (u % 7).cast("string")).alias("template"),
            F.concat(F.lit("C"), (u % 3).cast("string")).alias("condition"),
            F.concat(F.lit("X"), (u % 2).cast("string")).alias("strategy"),
            (e % 3 != 0).alias("success"), F.col("value").alias("latency"),
            ((e * 17 % 100) / 100.0).alias("accuracy"), ((e * 13 % 300) / 100.0 - 0.5).alias("sharpe_ratio"),
            ((e * 29 % 40) / 100.0).alias("max_drawdown"), ((e * 7 % 90) / 100.0 - 0.3).alias("total_return"),
        )

    def spot(self) -> DataFrame:
        return self.bars().groupBy("symbol").agg(F.max_by("close", "ts").alias("s"))

    def chain(self) -> DataFrame:
        n_symbols = self.raw("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
        pk = F.col("p_partkey")
        b = self.raw("part").select(
            pk.alias("contract_id"),
            F.concat(F.lit("S"), (pk % n_symbols).cast("string")).alias("symbol"),
            F.when(F.col("p_size") % 2 == 0, "call").otherwise("put").alias("put_call"),
            "p_size",
            "p_retailprice",
            (5 + 7 * (pk % 16)).alias("dte"),
        )
        c = b.join(self.spot(), "symbol").select(
            "contract_id", "symbol", "put_call", "p_retailprice", "dte", F.col("s").alias("underlying"),
            (F.col("s") * (F.lit(0.75) + F.lit(0.01) * F.col("p_size"))).alias("strike"),
        )
        u, k = F.col("underlying"), F.col("strike")
        mid = F.when(F.col("put_call") == "call", F.greatest(u - k, F.lit(0.0))).otherwise(
            F.greatest(k - u, F.lit(0.0))
        ) + u * F.lit(0.01) * (F.lit(1.0) + (F.col("p_retailprice") - F.lit(900.0)) / F.lit(100.0)) * F.sqrt(
            F.col("dte") / F.lit(30.0)
        )
        d = c.withColumn("mid", mid)
        cid = F.col("contract_id")
        return d.select(
            "contract_id", "symbol", "put_call", "strike", "underlying", "dte", (F.col("dte") / F.lit(365.0)).alias("t"),
            F.when(cid % 17 != 0, F.col("mid") * 0.98).alias("bid"),
            (F.col("mid") * 1.02).alias("ask"),
            F.col("mid").alias("last"),
            (cid * 37 % 1500).alias("volume"),
            (cid * 91 % 4000).alias("open_interest"),
        )

    def chain_snapshots(self) -> DataFrame:
        c = self.chain()
        cid = F.col("contract_id")
        cols = ["contract_id", "symbol", "put_call", "strike"]
        new = c.filter(cid % 11 != 0).select(*cols, F.lit(2).alias("chain_date"), "open_interest")
        old = c.filter(cid % 13 != 0).select(*cols, F.lit(1).alias("chain_date"), (cid * 53 % 4000).alias("open_interest"))
        return new.unionByName(old)

    def positions(self) -> DataFrame:
        cid = F.col("contract_id")
        return self.chain().filter(cid % 7 == 0).select(
            "contract_id", "symbol", "put_call", "strike",
            (F.col("last") * (F.lit(0.6) + F.lit(0.1) * (cid % 10))).alias("entry_price"),
            (cid % 5 + 1).alias("quantity"),
        )

    def quotes(self) -> DataFrame:
        ok = F.col("o_orderkey")
        return self.raw("orders").select(
            ok.alias("quote_id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_orderdate").alias("ts"),
            F.when(ok % 19 != 0, F.col("o_totalprice") / 1000.0).alias("price"),
            F.when(ok % 23 != 0, ok % 5000).alias("volume"),
        )

    def predictions(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("sample_id"), F.col("event_type").alias("model"), "ts",
            (F.col("value") - 50.0).alias("actual"),
            ((e * 7919 % 10000) / 100.0 - 50.0).alias("predicted"),
            ((e * 31 % 100) / 100.0).alias("confidence"),
        )

    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"), "ts",
            F.col("value").alias("price"), (F.col("event_id") % 100 + 1).alias("size"),
        )

    def sentiments(self) -> DataFrame:
        """Scored readings per symbol and source."""
        e = F.col("event_id")
        return self.raw("events").select(
            "event_id", F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"),
            F.col("event_type").alias("source"), "ts",
            F.least(F.greatest((F.col("value") - 50.0) / 100.0, F.lit(-1.0)), F.lit(1.0)).alias("score"),
            ((e * 31 % 100) / 100.0).alias("confidence"), (e % 300).alias("text_len"),
        )

    def feats(self) -> DataFrame:
        """One feature row per event."""
        return self.raw("events").select(
            "event_id", F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"), "ts", *[F.expr(e).alias(n) for n, e in FEATURES]
        )

    def texts(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", F.concat(F.lit("D"), (F.col("doc_id") % 20).cast("string")).alias("symbol"), "source", "lang", "text"
        )


VIEWS: dict[str, str] = {
    "bars": """
  SELECT symbol, ts, MAX(CASE WHEN rn = 1 THEN price END) AS open, MAX(price) AS high, MIN(price) AS low,
         MAX(CASE WHEN rn = n THEN price END) AS close, SUM(qty) AS volume
  FROM (SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, l_shipdate AS ts,
               l_extendedprice / l_quantity AS price, l_quantity AS qty,
               ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_shipdate
                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn,
               COUNT(*) OVER (PARTITION BY l_suppkey, l_shipdate) AS n
        FROM lineitem) p GROUP BY symbol, ts""",
    "periods": """
  SELECT symbol, m AS ts, close FROM (
    SELECT symbol, m, close, ROW_NUMBER() OVER (PARTITION BY symbol, m ORDER BY ts DESC) AS rn
    FROM (SELECT *, CAST(floor((year(ts) * 12 + month(ts) - 1) / 2e0) AS BIGINT) AS m FROM bars) b) t WHERE rn = 1""",
    "strategy": """
  SELECT * FROM (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / 50e0 AS r FROM bars) t
  WHERE r IS NOT NULL""",
    "vols": f"""
  SELECT symbol, stddev_samp(r) * {252.0 ** 0.5!r} AS hist_vol FROM strategy GROUP BY symbol""",
    "holdings": """
  SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS symbol, abs(s_acctbal) AS market_value FROM supplier""",
    "runs": """
  SELECT event_id AS run_id, event_type AS model, ts, concat('T', CAST(user_id % 7 AS VARCHAR)) AS template,
         concat('C', CAST(user_id % 3 AS VARCHAR)) AS condition, concat('X', CAST(user_id % 2 AS VARCHAR)) AS strategy,
         event_id % 3 <> 0 AS success, value AS latency, ((event_id * 17) % 100) / 100e0 AS accuracy,
         ((event_id * 13) % 300) / 100e0 - 0.5e0 AS sharpe_ratio, ((event_id * 29) % 40) / 100e0 AS max_drawdown,
         ((event_id * 7) % 90) / 100e0 - 0.3e0 AS total_return FROM events""",
    "spot": """
  SELECT symbol, close AS s FROM (
    SELECT symbol, close, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) t WHERE rn = 1""",
    "chain": """
  SELECT contract_id, symbol, put_call, strike, underlying, dte, dte / 365e0 AS t,
         CASE WHEN contract_id % 17 = 0 THEN NULL ELSE mid * 0.98e0 END AS bid, mid * 1.02e0 AS ask, mid AS last,
         (contract_id * 37) % 1500 AS volume, (contract_id * 91) % 4000 AS open_interest
  FROM (SELECT c.*, CASE WHEN put_call = 'call' THEN GREATEST(underlying - strike, 0e0)
                         ELSE GREATEST(strike - underlying, 0e0) END
                    + underlying * 0.01e0 * (1e0 + (p_retailprice - 900e0) / 100e0) * SQRT(dte / 30e0) AS mid
        FROM (SELECT b.*, s.s AS underlying, s.s * (0.75e0 + 0.01e0 * p_size) AS strike
              FROM (SELECT p_partkey AS contract_id,
                           concat('S', CAST(p_partkey % (SELECT COUNT(*) FROM supplier) AS VARCHAR)) AS symbol,
                           CASE WHEN p_size % 2 = 0 THEN 'call' ELSE 'put' END AS put_call, p_size, p_retailprice,
                           5 + 7 * (p_partkey % 16) AS dte FROM part) b
              JOIN spot s ON b.symbol = s.symbol) c) d""",
    "chain_snapshots": """
  SELECT contract_id, symbol, put_call, strike, 2 AS chain_date, open_interest FROM chain WHERE contract_id % 11 <> 0
  UNION ALL
  SELECT contract_id, symbol, put_call, strike, 1 AS chain_date, (contract_id * 53) % 4000 FROM chain
  WHERE contract_id % 13 <> 0""",
    "positions": """
  SELECT contract_id, symbol, put_call, strike, last * (0.6e0 + 0.1e0 * (contract_id % 10)) AS entry_price,
         contract_id % 5 + 1 AS quantity FROM chain WHERE contract_id % 7 = 0""",
    "quotes": """
  SELECT o_orderkey AS quote_id, concat('C', CAST(o_custkey AS VARCHAR)) AS symbol, o_orderpriority AS source,
         o_orderdate AS ts, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 1000e0 END AS price,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 5000 END AS volume FROM orders""",
    "predictions": """
  SELECT event_id AS sample_id, event_type AS model, ts, value - 50e0 AS actual,
         ((event_id * 7919) % 10000) / 100e0 - 50e0 AS predicted, ((event_id * 31) % 100) / 100e0 AS confidence
  FROM events""",
    "ticks": """
  SELECT event_id, concat('U', CAST(user_id % 20 AS VARCHAR)) AS symbol, ts, value AS price, event_id % 100 + 1 AS size
  FROM events""",
    "sentiments": """
  SELECT event_id, concat('U', CAST(user_id % 20 AS VARCHAR)) AS symbol, event_type AS source, ts,
         LEAST(GREATEST((value - 50e0) / 100e0, -1e0), 1e0) AS score, ((event_id * 31) % 100) / 100e0 AS confidence,
         event_id % 300 AS text_len FROM events""",
    "feats": f"""
  SELECT event_id, concat('U', CAST(user_id % 20 AS VARCHAR)) AS symbol, ts, {', '.join(f'{e} AS {n}' for n, e in FEATURES)} FROM events""",
    "texts": """
  SELECT doc_id, concat('D', CAST(doc_id % 20 AS VARCHAR)) AS symbol, source, lang, text FROM documents""",
}


def with_views(sql: str) -> tuple[str, str]:
    """The view definitions a text needs, in dependency order, as a WITH prefix (ends in a comma when not empty)."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    return "".join(f"{n} AS ({VIEWS[n]}),\n" for n in VIEWS if n in needed), sql

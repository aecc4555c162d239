"""Sources, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.operators import relational as rel
from tapeloom.plans.fragments import P
from tapeloom.plans.registry import Query
from tapeloom.session import scratch
from tapeloom.sources import readers as rd
from tapeloom.sources import stored as sd

QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


def qid():
    return F.col("quote_id")


def txt(c):
    return F.col(c).cast("string")


def landed_csv(t, df, label):
    """Write a derived table as CSV files and hand back the folder, as a vendor drop would arrive."""
    path = scratch(t.spark, label)
    df.write.option("header", True).csv(path)
    return path


ORDER_CSV = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
orders = lambda t: t.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
q("s01_csv_bulk", lambda t: rd.read_csv(t.spark, landed_csv(t, orders(t), "s01"), ORDER_CSV, lambda d: d.filter("o_totalprice > 1000").withColumn("thousands", F.col("o_totalprice") / 1000)),
  "o_orderkey:l o_custkey:l thousands:5", "SELECT o_orderkey, o_custkey, o_totalprice / 1000 AS thousands FROM orders WHERE o_totalprice > 1000")
q("s02_csv_load", lambda t: rd.read_csv(t.spark, landed_csv(t, orders(t), "s02"), ORDER_CSV).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")),
  "o_orderpriority n:l total:1", "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
q("s03_ats_csv", lambda t: rd.read_ats_csv(t.spark, landed_csv(t, t.raw("lineitem").groupBy(F.concat(F.lit("S"), txt("l_suppkey")).alias("IssueSymbol"), F.col("l_returnflag").alias("VenueName")).agg(
    F.sum("l_quantity").alias("ATSVolume"), F.sum(F.col("l_quantity") * 7).alias("TotalVolume")), "s03")), "symbol venue ats_volume:2 total_volume:2",
  "SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, l_returnflag AS venue, sum(l_quantity) AS ats_volume, sum(l_quantity * 7) AS total_volume FROM lineitem GROUP BY 1, 2")


def series_docs(t):
    """One vendor document per symbol and month, so that a document stays small."""
    d = F.day("ts")
    stamp = F.when(d % 9 == 0, "not a date").when(d % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    v = F.struct(stamp.alias("datetime"), *[F.when((d % 7 == 0) & F.lit(c == "high"), "none").otherwise(txt(c)).alias(c) for c in ("open", "high", "low", "close")], txt("volume").alias("volume"))
    return t.bars().groupBy("symbol", fr.month_block().alias("m")).agg(F.to_json(F.struct(F.collect_list(v).alias("values"))).alias("body"))


q("s04_series_documents", lambda t: rd.series_documents(series_docs(t)), "symbol ts open:4 high:4 close:4 volume:l",
  "SELECT symbol, ts, open, CASE WHEN day(ts) % 7 <> 0 THEN high END AS high, close, volume FROM bars WHERE day(ts) % 9 <> 0")
q("s05_daily_history", lambda t: rd.daily_history(t.quotes().select("symbol", F.to_date("ts").alias("date"), "quote_id", F.when(qid() % 10 == 0, "bad").otherwise(txt("price")).alias("open"),
    txt("price").alias("high"), txt("price").alias("low"), (F.col("price") * 1.1).alias("close"), "volume"), ["quote_id"]), "symbol date open:4 close:4 volume:l", """
SELECT symbol, date, round(price, 6) AS open, round(price * 1.1e0, 6) AS close, volume FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY quote_id DESC) AS rn
 FROM quotes WHERE price IS NOT NULL AND quote_id % 10 <> 0) x WHERE rn = 1""")
q("s06_dividends_splits", lambda t: rd.dividends_and_splits(t.quotes().select("symbol", F.to_json(F.struct(
    F.create_map(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(qid() % 6 == 0, "n/a").otherwise((qid() % 100 / 10).cast("string"))).alias("dividends"),
    F.create_map(F.date_format("ts", "yyyy-MM-dd"), (qid() % 4).cast("string")).alias("splits"))).alias("body"))), "symbol kind date value:4", """
SELECT symbol, 'dividend' AS kind, strftime(ts, '%Y-%m-%d') AS date, quote_id % 100 / 10e0 AS value FROM quotes WHERE quote_id % 6 <> 0 UNION ALL SELECT symbol, 'split', strftime(ts, '%Y-%m-%d'), quote_id % 4 FROM quotes""")


PRIMARY = "source in ('1-URGENT', '2-HIGH') and symbol like '%3'"


def earnings_primary(t):
    alt = qid() % 2 == 0
    body = F.when(alt, F.to_json(F.struct(F.col("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("AMC").alias("time"), (qid() % 90).alias("epsEstimated"), (qid() % 80).alias("eps")))).otherwise(
        F.to_json(F.struct(F.col("symbol").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("epsDate"), F.lit("none").alias("timeOfDay"), (qid() % 90).alias("epsEstimate"), (qid() % 80).alias("epsActual"), (qid() % 70).alias("revenue"))))
    return t.quotes().filter(PRIMARY).select(body.alias("body"))


q("s07_earnings_calendar", lambda t: rd.earnings_calendar(earnings_primary(t), t.quotes().filter(f"not ({PRIMARY})").select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"), (qid() % 60).cast("double").alias("eps_estimate"))),
  "symbol date time eps_estimate:2 eps_actual:2 revenue_actual:2 source", f"""
SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN quote_id % 2 = 0 THEN 'amc' END AS time, quote_id % 90 AS eps_estimate, quote_id % 80 AS eps_actual, CASE WHEN quote_id % 2 = 1 THEN quote_id % 70 END AS revenue_actual, 'primary' AS source
FROM quotes WHERE {PRIMARY} UNION ALL SELECT symbol, strftime(ts, '%Y-%m-%d'), NULL, quote_id % 60, NULL, NULL, 'secondary' FROM quotes q WHERE NOT ({PRIMARY}) AND symbol NOT IN (SELECT symbol FROM quotes WHERE {PRIMARY})""")


def side_frame(t, name):
    c = t.chain().filter(F.col("put_call") == name)
    k = F.col("contract_id")
    return c.select("symbol", F.when(k % 31 == 0, "?").otherwise(txt("strike")).alias("strike"), txt("last").alias("last"), txt("bid").alias("bid"), F.when(k % 8 == 0, "n/a").otherwise(txt("ask")).alias("ask"), txt("volume").alias("volume"), txt("open_interest").alias("open_interest"))


q("s08_flatten_chain", lambda t: rd.flatten_chain(side_frame(t, "call"), side_frame(t, "put")), "symbol put_call strike:3 last:3 bid:3 ask:3 volume:l open_interest:l",
  "SELECT symbol, put_call, strike, last, bid, CASE WHEN contract_id % 8 <> 0 THEN ask END AS ask, volume, open_interest FROM chain WHERE contract_id % 31 <> 0")
snap = lambda t: t.chain_snapshots().join(t.chain().select("contract_id", F.col("dte").alias("expiry")), "contract_id").withColumnRenamed("contract_id", "ingest")
SNAP = "SELECT s.contract_id AS ingest, s.symbol, s.put_call, s.strike, s.chain_date, s.open_interest, c.dte AS expiry FROM chain_snapshots s JOIN chain c ON s.contract_id = c.contract_id"
SNAP_UPSERTED = f"""
SELECT symbol, expiry, chain_date, put_call, strike, open_interest FROM (SELECT *, row_number() OVER (PARTITION BY symbol, expiry, chain_date, put_call, strike ORDER BY fresh DESC, ingest DESC) AS rn FROM (
 SELECT *, 0 AS fresh FROM ({SNAP}) a UNION ALL SELECT * REPLACE (open_interest + 1000 AS open_interest), 1 FROM ({SNAP}) b WHERE ingest % 3 = 0) c) d WHERE rn = 1"""
q("s09_snapshot_upsert", lambda t: rd.upsert(snap(t), snap(t).filter("ingest % 3 = 0").withColumn("open_interest", F.col("open_interest") + 1000)), "symbol expiry:l chain_date:l put_call strike:4 open_interest:l", SNAP_UPSERTED)


def stored_snapshots(t):
    """Two loads into a store partitioned by chain date, read back."""
    path, rows = scratch(t.spark, "snapshots"), snap(t).select(*rd.SNAPSHOT_KEY, "open_interest", "ingest")
    sd.upsert_stored(path, rows)
    sd.upsert_stored(path, rows.filter("ingest % 3 = 0").withColumn("open_interest", F.col("open_interest") + 1000))
    return sd.read_stored(t.spark, path, rows.schema)


q("s09_stored_upsert", stored_snapshots, "symbol expiry:l chain_date:l put_call strike:4 open_interest:l", SNAP_UPSERTED)
q("s10_latest_snapshot", lambda t: rd.latest_snapshot(snap(t)), "ingest:l symbol expiry:l chain_date:l open_interest:l",
  f"SELECT ingest, symbol, expiry, chain_date, open_interest FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol, expiry ORDER BY chain_date DESC) AS r FROM ({SNAP}) a) b WHERE r = 1")


def playbook_files(t):
    trade = lambda kind: F.struct(
        F.col("symbol").alias("ticker"), F.lit(kind).alias("direction"), F.col("source").alias("instrument"), (qid() % 50).cast("string").alias("profit_target"),
        F.create_map(F.lit("base_case"), F.concat((qid() % 100).cast("string"), F.lit("% flat"))).alias("scenario_tree"))
    path = scratch(t.spark, "s11")
    t.quotes().select(F.to_json(F.struct(F.array(trade("long"), trade("short")).alias("trades"), F.col("source").alias("tomorrows_tape"))).alias("value")).write.text(path)
    return rd.read_playbooks(t.spark, path)


q("s11_playbook_files", lambda t: playbook_files(t).withColumn("base_case", F.col("scenario_tree")["base_case"]), "ticker direction instrument profit_target base_case", """
SELECT symbol AS ticker, d AS direction, source AS instrument, CAST(quote_id % 50 AS VARCHAR) AS profit_target, concat(CAST(quote_id % 100 AS VARCHAR), '% flat') AS base_case FROM quotes, (SELECT unnest(['long', 'short']) AS d) k""")


def written(t):
    path = scratch(t.spark, "s12")
    rd.write_results(t.quotes().select("quote_id", "price"), path, "run-1", "2001-01-01")
    return t.spark.read.schema("quote_id bigint, price double, run_id string, as_of string").json(path)


q("s12_write_results", written, "quote_id:l price:4 run_id as_of", "SELECT quote_id, price, 'run-1' AS run_id, '2001-01-01' AS as_of FROM quotes")


def appended(t):
    path = scratch(t.spark, "s13")
    day = t.runs().groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    rd.append_metrics(day, path)
    rd.append_metrics(day.filter("accuracy < 0.5"), path)
    return t.spark.read.parquet(path)


q("s13_append_metrics", appended, "model accuracy:6 n:l", "WITH d AS (SELECT model, avg(accuracy) AS accuracy, count(*) AS n FROM runs GROUP BY 1) SELECT * FROM d UNION ALL SELECT * FROM d WHERE accuracy < 0.5")
pid = "CAST(page_id AS VARCHAR)"


def breadth_pages(t):
    p = F.col("page_id").cast("string")
    return t.raw("pages").select("page_id", F.concat("html", F.lit("<td>Advancing<b>55.2% ("), p, F.lit(")</b></td><td>Declining(<i>7"), p, F.lit("</i>)</td><p>New High2.1% <b>(3"), p, F.lit(")</b></p>")).alias("html"))


q("s14_breadth_counts", lambda t: rd.breadth_counts(breadth_pages(t)), "page_id:l advancers:l decliners:l new_highs:l new_lows:l",
  f"SELECT page_id, page_id AS advancers, CAST(concat('7', {pid}) AS BIGINT) AS decliners, CAST(concat('3', {pid}) AS BIGINT) AS new_highs, NULL AS new_lows FROM pages")
CELL = '<a href="[^"]*">([^<]*)</a>'
q("s15_listed_tickers", lambda t: rd.listed_tickers(t.raw("pages"), CELL), "ticker", f"""
SELECT DISTINCT replace(upper(x), 'ẞ', 'SS') AS ticker FROM (SELECT trim(unnest(regexp_extract_all(html, '{CELL}', 1))) AS x FROM pages) a WHERE regexp_full_match(x, '\\p{{L}}{{2,5}}')""")
q("s16_headlines", lambda t: rd.headlines(t.raw("pages").select("page_id", F.regexp_extract_all("html", F.lit("<(?:h1|li|p)>([^<]*)<"), F.lit(1)).alias("items"))), "page_id:l headline",
  "SELECT page_id, h AS headline FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '<(?:h1|li|p)>([^<]*)<', 1)), ' ') AS h FROM pages) a WHERE h <> ''")

# Filters ---------------------------------------------------------------------------------------------------------
q("f01_conditions", lambda t: rel.where(t.raw("lineitem"), {"l_quantity": {"min": 5, "max": 40}, "l_returnflag": {"in": ["A", "R"]}, "l_linenumber": {"not_in": [2, 3]}, "l_linestatus": "F", "absent": 1}),
  "l_orderkey:l l_linenumber:l l_quantity:2", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (2, 3) AND l_linestatus = 'F'")
word = lambda: F.split(F.trim("text"), " ")[0]


def heads(t):
    """Headlines: the whole text; the symbol is the document's second word, so that some mention it and some do not."""
    return t.raw("documents").select("doc_id", F.concat(F.lit("D"), (F.col("doc_id") % 20).cast("string")).alias("symbol"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("buy $d"), (F.col("doc_id") % 25).cast("string"), F.lit(" now "), "text")).otherwise(F.col("text")).alias("headline"))


HEADS = "SELECT doc_id, concat('D', CAST(doc_id % 20 AS VARCHAR)) AS symbol, CASE WHEN doc_id % 3 = 0 THEN concat('buy $d', CAST(doc_id % 25 AS VARCHAR), ' now ', text) ELSE text END AS headline FROM documents"
q("f05_symbol_headlines", lambda t: rel.symbol_headlines(heads(t), ["doc_id"], 5), "symbol doc_id:l matched:b", f"""
WITH h AS (SELECT *, contains(concat(' ', upper(headline), ' '), concat(' ', upper(symbol), ' ')) OR contains(upper(headline), concat('$', upper(symbol))) AS matched FROM ({HEADS}) x),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_id) AS rn FROM h WHERE matched OR symbol NOT IN (SELECT symbol FROM h WHERE matched)) SELECT symbol, doc_id, matched FROM k WHERE rn <= 5""")
WORDS, ALIASES = ("theth", "ingen", "ation"), {"D1": ("eau", "ent"), "D7": ("zzz",), "D9": ("cion", "ung")}
q("f06_relevant_articles", lambda t: rel.relevant_articles(heads(t), "headline", WORDS, ALIASES), "symbol doc_id:l", f"""
SELECT symbol, doc_id FROM (SELECT *, lower(headline) AS t FROM ({HEADS}) x) y WHERE contains(t, concat('$', lower(symbol))) OR contains(t, concat(' ', lower(symbol), ' ')) OR contains(t, 'theth') OR contains(t, 'ingen') OR contains(t, 'ation')
 OR (symbol = 'D1' AND (contains(t, 'eau') OR contains(t, 'ent'))) OR (symbol = 'D7' AND contains(t, 'zzz')) OR (symbol = 'D9' AND (contains(t, 'cion') OR contains(t, 'ung')))""")
q("t06_relevance_score", lambda t: rel.relevance_score(heads(t), "headline", WORDS, ALIASES), "symbol doc_id:l relevance:4", f"""
SELECT symbol, doc_id, CASE WHEN contains(t, concat('$', lower(symbol))) THEN 1 ELSE 0 END + CASE WHEN contains(t, concat(' ', lower(symbol), ' ')) THEN 0.8 ELSE 0 END
 + CASE WHEN (symbol = 'D1' AND (contains(t, 'eau') OR contains(t, 'ent'))) OR (symbol = 'D7' AND contains(t, 'zzz')) OR (symbol = 'D9' AND (contains(t, 'cion') OR contains(t, 'ung'))) THEN 0.6 ELSE 0 END
 + least(0.5, 0.1 * (CASE WHEN contains(t, 'theth') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ingen') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ation') THEN 1 ELSE 0 END)) AS relevance FROM (SELECT *, lower(headline) AS t FROM ({HEADS}) x) y""")
q("f07_typed_quote", lambda t: rel.typed_quote(t.quotes().withColumn("change", (qid() % 7 - 3) / 8.0), ["price", "change"]), "quote_id:l price:3 change:3 volume:l",
  "SELECT quote_id, round(CAST(price AS DECIMAL(18, 6)), 2) AS price, CASE WHEN quote_id % 7 <> 3 THEN round((quote_id % 7 - 3) / 8e0, 2) END AS change, nullif(volume, 0) AS volume FROM quotes")
q("f08_movers", lambda t: rel.movers(t.bars(), 25, 50.0), "symbol change_pct:4 high_volume:b large_mover:b", f"""
SELECT symbol, (close / p - 1) * 100 AS change_pct, volume > 25 AS high_volume, coalesce(abs((close / p - 1) * 100) > 50, false) AS large_mover FROM (SELECT *, lag(close) OVER ({P}) AS p, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) x WHERE rn = 1""")


def gated(t):
    ok, bad = rel.quality_gate(t.quotes().withColumn("score", (qid() * 7 % 100).cast("double")))
    return ok.withColumn("status", F.lit("ok")).unionByName(bad.withColumn("status", F.lit("warning"))).groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))


q("f09_quality_gate", gated, "status source n:l", "SELECT CASE WHEN quote_id * 7 % 100 >= 60 THEN 'ok' ELSE 'warning' END AS status, source, count(*) AS n FROM quotes GROUP BY 1, 2")
q("f10_drop_invalid", lambda t: rel.drop_invalid(t.quotes(), t.raw("customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), txt("c_custkey")).alias("symbol"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("c_nationkey")).alias("expires")), F.lit("2000-01-11").cast("date")),
  "quote_id:l symbol", "SELECT quote_id, symbol FROM quotes WHERE symbol NOT IN (SELECT concat('C', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 10)")
q("f11_safe_casts", lambda t: t.quotes().select(
    "quote_id", rd.clean_number(F.when(qid() % 5 == 0, " NaN ").when(qid() % 5 == 1, "None").when(qid() % 5 == 2, "abc").otherwise(F.concat(F.lit(" "), (qid() % 900 / 8.0).cast("string")))).alias("number"),
    rd.clean_percent(F.when(qid() % 4 == 0, "-").otherwise(F.concat(F.lit("1,"), (qid() % 900 + 100).cast("string"), F.lit(".5%")))).alias("percent"),
    rd.clean_time(F.when(qid() % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(qid() % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(qid() % 4 == 2, "soon").otherwise((qid() * 1000).cast("string"))).alias("time")),
  "quote_id:l number:4 percent:3 time", """
SELECT quote_id, CASE WHEN quote_id % 5 > 2 THEN quote_id % 900 / 8e0 END AS number, CASE WHEN quote_id % 4 <> 0 THEN 1000 + quote_id % 900 + 100.5 END AS percent,
 CASE WHEN quote_id % 4 IN (0, 1) THEN ts WHEN quote_id % 4 = 3 THEN make_timestamp(quote_id * 1000000000) END AS time FROM quotes""".replace("1000 + quote_id % 900 + 100.5", "CAST(concat('1', CAST(quote_id % 900 + 100 AS VARCHAR), '.5') AS DOUBLE)"))
q("f12_sentiment_bucket", lambda t: t.sentiments().withColumn("bucket", rel.sentiment_bucket(F.col("score"))), "event_id:l bucket",
  "SELECT event_id, CASE WHEN score < -0.1 THEN 'negative' WHEN score > 0.1 THEN 'positive' ELSE 'neutral' END AS bucket FROM sentiments")
q("f13_price_volume", lambda t: t.quotes().withColumn("market_cap", F.col("price") * F.col("volume")), "quote_id:l market_cap:3", "SELECT quote_id, price * volume AS market_cap FROM quotes")
q("f14_search_securities", lambda t: rel.search_securities(t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
    F.col("c_name").alias("name"), F.concat(F.lit("C"), txt("c_custkey")).alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, "etf").otherwise("equity").alias("asset_class"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country")),
    "equity", "c1", sector={"in": ["MACHINERY", "BUILDING"]}), "symbol name sector country", """
SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS symbol, c_name AS name, c_mktsegment AS sector, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey % 3 <> 0 AND c_mktsegment IN ('MACHINERY', 'BUILDING') AND (contains(concat('c', CAST(c_custkey AS VARCHAR)), 'c1') OR contains(lower(c_name), 'c1'))""")
q("f15_sector_validity", lambda t: rel.sector_validity(t.quotes().select(F.col("symbol").alias("batch"), F.when(qid() % 40 == 0, "industry").otherwise("sector").alias("group_type"), (qid() % 120 - 10).cast("double").alias("p1"), F.when(qid() % 3 == 0, F.lit(5.0)).alias("p2")), ["p1", "p2"]),
  "batch valid:b score:2", "SELECT symbol AS batch, bool_and(quote_id % 40 <> 0 AND quote_id % 120 - 10 <= 100) AS valid, CASE WHEN bool_and(quote_id % 40 <> 0 AND quote_id % 120 - 10 <= 100) THEN 85 ELSE 55 END AS score FROM quotes GROUP BY 1")
q("f16_retention", lambda t: rel.retain(t.runs(), "ts", t.runs().agg(F.max("ts")).scalar(), 10), "run_id:l model", "SELECT run_id, model FROM runs WHERE ts > (SELECT max(ts) FROM runs) - INTERVAL 10 DAYS")


def stored_runs(t):
    """Runs in a store partitioned by day, after retention, read back."""
    path, rows = scratch(t.spark, "runs"), t.runs().select("run_id", "model", "ts").withColumn("day", F.to_date("ts"))
    rows.repartition("day").write.partitionBy("day").parquet(path)
    sd.retain_stored(t.spark, path, rows.schema, "ts", rows.agg(F.max("ts")).first()[0], 10)
    return sd.read_stored(t.spark, path, rows.schema)


q("f16_stored_retention", stored_runs, "run_id:l model", "SELECT run_id, model FROM runs WHERE ts > (SELECT max(ts) FROM runs) - INTERVAL 10 DAYS")

# Joins -----------------------------------------------------------------------------------------------------------
# Orders of nine in ten customers keep their key, the others miss: both sides have rows without a partner.
shifted = lambda: F.col("o_custkey") - F.when(F.col("o_custkey") % 10 == 0, 10_000_000).otherwise(0)
cust = lambda t: t.raw("customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
ords = lambda t: t.raw("orders").select(shifted().alias("k"), "o_orderkey")
for how in ("inner", "left", "right", "outer"):
    q(f"j01_merge_{how}", lambda t, how=how: rel.merge(ords(t), cust(t), ["k"], how), "k:l o_orderkey:l c_mktsegment",
      f"SELECT k, o_orderkey, c_mktsegment FROM (SELECT o_custkey - CASE WHEN o_custkey % 10 = 0 THEN 10000000 ELSE 0 END AS k, o_orderkey FROM orders) o {'full' if how == 'outer' else how} JOIN (SELECT c_custkey AS k, c_mktsegment FROM customer) c USING (k)")
q("j01_merge_cross", lambda t: rel.merge(t.raw("nation").select("n_name"), t.raw("region").select("r_name"), None, "cross"), "n_name r_name", "SELECT n_name, r_name FROM nation, region")


def blocks(t):
    b = t.bars()
    return [b.filter(F.day("ts") % 3 != 0).select("symbol", "ts", F.col("close").alias("a")), b.filter(F.day("ts") % 4 != 0).select("symbol", "ts", F.col("volume").alias("b"))]


q("j03_align_features", lambda t: rel.align_features(blocks(t)), "symbol ts a:4 b:2", f"""
SELECT symbol, ts, coalesce(last_value(a IGNORE NULLS) OVER ({P}), 0) AS a, coalesce(last_value(b IGNORE NULLS) OVER ({P}), 0) AS b FROM (
 SELECT symbol, ts, CASE WHEN day(ts) % 3 <> 0 THEN close END AS a, CASE WHEN day(ts) % 4 <> 0 THEN volume END AS b FROM bars WHERE day(ts) % 3 <> 0 OR day(ts) % 4 <> 0) x""")
cand = lambda t: t.quotes().select("symbol", "source", "quote_id", "price", F.substring("source", 1, 1).cast("int").alias("p"), (qid() % 101).cast("double").alias("score")).withColumn("priority", F.struct("p", "quote_id"))
CAND = "SELECT symbol, source, quote_id, price, CAST(substr(source, 1, 1) AS INT) AS p, quote_id % 101 AS score FROM quotes"
q("j06_best_source", lambda t: rel.best_source(cand(t)), "symbol source quote_id:l score:2",
  f"SELECT symbol, source, quote_id, score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN score >= 95 THEN 0 ELSE 1 END, CASE WHEN score < 95 THEN -score ELSE 0 END, p, quote_id) AS rn FROM ({CAND}) c WHERE score > 0) x WHERE rn = 1")
q("j07_first_source", lambda t: rel.first_source(cand(t)), "symbol source quote_id:l price:4",
  f"SELECT symbol, source, quote_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, quote_id) AS rn FROM ({CAND}) c WHERE price IS NOT NULL) x WHERE rn = 1")
MADE = "symbol like '%1' or (symbol not like '%2' and source < '3')"
sig = lambda t, side: t.quotes().filter(side).groupBy("symbol").agg((F.max(qid()) % 100 / 100.0).alias("confidence"))
q("j08_merge_darkpool", lambda t: rel.merge_darkpool(sig(t, MADE), sig(t, f"not ({MADE})")), "symbol confidence:5 origin", f"""
SELECT coalesce(s.symbol, r.symbol) AS symbol, CASE WHEN s.c IS NOT NULL AND r.c IS NOT NULL THEN least(s.c * 1.3, 0.95) ELSE coalesce(s.c, r.c) END AS confidence,
 CASE WHEN s.c IS NOT NULL AND r.c IS NOT NULL THEN 'validated' WHEN s.c IS NOT NULL THEN 'synthetic' ELSE 'real' END AS origin
FROM (SELECT symbol, max(quote_id) % 100 / 100e0 AS c FROM quotes WHERE {MADE} GROUP BY 1) s FULL JOIN (SELECT symbol, max(quote_id) % 100 / 100e0 AS c FROM quotes WHERE NOT ({MADE}) GROUP BY 1) r ON s.symbol = r.symbol""")
q("j12_pair_outcomes", lambda t: rel.pair_outcomes(t.predictions().select("sample_id", "model", "predicted"), t.predictions().filter("confidence > 0.2").select("sample_id", "actual")),
  "sample_id:l model error:5 direction_correct:b score:6", """
SELECT sample_id, model, CASE WHEN actual = 0 THEN abs(predicted) ELSE abs(actual - predicted) / actual END AS error, (actual > 0) = (predicted > 0) AS direction_correct, 1 / (1 + abs(actual - predicted)) AS score FROM predictions WHERE confidence > 0.2""")
q("j13_add_sentiment", lambda t: rel.add_sentiment(t.bars().select("symbol", "ts", "close"), t.holdings().filter("market_value > 2000").select("symbol", (F.col("market_value") / 10000).alias("sentiment"))), "symbol ts sentiment:5",
  "SELECT b.symbol, b.ts, coalesce(h.market_value / 10000, 0) AS sentiment FROM bars b LEFT JOIN (SELECT * FROM holdings WHERE market_value > 2000) h ON b.symbol = h.symbol")
q("j14_as_of_view", lambda t: rel.as_of_view(t.bars(), "ts", F.lit("1998-06-30").cast("timestamp_ntz")), "symbol ts close:4", "SELECT symbol, ts, close FROM bars WHERE ts <= TIMESTAMP '1998-06-30'")


def asof(t):
    b = t.bars()
    return rel.as_of_join(b.filter(F.day("ts") % 2 == 0).select("symbol", "ts"), b.filter(F.day("ts") % 2 == 1).select("symbol", "ts", F.col("close").alias("prior")), "prior")


q("j14_as_of_join", asof, "symbol ts prior:4", "SELECT a.symbol, a.ts, b.close AS prior FROM (SELECT * FROM bars WHERE day(ts) % 2 = 0) a ASOF LEFT JOIN (SELECT * FROM bars WHERE day(ts) % 2 = 1) b ON a.symbol = b.symbol AND a.ts >= b.ts")
q("k02_rank_predictions", lambda t: rel.latest_by_rank(t.predictions(), "predicted", ["sample_id"], 50), "sample_id:l model predicted:4", "SELECT sample_id, model, predicted FROM predictions ORDER BY predicted DESC, sample_id LIMIT 50")
q("k04_best_per_ticker", lambda t: rel.best_per_key(t.quotes().withColumn("confidence", qid() % 50).select("symbol", "quote_id", "confidence", "source"), "symbol", "confidence", ["quote_id"]), "symbol quote_id:l confidence:l source",
  "SELECT symbol, quote_id, confidence, source FROM (SELECT *, quote_id % 50 AS confidence, row_number() OVER (PARTITION BY symbol ORDER BY quote_id % 50 DESC, quote_id) AS rn FROM quotes) x WHERE rn = 1")
q("u01_union_by_name", lambda t: t.quotes().filter("source < '3'").select("quote_id", "symbol", "price").unionByName(t.quotes().filter("source >= '3'").select("quote_id", "symbol", "volume"), allowMissingColumns=True),
  "quote_id:l symbol price:4 volume:l", "SELECT quote_id, symbol, price, NULL AS volume FROM quotes WHERE source < '3' UNION ALL SELECT quote_id, symbol, NULL, volume FROM quotes WHERE source >= '3'")
q("u02_distinct_items", lambda t: rel.distinct_items(t.quotes(), ["symbol"], F.trim(F.regexp_replace("source", "[0-9-]+", " ")), ["ts", "quote_id"], 3), "symbol item position:l", """
SELECT symbol, item, position_ FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY o) AS position_ FROM (
 SELECT symbol, trim(regexp_replace(source, '[0-9-]+', ' ', 'g')) AS item, min((ts, quote_id)) AS o FROM quotes GROUP BY 1, 2) x) y WHERE position_ <= 3""".replace("position_", "position"))
q("u03_union_selected", lambda t: rel.union_selected(*[t.raw("part").filter(c).select(F.col("p_brand").alias("feature")) for c in ("p_size < 3", "p_size > 48", "p_retailprice > 1040")]), "feature", "SELECT DISTINCT p_brand AS feature FROM part WHERE p_size < 3 OR p_size > 48 OR p_retailprice > 1040")
q("u04_common_numeric", lambda t: rel.common_numeric_long(t.quotes(), t.bars().select("symbol", "ts", F.col("close").alias("price"), "volume")).groupBy("column_name", "side").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), "column_name side n:l mean:3", """
SELECT 'price' AS column_name, 'a' AS side, count(price) AS n, avg(price) AS mean FROM quotes UNION ALL SELECT 'volume', 'a', count(volume), avg(volume) FROM quotes UNION ALL SELECT 'price', 'b', count(close), avg(close) FROM bars UNION ALL SELECT 'volume', 'b', count(volume), avg(volume) FROM bars""")
SNK = lambda t, d: t.chain_snapshots().filter(F.col("chain_date") == d).select("symbol", "put_call", "strike").distinct()
q("u05_key_union", lambda t: SNK(t, 1).withColumn("old", F.lit(1)).join(SNK(t, 2).withColumn("new", F.lit(1)), ["symbol", "put_call", "strike"], "full_outer"), "symbol put_call strike:4 old:l new:l", """
SELECT symbol, put_call, strike, max(CASE WHEN chain_date = 1 THEN 1 END) AS old, max(CASE WHEN chain_date = 2 THEN 1 END) AS new FROM chain_snapshots GROUP BY 1, 2, 3""")

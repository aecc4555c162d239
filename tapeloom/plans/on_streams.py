"""Streaming queries: each drains the stored events as a file stream and returns the written result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind
from tapeloom.operators import quality as ql
from tapeloom.plans.registry import Query
from tapeloom.session import scratch
from tapeloom.streaming import streams as st

QUERIES: list[Query] = []


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


PARTS = 4
#: Rows of a landed file; a part of more rows lands as several files, which arrive together.
FILE_ROWS = 1_000_000


def landed(spark, rows, order: str, per_trigger: int = 1, file_rows: int = FILE_ROWS):
    """Rows that land in order, one part after another, and arrive as a stream of as many micro-batches.

    The rows are computed once. All parts have the same number of files, so that a micro-batch takes whole parts; a part of fewer rows is filled up with empty files.
    """
    path, whole = scratch(spark, "landed"), scratch(spark, "landing")
    rows.write.parquet(whole)
    rows = spark.read.schema(rows.schema).parquet(whole)
    o = F.col(order).cast("timestamp").cast("double") if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    cuts = rows.select(o.alias("o")).approxQuantile("o", [i / PARTS for i in range(1, PARTS)], 0.01)
    part = F.coalesce(sum(((o > c).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    sizes = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    files = max(1, *(-(-n // file_rows) for n in sizes.values())) if sizes else 1
    for i in range(PARTS):
        own = rows.filter(part == i)
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return st.read_files(spark, path, rows.schema, per_trigger=per_trigger * files)


class Live:
    """The relations over the event stream instead of the event table."""

    def __init__(self, t):
        self.t = t

    def raw(self, name):
        return landed(self.t.spark, self.t.raw(name), "ts")


def live(t, relation):
    """A relation method run on streaming input."""
    return getattr(type(t), relation)(Live(t))


def doubled(pdf):
    return pdf.assign(doubled=pdf["price"] * 2)


q("r01_map_chunks", lambda t: st.drain(st.map_chunks(live(t, "ticks").select("event_id", "price"), doubled, "event_id bigint, price double, doubled double"), st.Place.fresh(t.spark, "r01")), "event_id:l doubled:4", "SELECT event_id, price * 2 AS doubled FROM ticks")
q("r02_fold", lambda t: st.fold(live(t, "ticks"), ["symbol"], [F.sum("size").alias("size"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n")], st.Place.fresh(t.spark, "r02")), "symbol size:l high:4 n:l", "SELECT symbol, sum(size) AS size, max(price) AS high, count(*) AS n FROM ticks GROUP BY symbol")


def samples(t):
    e = F.col("event_id")
    return live(t, "ticks").select("event_id", F.col("price").alias("pred_a"), (e % 90 / 1.0).alias("pred_b"), (e % 7 / 10.0).alias("conf_a"), (e % 5 / 10.0).alias("conf_b"))


q("r03_ensemble_stream", lambda t: st.drain(st.ensemble_stream(samples(t), ["a", "b"], {"a": 0.7, "b": 0.3}), st.Place.fresh(t.spark, "r03")), "event_id:l ensemble:4", """
SELECT event_id, CASE WHEN wa + wb > 0 THEN (price * wa + event_id % 90 * wb) / (wa + wb) ELSE 0 END AS ensemble FROM (SELECT *, 0.7e0 * (event_id % 7 / 10e0) AS wa, 0.3e0 * (event_id % 5 / 10e0) AS wb FROM ticks) x""")
SCORE = "SELECT model, row_number() OVER (PARTITION BY model ORDER BY ts DESC, sample_id DESC) AS back, count(*) OVER (PARTITION BY model) AS total, CASE WHEN abs(actual - predicted) < 0.5 THEN 1 ELSE 1 / (1 + abs(actual - predicted)) END AS s FROM predictions"
q("r04_track_scores", lambda t: st.track_scores(live(t, "predictions"), st.Place.fresh(t.spark, "r04"), 1000), "model kept:l mean_score:6 total_predictions:l", f"SELECT model, count(*) AS kept, avg(s) AS mean_score, max(total) AS total_predictions FROM ({SCORE}) x WHERE back <= 1000 GROUP BY model")
DRIFT = f"SELECT model, CASE WHEN count(*) >= 100 THEN CASE WHEN count(*) >= 200 THEN avg(CASE WHEN back > 100 AND back <= 200 THEN s END) ELSE 0.5 END - avg(CASE WHEN back <= 100 THEN s END) END AS performance_drop FROM ({SCORE}) x WHERE back <= 1000 GROUP BY model"
q("r05_concept_drift", lambda t: st.track_scores(live(t, "predictions"), st.Place.fresh(t.spark, "r05"), 1000), "model performance_drop:6 drift:b", f"SELECT model, performance_drop, coalesce(performance_drop > 0.1, false) AS drift FROM ({DRIFT}) d")
q("r05_concept_drift_batch", lambda t: st.score_stats(st.last_scores(t.predictions().withColumn("score", st.outcome_score(F.col("actual"), F.col("predicted"))), 1000)), "model performance_drop:6 drift:b", f"SELECT model, performance_drop, coalesce(performance_drop > 0.1, false) AS drift FROM ({DRIFT}) d")
q("r06_count_triggers", lambda t: st.count_triggers(live(t, "predictions"), {"retrain": 300, "select": 150}, st.Place.fresh(t.spark, "r06")), "event sample_count:l", """
SELECT 'retrain' AS event, i * 300 AS sample_count FROM (SELECT unnest(range(1, CAST(count(*) // 300 AS BIGINT) + 1)) AS i FROM predictions) a UNION ALL SELECT 'select', i * 150 FROM (SELECT unnest(range(1, CAST(count(*) // 150 AS BIGINT) + 1)) AS i FROM predictions) b""")


def bar_stream(t):
    return landed(t.spark, t.bars().select("symbol", "ts", "close", "volume"), "ts")


q("r07_rolling_history", lambda t: st.anomaly_stream(bar_stream(t), st.Place.fresh(t.spark, "r07"), 9), "symbol ts type severity confidence:5", """
SELECT symbol, ts, 'price_outlier' AS type, 'high' AS severity, least(0.95, abs(close - m) / sd / 5) AS confidence FROM (SELECT *, avg(close) OVER w AS m, stddev_samp(close) OVER w AS sd, count(close) OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)) x WHERE k = 9 AND sd > 0 AND abs(close - m) / sd > 3
UNION ALL SELECT symbol, ts, 'volume_spike', 'medium', 0.8 FROM (SELECT *, avg(volume) OVER w AS vm, count(volume) OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)) y WHERE k = 9 AND vm > 0 AND volume > 5 * vm""")
AS_OF = "2024-01-30 12:00:00"
q("r08_fresh_unique", lambda t: st.drain(st.fresh_unique(live(t, "sentiments").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id", "source"], F.lit(AS_OF).cast("timestamp_ntz")), st.Place.fresh(t.spark, "r08")), "event_id:l source freshness:2", f"""
SELECT event_id, source, CASE WHEN h > 24 THEN 0.3 WHEN h > 12 THEN 0.6 WHEN h > 6 THEN 0.8 WHEN h > 1 THEN 0.9 ELSE 1 END AS freshness FROM (SELECT *, trunc(epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600e0 AS h FROM sentiments) x""")
q("r09_sliding_check", lambda t: st.sliding_check(live(t, "predictions"), st.Place.fresh(t.spark, "r09"), 168), "model view_end n:l accuracy:6 avg_confidence:6", """
WITH h AS (SELECT model, date_trunc('hour', ts) AS hr, count(*) AS n, sum(CASE WHEN (actual > 0) = (predicted > 0) THEN 1 ELSE 0 END) AS hits, sum(confidence) AS c FROM predictions GROUP BY 1, 2),
g AS (SELECT DISTINCT model, hr + to_hours(CAST(i AS BIGINT)) AS view_end FROM h, (SELECT unnest(range(1, 169)) AS i) r)
SELECT g.model, view_end, sum(n) AS n, sum(hits) / sum(n) AS accuracy, sum(c) / sum(n) AS avg_confidence FROM g JOIN h ON g.model = h.model AND h.hr >= view_end - INTERVAL 168 HOURS AND h.hr < view_end GROUP BY 1, 2""")
q("r10_volume_bars", lambda t: st.volume_bars(live(t, "ticks"), st.Place.fresh(t.spark, "r10"), "5 minutes"), "symbol bar volume:l ticks:l", "SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar, sum(size) AS volume, count(*) AS ticks FROM ticks GROUP BY 1, 2")


def snapshot_stream(t):
    return landed(t.spark, t.chain_snapshots().select("contract_id", "chain_date", "open_interest"), "chain_date")


q("r11_oi_changes", lambda t: st.drain(st.oi_changes(snapshot_stream(t)), st.Place.fresh(t.spark, "r11")), "contract_id:l chain_date:l oi_change:l", "SELECT contract_id, chain_date, open_interest - lag(open_interest) OVER (PARTITION BY contract_id ORDER BY chain_date) AS oi_change FROM chain_snapshots")

# User functions --------------------------------------------------------------------------------------------------
q("y01_chunk_function", lambda t: st.map_chunks(t.ticks().select("event_id", "price"), doubled, "event_id bigint, price double, doubled double"), "event_id:l doubled:4", "SELECT event_id, price * 2 AS doubled FROM ticks")
q("y02_reduce_function", lambda t: st.reduce_by(t.ticks(), ["symbol"], "price", max), "symbol price:4", "SELECT symbol, max(price) AS price FROM ticks GROUP BY 1")
q("y03_map_items", lambda t: st.map_items(t.ticks().select("event_id", "size"), "size", lambda x: 100.0 / (int(x) % 10), "share"), "event_id:l share:4", "SELECT event_id, 100e0 / nullif(size % 10, 0) AS share FROM ticks")
q("y04_custom_rules", lambda t: ql.RuleSet().register("cheap", "error", lambda: F.col("price") < 5).register("small", "warning", lambda: F.col("size") < 10).register("off", "error", lambda: F.lit(True), enabled=False).apply(t.ticks()), "event_id:l is_valid:b quality_score:4", """
SELECT event_id, price >= 5 AS is_valid, CASE WHEN price < 5 THEN 0.5 ELSE 1 END * CASE WHEN size < 10 THEN 0.9 ELSE 1 END AS quality_score FROM ticks""")


def by_sql(t):
    st.register_views({"ticks_view": t.ticks()})
    return t.spark.sql("SELECT symbol, count(*) AS n, avg(price) AS mean_price FROM ticks_view GROUP BY symbol")


q("y05_sql_views", by_sql, "symbol n:l mean_price:5", "SELECT symbol, count(*) AS n, avg(price) AS mean_price FROM ticks GROUP BY symbol")


def by_table_function(t):
    """Two operators called from SQL text, one restricted by its arguments."""
    st.register_tables(t.spark, t.bars(), {
        "moving_averages": (lambda b: ind.sma(b, (5, 20)), "", "true"),
        "drawdowns": (ind.max_drawdown, "at_least double", "max_drawdown >= at_least"),
    })
    return t.spark.sql("""SELECT m.symbol, count(m.sma_20) AS n, avg(m.price_to_sma_5) AS ratio, max(d.max_drawdown) AS worst
        FROM moving_averages() m JOIN drawdowns(at_least => 0.2D) d ON m.symbol = d.symbol GROUP BY m.symbol""")


q("y05_table_functions", by_table_function, "symbol n:l ratio:5 worst:5", """
WITH m AS (SELECT symbol, CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w20 END AS sma_20, CASE WHEN count(close) OVER w5 >= 5 THEN close / avg(close) OVER w5 END AS ratio FROM bars
 WINDOW w20 AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)),
p AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM bars),
d AS (SELECT symbol, max((peak - close) / peak) AS worst FROM p GROUP BY symbol HAVING worst >= 0.2)
SELECT m.symbol, count(sma_20) AS n, avg(ratio) AS ratio, max(worst) AS worst FROM m JOIN d ON m.symbol = d.symbol GROUP BY m.symbol""")

"""Structured Streaming operators. Each has the semantics of a batch operator on the same rows.

State lives in Spark: streaming aggregates, or keyed state of bounded size. A :class:`Place` names the output and the checkpoint
of a stream; starting it again with the same place goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.operators.quality import age_hours, bar_findings
from tapeloom.session import scratch


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def event_time(stream: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@dataclass(frozen=True)
class Place:
    """Where a stream writes and keeps its checkpoint (shared folders), and its trigger."""

    out: str
    checkpoint: str
    trigger: dict = field(default_factory=lambda: {"availableNow": True})

    @staticmethod
    def fresh(spark: SparkSession, label: str) -> Place:
        root = scratch(spark, label)
        return Place(f"{root}/out", f"{root}/checkpoint")


def drain(stream: DataFrame, to: Place) -> DataFrame:
    """Run an append stream into files and hand back the written table."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", to.out).option("checkpointLocation", to.checkpoint)
    w.trigger(**to.trigger).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(to.out)


def changes(stream: DataFrame, to: Place) -> DataFrame:
    """Run an update stream; the rows that micro-batch N changed are written to ``batch=N``, which a replay overwrites."""
    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{to.out}/batch={n}")

    w = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", to.checkpoint)
    w.trigger(**to.trigger).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    # a stream that brought nothing yet has an empty result
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{to.out}/batch=-1")
    return stream.sparkSession.read.schema(schema).option("basePath", to.out).parquet(to.out)


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of every key of :func:`changes`."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def map_chunks(stream: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to every chunk of a stream or table."""
    def run(chunks):
        for pdf in chunks:
            yield fn(pdf)

    return stream.mapInPandas(run, schema)


def fold(stream: DataFrame, keys: list[str], aggs: list[Column], to: Place) -> DataFrame:
    """Running aggregates per key, as a streaming aggregation."""
    return newest(changes(stream.groupBy(*keys).agg(*aggs), to), keys)


def ensemble_stream(stream: DataFrame, models: list[str], weights: dict[str, float]) -> DataFrame:
    """Prediction per arriving sample from its model columns, weighted by model weight times confidence."""
    w = [F.lit(weights.get(m, 1.0)) * F.col(f"conf_{m}") for m in models]
    total = sum(w, F.lit(0.0))
    mixed = sum((F.col(f"pred_{m}") * x for m, x in zip(models, w)), F.lit(0.0))
    return stream.withColumn("ensemble", F.when(total > 0, mixed / total).otherwise(0.0))


EARLIEST = -(2**63)


def _micros(c: str) -> Column:
    """Microseconds of a time; a null time comes before all others."""
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(EARLIEST))


def outcome_score(actual: Column, predicted: Column) -> Column:
    """1 for a hit within one half, else 1 / (1 + error)."""
    e = F.abs(actual - predicted)
    return F.when(e < 0.5, 1.0).otherwise(1.0 / (1.0 + e))


def last_scores(rows: DataFrame, k: int) -> DataFrame:
    """The last k scores of every model, newest first as ``back`` = 1 (rank filter before the shuffle)."""
    w = Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("sample_id"))
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= k)


def score_stats(last: DataFrame) -> DataFrame:
    """Mean of the kept scores and the drop of the last 100 against the 100 before (0.5 when there are fewer)."""
    b, s = F.col("back"), F.col("score")
    g = last.groupBy("model").agg(
        F.count(F.lit(1)).alias("kept"), F.avg(s).alias("mean_score"), F.avg(F.when(b <= 100, s)).alias("_new"), F.avg(F.when((b > 100) & (b <= 200), s)).alias("_old")
    )
    drop = F.when(F.col("kept") >= 200, F.col("_old")).otherwise(0.5) - F.col("_new")
    g = g.withColumn("performance_drop", F.when(F.col("kept") >= 100, drop))
    return g.withColumn("drift", F.coalesce(F.col("performance_drop") > 0.1, F.lit(False))).drop("_new", "_old")


def track_scores(stream: DataFrame, to: Place, k: int = 1000, salts: int = 16) -> DataFrame:
    """Score tracking and drift per model over a prediction stream.

    State per (model, salt) is a count and the last ``k`` scores, so a hot model spreads over ``salts`` tasks; the last ``k`` of a
    model are among those of its salts. Rows pass through the state in chunks and are never held together.
    """
    def step(key, chunks, state: GroupState):
        total, ts, ids, scores = state.get if state.exists else (0, [], [], [])
        held = pd.DataFrame({"ts": list(ts), "sample_id": list(ids), "score": list(scores)})
        for pdf in chunks:
            total += len(pdf)
            new = pdf[["ts", "sample_id", "score"]]
            held = (pd.concat([held, new]) if len(held) else new).sort_values(["ts", "sample_id"], ascending=False).head(k)
        kept = ([int(x) for x in held["ts"]], [int(x) for x in held["sample_id"]], [float(x) for x in held["score"]])
        state.update((total, *kept))
        yield pd.DataFrame({"model": [key[0]], "salt": [key[1]], "total": [total], "ts": [kept[0]], "ids": [kept[1]], "scores": [kept[2]]})

    held = "total bigint, ts array<bigint>, ids array<bigint>, scores array<double>"
    rows = stream.select(
        "model", F.pmod(F.xxhash64("sample_id"), F.lit(salts)).cast("int").alias("salt"), _micros("ts").alias("ts"),
        F.coalesce(F.col("sample_id").cast("bigint"), F.lit(EARLIEST)).alias("sample_id"), outcome_score(F.col("actual"), F.col("predicted")).alias("score"),
    )
    kept = rows.groupBy("model", "salt").applyInPandasWithState(step, f"model string, salt int, {held}", held, "update", GroupStateTimeout.NoTimeout)
    parts = newest(changes(kept, to), ["model", "salt"])
    totals = parts.groupBy("model").agg(F.sum("total").alias("total_predictions"))
    each = parts.select("model", F.explode(F.arrays_zip("ts", "ids", "scores")).alias("x")).select("model", "x.ts", F.col("x.ids").alias("sample_id"), F.nanvl("x.scores", F.lit(None).cast("double")).alias("score"))
    return score_stats(last_scores(each, k)).join(totals, "model")


def _crossings(name: str, f: int) -> Column:
    """Event rows for the multiples of ``f`` above ``before`` and up to ``total``."""
    first, last = F.floor(F.col("before") / f) + 1, F.floor(F.col("total") / f)
    rows = F.transform(F.sequence(first, last), lambda i: F.struct(F.lit(name).alias("event"), (i * f).alias("sample_count")))
    return F.when(last >= first, rows).otherwise(F.array().cast("array<struct<event:string,sample_count:bigint>>"))


def count_triggers(stream: DataFrame, every: dict[str, int], to: Place) -> DataFrame:
    """One event row each time the sample count passes a multiple of a frequency.

    The count is a streaming aggregate; one total per micro-batch is written, and what lies between two totals has been passed.
    """
    totals = changes(stream.agg(F.count(F.lit(1)).alias("total")), to)
    t = totals.withColumn("before", F.coalesce(F.lag("total").over(Window.orderBy("batch")), F.lit(0)))
    hits = F.flatten(F.array(*[_crossings(name, f) for name, f in every.items()]))
    return t.select(F.explode(hits).alias("x")).select("x.*")


#: Keys that travel and keep their state together: one call of Python and one row of state for a bucket, not for every key.
BUCKETS = 4096


def _bucket(key: str, buckets: int) -> Column:
    """The bucket of a key; null keys have one of their own, -1."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("bucket")


def anomaly_stream(stream: DataFrame, to: Place, history: int = 9, buckets: int = BUCKETS) -> DataFrame:
    """Outlier checks on arriving bars against the last ``history`` bars of their symbol, by the rules of the batch operator.

    State is the tail of every symbol, kept by bucket of symbols; a row is reported in the batch it arrives in. A task holds what one
    trigger brings of a bucket, which ``maxFilesPerTrigger`` and ``buckets`` bound.
    """
    def step(key, chunks, state: GroupState):
        names, ts, close, volume = state.get if state.exists else ([], [], [], [])
        tail = pd.DataFrame({"symbol": list(names), "ts": list(ts), "close": list(close), "volume": list(volume)}).astype({"symbol": object, "ts": "int64", "close": float, "volume": float})
        new = pd.concat([p[["symbol", "ts", "close", "volume"]] for p in chunks])
        both = pd.concat([tail.assign(fresh=False), new.assign(fresh=True)]).sort_values(["symbol", "ts", "fresh"], kind="stable").reset_index(drop=True)
        last = both.groupby("symbol", sort=False).tail(history)
        state.update(([str(x) for x in last["symbol"]], [int(x) for x in last["ts"]], [float(x) for x in last["close"]], [float(x) for x in last["volume"]]))
        at = both.groupby("symbol", sort=False).cumcount().to_numpy()
        c, v = (np.column_stack([np.where(at >= i, both[x].shift(i).to_numpy(float), np.nan) for i in range(1, history + 1)]) for x in ("close", "volume"))
        m, nv = c.mean(axis=1), (~np.isnan(v)).sum(axis=1)
        out = both.assign(
            _k=(~np.isnan(c)).sum(axis=1), _m=m, _s=np.sqrt(((c - m[:, None]) ** 2).sum(axis=1) / (history - 1)),
            _v=np.where(nv > 0, np.nansum(v, axis=1) / np.maximum(nv, 1), np.nan),
        )
        if key[0] < 0:
            out["symbol"] = None
        yield out.loc[out["fresh"], ["symbol", "ts", "close", "volume", "_k", "_m", "_s", "_v"]]

    rows = stream.select(
        _bucket("symbol", buckets), F.coalesce("symbol", F.lit("")).alias("symbol"), _micros("ts").alias("ts"), F.col("close").cast("double"), F.col("volume").cast("double"))
    out = "symbol string, ts bigint, close double, volume double, _k bigint, _m double, _s double, _v double"
    held = "symbol array<string>, ts array<bigint>, close array<double>, volume array<double>"
    seen = rows.groupBy("bucket").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.NoTimeout)
    when = F.timestamp_micros(F.nullif(F.col("ts"), F.lit(EARLIEST))).cast("timestamp_ntz")
    s = seen.filter(F.col("_k") == history).select("symbol", when.alias("ts"), F.explode(bar_findings()).alias("a"))
    return drain(s.select("symbol", "ts", "a.*"), to)


def fresh_unique(stream: DataFrame, keys: list[str], as_of: Column, delay: str = "2 hours") -> DataFrame:
    """First arrival per key within the watermark, with its freshness band."""
    d = event_time(stream).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    h = age_hours(F.col("ts"), as_of)
    return d.withColumn("freshness", F.when(h > 24, 0.3).when(h > 12, 0.6).when(h > 6, 0.8).when(h > 1, 0.9).otherwise(1.0))


def sliding_check(stream: DataFrame, to: Place, hours: int = 168) -> DataFrame:
    """Model measures over a sliding view, one row per hour.

    The stream keeps hourly sums; the overlapping views are combined from those, so a prediction is never copied per view.
    """
    a, p = F.col("actual"), F.col("predicted")
    hourly = fold(
        stream.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["model", "hour"],
        [F.count(F.lit(1)).alias("n"), F.sum(((a > 0) == (p > 0)).cast("int")).alias("hits"), F.sum("confidence").alias("conf")], to,
    )
    ends = F.expr(f"transform(sequence(0, {hours - 1}), i -> hour + make_interval(0, 0, 0, 0, i + 1, 0, 0))")
    v = hourly.withColumn("view_end", F.explode(ends)).groupBy("model", "view_end").agg(F.sum("n").alias("n"), F.sum("hits").alias("h"), F.sum("conf").alias("c"))
    return v.select("model", "view_end", "n", (F.col("h") / F.col("n")).alias("accuracy"), (F.col("c") / F.col("n")).alias("avg_confidence"))


def volume_bars(stream: DataFrame, to: Place, width: str = "5 minutes") -> DataFrame:
    """Tumbling volume bars of ticks. The watermark ends the state of bars that can no longer change."""
    w = event_time(stream).withWatermark("ts", "1 day").groupBy("symbol", F.window("ts", width).alias("w"))
    t = newest(changes(w.agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("ticks")).select("symbol", F.col("w.start").alias("bar"), "volume", "ticks"), to), ["symbol", "bar"])
    return t.withColumn("bar", F.col("bar").cast("timestamp_ntz"))


def oi_changes(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Open-interest change of every arriving snapshot row against the previous one of its contract; the state is one number a contract, kept by bucket."""
    def change(key, chunks, state: GroupState):
        ids, known, before = (list(x) for x in state.get) if state.exists else ([], [], [])
        held = pd.DataFrame({"contract_id": ids, "oi": pd.array(before, "Int64")}).astype({"contract_id": "int64"})
        held.loc[~np.array(known, bool), "oi"] = pd.NA
        rows = pd.concat(list(chunks)).sort_values(["contract_id", "chain_date"], kind="stable").reset_index(drop=True)
        oi, contract = rows["open_interest"].astype("Int64"), rows["contract_id"].astype("int64")
        first = contract.ne(contract.shift(1))
        earlier = held.set_index("contract_id")["oi"].reindex(contract[first])
        was = oi.shift(1)
        was[first] = earlier.array
        last = ~contract.duplicated(keep="last")
        now = pd.concat([held[~held["contract_id"].isin(contract)], pd.DataFrame({"contract_id": contract[last], "oi": oi[last]})])
        state.update(([int(x) for x in now["contract_id"]], [bool(x) for x in now["oi"].notna()], [int(x) for x in now["oi"].fillna(0)]))
        yield pd.DataFrame({"contract_id": None if key[0] < 0 else contract, "chain_date": rows["chain_date"], "oi_change": oi - was})

    rows = stream.select(_bucket("contract_id", buckets), F.coalesce("contract_id", F.lit(0)).alias("contract_id"), "chain_date", "open_interest")
    return rows.groupBy("bucket").applyInPandasWithState(
        change, "contract_id bigint, chain_date int, oi_change bigint", "contract_id array<bigint>, known array<boolean>, oi array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


# User functions ------------------------------------------------------------------------------------------------

def reduce_by(df: DataFrame, keys: list[str], value: str, fn: Callable[[float, float], float]) -> DataFrame:
    """User reduce function, associative and commutative: folded inside every partition first, then over the partials.

    No task sees more than one chunk plus one partial per partition of a key.
    """
    from functools import reduce

    schema = df.select(*keys, F.col(value).cast("double").alias(value)).schema

    def partial(chunks):
        held: dict = {}
        for pdf in chunks:
            for k, g in pdf.groupby(keys, sort=False)[value]:
                v = reduce(fn, g.tolist())
                held[k] = fn(held[k], v) if k in held else v
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, value])

    parts = df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(partial, schema)
    return parts.groupBy(*keys).applyInPandas(lambda k, pdf: pd.DataFrame([(*k, reduce(fn, pdf[value].tolist()))], columns=[*keys, value]), schema)


def map_items(df: DataFrame, c: str, fn: Callable, out: str, type_: str = "double") -> DataFrame:
    """User function over the items of a column; an item that fails becomes null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` {type_}"

    def safe(x):
        try:
            return fn(x)
        except Exception:
            return None

    def run(chunks):
        for pdf in chunks:
            yield pdf.assign(**{out: [safe(x) for x in pdf[c]]})

    return df.mapInPandas(run, schema)


def register_views(views: dict[str, DataFrame]) -> None:
    """Name operator inputs and outputs for SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)



def register_tables(spark: SparkSession, source: DataFrame, operators: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]]) -> None:
    """Make operators callable from SQL text as table functions.

    ``operators``: name to (operator, parameters as in ``"level double, side string"``, condition over them and the operator's columns). The
    result of the operator on ``source`` becomes the view ``<name>_rows`` and ``SELECT ... FROM name(...)`` its rows that meet the condition. Both are
    plans, nothing is computed here, and a call is inlined: its columns and filters reach the scan like those of any view. Names are
    used as given; a parameter hides no column, so it needs a name of its own.
    """
    for name, (operator, parameters, condition) in operators.items():
        rows = operator(source)
        clash = {p.split()[0].lower() for p in parameters.split(",") if p.strip()} & {c.lower() for c in rows.columns}
        if clash:
            raise ValueError(f"parameters of {name} named like its columns: {sorted(clash)}")
        rows.createOrReplaceTempView(f"{name}_rows")
        out = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({out}) RETURN SELECT * FROM {name}_rows WHERE {condition}")

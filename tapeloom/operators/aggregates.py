"""Grouped summaries: portfolio, flow, sentiment, insider, source and model statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div

SIMPLE = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def group_stats(df: DataFrame, keys: Sequence[str], ops: dict[str, Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Named statistics per group; first / last follow ``order`` and skip nulls; unknown columns are ignored."""
    pos = F.struct(*order)
    aggs = []
    for c, names in ops.items():
        if c not in df.columns:
            continue
        for name in names:
            if name in SIMPLE:
                col = SIMPLE[name](c)
            else:
                pick = F.min_by if name == "first" else F.max_by
                col = pick(F.col(c), F.when(F.col(c).isNotNull(), pos))
            aggs.append(col.alias(f"{c}_{name}"))
    return df.groupBy(*keys).agg(*aggs)


def portfolio_metrics(quotes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, totals and means of quotes; zero counts as missing."""
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    return quotes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.coalesce(F.sum("market_cap"), F.lit(0.0)).alias("total_market_cap"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
        F.avg(nz("pe_ratio")).alias("avg_pe_ratio"),
        F.avg(nz("change_percent")).alias("avg_price_change"),
        F.when(F.count(nz("change_percent")) > 1, F.stddev_pop(nz("change_percent"))).alias("price_change_volatility"),
    )


def chain_flow(chain: DataFrame) -> DataFrame:
    """Put/call balance and unusual, block, smart-money and sweep shares per symbol."""
    mean = chain.groupBy("symbol").agg(F.avg(F.coalesce("volume", F.lit(0))).alias("_mean"))
    put, call = F.col("put_call") == "put", F.col("put_call") == "call"
    v, oi = F.coalesce("volume", F.lit(0)), F.coalesce("open_interest", F.lit(0))
    n = F.count(F.lit(1))
    at_least_1 = lambda c: F.greatest(c, F.lit(1))
    return (
        chain.join(mean, "symbol").groupBy("symbol").agg(
            (F.sum(F.when(put, v).otherwise(0)) / at_least_1(F.sum(F.when(call, v).otherwise(0)))).alias("put_call_ratio"),
            (F.sum(F.when(put, oi).otherwise(0)) / at_least_1(F.sum(F.when(call, oi).otherwise(0)))).alias("put_call_oi_ratio"),
            (F.sum(v) / at_least_1(F.sum(oi))).alias("volume_oi_ratio"),
            (F.count_if(v > F.col("_mean") * 3) / n).alias("unusual_activity_score"),
            (F.count_if(v > 1000) / n).alias("large_block_ratio"),
            (F.count_if((oi > 0) & (div(v, oi) > 0.5)) / n).alias("smart_money_indicator"),
            (F.count_if(v > 500) / n).alias("sweep_score"),
        )
    )


def weighted_sentiment(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.groupBy(*keys).agg(
        div(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")).alias("sentiment_score"),
        F.avg("confidence").alias("confidence"),
    )


def trend_label(score: Column, confidence: Column, bulls: Column, bears: Column) -> Column:
    return (
        F.when(confidence < 0.3, "uncertain").when((score > 0.2) & (bulls > bears), "bullish")
        .when((score < -0.2) & (bears > bulls), "bearish").otherwise("neutral")
    )


def summary_quality(n: Column, confidence: Column, sources: Column, n_strong: Column, spread: Column, text_len: Column) -> Column:
    """0-100: confidence 40, distinct sources 20, samples 15, agreement 15, text length 10."""
    agreement = F.when(n_strong >= 2, F.greatest(F.lit(0.0), 15.0 * (1.0 - F.least(F.lit(1.0), spread * 2.0)))).otherwise(7.5)
    total = (
        F.least(F.lit(40.0), confidence * 40.0) + F.least(F.lit(20.0), sources * 4.0) + F.least(F.lit(15.0), n * 1.5)
        + agreement + clamp((text_len - 50) / 5.0, 0.0, 10.0)
    )
    return clamp(total, 0.0, 100.0)


def sentiment_summary(readings: DataFrame) -> DataFrame:
    """Confidence-weighted score, direction counts, trend label and quality per symbol.

    Partial results are combined per (symbol, source) first, so the distinct source count needs no expansion.
    """
    s, c = F.col("score"), F.col("confidence")
    strong = F.when(F.abs(s) > 0.01, s)
    part = readings.groupBy("symbol", "source").agg(
        F.sum(s * c).alias("sc"), F.sum(c).alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(s > 0.1).alias("up"),
        F.count_if(s < -0.1).alias("down"), F.count(strong).alias("ns"), F.sum(strong).alias("s1"),
        F.sum(strong * strong).alias("s2"), F.sum("text_len").alias("tl"),
    )
    g = part.groupBy("symbol").agg(
        F.sum("sc").alias("_sc"), F.sum("c").alias("_c"), F.sum("n").alias("sample_size"), F.sum("up").alias("bullish_mentions"),
        F.sum("down").alias("bearish_mentions"), F.count("source").alias("_sources"), F.sum("ns").alias("_ns"),
        F.sum("s1").alias("_s1"), F.sum("s2").alias("_s2"), F.sum("tl").alias("_tl"),
    )
    n = F.col("sample_size")
    score = F.when(F.col("_c") > 0, F.col("_sc") / F.col("_c")).otherwise(0.0)
    conf = F.when(F.col("_c") > 0, F.col("_c") / n).otherwise(0.0)
    mean = div(F.col("_s1"), F.col("_ns"))
    spread = F.sqrt(F.greatest(div(F.col("_s2"), F.col("_ns")) - mean * mean, F.lit(0.0)))
    g = g.withColumn("overall_sentiment", score).withColumn("confidence", conf)
    g = g.withColumn("neutral_mentions", n - F.col("bullish_mentions") - F.col("bearish_mentions"))
    return g.select(
        "symbol", "overall_sentiment", "confidence", "sample_size", "bullish_mentions", "bearish_mentions", "neutral_mentions",
        trend_label(F.col("overall_sentiment"), F.col("confidence"), F.col("bullish_mentions"), F.col("bearish_mentions")).alias("trend"),
        summary_quality(n, F.col("confidence"), F.col("_sources"), F.col("_ns"), spread, F.col("_tl") / n).alias("quality_score"),
    )


def source_signals(readings: DataFrame, news: Sequence[str], social: Sequence[str]) -> DataFrame:
    """Mean score, strongest news and social score, social confidence share, per symbol."""
    s, c, src = F.col("score"), F.col("confidence"), F.lower("source")
    named = lambda words: F.array_max(F.array(*[src.contains(w).cast("int") for w in words])) == 1
    is_news = named(news)
    is_social = ~is_news & named(social)
    return readings.groupBy("symbol").agg(
        F.avg(s).alias("overall_sentiment"), F.avg(c).alias("sentiment_confidence"),
        F.coalesce(F.max(F.when(is_news, s)), F.lit(0.0)).alias("news_sentiment"),
        F.coalesce(F.max(F.when(is_social, s)), F.lit(0.0)).alias("social_sentiment"),
        (F.sum(F.when(is_social, c).otherwise(0.0)) / F.count(F.lit(1))).alias("retail_interest"),
    )


def two_level_sentiment(readings: DataFrame) -> DataFrame:
    """Mean per ticker over its source readings, then over tickers."""
    per = readings.groupBy("symbol").agg(F.avg("score").alias("s"), F.avg("confidence").alias("c"))
    return per.agg(
        F.avg("s").alias("overall_sentiment"), F.avg("c").alias("confidence"), F.avg(F.col("c") * 100).alias("quality_score"),
        F.count(F.lit(1)).alias("tickers"),
    )


def headline_sentiment(scored: DataFrame, full_size: float = 25.0, confidence_share: float = 0.7) -> DataFrame:
    """Mean, population variance, size-scaled confidence and quality of scored headlines per symbol."""
    g = scored.groupBy("symbol").agg(
        F.avg("score").alias("sentiment_score"), F.var_pop("score").alias("variance"), F.count("score").alias("n")
    )
    size = F.least(F.lit(1.0), F.col("n") / full_size)
    conf = clamp(size * (1.0 - F.least(F.lit(0.6), F.col("variance"))), 0.1, 0.9)
    return g.withColumn("confidence", conf).withColumn(
        "quality", (F.col("confidence") * confidence_share + size * (1 - confidence_share)) * 100
    )


def post_sentiment(scored: DataFrame) -> DataFrame:
    g = scored.groupBy("symbol").agg(
        F.avg("score").alias("sentiment_score"), F.var_pop("score").alias("variance"), F.count("score").alias("n")
    )
    g = g.withColumn("confidence", clamp(1.0 - F.col("variance"), 0.1, 0.95))
    return g.withColumn("quality", (F.col("confidence") * 0.7 + F.least(F.lit(1.0), F.col("n") / 20.0) * 0.3) * 100)


# Share and volume bands of venue activity with their label and confidence.
ATS_BANDS = (
    (15.0, 1_000_000, "high_institutional_activity", 0.85),
    (12.0, 500_000, "elevated_institutional_activity", 0.70),
    (10.0, None, "moderate_institutional_activity", 0.55),
    (7.0, None, "normal_activity", 0.40),
)
ATS_LOW = ("low_institutional_activity", 0.25)


def ats_signal(share: Column, volume: Column) -> tuple[Column, Column]:
    label, conf = F.lit(ATS_LOW[0]), F.lit(ATS_LOW[1])
    for least, more_than, name, value in reversed(ATS_BANDS):
        hit = share >= least if more_than is None else (share >= least) & (volume > more_than)
        label, conf = F.when(hit, name).otherwise(label), F.when(hit, value).otherwise(conf)
    return label, conf


def ats_activity(venues: DataFrame) -> DataFrame:
    """Totals, share, three largest venues and signal per symbol."""
    g = venues.groupBy("symbol").agg(F.sum("ats_volume").alias("total_ats_volume"), F.sum("total_volume").alias("total_market_volume"))
    w = Window.partitionBy("symbol").orderBy(F.desc("ats_volume"), "venue")
    top = (
        venues.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3").groupBy("symbol")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "venue"))), lambda x: x["venue"]).alias("top_venues"))
    )
    share = F.when(F.col("total_market_volume") > 0, div(F.col("total_ats_volume"), F.col("total_market_volume")) * 100).otherwise(0.0)
    g = g.join(top, "symbol").withColumn("share_pct", share)
    label, conf = ats_signal(F.col("share_pct"), F.col("total_ats_volume"))
    return g.withColumn("signal", label).withColumn("confidence", conf)


def darkpool_base(daily: DataFrame, intraday: DataFrame, days: int = 30, periods: int = 78) -> DataFrame:
    """Volume ratio, count of large 5-minute bars on the last day and the probability built from them."""
    d = fr.tail(daily, days).groupBy("symbol").agg(
        F.avg("volume").alias("avg_volume"), F.max_by("volume", "ts").alias("recent_volume"), F.max_by("close", "ts").alias("price"),
        F.max("ts").alias("_day"),
    )
    j = intraday.withColumn("_d", F.to_date("bar")).join(d.select("symbol", "avg_volume", "_day"), "symbol")
    large = j.filter(F.col("_d") == F.to_date("_day")).groupBy("symbol").agg(
        F.count_if(F.col("volume") > F.col("avg_volume") * 0.01).alias("_large")
    )
    g = d.join(large, "symbol", "left").withColumn("large_trades", F.coalesce("_large", F.lit(0)))
    ratio = F.when(F.col("avg_volume") > 0, div(F.col("recent_volume"), F.col("avg_volume"))).otherwise(1.0)
    g = g.withColumn("volume_ratio", ratio)
    p = F.least((F.col("volume_ratio") - 1.0) * 0.5 + F.col("large_trades") / periods * 0.3 + 0.2, F.lit(1.0))
    block = F.greatest(((F.col("recent_volume") - F.col("avg_volume")) * 0.15).cast("bigint"), F.lit(5000))
    return g.withColumn("probability", p).withColumn("block_size", block).drop("_day", "_large")


def darkpool_proxy(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    p = F.col("probability")
    return darkpool_base(daily, intraday).filter((F.col("volume_ratio") > 1.3) | (p > 0.4)).withColumn(
        "signal",
        F.when(p > 0.7, "high_institutional_activity").when(p > 0.5, "elevated_institutional_activity")
        .otherwise("possible_institutional_activity"),
    )


def darkpool_proxy_strict(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    p = F.col("probability")
    return darkpool_base(daily, intraday).filter(p > 0.4).withColumn(
        "signal", F.when(p > 0.6, "possible_institutional_activity").otherwise("elevated_volume")
    )


def _side(a: Column, b: Column) -> Column:
    return F.when(a > b, "bullish").when(b > a, "bearish").otherwise("neutral")


def insider_net(changes: DataFrame) -> DataFrame:
    ch = F.coalesce("change", F.lit(0))
    g = changes.groupBy("symbol").agg(
        F.sum(F.when(ch > 0, ch).otherwise(0)).alias("_b"), F.sum(F.when(ch < 0, -ch).otherwise(0)).alias("_s"),
        F.count(F.lit(1)).alias("transactions"),
    )
    return g.select("symbol", (F.col("_b") - F.col("_s")).alias("net_buying"), "transactions", _side(F.col("_b"), F.col("_s")).alias("sentiment"))


def insider_transactions(tx: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce("transaction_type", F.lit("")))
    g = tx.groupBy("symbol").agg(
        F.count_if(kind.isin("p-purchase", "m-exempt")).alias("recent_buys"), F.count_if(kind == "s-sale").alias("recent_sells"),
        F.count(F.lit(1)).alias("total_transactions"),
    )
    return g.withColumn("net_sentiment", _side(F.col("recent_buys"), F.col("recent_sells")))


def analyst_consensus(counts: DataFrame) -> DataFrame:
    """Label from rating counts, strong ratings twice."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    buy, sell, hold = z("buy") + z("strong_buy") * 2, z("sell") + z("strong_sell") * 2, z("hold")
    return counts.withColumn(
        "consensus",
        F.when(buy > sell + hold, "strong_buy").when(buy > sell, "buy").when(sell > buy + hold, "strong_sell")
        .when(sell > buy, "sell").otherwise("hold"),
    )


def top_holders(holders: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """First k holders in filing order, their shares, and the holder count."""
    w = Window.partitionBy("symbol").orderBy(*order)
    top = (
        holders.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).groupBy("symbol")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "holder"))), lambda x: x["holder"]).alias("top_holders"),
             F.sum(F.coalesce("shares", F.lit(0))).alias("top_shares"))
    )
    return top.join(holders.groupBy("symbol").agg(F.count(F.lit(1)).alias("total_holders")), "symbol")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by an ordered struct (map-side combined, no sort)."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select(*keys, "_r.*")


def source_quality(calls: DataFrame, last_scores: int = 100, last_issues: int = 5) -> DataFrame:
    """Per source: mean of its last scores, mean latency, success rate, last issue messages; best first."""
    g = calls.groupBy("source").agg(F.avg("latency").alias("latency_ms"), (F.count_if("success") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"))
    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("call_id"))
    ok = calls.filter("success").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last_scores)
    scores = ok.groupBy("source").agg(F.avg("quality").alias("quality_score"))
    bad = calls.filter(~F.col("success")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last_issues)
    issues = bad.groupBy("source").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), "message"))), lambda x: x["message"]).alias("issues")
    )
    j = g.join(scores, "source", "left").join(issues, "source", "left")
    return j.withColumn("quality_score", F.coalesce("quality_score", F.lit(0.0))).orderBy(F.desc("quality_score"), "source")


def component_metrics(calls: DataFrame, warning: float, critical: float) -> DataFrame:
    """Calls, success rate, times and level per component; time limits go before success bands."""
    g = calls.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if("success").alias("successful_calls"),
        F.min("seconds").alias("min_time"), F.max("seconds").alias("max_time"), F.avg("seconds").alias("average_time"),
    )
    rate = F.col("successful_calls") / F.col("total_calls")
    avg = F.col("average_time")
    return g.withColumn("success_rate", rate).withColumn(
        "level",
        F.when(avg == 0, "optimal").when(avg > critical, "critical").when(avg > warning, "degraded").when(rate >= 0.95, "optimal")
        .when(rate >= 0.85, "acceptable").when(rate >= 0.70, "degraded").otherwise("critical"),
    )


def market_internals(bars: DataFrame) -> DataFrame:
    """Breadth estimated from the mean last change, and breadth counted from the last two bars of every symbol."""
    b = F.col("_back")
    t = fr.tail(bars, 2).groupBy("symbol").agg(
        F.max(F.when(b == 1, F.col("close"))).alias("c"), F.max(F.when(b == 2, F.col("close"))).alias("p"),
        F.max(F.when(b == 1, F.col("volume"))).alias("v"),
    )
    chg = F.coalesce(div(F.col("c") - F.coalesce("p", "c"), F.coalesce("p", "c")) * 100, F.lit(0.0))
    t = t.withColumn("chg", chg)
    g = t.agg(
        F.avg("chg").alias("avg_change"), F.count_if(F.col("chg") > 0).alias("counted_advancers"),
        F.count_if(F.col("chg") < 0).alias("counted_decliners"),
        F.sum(F.when(F.col("chg") > 0, F.col("v")).otherwise(0.0)).alias("counted_up_volume"),
        F.sum(F.when(F.col("chg") < 0, F.col("v")).otherwise(0.0)).alias("counted_down_volume"),
    )
    a = F.col("avg_change")
    up, down = a > 0.5, a < -0.5
    by = lambda hi, lo, mid: F.when(up, hi).when(down, lo).otherwise(F.lit(mid)).cast("bigint")
    whole = lambda c: c.cast("bigint")
    g = (
        g.withColumn("_adv", by(2800 + whole(a * 200), 1800 + whole(a * 150), 2300))
        .withColumn("_dec", by(1800 - whole(a * 150), 2800 - whole(a * 200), 2300))
        .withColumn("_uv", by(2e9 + a * 5e8, 1.5e9 + a * 3e8, 1_750_000_000))
        .withColumn("_dv", by(1.5e9 - a * 3e8, 2e9 - a * 5e8, 1_750_000_000))
    )
    ratio = F.when(F.col("_dec") > 0, div(F.col("_adv"), F.col("_dec"))).otherwise(1.0)
    volume = F.when(F.col("_dv") > 0, div(F.col("_uv"), F.col("_dv"))).otherwise(1.0)
    zero = F.lit(0).cast("bigint")
    return g.select(
        "avg_change", F.greatest(zero, "_adv").alias("advancers"), F.greatest(zero, "_dec").alias("decliners"),
        F.greatest(zero, "_uv").alias("up_volume"), F.greatest(zero, "_dv").alias("down_volume"),
        F.round(ratio, 3).alias("advance_decline_ratio"),
        F.when(up, "positive").when(down, "negative").otherwise("neutral").alias("breadth_status"),
        F.round(F.when(ratio > 0, div(volume, ratio)).otherwise(1.0), 3).alias("trin"),
        F.when(a > 1.0, "bullish").when(a < -1.0, "bearish").otherwise("neutral").alias("market_sentiment"),
        "counted_advancers", "counted_decliners", "counted_up_volume", "counted_down_volume",
    )


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def data_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, data type, null share, time-series flag and skew class in one aggregate pass."""
    numeric = [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    timed = [c for c, t in df.dtypes if t.startswith("timestamp") or t == "date"]
    width = len(df.columns)
    kind = "numeric" if len(numeric) > width * 0.7 else "time_series" if timed else "mixed"
    x = F.col(numeric[0])
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    g = df.agg(F.count(F.lit(1)).alias("size"), nulls.alias("_nulls"), F.when(n > 10, skew).alias("_skew"))
    sk = F.abs("_skew")
    return g.select(
        "size", F.lit(width).alias("dimensionality"), F.lit(kind).alias("data_type"),
        F.coalesce(div(F.col("_nulls"), F.col("size") * width), F.lit(0.0)).alias("sparsity"), (F.col("_nulls") > 0).alias("has_nulls"),
        F.lit(any(c in ("timestamp", "date") for c in df.columns)).alias("is_time_series"),
        F.when(sk < 0.5, "normal").when(sk > 1, "skewed").when(sk.isNotNull(), "uniform").otherwise("unknown").alias("distribution_type"),
    )


def category_candidates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Text columns whose distinct share is below the threshold: counts per (column, value) first, then per column."""
    text = [c for c, t in df.dtypes if t == "string"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in text])).alias("x")).select("x.*")
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("column").agg(F.count("v").alias("distinct_values"), F.sum("n").alias("total"))
    share = div(F.col("distinct_values"), F.col("total"))
    return g.withColumn("share", share).withColumn("convert", (share < threshold) & (F.col("distinct_values") > 1))


def combine_chunks(partials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size-weighted mean of chunk means, and sums of chunk counters."""
    return partials.groupBy(*keys).agg(
        div(F.sum(F.col("mean") * F.col("rows")), F.sum("rows")).alias("mean"), F.sum("rows").alias("rows"), F.sum("total").alias("total")
    )


def quality_weighted_ensemble(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(
        div(F.sum(F.col("predicted") * F.col("confidence")), F.sum("confidence")).alias("prediction"),
        F.avg("confidence").alias("mean_confidence"), (F.max("predicted") - F.min("predicted")).alias("prediction_range"),
        F.min("predicted").alias("lowest"), F.max("predicted").alias("highest"),
    )


def latest_ratios(ratios: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest value per (symbol, ratio), one column per ratio name."""
    pos = F.struct(*order)
    return ratios.groupBy("symbol").agg(
        *[F.max_by(F.when(F.col("ratio") == n, F.col("value")), F.when(F.col("ratio") == n, pos)).alias(n) for n in names]
    )


def signal_pack(bars: DataFrame, days: int = 30) -> DataFrame:
    """Latest bar and return volatility in percent over the last ``days`` bars of every symbol."""
    t = fr.tail(bars, days)
    t = t.withColumn("_r", div(F.col("close"), fr.lag("close")) - 1)
    last = F.max_by(F.struct("close", "volume", "high", "low"), "ts")
    g = t.groupBy("symbol").agg(last.alias("_b"), (F.stddev_samp("_r") * 100).alias("volatility"))
    return g.select("symbol", "_b.*", "volatility")


# Trend metrics and advice limits of the model report.
TREND_METRICS = ("accuracy", "sharpe_ratio", "total_return")
ADVICE = (
    ("accuracy", "<", 0.6, "Consider retraining model - accuracy below 60%"),
    ("sharpe_ratio", "<", 1.0, "Risk-adjusted returns are low - review strategy"),
    ("max_drawdown", ">", 0.15, "High drawdown detected - implement risk controls"),
)


def model_report(runs: DataFrame, metrics: Sequence[str], as_of: Column, days: int = 30) -> DataFrame:
    """Mean, std, min, max, latest and slope sign per (model, metric) of the last ``days`` days."""
    order = ("ts", "run_id")
    recent = runs.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date"))
    seg = fr.segment(recent, keys=("model",), order=order, block=day * 24 + F.hour("ts"))
    seg = fr.own(seg.withColumn("_pos", fr.position(("model",), order)))
    long = seg.unpivot(["model", "ts", "run_id", "_pos"], list(metrics), "metric", "value")
    g = long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct(*order)).alias("latest"), F.regr_slope("value", F.col("_pos").cast("double")).alias("_slope"),
    )
    return g.withColumn(
        "trend", F.when(F.col("metric").isin(*TREND_METRICS), F.when(F.col("_slope") > 0, "improving").otherwise("declining"))
    ).drop("_slope")


def model_advice(runs: DataFrame) -> DataFrame:
    """Advice texts from the latest run of every model."""
    last = latest_row(runs, ["model"], ["ts", "run_id"])
    texts = [F.when((F.col(m) < lim) if op == "<" else (F.col(m) > lim), text) for m, op, lim, text in ADVICE]
    return last.select("model", F.array_compact(F.array(*texts)).alias("advice"))


def diagnostics_summary(runs: DataFrame, as_of: Column) -> DataFrame:
    """Latest accuracy, evaluation count, mean accuracy and latency, and mean latency of the last hour, per model."""
    hour = F.col("ts") > as_of - F.expr("INTERVAL 1 HOUR")
    return runs.groupBy("model").agg(
        F.max_by("accuracy", F.struct("ts", "run_id")).alias("latest_accuracy"), F.count(F.lit(1)).alias("total_evaluations"),
        F.avg("accuracy").alias("avg_accuracy"), F.avg("latency").alias("avg_latency_ms"),
        F.coalesce(F.avg(F.when(hour, F.col("latency"))), F.lit(0.0)).alias("last_hour_latency_ms"),
    )


def run_log(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Runs, success rate and mean duration overall (template null) and per template, one grouping pass."""
    r = runs.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    g = r.groupBy("template").agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("ok"), F.sum("latency").alias("d"))
    both = g.select("template", "runs", "ok", "d").unionByName(
        g.agg(F.sum("runs").alias("runs"), F.sum("ok").alias("ok"), F.sum("d").alias("d")).withColumn("template", F.lit(None).cast("string"))
    )
    return both.select("template", "runs", (F.col("ok") / F.col("runs")).alias("success_rate"), (F.col("d") / F.col("runs")).alias("avg_duration"))


def template_analytics(perf: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    r = perf.filter(F.col("last_used") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return r.groupBy("template", "condition", "strategy").agg(
        F.avg("success_rate").alias("avg_success"), F.avg("avg_latency").alias("avg_latency"), F.sum("usage_count").alias("total_usage")
    ).orderBy(F.desc("avg_success"))


def attempt_rollup(attempts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Success rate, mean latency and last use per prompt; each roll-up adds one to the stored usage count."""
    keys = ["template", "condition", "strategy"]
    g = attempts.groupBy(*keys).agg(
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("latency").alias("avg_latency"), F.max("ts").alias("last_used")
    )
    if previous is None:
        return g.withColumn("usage_count", F.lit(1).cast("bigint"))
    p = previous.select(*keys, F.col("usage_count").alias("_u"))
    return g.join(p, keys, "left").withColumn("usage_count", F.coalesce("_u", F.lit(0)) + 1).drop("_u")


def signal_statistics(signals: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    s = signals.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    return s.agg(
        F.count(F.lit(1)).alias("total_signals"), *[F.count_if(F.col("signal") == k.upper()).alias(f"{k}_signals") for k in ("buy", "sell", "hold")],
        F.avg("confidence").alias("average_confidence"), F.avg("risk_score").alias("average_risk_score"),
        F.avg("size_factor").alias("average_size_factor"),
    )


def recent_performance(preds: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Direction accuracy, relative error and confidence per model over the last days."""
    r = preds.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    a, p = F.col("actual"), F.col("predicted")
    same = ((a > 0) == (p > 0)).cast("double")
    err = F.coalesce(div(F.abs(a - p), a), F.abs(p))
    return r.groupBy("model").agg(
        F.avg(same).alias("accuracy"), F.avg(err).alias("avg_error"), F.avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("count")
    )


def retrain_trigger(perf: DataFrame) -> DataFrame:
    enough = F.col("count") >= 10
    return perf.withColumn(
        "trigger",
        F.when((F.col("accuracy") < 0.4) & enough, "low_accuracy").when((F.col("avg_error") > 0.5) & enough, "high_error")
        .when((F.col("avg_confidence") < 0.3) & enough, "low_confidence"),
    )


def compare_models(metrics: DataFrame) -> DataFrame:
    """Best accuracy, best Sharpe and lowest drawdown with their model."""
    pick = lambda fn, c, sign: fn(F.struct("model", F.col(c).alias("value")), F.struct(F.col(c) * sign, F.col("model")))
    g = metrics.agg(
        pick(F.min_by, "accuracy", -1.0).alias("best_accuracy"), pick(F.min_by, "sharpe_ratio", -1.0).alias("best_sharpe"),
        pick(F.min_by, "max_drawdown", 1.0).alias("lowest_drawdown"),
    )
    names = ("best_accuracy", "best_sharpe", "lowest_drawdown")
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"{n}.model").alias("model"), F.col(f"{n}.value").alias("value")) for n in names])
    return g.select(F.explode(rows).alias("x")).select("x.*")


def model_alerts(metrics: DataFrame) -> DataFrame:
    def alert(cond, kind, severity, c):
        return F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(c).alias("metric"), F.col(c).alias("value")))

    alerts = F.array_compact(F.array(
        alert(F.col("accuracy") < 0.5, "performance", "high", "accuracy"),
        alert(F.col("max_drawdown") > 0.2, "risk", "high", "max_drawdown"),
        alert(F.col("sharpe_ratio") < 0.5, "performance", "medium", "sharpe_ratio"),
    ))
    return metrics.select("model", F.explode(alerts).alias("a")).select("model", "a.*")


def classification_metrics(labelled: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 from the confusion counts of ``y_true`` and ``y_pred``."""
    conf = labelled.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    t = conf.groupBy(F.col("y_true").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = conf.groupBy(F.col("y_pred").alias("k")).agg(F.sum("n").alias("guessed"))
    m = t.join(p, "k", "left")
    prec = F.coalesce(div(F.col("tp"), F.col("guessed")), F.lit(0.0))
    rec = F.coalesce(div(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(div(2 * prec * rec, prec + rec), F.lit(0.0))
    w = F.sum("support")
    return m.agg(
        (F.sum("tp") / w).alias("accuracy"), (F.sum(prec * F.col("support")) / w).alias("precision"),
        (F.sum(rec * F.col("support")) / w).alias("recall"), (F.sum(f1 * F.col("support")) / w).alias("f1_score"),
    )


def regression_metrics(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    g = preds.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("actual").alias("_v"))
    return g.withColumn("rmse", F.sqrt("mse")).withColumn("r2_score", 1 - div(F.col("mse"), F.col("_v"))).drop("_v")


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by average ranks, from counts per distinct score.

    Ranks are running counts over equally full ranges of scores, so no task orders all rows.
    """
    c = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).withColumn("_k", F.lit(0))
    c = fr.carried(fr.value_blocks(c, ["_k"], "score"), {"n": (F.sum, F.col("n"))}, keys=("_k",), order=("score",), block=F.col("_part"))
    upto = fr.running_sum("n", F.col("n").cast("double"), keys=("_k",), order=("score",))
    c = c.withColumn("_rank", upto - (F.col("n") - 1) / 2.0)
    np_, nn = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return c.agg(div(F.sum(F.col("_rank") * F.col("pos")) - np_ * (np_ + 1) / 2.0, np_ * nn).alias("auc_roc"))


def scenario_probabilities(trades: DataFrame) -> DataFrame:
    """Leading whole percent of every scenario text; unparsable texts give no row."""
    x = trades.select("ticker", F.explode("scenario_tree").alias("case", "text"))
    head = F.trim(F.split_part("text", F.lit("%"), F.lit(1)))
    title = F.replace(F.initcap(F.replace("case", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))
    return x.select("ticker", title.alias("case"), head.try_cast("int").alias("probability")).filter(F.col("probability").isNotNull())


def price_targets(docs: DataFrame, c: str = "body") -> DataFrame:
    """Analyst price-target row per symbol from a landed JSON document; documents without a mean are dropped."""
    schema = "targetHigh double, targetLow double, targetMean double, targetMedian double, numberOfAnalysts bigint"
    j = docs.select("symbol", F.from_json(c, schema).alias("j")).filter(F.col("j.targetMean").isNotNull())
    return j.select(
        "symbol", F.col("j.targetHigh").alias("target_high"), F.col("j.targetLow").alias("target_low"), F.col("j.targetMean").alias("target_mean"),
        F.col("j.targetMedian").alias("target_median"), F.coalesce("j.numberOfAnalysts", F.lit(0)).alias("num_analysts"),
    )


def scan_summary(recs: DataFrame, k: int = 10) -> DataFrame:
    """Symbols and opportunities of a scan with its top k, ranked by a bounded limit."""
    totals = recs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("opportunities"))
    top = recs.orderBy(F.desc("opportunity_score"), "contract_id").limit(k)
    both = totals.select(F.struct("symbols", "opportunities")).scalar()
    return top.select("contract_id", "symbol", "opportunity_score", both["symbols"].alias("symbols"), both["opportunities"].alias("opportunities"))


def score_insights(recs: DataFrame) -> DataFrame:
    """Mean, median, population std, min and max of the score, and the mean confidence."""
    g = recs.agg(
        F.avg("opportunity_score").alias("mean"), F.stddev_pop("opportunity_score").alias("std"), F.min("opportunity_score").alias("min"),
        F.max("opportunity_score").alias("max"), F.avg("confidence").alias("average_confidence"),
    )
    med = fr.exact_quantile(recs, [], "opportunity_score", 0.5, "median")
    return g.withColumn("median", med.scalar())


def category_counts(recs: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("name")) for c in cols])
    return recs.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("name").isNotNull()).groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"))


def recommendation_stats(recs: DataFrame, k: int = 10) -> DataFrame:
    """Totals and means beside the top k symbols by recommendation count."""
    per = recs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("opportunity_score").alias("s"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"))
    tot = per.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("s"), div(F.sum("c"), F.sum("nc")).alias("c"))
    top = per.orderBy(F.desc("n"), "symbol").limit(k)
    x = tot.select(F.struct("n", "s", "c")).scalar()
    return top.select(
        "symbol", F.col("n").alias("recommendations"), x["n"].alias("total_recommendations"), x["s"].alias("avg_opportunity_score"), x["c"].alias("avg_ml_confidence"),
    )

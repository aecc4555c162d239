"""Data quality: scores, anomalies and rule sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div


def age_hours(ts: Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", ts, as_of) / 3600.0


def quote_quality(quotes: DataFrame, as_of: Column) -> DataFrame:
    """Score and issues of a quote; a bad price stops the checks."""
    price, v, ts = F.col("price"), F.col("volume"), F.col("ts")
    bad_price = F.coalesce(price, F.lit(0.0)) <= 0
    bad_volume = F.coalesce(v, F.lit(0)) <= 0
    stale, no_time = age_hours(ts, as_of) > 1, ts.isNull()
    outside = F.col("day_low").isNotNull() & F.col("day_high").isNotNull() & ~price.between(F.col("day_low"), F.col("day_high"))
    cost = lambda c, n: F.when(c, n).otherwise(0)
    score = F.when(bad_price, 60).otherwise(100 - cost(bad_volume, 20) - cost(stale, 20) - cost(no_time, 10) - cost(outside, 10))
    rest = F.array_compact(F.array(
        F.when(bad_volume, "Missing or invalid volume"), F.when(stale, "Stale quote timestamp"),
        F.when(no_time, "Missing timestamp"), F.when(outside, "Price outside day range"),
    ))
    issues = F.when(bad_price, F.array(F.lit("Missing or invalid price"))).otherwise(rest)
    return quotes.withColumn("score", score.cast("double")).withColumn("issues", issues)


def table_quality(df: DataFrame, numeric: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """100 less 20 for over 5 percent missing cells and 10 once for any |z| above 5; two aggregate passes."""
    n = F.count(F.lit(1))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    first = df.agg(
        n.alias("rows"), nulls.alias("nulls"),
        *[f(c).alias(f"{k}_{c}") for c in numeric for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max), ("n", F.count))],
    )
    # The largest |z| of a column is reached at its minimum or maximum: no second scan is needed.
    z = {c: F.greatest(div(F.col(f"hi_{c}") - F.col(f"m_{c}"), F.col(f"s_{c}")), div(F.col(f"m_{c}") - F.col(f"lo_{c}"), F.col(f"s_{c}"))) for c in numeric}
    hits = F.array_compact(F.array(*[F.when((F.col(f"n_{c}") > 2) & (x > 5), F.lit(c)) for c, x in z.items()]))
    share = div(F.col("nulls"), F.col("rows") * len(columns)) * 100
    out = first.select("rows", F.coalesce(share, F.lit(0.0)).alias("missing_pct"), hits.alias("outlier_columns"))
    score = 100 - F.when(F.col("missing_pct") > 5, 20).otherwise(0) - F.when(F.size("outlier_columns") > 0, 10).otherwise(0)
    return out.withColumn("score", F.when(F.col("rows") == 0, 0).otherwise(score).cast("double"))


def zscore_anomalies(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.0, population: bool = False, least: int = 2) -> DataFrame:
    """Rows whose |z| against their key exceeds the threshold; moments are aggregated, then joined back."""
    sd = F.stddev_pop if population else F.stddev_samp
    g = df.groupBy(*keys).agg(F.avg(value).alias("_m"), sd(value).alias("_s"), F.count(value).alias("_n"))
    j = df.join(g.filter((F.col("_n") >= least) & (F.col("_s") > 0)), list(keys))
    z = F.abs((F.col(value) - F.col("_m")) / F.col("_s"))
    return j.withColumn("z", z).filter(F.col("z") > threshold).drop("_m", "_s", "_n")


# Reliability of the known sources; others count 0.5.
RELIABILITY = {"YFINANCE": 0.9, "TWELVE_DATA": 0.8, "FMP": 0.7, "FINNHUB": 0.6, "ALPHA_VANTAGE": 0.5}
BAR_WEIGHTS = {"completeness": 0.15, "consistency": 0.20, "accuracy": 0.25, "timeliness": 0.15, "validity": 0.15, "reliability": 0.10}
OPTION_WEIGHTS = {"completeness": 0.25, "consistency": 0.25, "accuracy": 0.30, "validity": 0.20}


def reliability(source: Column) -> Column:
    out = F.lit(0.5)
    for name, v in RELIABILITY.items():
        out = F.when(source == name, v).otherwise(out)
    return out


def timeliness(hours: Column) -> Column:
    return F.when(hours > 24, 0.3).when(hours > 12, 0.6).when(hours > 6, 0.8).when(hours > 1, 0.9).otherwise(1.0)


def price_consistency(soft: float = 0.7, hard: float = 0.0) -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = (o > h) | (o < l) | (c > h) | (c < l)
    return F.when(l > h, hard).when(out, soft).otherwise(1.0) * F.when(F.col("volume") == 0, 0.8).otherwise(1.0)


def past(n: int, tag: str = "") -> dict[str, Column]:
    """Mean and deviation of close, mean volume and number of closes of the ``n`` bars before, as ``_m``, ``_s``, ``_v``, ``_k`` and ``tag``."""
    w = fr.over().rowsBetween(-n, -1)
    of = {"_m": F.avg("close"), "_s": F.stddev_samp("close"), "_v": F.avg("volume"), "_k": F.count("close")}
    return {k + tag: e.over(w) for k, e in of.items()}


def bar_quality(bars: DataFrame, as_of: Column) -> DataFrame:
    """Six part scores and their weighted total per bar; accuracy looks at the 10 bars before, ``findings`` at the 9 before."""
    s = fr.segment(bars, lookback=11).withColumns(past(10) | past(9, "9"))
    c, v = F.col("close"), F.col("volume")
    none = F.filter(bar_findings("9"), lambda x: F.lit(False))
    s = s.withColumn("findings", F.when(F.col("_k9") == 9, bar_findings("9")).otherwise(none))
    z = F.abs(div(c - F.col("_m"), F.col("_s")))
    ratio = div(v, F.col("_v"))
    acc = F.when(z > 3, 0.7).when(z > 2, 0.9).otherwise(1.0) * F.when((ratio > 10) | (ratio < 0.1), 0.8).otherwise(1.0)
    fields = ("symbol", "ts", "open", "high", "low", "close", "volume", "source")
    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    s = s.withColumns({
        "completeness": present / len(fields), "consistency": price_consistency(),
        "accuracy": F.when(F.col("_k") >= 10, acc).otherwise(1.0), "timeliness": timeliness(age_hours(F.col("ts"), as_of)),
        "validity": F.when(F.col("symbol").rlike("^[A-Z]+$"), 1.0).otherwise(0.5), "reliability": reliability(F.col("source")),
    })
    total = sum((F.col(k) * w_ for k, w_ in BAR_WEIGHTS.items()), F.lit(0.0))
    return fr.own(s.withColumn("overall", total)).drop(*past(10), *past(9, "9"))


#: Contracts that expire before this year are taken for broken.
EXPIRY_YEAR = 2000


def option_quality(chain: DataFrame) -> DataFrame:
    """Four part scores and their weighted total per contract; a column ``expiry`` before the year 2000 costs validity."""
    req, opt = ("symbol", "strike", "dte", "put_call"), ("bid", "ask", "last", "volume", "open_interest", "iv", "underlying")
    share = lambda cs: sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)) / len(cs)
    bid, ask, u, iv = (F.col(c) for c in ("bid", "ask", "underlying", "iv"))
    quote = F.when(bid >= ask, 0.0).when(div(ask - bid, u) > 0.1, 0.7).otherwise(1.0)
    iv_ok = F.when((iv < 0) | (iv > 5), 0.5).otherwise(1.0)
    parts = {
        "completeness": share(req) * 0.7 + share(opt) * 0.3, "consistency": quote * iv_ok, "accuracy": F.lit(0.8),
        "validity": F.when(F.col("option_symbol").rlike(r"^[A-Z]+\d{6}[CP]\d{8}$"), 1.0).otherwise(0.5)
        * (F.when(F.year("expiry") < EXPIRY_YEAR, 0.3).otherwise(1.0) if "expiry" in chain.columns else F.lit(1.0)),
    }
    c = chain.withColumns(parts)
    return c.withColumn("overall", sum((F.col(k) * w for k, w in OPTION_WEIGHTS.items()), F.lit(0.0)))


def bar_findings(tag: str = "") -> Column:
    """What is odd about a bar, by the columns of `past`."""
    m, sd, vol = (F.col(x + tag) for x in ("_m", "_s", "_v"))
    z = F.when(sd > 0, F.abs((F.col("close") - m) / sd))
    return F.array_compact(F.array(
        F.when(z > 3, F.struct(F.lit("price_outlier").alias("type"), F.lit("high").alias("severity"), F.least(F.lit(0.95), z / 5.0).alias("confidence"))),
        F.when((vol > 0) & (F.col("volume") > vol * 5), F.struct(F.lit("volume_spike").alias("type"), F.lit("medium").alias("severity"), F.lit(0.8).alias("confidence"))),
    ))


def bar_anomalies(bars: DataFrame, history: int = 9) -> DataFrame:
    """Price outliers (|z| > 3 over the previous bars) and volume spikes (over 5 times their mean), one row each."""
    s = fr.segment(bars, lookback=history + 1).withColumns(past(history))
    s = fr.own(s.filter(F.col("_k") == history)).select("symbol", "ts", F.explode(bar_findings()).alias("a"))
    return s.select("symbol", "ts", "a.*")


def spread_anomalies(chain: DataFrame, limit: float = 0.2) -> DataFrame:
    share = div(F.col("ask") - F.col("bid"), F.col("underlying"))
    return chain.withColumn("spread_share", share).filter(F.col("spread_share") > limit)


@dataclass(frozen=True)
class Rule:
    """A named check: ``when`` is true where the row breaks it."""

    name: str
    severity: str
    when: Callable[[], Column]
    enabled: bool = True


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)

    def register(self, name: str, severity: str, when: Callable[[], Column], enabled: bool = True) -> RuleSet:
        return RuleSet([r for r in self.rules if r.name != name] + [Rule(name, severity, when, enabled)])

    def apply(self, df: DataFrame) -> DataFrame:
        """Arrays of broken rules per severity, validity, and 0.5^errors (at most 5) times 0.9^warnings (at most 10)."""
        def broken(severity):
            hits = [F.when(r.when(), F.lit(r.name)) for r in self.rules if r.enabled and r.severity == severity]
            return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

        out = df.withColumns({"errors": broken("error"), "warnings": broken("warning"), "info": broken("info")})
        score = F.pow(F.lit(0.5), F.least(F.size("errors"), F.lit(5)).cast("double")) * F.pow(F.lit(0.9), F.least(F.size("warnings"), F.lit(10)).cast("double"))
        return out.withColumn("is_valid", F.size("errors") == 0).withColumn("quality_score", score)


def with_history(bars: DataFrame, history: int = 10) -> DataFrame:
    """Bars with mean and deviation of close and mean volume of the ``history`` bars before, null where there are fewer; `bar_rules` reads them."""
    s = fr.segment(bars, lookback=history + 1).withColumns(past(history))
    full = lambda c: F.when(F.col("_k") == history, F.col(c))
    return fr.own(s.withColumns({"past_mean": full("_m"), "past_dev": full("_s"), "past_volume": full("_v")})).drop(*past(history))


def bar_rules(as_of: Callable[[], Column], strict: bool = False) -> RuleSet:
    """Rules of a bar. The ``strict`` level also compares with the bars before, by the columns of `with_history`."""
    c = F.col
    rs = RuleSet()
    rs = rs.register("symbol_format", "error", lambda: ~c("symbol").rlike("^[A-Z]+$"))
    for f in ("open", "high", "low", "close"):
        rs = rs.register(f"{f}_positive", "error", lambda f=f: c(f) <= 0)
    rs = rs.register("volume_non_negative", "error", lambda: c("volume") < 0)
    rs = rs.register("low_above_high", "error", lambda: c("low") > c("high"))
    rs = rs.register("open_outside_range", "warning", lambda: (c("open") > c("high")) | (c("open") < c("low")))
    rs = rs.register("close_outside_range", "warning", lambda: (c("close") > c("high")) | (c("close") < c("low")))
    rs = rs.register("price_outlier", "warning", lambda: (c("past_dev") > 0) & (F.abs(c("close") - c("past_mean")) > c("past_dev") * 3), strict)
    rs = rs.register("volume_anomaly", "warning", lambda: c("volume") > c("past_volume") * 5, strict)
    rs = rs.register("stale", "warning", lambda: age_hours(c("ts"), as_of()) > 24)
    return rs.register("unreliable_source", "info", lambda: reliability(c("source")) < 0.7)


def zone_rule(text: Callable[[], Column]) -> Rule:
    """Landed time texts that do not say UTC (``Z`` or a zero offset) break it; typed timestamps of Spark carry no zone of their own."""
    return Rule("time_zone", "error", lambda: ~F.coalesce(text().rlike(r"(Z|[+-]00:?00)$"), F.lit(False)))


def option_rules(expiry: bool = False) -> RuleSet:
    """Rules of a contract; with ``expiry`` the table has a column of that name, which must not lie before the year 2000."""
    c = F.col
    rs = RuleSet()
    rs = rs.register("option_symbol_format", "error", lambda: ~c("option_symbol").rlike(r"^[A-Z]+\d{6}[CP]\d{8}$"))
    for f in ("bid", "ask", "last", "strike", "underlying"):
        rs = rs.register(f"{f}_positive", "error", lambda f=f: c(f) <= 0)
    for f in ("volume", "open_interest"):
        rs = rs.register(f"{f}_non_negative", "error", lambda f=f: c(f) < 0)
    rs = rs.register("iv_range", "error", lambda: (c("iv") < 0) | (c("iv") > 5))
    rs = rs.register("spread_not_positive", "error", lambda: c("ask") - c("bid") <= 0)
    rs = rs.register("wide_spread", "warning", lambda: (c("ask") > c("bid")) & (div(c("ask") - c("bid"), c("underlying")) * 100 > 10))
    rs = rs.register("past_expiry", "error", lambda: F.year("expiry") < EXPIRY_YEAR, expiry)
    return rs.register("far_expiry", "warning", lambda: c("dte") > 365 * 3)


@dataclass(frozen=True)
class FieldRule:
    """Schema rule of one field."""

    name: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


def schema_quality(df: DataFrame, fields: Sequence[FieldRule], ts: str, as_of: Column) -> DataFrame:
    """Required, range and pattern checks per field; completeness, accuracy and timeliness weighted 30 / 50 / 20."""
    checks: list[tuple[str, str, Column]] = []
    for f in fields:
        x = F.col(f.name)
        if f.required:
            checks.append((f.name, "required", x.isNotNull()))
        if f.low is not None:
            checks.append((f.name, "min", x.isNull() | (x >= f.low)))
        if f.high is not None:
            checks.append((f.name, "max", x.isNull() | (x <= f.high)))
        if f.pattern:
            checks.append((f.name, "pattern", x.isNull() | x.rlike(f.pattern)))
    ok = lambda cs: sum((c.cast("int") for _, _, c in cs), F.lit(0)) / len(cs) * 100
    req = [c for c in checks if c[1] == "required"]
    h = age_hours(F.col(ts), as_of)
    time_score = (
        F.when(F.col(ts).isNull(), 50.0).when(h < 1, 100.0).when(h < 24, F.greatest(F.lit(80.0), 100.0 - (h - 1) * 2))
        .otherwise(F.greatest(F.lit(20.0), 80.0 - (h - 24)))
    )
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(f"{n}:{k}")) for n, k, c in checks]))
    out = df.withColumns({"completeness": ok(req) if req else F.lit(100.0), "accuracy": ok(checks), "timeliness": time_score, "failed": failed})
    return out.withColumn("overall", F.col("completeness") * 0.3 + F.col("accuracy") * 0.5 + F.col("timeliness") * 0.2)


def bar_multiplier(as_of: Column) -> Column:
    """0-1 product of penalties of a bar."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    hours = age_hours(F.col("ts"), as_of)
    p = lambda cond, v: F.when(cond, v).otherwise(1.0)
    stale = F.when(hours > 1, F.greatest(F.lit(0.8), 1.0 - (hours - 1) * 0.1)).otherwise(1.0)
    return p(F.col("volume") == 0, 0.8) * p(l > h, 0.5) * p((o > h) | (o < l), 0.7) * p((c > h) | (c < l), 0.7) * stale


def option_multiplier() -> Column:
    """0-1 product of penalties of a contract."""
    bid, ask, last = F.col("bid"), F.col("ask"), F.col("last")
    missing = bid.isNull().cast("int") + ask.isNull().cast("int") + last.isNull().cast("int")
    spread = F.when(ask - bid <= 0, 0.5).when(ask - bid > F.col("underlying") * 0.1, 0.7).otherwise(1.0)
    return (3 - missing) / 3.0 * spread


# Advice per low part score.
BAR_ADVICE = (
    ("completeness", 0.8, "Consider fetching missing data fields from alternative sources"),
    ("consistency", 0.7, "Verify data consistency with source provider"),
    ("timeliness", 0.6, "Consider using more recent data or real-time sources"),
    ("reliability", 0.7, "Consider using higher reliability data sources"),
)
OPTION_ADVICE = (
    ("completeness", 0.7, "Fetch missing option data fields (bid, ask, IV, etc.)"),
    ("consistency", 0.7, "Verify option pricing consistency"),
)


ANOMALY_ADVICE = "Review detected anomalies before using data for trading decisions"


def advice(rules: Sequence[tuple[str, float, str]], anomalous: Column | None = None) -> Column:
    """One text per low part score, and one where the row is ``anomalous``."""
    texts = [F.when(F.col(c) < lim, F.lit(text)) for c, lim, text in rules]
    return F.array_compact(F.array(*texts, *([] if anomalous is None else [F.when(anomalous, F.lit(ANOMALY_ADVICE))])))


def cross_field_checks(df: DataFrame) -> DataFrame:
    """Volume over 100 times its average, strong sentiment with low confidence, heavy volume with hardly any price."""
    v, av, s, c, p = (F.col(x) for x in ("volume", "avg_volume", "sentiment_score", "confidence", "price"))
    present = lambda x: F.coalesce(x, F.lit(0)) != 0
    ratio = div(v, av)
    return df.withColumn("failed", F.array_compact(F.array(
        F.when(present(v) & present(av) & (ratio > 100), F.lit("excessive_volume")),
        F.when(present(s) & present(c) & (F.abs(s) > 0.5) & (c < 0.3), F.lit("unsupported_sentiment")),
        F.when((av > 0) & (ratio > 5) & (F.abs(p) < 0.01), F.lit("volume_without_price")),
    )))

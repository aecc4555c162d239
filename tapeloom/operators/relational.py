"""Filters, projections, joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div


def where(df: DataFrame, conditions: dict[str, Any]) -> DataFrame:
    """Conjunction of min / max / in / not_in / equals conditions; unknown columns are ignored."""
    for c, cond in conditions.items():
        if c not in df.columns:
            continue
        x = F.col(c)
        if isinstance(cond, dict):
            if "min" in cond:
                df = df.filter(x >= cond["min"])
            if "max" in cond:
                df = df.filter(x <= cond["max"])
            if "in" in cond:
                df = df.filter(x.isin(list(cond["in"])))
            if "not_in" in cond:
                df = df.filter(x.isNull() | ~x.isin(list(cond["not_in"])))
        else:
            df = df.filter(x == cond)
    return df


def mentions(headlines: DataFrame, text: str = "headline") -> Column:
    up = F.upper(text)
    sym = F.upper("symbol")
    return F.contains(F.concat(F.lit(" "), up, F.lit(" ")), F.concat(F.lit(" "), sym, F.lit(" "))) | F.contains(up, F.concat(F.lit("$"), sym))


def symbol_headlines(headlines: DataFrame, order: Sequence[str], k: int, text: str = "headline") -> DataFrame:
    """First k headlines that mention the symbol; a symbol without any keeps its first k headlines."""
    h = headlines.withColumn("_hit", mentions(headlines, text))
    any_hit = h.groupBy("symbol").agg(F.max("_hit").alias("_any"))
    h = h.join(any_hit, "symbol").filter(F.col("_hit") | ~F.col("_any"))
    w = Window.partitionBy("symbol").orderBy(*order)
    return h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn", "_any").withColumnRenamed("_hit", "matched")


# Finance keywords that make an article relevant to any symbol, and the ones that count for ranking.
FINANCE_WORDS = ("stock", "stocks", "earnings", "revenue", "profit", "market", "trading", "investor", "nasdaq", "nyse", "sp 500", "financial")
RANKING_WORDS = ("earnings", "revenue", "profit", "stock", "market")
# Company words of the large symbols.
COMPANY_WORDS = {
    "AAPL": ("apple", "iphone", "ipad", "mac", "tim cook"),
    "TSLA": ("tesla", "elon musk", "electric vehicle", "ev"),
    "MSFT": ("microsoft", "windows", "xbox", "azure"),
    "GOOGL": ("google", "alphabet", "youtube", "android"),
    "GOOG": ("google", "alphabet", "youtube", "android"),
    "AMZN": ("amazon", "aws", "prime", "bezos"),
    "META": ("facebook", "meta", "instagram", "whatsapp", "zuckerberg"),
    "NVDA": ("nvidia", "graphics card", "gpu", "ai chip"),
}

# Company words that count for ranking.
RANKING_COMPANY_WORDS = {
    "AAPL": ("apple",), "TSLA": ("tesla",), "MSFT": ("microsoft",), "GOOGL": ("google", "alphabet"), "AMZN": ("amazon",), "META": ("meta", "facebook"),
}


def _aliases(words: dict[str, Sequence[str]]) -> Column:
    pairs = [x for k, v in words.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]
    return F.create_map(*pairs)[F.upper("symbol")] if pairs else F.array().cast("array<string>")


def _symbol_hits(low: Column) -> tuple[Column, Column]:
    sym = F.lower("symbol")
    return F.contains(low, F.concat(F.lit("$"), sym)), F.contains(low, F.concat(F.lit(" "), sym, F.lit(" ")))


def relevant_articles(articles: DataFrame, text: str, words: Sequence[str] = FINANCE_WORDS, aliases: dict[str, Sequence[str]] = COMPANY_WORDS) -> DataFrame:
    """Articles that carry the cashtag, the padded symbol, a company word, or a finance word."""
    a = articles.withColumn("_low", F.lower(text)).withColumn("_al", _aliases(aliases))
    low = F.col("_low")
    cash, padded = _symbol_hits(low)
    company = F.coalesce(F.exists("_al", lambda w: F.contains(low, w)), F.lit(False))
    finance = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return a.filter(cash | padded | company | finance).drop("_low", "_al")


def relevance_score(articles: DataFrame, text: str, words: Sequence[str] = RANKING_WORDS, aliases: dict[str, Sequence[str]] = RANKING_COMPANY_WORDS) -> DataFrame:
    """Ranking score: cashtag 1, padded symbol 0.8, company word 0.6, finance words 0.1 each up to 0.5."""
    a = articles.withColumn("_low", F.lower(text)).withColumn("_al", _aliases(aliases))
    low = F.col("_low")
    cash, padded = _symbol_hits(low)
    company = F.coalesce(F.exists("_al", lambda w: F.contains(low, w)), F.lit(False))
    n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = F.when(cash, 1.0).otherwise(0.0) + F.when(padded, 0.8).otherwise(0.0) + F.when(company, 0.6).otherwise(0.0) + F.least(n * 0.1, F.lit(0.5))
    return a.withColumn("relevance", score).drop("_low", "_al")


def typed_quote(quotes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two decimals half up; zero counts as missing; volume whole."""
    two = {c: F.when(F.col(c) != 0, F.round(F.col(c), 2)) for c in cols}
    return quotes.withColumns(two).withColumn("volume", F.when(F.col("volume") != 0, F.col("volume").cast("bigint")))


def movers(bars: DataFrame, volume: float = 5_000_000, move: float = 3.0) -> DataFrame:
    """Flags of high volume and large moves on the last bar of every symbol."""
    t = fr.tail(bars, 2)
    b = F.col("_back")
    g = t.groupBy("symbol").agg(
        F.max(F.when(b == 1, F.col("close"))).alias("close"), F.max(F.when(b == 2, F.col("close"))).alias("_p"), F.max(F.when(b == 1, F.col("volume"))).alias("volume")
    )
    g = g.withColumn("change_pct", (div(F.col("close"), F.col("_p")) - 1) * 100).drop("_p")
    return g.withColumn("high_volume", F.col("volume") > volume).withColumn("large_mover", F.coalesce(F.abs("change_pct") > move, F.lit(False)))


def quality_gate(scored: DataFrame, threshold: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """Rows at or above the threshold, and the others as warnings."""
    ok = F.col("score") >= threshold
    return scored.filter(ok), scored.filter(~ok)


def drop_invalid(rows: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Drop symbols whose invalid mark has not expired."""
    return rows.join(marks.filter(F.col("expires") > as_of).select("symbol").distinct(), "symbol", "left_anti")


def sentiment_bucket(score: Column) -> Column:
    return F.when(score < -0.1, "negative").when(score > 0.1, "positive").otherwise("neutral")


def search_securities(securities: DataFrame, asset_class: str, query: str | None = None, **filters: Any) -> DataFrame:
    """Securities of a class by name or symbol text and field filters."""
    s = where(securities.filter(F.col("asset_class") == asset_class), filters)
    if query:
        t = query.lower()
        s = s.filter(F.contains(F.lower("symbol"), F.lit(t)) | F.contains(F.lower("name"), F.lit(t)))
    return s


def sector_validity(perf: DataFrame, cols: Sequence[str]) -> DataFrame:
    """85 when every group row is a sector with all known performances in [-100, 100], else 55."""
    ok = (F.col("group_type") == "sector") & F.forall(F.array(*cols), lambda x: x.isNull() | x.between(-100, 100))
    g = perf.groupBy("batch").agg(F.bool_and(ok).alias("valid"))
    return g.withColumn("score", F.when(F.col("valid"), 85.0).otherwise(55.0))


def retain(df: DataFrame, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    return df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {days} DAYS"))


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] | None, how: str = "inner") -> DataFrame:
    """Equi join; ``cross`` pairs all rows and is meant for a right side of a few rows."""
    if how == "cross":
        return left.crossJoin(right)
    return left.join(right, list(on), {"outer": "full_outer"}.get(how, how))


def align_features(blocks: Sequence[DataFrame], keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), block: Column | None = None) -> DataFrame:
    """Outer join of feature blocks on their index, forward fill per key, then 0."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, [*keys, *order], "full_outer")
    cols = [c for c in out.columns if c not in (*keys, *order)]
    seen = {c: (F.max, F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))) for c in cols}
    d = fr.carried(out, seen, keys, order, block)
    w = fr.in_block(keys, order)
    d = d.withColumns({f"_f_{c}": F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_carry_{c}.v"), F.lit(0.0)) for c in cols})
    return fr.drop_layout(d.select(*keys, *order, *[F.col(f"_f_{c}").alias(c) for c in cols]))


def best_source(candidates: DataFrame, excellent: float = 95.0) -> DataFrame:
    """Per symbol: the first source in priority with an excellent score, else the highest score (earlier source on ties)."""
    c = candidates.filter(F.coalesce("score", F.lit(0.0)) > 0)
    good = F.col("score") >= excellent
    rank = F.struct(F.when(good, 0).otherwise(1), F.when(good, 0.0).otherwise(-F.col("score")), "priority")
    rest = [x for x in c.columns if x != "symbol"]
    return c.groupBy("symbol").agg(F.min_by(F.struct(*rest), rank).alias("r")).select("symbol", "r.*")


def first_source(candidates: DataFrame, value: str = "price") -> DataFrame:
    """First source in priority that has a value."""
    c = candidates.filter(F.col(value).isNotNull())
    rest = [x for x in c.columns if x != "symbol"]
    return c.groupBy("symbol").agg(F.min_by(F.struct(*rest), "priority").alias("r")).select("symbol", "r.*")


def merge_darkpool(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """Synthetic signals confirmed by real data gain 30 percent up to 0.95; real-only symbols are appended."""
    r = real.select("symbol", F.col("confidence").alias("_rc")).dropDuplicates(["symbol"])
    j = synthetic.join(r, "symbol", "full_outer")
    s, rc = F.col("confidence"), F.col("_rc")
    both = s.isNotNull() & rc.isNotNull()
    return j.select(
        "symbol", F.when(both, F.least(s * 1.3, F.lit(0.95))).otherwise(F.coalesce(s, rc)).alias("confidence"),
        F.when(both, "validated").when(s.isNotNull(), "synthetic").otherwise("real").alias("origin"),
    )


def pair_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with their outcome by sample id: error, direction hit and squared-error score."""
    j = predictions.join(outcomes, "sample_id")
    a, p = F.col("actual"), F.col("predicted")
    return j.withColumns({
        "error": F.coalesce(div(F.abs(a - p), a), F.abs(p)), "direction_correct": (a > 0) == (p > 0), "score": 1 / (1 + F.abs(a - p)),
    })


def add_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Symbol sentiment on every bar; 0 where there is none."""
    cols = [c for c in sentiment.columns if c != "symbol"]
    return bars.join(sentiment, "symbol", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


def as_of_view(df: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """Rows known at or before a moment."""
    return df.filter(F.col(ts) <= as_of)


def as_of_join(left: DataFrame, right: DataFrame, value: str, keys: Sequence[str] = ("symbol",), block: Column | None = None) -> DataFrame:
    """Latest ``value`` of the right side at or before every left row: one ordered union and a carried last value."""
    r = right.select(*keys, "ts", F.lit(0).alias("_side"), F.struct("ts", F.col(value).alias("v")).alias("_v"))
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType))
    u = l.unionByName(r, allowMissingColumns=True)
    order = ("ts", "_side")
    c = fr.carried(u, {"v": (F.max, F.col("_v"))}, keys, order, block)
    w = fr.in_block(keys, order)
    got = F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_carry_v"))
    c = c.withColumn("_got", got).filter("_side = 1")
    return fr.drop_layout(c.withColumn(value, F.col("_got.v"))).drop("_got", "_side", "_v")


def best_per_key(df: DataFrame, key: str, score: str, first: Sequence[str]) -> DataFrame:
    """Highest score per key; the earlier row wins ties."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), *first)).alias("r")).select(key, "r.*")


def distinct_items(df: DataFrame, keys: Sequence[str], item: Column, order: Sequence[str], k: int) -> DataFrame:
    """First occurrence of every cleaned item per key, then the first k of them in order."""
    d = df.withColumn("item", item).filter(F.col("item") != "")
    g = d.groupBy(*keys, "item").agg(F.min(F.struct(*order)).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_o")
    return g.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).drop("_o")


def union_selected(*chosen: DataFrame) -> DataFrame:
    out = chosen[0].select("feature")
    for c in chosen[1:]:
        out = out.unionByName(c.select("feature"))
    return out.distinct()


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def common_numeric(a: DataFrame, b: DataFrame) -> list[str]:
    """Names of the numeric columns both tables have."""
    nb = {c for c, t in b.dtypes if t in NUMERIC or t.startswith("decimal")}
    return [c for c, t in a.dtypes if c in nb and (t in NUMERIC or t.startswith("decimal"))]


def common_numeric_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables unpivoted over their common numeric columns with a side mark."""
    cols = common_numeric(a, b)
    def side(df, name):
        d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        return d.unpivot([], cols, "column_name", "value").withColumn("side", F.lit(name))
    return side(a, "a").unionByName(side(b, "b"))


def latest_by_rank(df: DataFrame, score: str, keys: Sequence[str], k: int) -> DataFrame:
    """The k best rows by score, ties by the given keys."""
    return df.orderBy(F.desc(score), *keys).limit(k)

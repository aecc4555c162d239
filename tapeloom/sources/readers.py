"""Landed files and documents to typed tables. Schemas are explicit; partitions of the reader replace chunk loops."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
NOT_A_NUMBER = ("", "none", "null", "nan")


def read_csv(spark: SparkSession, path: str, schema: str, apply: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """CSV files of a folder with a header and a declared schema; ``apply`` runs on every partition's rows."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return apply(df) if apply else df


ATS_SCHEMA = "IssueSymbol string, VenueName string, ATSVolume double, TotalVolume double"


def read_ats_csv(spark: SparkSession, path: str) -> DataFrame:
    """Venue volumes with our column names."""
    return read_csv(spark, path, ATS_SCHEMA).select(
        F.col("IssueSymbol").alias("symbol"), F.col("VenueName").alias("venue"), F.col("ATSVolume").alias("ats_volume"), F.col("TotalVolume").alias("total_volume")
    )


def clean_number(c: Column) -> Column:
    """Text to double; blank, none, null, nan and unparsable text become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*NOT_A_NUMBER), t.try_cast("double"))


def clean_percent(c: Column) -> Column:
    """'12.5%', '1,234.5%' to a number; '-' and blank become null."""
    t = F.trim(F.regexp_replace(F.trim(c), "[%,]", ""))
    return F.when(~t.isin("", "-"), t.try_cast("double"))


def clean_time(c: Column) -> Column:
    """First matching format, else epoch seconds, else null."""
    t = F.trim(c)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(*tries, F.timestamp_seconds(t.try_cast("bigint"))).cast("timestamp_ntz")


def series_documents(docs: DataFrame, body: str = "body") -> DataFrame:
    """Vendor time-series documents (``values`` of text fields) to typed bars; rows without a readable time are dropped."""
    schema = "values array<struct<datetime string, open string, high string, low string, close string, volume string>>"
    v = docs.select("symbol", F.explode(F.from_json(body, schema)["values"]).alias("v"))
    prices = [clean_number(F.col(f"v.{c}")).alias(c) for c in ("open", "high", "low", "close")]
    out = v.select("symbol", clean_time(F.col("v.datetime")).alias("ts"), *prices, clean_number(F.col("v.volume")).cast("bigint").alias("volume"))
    return out.filter(F.col("ts").isNotNull())


def daily_history(rows: DataFrame, ingest: Sequence[str]) -> DataFrame:
    """Drop rows without date or price, round prices to 6 places, keep the last ingested row of every day."""
    prices = ("open", "high", "low", "close")
    r = rows.filter(F.col("date").isNotNull())
    for c in prices:
        r = r.withColumn(c, F.round(F.col(c).try_cast("double"), 6)).filter(F.col(c).isNotNull())
    r = r.withColumn("volume", F.col("volume").try_cast("double"))
    keep = F.max_by(F.struct(*prices, "volume"), F.struct(*ingest))
    return r.groupBy("symbol", "date").agg(keep.alias("r")).select("symbol", "date", "r.*")


def dividends_and_splits(docs: DataFrame, body: str = "body") -> DataFrame:
    """Dated amounts and ratios of every symbol in long form; values that are not numbers are dropped."""
    j = F.from_json(body, "dividends map<string,string>, splits map<string,string>")
    d = docs.select("symbol", j.alias("j"))
    both = d.select("symbol", F.explode(F.array(
        F.struct(F.lit("dividend").alias("kind"), F.col("j.dividends").alias("m")), F.struct(F.lit("split").alias("kind"), F.col("j.splits").alias("m")),
    )).alias("x"))
    e = both.select("symbol", "x.kind", F.explode("x.m").alias("date", "text"))
    return e.select("symbol", "kind", F.substring("date", 1, 10).alias("date"), clean_number(F.col("text")).alias("value")).filter(F.col("value").isNotNull())


def earnings_calendar(primary: DataFrame, secondary: DataFrame, body: str = "body") -> DataFrame:
    """Calendar rows from the primary documents with alternate field names; symbols it lacks come from the secondary table."""
    names = {
        "symbol": ("symbol", "ticker"), "date": ("date", "epsDate"), "time": ("time", "timeOfDay"), "eps_estimate": ("epsEstimated", "epsEstimate"),
        "eps_actual": ("eps", "epsActual"), "revenue_estimate": ("revenueEstimated", "revenueEstimate"), "revenue_actual": ("revenue", "revenueActual"),
    }
    schema = ", ".join(f"{n} string" for pair in names.values() for n in pair)
    j = primary.select(F.from_json(body, schema).alias("j"))
    pick = {k: F.coalesce(*[F.col(f"j.{n}") for n in v]) for k, v in names.items()}
    time = F.lower(pick["time"])
    out = j.select(
        pick["symbol"].alias("symbol"), pick["date"].alias("date"), F.when(~time.isin("", "none"), time).alias("time"),
        *[clean_number(pick[c]).alias(c) for c in ("eps_estimate", "eps_actual", "revenue_estimate", "revenue_actual")],
    ).withColumn("source", F.lit("primary"))
    rest = secondary.join(out.select("symbol").distinct(), "symbol", "left_anti").withColumn("source", F.lit("secondary"))
    return out.unionByName(rest, allowMissingColumns=True)


def flatten_chain(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Calls and puts as one table with a side flag and safe casts."""
    def side(df, name):
        num = lambda c, t: F.col(c).try_cast(t).alias(c)
        return df.select("symbol", F.lit(name).alias("put_call"), num("strike", "double"), num("last", "double"), num("bid", "double"), num("ask", "double"),
                         num("volume", "bigint"), num("open_interest", "bigint"))
    return side(calls, "call").unionByName(side(puts, "put")).filter(F.col("strike").isNotNull())


SNAPSHOT_KEY = ("symbol", "expiry", "chain_date", "put_call", "strike")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = SNAPSHOT_KEY, order: Sequence[str] = ("ingest",)) -> DataFrame:
    """New rows replace stored rows of the same key; inside a load the last ingested row wins (partial aggregation, no sort)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("_r"))
    return g.select(*keys, "_r.*")


def latest_snapshot(snaps: DataFrame, keys: Sequence[str] = ("symbol", "expiry")) -> DataFrame:
    """All rows of the newest chain date per symbol and expiry: a small maximum table joined back."""
    newest = snaps.groupBy(*keys).agg(F.max("chain_date").alias("chain_date"))
    return snaps.join(newest, [*keys, "chain_date"], "left_semi")


PLAYBOOK_SCHEMA = (
    "trades array<struct<ticker string, direction string, instrument string, entry_range string, profit_target string, stop_loss string, "
    "counter_signal string, thesis string, scenario_tree map<string,string>>>, tomorrows_tape string"
)


def read_playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Playbook JSON files, one document each, to one row per trade."""
    j = spark.read.schema(PLAYBOOK_SCHEMA).json(path)
    return j.select("tomorrows_tape", F.explode("trades").alias("t")).select("tomorrows_tape", "t.*")


def page_text(html: Column) -> Column:
    """Text of a page without tags."""
    return F.regexp_replace(html, "<[^>]*>", "")


# Where the four breadth counts stand in the page text.
BREADTH = {
    "advancers": r"Advancing[\d.]+%\s*\((\d+)\)", "decliners": r"Declining\((\d+)\)",
    "new_highs": r"New High[\d.]+%\s*\((\d+)\)", "new_lows": r"New Low\((\d+)\)",
}


def breadth_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    p = pages.withColumn("_text", page_text(F.col(html)))
    return p.withColumns({k: F.regexp_extract("_text", pat, 1).try_cast("bigint") for k, pat in BREADTH.items()}).drop("_text")


def listed_tickers(pages: DataFrame, cell: str, html: str = "html") -> DataFrame:
    """Distinct upper-case symbols of two to five letters found in the cells a pattern selects."""
    c = pages.select(F.explode(F.regexp_extract_all(html, F.lit(cell), F.lit(1))).alias("x")).select(F.trim("x").alias("x"))
    return c.filter(F.col("x").rlike(r"^\p{L}{2,5}$")).select(F.upper("x").alias("ticker")).distinct()


def headlines(items: DataFrame, c: str = "items") -> DataFrame:
    """One trimmed headline per feed item; empty ones are dropped."""
    keep = [k for k in items.columns if k != c]
    return items.select(*keep, F.explode(c).alias("h")).withColumn("headline", F.trim("h")).filter(F.col("headline") != "").drop("h")


def write_results(df: DataFrame, path: str, run_id: str, as_of: str, fmt: str = "json") -> None:
    """Result documents with run metadata on every row."""
    df.withColumns({"run_id": F.lit(run_id), "as_of": F.lit(as_of)}).write.mode("overwrite").format(fmt).save(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")

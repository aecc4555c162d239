"""Finance text: cleaning, extraction and sentiment scores as native column expressions over whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.frames import div
from tapeloom.operators.aggregates import clamp

# Weighted finance terms.
BULLISH = {
    "moon": 2.0, "rocket": 1.8, "bull": 1.5, "buy": 1.2, "long": 1.1, "breakout": 1.6, "uptrend": 1.4, "rally": 1.3, "surge": 1.5,
    "outperform": 1.2, "upgrade": 1.3, "target": 1.1, "beat": 1.4, "strong": 1.2, "momentum": 1.1, "bullish": 1.5, "pump": 1.8, "hodl": 1.3,
    "diamond hands": 2.0, "to the moon": 2.5, "earnings beat": 1.6, "guidance raise": 1.7, "revenue growth": 1.3, "pricing power": 1.4,
    "backlog expanded": 1.2, "book-to-bill": 1.1, "beat and raise": 1.8, "reacceleration": 1.3, "visibility improved": 1.1,
}
BEARISH = {
    "crash": -2.0, "dump": -1.8, "bear": -1.5, "sell": -1.2, "short": -1.1, "breakdown": -1.6, "downtrend": -1.4, "decline": -1.3, "plunge": -1.5,
    "underperform": -1.2, "downgrade": -1.3, "miss": -1.4, "weak": -1.2, "bearish": -1.5, "bubble": -1.6, "overvalued": -1.3, "resistance": -1.1,
    "paper hands": -1.8, "rugpull": -2.5, "bag holder": -1.9, "earnings miss": -1.6, "guidance cut": -1.7, "revenue decline": -1.3,
    "margin compression": -1.4, "inventory overhang": -1.2, "order cancellations": -1.3, "probe": -1.1, "settlement": -0.6, "class action": -1.2,
    "regulatory risk": -1.1, "weak sell-through": -1.0, "credit losses": -1.1, "liquidity stress": -1.2,
}
REGIME = {
    "volatility": -0.5, "uncertainty": -0.8, "correction": -1.2, "rotation": 0.0, "consolidation": -0.3, "institutional": 0.5, "retail": 0.2,
    "volume": 0.1, "options flow": 0.3, "soft landing": 0.6, "hard landing": -0.9, "disinflation": 0.5, "stagflation": -1.4, "tightening": -0.6,
    "easing": 0.5, "recession risk": -1.1, "credit crunch": -1.2,
}
# Qualifiers, markers and keywords.
INTENSIFIERS = {"materially": 1.25, "significantly": 1.2, "substantially": 1.2, "meaningfully": 1.15, "strongly": 1.1}
DIMINISHERS = {"slightly": 0.85, "modestly": 0.9, "marginally": 0.9, "somewhat": 0.92}
NEGATIONS = ("not", "no", "without", "lack", "isn't", "wasn't", "aren't", "weren't", "never")
FORWARD = ("expects", "guiding", "outlook", "forecast", "project", "anticipate", "targets", "sees")
BACKWARD = ("reported", "was", "were", "had", "realized")
POSITIVE_WORDS = ("bullish", "positive", "gain", "rise", "growth", "profit", "strong", "beat")
NEGATIVE_WORDS = ("bearish", "negative", "loss", "fall", "decline", "weak", "miss", "below")
EARNINGS_WORDS = ("earnings", "results", "quarter", "guidance", "forecast", "outlook")
DEAL_WORDS = ("acquisition", "merger", "buyout", "takeover", "deal")
# Abbreviations and their expansion, in the order of replacement.
ABBREVIATIONS = (
    ("EPS", "earnings per share"), ("EBITDA", "earnings before interest taxes depreciation amortization"), ("P/E", "price to earnings ratio"),
    ("ROI", "return on investment"), ("IPO", "initial public offering"), ("M&A", "mergers and acquisitions"), ("CEO", "chief executive officer"),
    ("CFO", "chief financial officer"), ("Q1", "first quarter"), ("Q2", "second quarter"), ("Q3", "third quarter"), ("Q4", "fourth quarter"),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated tokens; empty text has none."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def _strings(xs: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def any_term(terms: Sequence[str]) -> str:
    """A pattern whose first group is, at each place of a text, the longest term that starts there; common beginnings are tried once."""
    tree: dict = {}
    for t in terms:
        node = tree
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def part(node: dict) -> str:
        ways = [re.escape(ch) + part(below) for ch, below in sorted(node.items()) if ch]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return f"(?=({part(tree)}))"


def lexicon_score(
    texts: DataFrame, text: str = "text", terms: dict[str, float] | None = None, negations: Sequence[str] = NEGATIONS,
    intensifiers: dict[str, float] = INTENSIFIERS, diminishers: dict[str, float] = DIMINISHERS, forward: Sequence[str] = FORWARD,
    backward: Sequence[str] = BACKWARD, reach: int = 3,
) -> DataFrame:
    """Sum of the weights of all terms found in the text, each adjusted by the tokens around its first token.

    A negation near the term flips the weight at 0.8; distinct intensifiers and diminishers multiply it. Forward
    markers anywhere raise the sum by 1.08, backward markers lower it to 0.96. Adds ``lex_score``, ``lex_matches``.
    The text is searched once for all terms: the longest at each place, which holds any other term that begins there.
    """
    terms = terms if terms is not None else {**BULLISH, **BEARISH, **REGIME}
    factors = {**diminishers, **intensifiers}
    lex = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.split()[0]).alias("first"), F.lit(float(w)).alias("weight")) for t, w in terms.items()])
    scale = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))]) if factors else F.create_map().cast("map<string,double>")

    def once(x: Column, f: Callable[[Column], Column]) -> Column:
        """f(x) with x computed once a row: what stands inside a lambda is computed for each of its elements."""
        return F.transform(F.array(x), f)[0]

    def adjusted(tok: Column, hit: Column) -> Column:
        def by(near: Column) -> Column:
            w = hit["weight"]
            flipped = F.when(w > 0, -F.abs(w) * 0.8).otherwise(F.abs(w) * 0.8)
            w = F.when(F.arrays_overlap(near, _strings(negations)), flipped).otherwise(w)
            known = F.filter(near, lambda x: F.array_contains(_strings(tuple(factors)), x))
            return w * F.aggregate(known, F.lit(1.0), lambda a, x: a * scale[x])

        def around(at: Column) -> Column:
            start = F.greatest(at - reach, F.lit(1))
            return once(F.array_distinct(F.slice(tok, start, at + reach - start + 1)), by)

        return once(F.greatest(F.array_position(tok, hit["first"]).cast("int"), F.lit(1)), around)

    def scored(tok: Column, hits: Column) -> Column:
        total = F.aggregate(F.transform(hits, lambda h: adjusted(tok, h)), F.lit(0.0), lambda a, w: a + w)
        ahead = F.when(F.arrays_overlap(tok, _strings(forward)), 1.08).otherwise(1.0)
        behind = F.when(F.arrays_overlap(tok, _strings(backward)), 0.96).otherwise(1.0)
        return F.struct((total * ahead * behind).alias("score"), F.size(hits).alias("matches"))

    def of(low: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(any_term(tuple(terms))), F.lit(1)))
        hits = once(found, lambda all_: F.filter(lex, lambda t: F.exists(all_, lambda x: F.contains(x, t["term"]))))
        return once(F.struct(words(low).alias("tok"), hits.alias("hits")), lambda s: scored(s["tok"], s["hits"]))

    d = texts.withColumn("_lex", once(F.lower(text), of))
    return d.withColumn("lex_score", F.col("_lex.score")).withColumn("lex_matches", F.col("_lex.matches")).drop("_lex")


def keyword_polarity(low: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """(positive - negative) / (positive + negative) words contained, 0 without any."""
    n = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    p, m = n(positive), n(negative)
    return F.coalesce(div((p - m).cast("double"), p + m), F.lit(0.0))


def news_sentiment(texts: DataFrame, text: str = "text", positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Mean keyword polarity and clamped mean strength per symbol."""
    t = texts.withColumn("_low", F.lower(text))
    t = t.withColumn("_s", keyword_polarity(F.col("_low"), positive, negative))
    return t.groupBy("symbol").agg(F.avg("_s").alias("sentiment_score"), clamp(F.avg(F.abs("_s")), 0.2, 0.8).alias("confidence"), F.count(F.lit(1)).alias("sample_size"))


# Base weights of the three scores.
BASE_WEIGHTS = {"vader": 0.3, "lexicon": 0.2, "finbert": 0.5}


def ensemble_weights(length: Column, matches: Column, model_confidence: Column) -> dict[str, Column]:
    """Per-row weights from text length, lexicon matches and model confidence, normalised to one."""
    pick = lambda cond, a, other: F.when(cond, a).otherwise(other)
    short, long = length < 50, length > 200
    lex = F.lit(BASE_WEIGHTS["lexicon"]) * pick(short, 1.5, 1.0) * pick(matches > 3, 1.4, 1.0)
    fin = F.lit(BASE_WEIGHTS["finbert"]) * F.when(short, 0.7).when(long, 1.3).otherwise(1.0)
    fin = fin * F.when(model_confidence > 0.8, 1.2).when(model_confidence < 0.5, 0.6).otherwise(1.0)
    vad = F.lit(BASE_WEIGHTS["vader"]) * pick(long, 0.8, 1.0)
    total = lex + fin + vad
    return {"vader": vad / total, "lexicon": lex / total, "finbert": fin / total}


def ensemble_score(rows: DataFrame) -> DataFrame:
    """Weighted score of the columns ``vader``, ``lex_score`` and ``finbert``, with fallbacks and a confidence less a disagreement penalty.

    ``blob`` is an optional polarity column: it is averaged in, or stands alone when all scores are zero.
    """
    rows = rows if "blob" in rows.columns else rows.withColumn("blob", F.lit(None).cast("double"))
    v, f, fc, b, n, m = (F.col(c) for c in ("vader", "finbert", "finbert_conf", "blob", "length", "lex_matches"))
    r = rows.withColumn("lexicon", F.tanh(F.col("lex_score") / 3.0))
    w = ensemble_weights(n, m, fc)
    r = r.withColumns({f"_w_{k}": x for k, x in w.items()})
    l = F.col("lexicon")
    tiny = lambda c: F.abs(c) < 1e-6
    mixed = v * F.col("_w_vader") + l * F.col("_w_lexicon") + f * F.col("_w_finbert")
    mixed = F.when(b.isNotNull(), (mixed + b) / 2).otherwise(mixed)
    r = r.withColumn("_e", F.when(tiny(v) & tiny(l) & tiny(f), F.coalesce(b, F.lit(0.0))).otherwise(mixed))
    strongest = F.when((F.abs(v) >= F.abs(l)) & (F.abs(v) >= F.abs(f)), v).when(F.abs(l) >= F.abs(f), l).otherwise(f)
    score = F.when(tiny(F.col("_e")) & (strongest != 0), strongest).otherwise(F.col("_e"))
    mean = (v + l + f) / 3
    spread = F.sqrt(((v - mean) ** 2 + (l - mean) ** 2 + (f - mean) ** 2) / 3)
    base = F.abs(v) * 0.3 + F.least(F.lit(1.0), m / 5.0) * 0.2 + fc * 0.4 + F.least(F.lit(1.0), n / 100.0) * 0.1
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base) - F.least(F.lit(0.15), spread * 0.2))
    return r.withColumn("ensemble_score", score).withColumn("confidence", conf).drop("_e", "_w_vader", "_w_lexicon", "_w_finbert")


def batch_ensemble(rows: DataFrame) -> DataFrame:
    """Weighted mean with the raw lexicon score and the clamped batch confidence."""
    v, f, fc, n, m = (F.col(c) for c in ("vader", "finbert", "finbert_conf", "length", "lex_matches"))
    w = ensemble_weights(n, m, fc)
    score = v * w["vader"] + f * w["finbert"] + F.when(m > 0, F.col("lex_score")).otherwise(0.0) * w["lexicon"]
    conf = clamp(F.abs(f) * 0.5 + F.abs(v) * 0.3 + F.least(F.lit(1.0), m / 8.0) * 0.2, 0.05, 0.99)
    return rows.withColumn("ensemble_score", score).withColumn("confidence", conf)


def context_boost(low: Column, score: Column, earnings: Sequence[str] = EARNINGS_WORDS, deals: Sequence[str] = DEAL_WORDS) -> Column:
    has = lambda ws: F.exists(_strings(ws), lambda w: F.contains(low, w))
    return clamp(score * F.when(has(earnings), 1.15).otherwise(1.0) * F.when(has(deals), 1.1).otherwise(1.0), -1.0, 1.0)


# Cleaning and extraction ---------------------------------------------------------------------------------------

def string_features(df: DataFrame, c: str) -> DataFrame:
    x = F.col(c)
    clean = F.regexp_replace(F.regexp_replace(F.lower(x), r"^\s+|\s+$", ""), r"[^\p{L}\p{N}_\s]", "")
    return df.withColumns({f"{c}_clean": clean, f"{c}_length": F.length(x), f"{c}_word_count": F.size(words(x))})


def clean_text(c: Column, limit: int = 400) -> Column:
    """Collapse whitespace, drop everything outside printable ASCII, collapse again, cut with an ellipsis."""
    t = F.regexp_replace(c, r"\s+", " ")
    t = F.regexp_replace(t, r"[^\x20-\x7E]", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def clean_post(c: Column) -> Column:
    """Without links and mentions, single spaces."""
    t = F.regexp_replace(F.regexp_replace(c, r"https?://[^\s]+", ""), r"@\w+", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"\$([A-Z]{1,5})"), F.lit(1)))


def expand_finance(c: Column) -> Column:
    """Drop dollar signs, spell out percent and the abbreviations."""
    t = F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit("%"), F.lit(" percent "))
    for short, full in ABBREVIATIONS:
        t = F.replace(t, F.lit(short), F.lit(full))
    return t


def percent_change(old: Column, new: Column) -> Column:
    return F.coalesce(div(new - old, old) * 100, F.lit(0.0))


def currency_text(x: Column, unit: str = "USD") -> Column:
    out = F.format_string(f"$%.2f {unit}", x)
    for limit, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(x >= limit, F.format_string(f"$%.2f{mark} {unit}", x / limit)).otherwise(out)
    return out


def token_estimate(c: Column) -> Column:
    return F.floor(F.size(words(c)) * 1.3).cast("bigint")


def compress_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(c)


def compress_map(m: Column, keys: int = 3, limit: int = 50) -> Column:
    """First entries of a map with long values cut."""
    return F.map_from_entries(F.transform(F.slice(F.map_entries(m), 1, keys), lambda e: F.struct(
        e["key"], F.when(F.length(e["value"]) > limit, F.concat(F.substring(e["value"], 1, limit), F.lit("..."))).otherwise(e["value"]))))


def date_parts(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Weekday and month marks; the quarter mark is the change of quarter to the previous row."""
    from tapeloom.functions.frames import over, own, segment

    s = segment(df, 1, keys=keys, order=(ts,))
    t = F.col(ts)
    day = F.weekday(t)
    change = F.quarter(t) - F.lag(F.quarter(t), 1).over(over(keys, (ts,)))
    return own(s.withColumns({
        "day_of_week": day, "is_monday": (day == 0).cast("int"), "is_friday": (day == 4).cast("int"), "month": F.month(t),
        "is_month_end": (F.day(t) > 25).cast("int"), "is_quarter_end": F.coalesce(change, F.lit(0)),
    }))


def expiry_marks(chain: DataFrame) -> DataFrame:
    return chain.withColumns({"is_expiry_week": (F.col("dte") <= 5).cast("int"), "is_expiry_month": (F.col("dte") <= 30).cast("int")})


def daily_open_close(bars: DataFrame, start: str, end: str) -> DataFrame:
    """One text 'date o:open, c:close ...' per symbol over a date range."""
    b = bars.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    part = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" o:"), F.format_string("%.4f", "open"), F.lit(", c:"), F.format_string("%.4f", "close"))
    rows = F.sort_array(F.collect_list(F.struct("ts", part.alias("p"))))
    return b.groupBy("symbol").agg(F.array_join(F.transform(rows, lambda r: r["p"]), " ").alias("line"))


# Embedded JSON -------------------------------------------------------------------------------------------------

def repair_json(c: Column) -> Column:
    """Without code fences, trailing commas and comments."""
    t = F.regexp_replace(c, r"```json\s*", "")
    t = F.regexp_replace(t, r"```\s*$", "")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r"//.*", "")
    return strip(F.regexp_replace(t, r"(?s)/\*.*?\*/", ""))


TREE = "map<string,string>"
DOCUMENT = f"scenario_tree {TREE}, trades array<struct<scenario_tree:{TREE}>>"


def _tree_in(text: Column) -> Column:
    """Scenario tree of a JSON document, or of its first trade that has one."""
    doc = F.from_json(repair_json(text), DOCUMENT)
    of_trades = F.try_element_at(F.filter(doc["trades"]["scenario_tree"], lambda m: m.isNotNull()), F.lit(1))
    return F.coalesce(_filled(doc["scenario_tree"]), _filled(of_trades))


def _filled(m: Column) -> Column:
    return F.when(F.size(m) > 0, m)


def scenario_tree(c: Column, strict: bool = False) -> Column:
    """First scenario tree found: whole text, fenced block, key pattern, then (unless strict) the first braces with all three cases."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)```json(.*?)```"), F.lit(1))
    fenced = F.try_element_at(F.filter(F.transform(blocks, _tree_in), lambda m: m.isNotNull()), F.lit(1))
    keyed = F.regexp_extract(c, r'(?s)"scenario_tree"\s*:\s*(\{.*?\})', 1)
    by_key = _filled(F.from_json(F.when(keyed != "", repair_json(keyed)), TREE))
    loose = F.regexp_extract(c, r"(\{[\s\S]*?\})", 1)
    m = F.from_json(F.when(loose != "", F.translate(loose, "'", '"')), TREE)
    cases = ("base_case", "bull_case", "bear_case")
    by_braces = F.when(F.array_size(F.array_intersect(F.map_keys(m), _strings(cases))) == 3, m)
    tries = [_tree_in(c), fenced, by_key]
    return F.coalesce(*tries, *([] if strict else [by_braces]))


# Fields every trade needs.
TRADE_FIELDS = ("ticker", "direction", "entry_range", "profit_target", "stop_loss")


def playbook_quality(df: DataFrame, c: str) -> DataFrame:
    """Structure and content marks of a playbook document and their mean."""
    v = F.try_parse_json(c)
    get = lambda path, t: F.try_variant_get(F.col("_v"), path, t)
    d = df.withColumn("_v", v).withColumn("_t", get("$.trades", "array<variant>"))
    has = F.col("_t").isNotNull()
    first = [get(f"$.trades[0].{f}", "variant").isNotNull() for f in TRADE_FIELDS]
    required = first[0]
    for x in first[1:]:
        required = required & x
    tape = F.coalesce(F.trim(get("$.tomorrows_tape", "string")) != "", F.lit(False))
    marks = {"valid_json": F.col("_v").isNotNull(), "has_trades": has, "has_tape": tape, "trades_complete": F.coalesce(has & required, F.lit(False))}
    d = d.withColumns(marks).withColumn("trade_count", F.when(has, F.size("_t")).otherwise(0)).drop("_v", "_t")
    structure = sum((F.col(k).cast("int") for k in marks), F.lit(0)) / 4.0
    score = (structure + F.least(F.lit(1.0), F.col("trade_count") / 2.0)) / 2
    return d.withColumn("completeness_score", F.when(F.col("valid_json"), score).otherwise(0.0))


def opaque_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("-", *parts), 256)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.9, "very_high").when(c >= 0.7, "high").when(c >= 0.5, "medium").when(c >= 0.3, "low").otherwise("very_low")


def quality_band(score: Column) -> Column:
    return F.when(score >= 95, "excellent").when(score >= 80, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("unusable")


# Signal packs --------------------------------------------------------------------------------------------------

# Keyword groups of the market-condition rules.
MOOD_UP = ("bullish", "optimistic", "positive", "rally", "breakout")
MOOD_DOWN = ("bearish", "pessimistic", "negative", "decline", "breakdown")
MOOD_WILD = ("volatile", "uncertainty", "swing", "whipsaw", "erratic")


def market_condition(packs: DataFrame, up: Sequence[str] = MOOD_UP, down: Sequence[str] = MOOD_DOWN, wild: Sequence[str] = MOOD_WILD) -> DataFrame:
    """Condition of a signal pack: earnings, heavy option flow, then keyword counts."""
    mood, both = F.lower("sentiment_text"), F.lower(F.concat("internals_text", "sentiment_text"))
    n = lambda text, ws: sum((F.contains(text, F.lit(w)).cast("int") for w in ws), F.lit(0))
    p = packs.withColumns({"_up": n(mood, up), "_down": n(mood, down), "_wild": n(both, wild)})
    u, d = F.col("_up"), F.col("_down")
    return p.withColumn(
        "condition",
        F.when(F.col("n_earnings") > 3, "earnings").when(F.col("n_flow") > 20, "options_heavy").when(F.col("_wild") > 2, "volatile")
        .when((u > d) & (u > 1), "bullish").when((d > u) & (d > 1), "bearish").otherwise("sideways"),
    ).drop("_up", "_down", "_wild")


def budgeted_pick(signals: DataFrame, budget: int, keys: Sequence[str] = ("pack",), high: float = 0.5) -> DataFrame:
    """Signals of a pack in order of weight (halved without ``priority``), taken while their tokens fit the budget.

    The first signal above ``high`` that does not fit is cut to as many words as tokens are left, which ends its pack; others that
    do not fit are skipped. ``words`` counts the words of a signal; those without any are never taken, a null weight comes last. Columns: keys, ``used``,
    ``picked`` (signal, words kept), which `compress_words` turns into texts.

    What has not fitted once never fits again, so of the signals of t tokens only the first budget / t + 1 can matter; those beyond
    the budget count as one size. The list collected for a pack is therefore bounded by the budget, whatever the pack holds.
    """
    tokens = lambda w: F.floor(w * 1.3).cast("bigint")
    weight = F.coalesce(F.col("weight") * F.when(F.col("priority"), 1.0).otherwise(0.5), F.lit(0.0))
    s = signals.filter("words > 0").select(*keys, "signal", F.col("words").cast("bigint").alias("words"), (-weight).alias("_k"))
    s = s.withColumn("_t", F.least(tokens(F.col("words")), F.lit(budget + 1)))
    by_size = Window.partitionBy(*keys, "_t").orderBy("_k", "signal")
    s = s.withColumn("_n", F.row_number().over(by_size)).filter((F.col("_n") <= budget + 1) & (F.col("_n") <= F.floor(budget / F.col("_t")) + 1))
    g = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "signal", "words"))).alias("_s"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<signal:string,words:bigint>>").alias("picked"))

    def step(acc, x):
        left = budget - acc["used"]
        kept = F.when(tokens(x["words"]) <= left, x["words"]).when((-x["_k"] > high) & (left > 0), F.least(x["words"], left))
        return F.struct(
            (acc["used"] + F.coalesce(tokens(kept), F.lit(0).cast("bigint"))).alias("used"),
            F.when(kept.isNull(), acc["picked"]).otherwise(F.array_append(acc["picked"], F.struct(x["signal"].alias("signal"), kept.alias("words")))).alias("picked"),
        )

    return g.select(*keys, F.aggregate("_s", start, step).alias("r")).select(*keys, "r.*")


def best_template(templates: DataFrame, performance: DataFrame, default: float = 0.5) -> DataFrame:
    """Template with the highest success rate per market condition; unknown ones count the default, the first listed wins ties."""
    j = templates.join(performance, "template", "left").withColumn("rate", F.coalesce("success_rate", F.lit(default)))
    return j.groupBy("condition").agg(F.min_by(F.struct("template", "rate"), F.struct(-F.col("rate"), "listed")).alias("r")).select("condition", "r.*")


def experiment_winner(variants: DataFrame, doc: str) -> DataFrame:
    """Variant with the highest completeness per experiment; failed runs count 0, the earlier variant wins ties."""
    v = playbook_quality(variants, doc).withColumn("score", F.when(F.col("success"), F.col("completeness_score")).otherwise(0.0))
    return v.groupBy("experiment").agg(F.min_by(F.struct("variant", "score"), F.struct(-F.col("score"), "variant")).alias("r")).select("experiment", "r.*")


def clean_signal_pack(items: DataFrame, keys: Sequence[str], k: int = 5, limit: int = 400) -> DataFrame:
    """Distinct cleaned items of every list of a pack, first k kept in order."""
    d = items.withColumn("item", clean_text(F.col("item"), limit)).filter(F.col("item") != "")
    g = d.groupBy(*keys, "item").agg(F.min("position").alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_p")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_p")

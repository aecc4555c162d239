"""Row frames over long tables keyed by symbol and ordered by time.

A window partitioned by symbol alone puts a whole symbol into one task. ``segment`` cuts each symbol into
time blocks, counts the rows per block (a map-side combined aggregate), and from the running counts gives every
block its chunk of about ``rows`` rows plus the chunks that need it as context. A bounded frame
computed over (symbol, chunk) then sees exactly the rows it would see over the symbol. A task holds a chunk and its
context. A row is copied only into chunks that own rows and need it. Symbols shorter than ``rows`` stay whole and are not copied.

Blocks are months of dates and hours of timestamps. ``cut_dense`` counts them first and cuts those above ``rows`` at quantiles of
their times; every layout of a table it has passed uses the finer blocks, so no operator has to be told.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)
ORDER = ("ts",)
FINE = "_fine"
_INTERNAL = ("_block", "_off", "_cnt", "_n", "_own", "_chunk", "_chunks")


def month_block(c: str = "ts") -> Column:
    """Calendar month number: the default block for bars."""
    return F.year(c) * 12 + F.month(c)


def default_block(df: DataFrame, c: str = "ts") -> Column:
    """The finer blocks of `cut_dense` where the table has them, else hours of a timestamp and calendar months of a date."""
    if FINE in df.columns:
        return F.col(FINE)
    return F.floor(F.unix_seconds(c) / 3600) if dict(df.dtypes).get(c) == "timestamp" else month_block(c)


def cut_dense(
    df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, block: Column | None = None, rows: int = 65536, parts: int = 256
) -> DataFrame:
    """``df`` with finer blocks where a block holds more than ``rows`` rows, for tables of ticks; the rows stay as they are.

    One count finds the dense blocks, one sketch of their own rows gives ``parts`` equally full ranges of time, and a row joins its range.
    So a block of up to ``parts`` * ``rows`` rows ends in pieces below ``rows``, give or take the sketch's error of a ten-thousandth. Rows of
    one key at one time stay together, since nothing orders them.
    """
    c = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    at = F.unix_micros(c) if kind == "timestamp" else F.unix_date(c) if kind == "date" else c.cast("double")
    b = df.withColumn("_block", block if block is not None else default_block(df, order[0])).withColumn("_at", at)
    dense = b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col("_cnt") > rows).select(*keys, "_block")
    ends = [i / parts for i in range(1, parts)]
    cuts = _rejoin(b.select(*keys, "_block", "_at"), dense, keys).groupBy(*keys, "_block").agg(F.percentile_approx("_at", ends, 10000).alias("_cuts"))
    part = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda e: e < F.col("_at")))).otherwise(0)
    return _rejoin(b, cuts, keys, "left").withColumn(FINE, F.struct(F.col("_block").alias("block"), part.alias("part"))).drop("_block", "_at", "_cuts")


def _sizes(df: DataFrame, keys: Sequence[str], carry: dict[str, tuple[Callable, Column]]) -> DataFrame:
    """Per (keys, block): rows before the block, rows in it, rows of the key, and carried aggregates of earlier blocks."""
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [fn(c).alias(f"_t_{name}") for name, (fn, c) in carry.items()]
    w = Window.partitionBy(*keys).orderBy("_block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*keys)).alias("_n"),
    ]
    cols += [fn(F.col(f"_t_{name}")).over(before).alias(f"_carry_{name}") for name, (fn, _) in carry.items()]
    return df.groupBy(*keys, "_block").agg(*aggs).select(*keys, "_block", "_cnt", *cols)


def _rejoin(b: DataFrame, sizes: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with what is known of their block; null keys and null times are keys like any other."""
    on = [*keys, "_block"]
    right = sizes.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in sizes.columns if c not in on])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    return b.join(right, same, how).drop(*[f"_r_{k}" for k in on])


def segment(
    df: DataFrame,
    lookback: int = 0,
    lookahead: int = 0,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block: Column | None = None,
    rows: int = 65536,
) -> DataFrame:
    """Lay out ``df`` in chunks that carry ``lookback`` / ``lookahead`` rows of context.

    Adds ``_chunk`` (where the row is evaluated), ``_own`` (the chunk it belongs to), ``_off`` (rows before its
    block) and ``_n`` (rows of its key). Finish with :func:`own`.
    """
    b = df.withColumn("_block", block if block is not None else default_block(df, order[0]))
    by_start, by_end = Window.partitionBy(*keys).orderBy("_off"), Window.partitionBy(*keys).orderBy("_end")
    sizes = _sizes(b, keys, {}).withColumn("_end", F.col("_off") + F.col("_cnt") - 1).withColumn("_step", F.floor(F.col("_off") / rows))
    # chunks are numbered without gaps: each of them owns rows
    sizes = sizes.withColumn("_own", F.sum(F.coalesce((F.col("_step") != F.lag("_step").over(by_start)).cast("long"), F.lit(0))).over(by_start))
    first = last = F.col("_own")
    if lookback:  # the last chunk that starts within the context after this block
        sizes = sizes.withColumn("_reach", F.max("_own").over(by_start.rangeBetween(0, lookback - 1)))
        last = F.coalesce(F.lead("_reach").over(by_start), last)
    if lookahead:  # the first chunk that ends within the context before it
        sizes = sizes.withColumn("_from", F.min("_own").over(by_end.rangeBetween(1 - lookahead, 0)))
        first = F.coalesce(F.lag("_from").over(by_start), first)
    sizes = sizes.select(*keys, "_block", "_off", "_n", "_own", F.sequence(first, last).alias("_chunks"))
    return _rejoin(b, sizes, keys).withColumn("_chunk", F.explode("_chunks")).drop("_chunks")


def over(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    """Window over a segmented frame."""
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def last_n(n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return over(keys, order).rowsBetween(-(n - 1), 0)


def position(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> Column:
    """1-based position of the row in its whole key, from block offsets (no window over the key)."""
    return F.min("_off").over(Window.partitionBy(*keys, "_chunk")) + F.row_number().over(over(keys, order))


def own(df: DataFrame) -> DataFrame:
    """Drop context copies and the layout columns."""
    return df.filter(F.col("_chunk") == F.col("_own")).drop(*_INTERNAL)


def tail(
    df: DataFrame, k: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, block: Column | None = None
) -> DataFrame:
    """The last ``k`` rows of every key, laid out as one chunk, with ``_pos`` counted from the start of the key
    and ``_back`` counted from its end (last row = 1).

    Blocks that end before the last ``k`` rows are dropped by the block counts before any sort.
    """
    b = df.withColumn("_block", block if block is not None else default_block(df, order[0]))
    sizes = _sizes(b, keys, {}).filter(F.col("_off") + F.col("_cnt") > F.col("_n") - k)
    sizes = sizes.select(*keys, "_block", "_off", "_n")
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        _rejoin(b, sizes, keys)
        .withColumn("_pos", F.col("_off") + F.row_number().over(w))
        .filter(F.col("_pos") > F.col("_n") - k)
        .withColumn("_back", F.col("_n") - F.col("_pos") + 1)
        .withColumn("_chunk", F.lit(0))
        .withColumn("_own", F.lit(0))
    )


def head(df: DataFrame, k: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, block: Column | None = None) -> DataFrame:
    """The first ``k`` rows of every key with ``_pos``; later blocks are dropped by the block counts."""
    b = df.withColumn("_block", block if block is not None else default_block(df, order[0]))
    sizes = _sizes(b, keys, {}).filter(F.col("_off") < k).select(*keys, "_block", "_off", "_n")
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        _rejoin(b, sizes, keys)
        .withColumn("_pos", F.col("_off") + F.row_number().over(w))
        .filter(F.col("_pos") <= k)
    )


def carried(
    df: DataFrame,
    carry: dict[str, tuple[Callable, Column]],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block: Column | None = None,
) -> DataFrame:
    """Join each block with the aggregates of all earlier blocks of its key (``_carry_<name>``, null in the first).

    A running total is then ``combine(_carry_x, agg(x) over in_block())``: exact, and no task holds a whole key.
    """
    b = df.withColumn("_block", block if block is not None else default_block(df, order[0]))
    sizes = _sizes(b, keys, carry)
    return _rejoin(b, sizes.select(*keys, "_block", "_off", "_n", *[f"_carry_{c}" for c in carry]), keys)


def in_block(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> WindowSpec:
    """From the start of the block to the current row."""
    return Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(name: str, c: Column, **kw) -> Column:
    return F.coalesce(F.col(f"_carry_{name}"), F.lit(0.0)) + F.coalesce(F.sum(c).over(in_block(**kw)), F.lit(0.0))


def running_max(name: str, c: Column, **kw) -> Column:
    return F.greatest(F.col(f"_carry_{name}"), F.max(c).over(in_block(**kw)))


def drop_layout(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c.startswith("_carry_")]
    return df.drop(*_INTERNAL, "_pos", "_back", *extra)


def guarded(agg: Callable[[Column], Column], c: Column, n: int, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``n`` non-null values are present (pandas ``rolling(n)``)."""
    w = w if w is not None else last_n(n)
    return F.when(F.count(c).over(w) >= n, agg(c).over(w))


def mean_n(c: Column, n: int) -> Column:
    return guarded(F.avg, c, n)


def std_n(c: Column, n: int) -> Column:
    return guarded(F.stddev_samp, c, n)


def max_n(c: Column, n: int) -> Column:
    return guarded(F.max, c, n)


def min_n(c: Column, n: int) -> Column:
    return guarded(F.min, c, n)


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(c, k).over(over())


def div(a, b) -> Column:
    """a / b, null when b is zero or null."""
    return F.try_divide(a, b)


def pct_change(c: Column, k: int = 1) -> Column:
    return div(c, lag(c, k)) - 1


def keep(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a computed score where it stands.

    A plain filter is pushed below the projections it depends on, with the whole score expression copied into it.
    The partition id is not deterministic for the optimizer, so the filter stays above its columns and reads them.
    """
    return df.withColumn("_stage", F.spark_partition_id()).filter(cond & (F.col("_stage") >= 0)).drop("_stage")


#: Keys of at least so many rows are bracketed at so much of their ranks on either side: 8 ranks or more, where the sketch of a key is off by 2 at most.
WIDTHS = ((800, 0.01), (400, 0.02), (160, 0.05))


def _bracket(q: float, accuracy: int) -> tuple[list[float], Callable[[Column, Column], tuple[Column, Column]]]:
    """The ranks to sketch for a quantile, and its bracket from (the sketched values by rank, the rows of the key); null for a key that is kept whole."""
    tiers = [(2 * accuracy + 1, 3.0 / accuracy), *(t for t in WIDTHS if t[0] <= 2 * accuracy)]
    rank = lambda p: round(min(1.0, max(0.0, p)), 12)

    def ends(at: Callable[[float], Column], n: Column) -> tuple[Column, Column]:
        pick = lambda side: F.coalesce(*[F.when(n >= rows, at(rank(q + side * eps))) for rows, eps in tiers])
        return pick(-1), pick(1)

    return sorted({rank(q + d * eps) for _, eps in tiers for d in (-1, 1)}), ends


def quantile_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str], qs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """(keys, column_name, _slot, _v, _c): the counted rows of `exact_quantiles`, values only inside the brackets."""
    on, brackets = [*keys, "column_name"], [_bracket(q, accuracy) for q in qs]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_v")) for c in values])
    vals = df.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.*").filter(F.col("_v").isNotNull())
    ends = sorted({p for ranks, _ in brackets for p in ranks})
    edges = vals.groupBy(*on).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"), F.count(F.lit(1)).alias("_n"))
    v = F.col("_v")
    pairs = [find(lambda p: F.element_at("_e", ends.index(p) + 1), F.col("_n")) for _, find in brackets]
    edges = edges.select(*on, F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in pairs]).alias("_b"))
    inside = F.exists("_b", lambda b: b["lo"].isNull() | v.between(b["lo"], b["hi"]))
    slot = F.aggregate("_b", F.lit(0), lambda n, b: n + F.when(v > b["lo"], 1).otherwise(0) + F.when(v > b["hi"], 1).otherwise(0))
    return vals.join(edges, on).select(*on, slot.alias("_slot"), F.when(inside, v).alias("_v")).groupBy(*on, "_slot", "_v").agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], qs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """(keys, column_name, quantiles): exact linear-interpolated quantiles of several columns per key, in two scans.

    The first scan makes a mergeable sketch per key and column, whose ranks are off by at most n / ``accuracy``; it brackets every
    wanted rank by two values. The second counts what lies outside the brackets and keeps values only inside them, about
    8 n / ``accuracy`` rows a quantile before equal ones are counted together, whatever the range or scale of the values. A key of up to
    2 ``accuracy`` rows has wider brackets (`WIDTHS`), below 160 rows it is kept whole. A rank that its bracket does not hold is an error, never a wrong value. Nulls do not count, NaN is the largest value; a column without values gives no row.
    """
    on, v = [*keys, "column_name"], F.col("_v")
    counts = quantile_counts(df, keys, values, qs, accuracy)
    w = Window.partitionBy(*on)
    upto = F.sum("_c").over(w.orderBy("_slot", "_v").rowsBetween(Window.unboundedPreceding, 0))  # within a slot what is outside comes first
    ranked = counts.select(*on, "_v", "_c", upto.alias("_to"), (F.sum("_c").over(w) - 1).alias("_last"))

    def held(rank: Column) -> Column:
        here = (F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)
        return F.max(F.when(here, F.coalesce(v, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))))

    aggs = []
    for i, q in enumerate(qs):
        h = F.lit(q) * F.col("_last")
        aggs += [held(F.floor(h)).alias(f"_lo{i}"), held(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
    out = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(qs))]
    return ranked.groupBy(*on).agg(*aggs).select(*on, F.array(*out).alias("quantiles"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """(keys, out): one exact quantile of a column per key, see `exact_quantiles`."""
    return exact_quantiles(df, keys, [value], [q]).select(*keys, F.col("quantiles")[0].alias(out))


def tail_counts(df: DataFrame, keys: Sequence[str], value: str, q: float, cut: Column, carry: Sequence[Column] = (), accuracy: int = 10000) -> DataFrame:
    """The counted rows of `tails`: (keys, carry, _n, _cut, _slot, _in, _c, _s, _cb, _sb), values ``_in`` only inside the bracket."""
    on, v, (ranks, find) = list(keys), F.col("_v"), _bracket(q, accuracy)
    vals = df.filter(F.col(value).isNotNull())
    edges = vals.groupBy(*on).agg(
        F.percentile_approx(value, ranks, accuracy).alias("_e"), F.count(F.lit(1)).alias("_n"), cut.cast("double").alias("_cut"), *carry)
    known = [c for c in edges.columns if c not in {*on, "_e"}]
    lo, hi = find(lambda p: F.element_at("_e", ranks.index(p) + 1), F.col("_n"))
    edges = edges.select(*on, *known, lo.cast("double").alias("_lo_e"), hi.cast("double").alias("_hi_e"))
    d = vals.select(*on, F.col(value).cast("double").alias("_v")).join(edges, on)
    slot = F.when(v < F.col("_lo_e"), 0).when(v > F.col("_hi_e"), 2).otherwise(1)
    below = v <= F.col("_cut")
    return d.select(*on, *known, slot.alias("_slot"), F.when(slot == 1, v).alias("_in"), "_v", below.alias("_below")).groupBy(*on, *known, "_slot", "_in").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), F.count_if("_below").alias("_cb"), F.sum(F.when(F.col("_below"), v)).alias("_sb"))


def tails(df: DataFrame, keys: Sequence[str], value: str, q: float, cut: Column, carry: Sequence[Column] = (), accuracy: int = 10000) -> DataFrame:
    """Counts and sums of the values at or below an exact quantile and at or below ``cut`` per key, in two scans.

    The first scan makes the bracket of the quantile (see `exact_quantiles`), the aggregate ``cut`` and the named aggregates ``carry``; the
    second counts and adds up what lies outside the bracket and keeps values only inside it. Gives the keys, ``carry``, ``_n``,
    ``_cut``, ``_q`` and the counts ``_n_cut``, ``_n_q`` and sums ``_s_cut``, ``_s_q``.
    """
    on, counts = list(keys), tail_counts(df, keys, value, q, cut, carry, accuracy)
    known = [c for c in counts.columns if c not in {*on, "_slot", "_in", "_c", "_s", "_cb", "_sb"}]
    w = Window.partitionBy(*on)
    upto = F.sum("_c").over(w.orderBy("_slot", "_in").rowsBetween(Window.unboundedPreceding, 0))
    h = F.lit(q) * (F.col("_n") - 1)

    def held(rank: Column) -> Column:
        here = (F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)
        return F.max(F.when(here, F.coalesce("_in", F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))).over(w)

    r = counts.withColumn("_to", upto).withColumns({"_lo": held(F.floor(h)), "_hi": held(F.ceil(h))})
    r = r.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (h - F.floor(h)))
    upto_q = F.when(F.col("_in").isNull(), F.col("_slot") == 0).otherwise(F.col("_in") <= F.col("_q"))
    return r.groupBy(*on, *known).agg(
        F.max("_q").alias("_q"), F.sum("_cb").alias("_n_cut"), F.sum("_sb").alias("_s_cut"),
        F.sum(F.when(upto_q, F.col("_c"))).alias("_n_q"), F.sum(F.when(upto_q, F.col("_s"))).alias("_s_q"))


def value_blocks(df: DataFrame, keys: Sequence[str], value: str, parts: int = 256) -> DataFrame:
    """Rows with ``_part``, about equally full ranges of ``value`` per key, whatever its scale: edges from one mergeable sketch."""
    ends = [i / parts for i in range(1, parts)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), ends, 10000).alias("_e"))
    part = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return df.join(edges, list(keys)).withColumn("_part", part).drop("_e")

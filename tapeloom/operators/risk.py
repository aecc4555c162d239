"""Return alignment, co-movement and portfolio risk."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div
from tapeloom.session import scratch

YEAR = math.sqrt(252.0)
Z95 = 1.6448536269514722
#: A tile has about so many symbols and cells at most; so many of its symbols and times are multiplied at once, more symbols where times are few.
NAMES, CELLS = 2048, 1 << 20
STRIP, SPAN = 512, 2048
#: Series of more cells than this on average are cut by time, in tiles of so many symbols and blocks of so many times.
LONG, TILE, TIMES = 1 << 15, 1024, 256
#: Units that a product of few tiles is cut into by time.
UNITS = 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: What `_pairs` makes of the sums of two symbols.
FORMS = {
    "sums": "a string, b string, " + ", ".join(f"{c} double" for c in SUMS),
    "correlation": "n bigint, correlation double",
    "covariance": "n bigint, covariance double",
    "population": "n bigint, c double",
    "totals": "trace double, p double, n double, delta_ double",
    "blocks": "meet int, ta int, tb int, left array<string>, right array<string>, kept binary, covariance binary",
}


class Blocks(NamedTuple):
    """A matrix of pairs: strips of ``tiles`` tiles of symbols with every pair in one of them, or the long form where there are no tiles."""

    rows: DataFrame
    tiles: int


def _unit_work(form: str, least: int) -> tuple[Callable, Callable, Callable]:
    """The tasks of `_pairs`, defined inside a function so that they travel whole and executors need no copy of this module."""
    strip, span, sums, many, pairs_of = STRIP, SPAN, SUMS, 1 << 16, itertools.product

    def ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
        d = pa.concat_arrays([pa.array([], column.type), *column.chunks]).dictionary_encode()
        known = d.dictionary.to_pylist()
        order = sorted(range(len(known)), key=known.__getitem__)
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(len(known))
        return place[d.indices.to_numpy()], [known[i] for i in order]

    def packed(cells: pa.Table) -> pa.Table:
        """All cells of one tile as one row: names and times in order, cells by time with the counts of the times, values as distances from the mean of their name."""
        (of, names), (at, times) = ranks(cells["symbol"]), ranks(cells["ts"])
        order = np.lexsort((of, at))
        of, at, v = of[order], at[order], cells["v"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])])
        of, at, v = of[first], at[first], np.add.reduceat(v, first) / np.diff(np.r_[first, len(v)])
        v = v - (np.bincount(of, v) / np.bincount(of))[of]
        row = {"tile": cells["tile"][0].as_py(), "names": names, "times": [str(t) for t in times]}
        row |= {"held": np.bincount(at).astype("<u4").tobytes(), "of": of.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes(), "v": v.astype("<f8").tobytes()}
        kinds = [("tile", pa.int32()), ("names", pa.list_(pa.string())), ("times", pa.list_(pa.string())), ("held", pa.binary()), ("of", pa.binary()), ("v", pa.binary())]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    def side(batch: pa.RecordBatch, i: int, s: str) -> dict:
        r = {c: batch.column(f"{s}_{c}")[i] for c in ("tile", "names", "times", "held", "of", "v")}
        held, of, v = (r.pop(c).as_buffer() for c in ("held", "of", "v"))
        cells = {"held": np.frombuffer(held, "<u4"), "of": np.frombuffer(of, "<u2" if 4 * of.size == v.size else "<u4"), "v": np.frombuffer(v, "<f8")}
        return {c: x.as_py() for c, x in r.items()} | cells

    def common(x: dict, y: dict) -> int:
        """Leaves both sides the cells of the times they share, numbered from 0 in order; their number."""
        known = {*y["times"]}
        shared = {t: k for k, t in enumerate(t for t in x["times"] if t in known)}
        for r in (x, y):
            at = np.repeat(np.array([shared.get(t, -1) for t in r["times"]], "i4"), r["held"])
            here = at >= 0
            if here.all():
                r["at"] = at
            else:
                r["at"], r["of"], r["v"] = at[here], r["of"][here], r["v"][here]
        return len(shared)

    def dense(r: dict, t: int, until: int, lo: int, hi: int) -> tuple:
        """Values and marks of a span of times and some of the names; no marks where all cells are there."""
        i, j = np.searchsorted(r["at"], (t, until))
        at, of, v = r["at"][i:j] - t, r["of"][i:j], r["v"][i:j]
        if lo > 0 or hi < len(r["names"]):
            here = (of >= lo) & (of < hi)
            at, of, v = at[here], of[here] - lo, v[here]
        x = np.zeros((until - t, hi - lo))
        x[at, of] = v
        if len(v) == x.size:
            return x, None, None
        m = np.zeros(x.shape, "f4")
        m[at, of] = 1
        return x, m, m.astype("f8")

    def product(x: np.ndarray | None, y: np.ndarray | None) -> np.ndarray:
        """Sums over the times of every pair of columns, where None is all ones."""
        if x is None:
            return y.sum(0, dtype="f8")[None, :]
        return x.sum(0, dtype="f8")[:, None] if y is None else x.T @ y

    def summed(x: dict, y: dict, times: int, lo: int, hi: int, first: int, last: int) -> list[np.ndarray]:
        """The six sums of the names lo to hi of x and first to last of y, of shapes that fit together."""
        s = [np.zeros((1, 1)) for _ in sums]
        cuts = np.linspace(0, times, -(-times // span) + 1).astype(int).tolist()
        for t, until in zip(cuts, cuts[1:]):
            (xa, fa, ma), (xb, fb, mb) = dense(x, t, until, lo, hi), dense(y, t, until, first, last)
            n = np.full((1, 1), float(until - t)) if fa is None and fb is None else product(fa, fb)
            for i, new in enumerate((n, product(xa, mb), product(ma, xb), product(xa * xa, mb), product(ma, xb * xb), xa.T @ xb)):
                s[i] = s[i] + new
        return s

    def measured(n, sx, sy, sxx, syy, sxy) -> tuple[np.ndarray, dict]:
        """Which pairs count, and the columns of the form."""
        if form == "sums":
            return n > 0, dict(zip(sums, (n, sx, sy, sxx, syy, sxy)))
        with np.errstate(all="ignore"):
            co = sxy - sx * sy / n
            if form == "correlation":
                vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                ok = (n >= 2) & (vx > sxx * 1e-12) & (vy > syy * 1e-12)
                return n > 0, {"n": n, "correlation": np.ma.array(co / np.sqrt(vx) / np.sqrt(vy), mask=~np.broadcast_to(ok, co.shape))}
            return n >= max(1, least), {"n": n, "c": co / n} if form in ("population", "totals") else {"n": n, "covariance": co / (n - 1)}

    def column(name: str, v: np.ndarray) -> pa.Array:
        if name == "n" and form != "sums":
            return pa.array(v.astype("i8"))
        return pa.array(v.data, mask=v.mask) if isinstance(v, np.ma.MaskedArray) else pa.array(v)

    def long(left: list, right: list, s: list, meet: int | None) -> Iterator[pa.RecordBatch]:
        """Every pair, its names in order; of one tile, where ``right`` starts ``meet`` names after ``left``, each pair once. A row a pair for sums, else two rows for a name: its pairs with the names before and after it."""
        p, q = len(left), len(right)
        names, after = pa.array([*left, *right], pa.string()), np.searchsorted(np.array(right, object), np.array(left, object))
        rows = max(1, many // q)
        for at in range(0, p, rows):
            part = [x[at: at + rows] if x.shape[0] > 1 else x for x in s]
            i = np.arange(at, min(p, at + rows), dtype="i4")[:, None]
            j = np.arange(q, dtype="i4")[None, :]
            swap = j < after[i]
            kept, cols = measured(*part)
            if form == "sums":
                cols |= {c: np.where(swap, cols[d], cols[c]) for c, d in (("sx", "sy"), ("sy", "sx"), ("sxx", "syy"), ("syy", "sxx"))}
            kept = kept & (i < j + meet if form == "correlation" else i <= j + meet) if meet is not None else np.broadcast_to(kept, swap.shape)
            every = bool(kept.all())
            flat = lambda x: np.broadcast_to(x, swap.shape).ravel() if every else np.broadcast_to(x, swap.shape)[kept]  # noqa: B023, E731
            out = {c: column(c, np.ma.array(flat(v.data), mask=flat(v.mask)) if isinstance(v, np.ma.MaskedArray) else flat(v)) for c, v in cols.items()}
            if form == "sums":
                one, two = flat(np.where(swap, j + p, i)), flat(np.where(swap, i, j + p))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(one)), names.take(pa.array(two)), *out.values()], names=["a", "b", *out])
            else:
                ends = np.cumsum(np.r_[0, np.stack([(kept & swap).sum(1), (kept & ~swap).sum(1)], 1).ravel()]).astype("i4")
                lists = {c: pa.ListArray.from_arrays(pa.array(ends), v) for c, v in {"others": names.take(pa.array(flat(j + p))), **out}.items()}
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(i.ravel(), 2))), pa.array(np.tile([True, False], len(i))), *lists.values()], names=["one", "last", *lists])

    def told(n: np.ndarray, c: np.ndarray, diagonal: np.ndarray) -> pa.RecordBatch:
        square = c * c
        one = {"trace": float(c[diagonal].sum()), "p": float(diagonal.sum()), "n": float(n.max()), "delta_": float(2 * square.sum() - square[diagonal].sum())}
        return pa.RecordBatch.from_pylist([one])

    def totals(left: list, right: list, s: list, meet: int | None) -> Iterator[pa.RecordBatch]:
        kept, cols = measured(*s)
        shape = (len(left), len(right))
        kept = np.broadcast_to(kept, shape) if meet is None else np.triu(np.broadcast_to(kept, shape), -meet)
        if kept.any():
            yield told(np.broadcast_to(cols["n"], shape)[kept], cols["c"][kept], np.eye(*shape, -meet, dtype=bool)[kept] if meet is not None else np.zeros(int(kept.sum()), bool))

    def blocks(left: list, right: list, s: list, meet: int | None) -> tuple[bytes, bytes]:
        kept, cols = measured(*s)
        kept = np.broadcast_to(kept, (len(left), len(right)))
        kept = kept if meet is None else np.triu(kept, -meet)
        return b"" if kept.all() else kept.tobytes(), cols["covariance"].astype("<f8").tobytes()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two tiles a row, met both ways round: each way takes half of the names of the lesser tile; a tile and itself take each pair once."""
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = side(batch, i, "l"), side(batch, i, "r")
                same, half = x["tile"] == y["tile"], len(x["names"] if x["tile"] <= y["tile"] else y["names"]) // 2
                if x["tile"] > y["tile"]:
                    x, y, mine = y, x, (half, len(y["names"]))
                else:
                    mine = (0, len(x["names"]) if same else half)
                times = common(x, y)
                wide = max(strip, many * 16 // max(1, times))
                for lo, first in pairs_of(range(*mine, strip), range(0, len(y["names"]), wide)) if times else ():
                    hi, last = min(mine[1], lo + strip), min(len(y["names"]), first + wide)
                    first = max(first, lo) if same else first
                    if first < last:
                        s, left, right, meet = summed(x, y, times, lo, hi, first, last), x["names"][lo:hi], y["names"][first:last], first - lo if same else None
                        if form == "blocks":
                            kept, c = blocks(left, right, s, meet)
                            row = {"meet": meet, "ta": x["tile"], "tb": y["tile"], "left": left, "right": right, "kept": kept, "covariance": c}
                            yield pa.RecordBatch.from_pylist([row], pa.schema([
                                ("meet", pa.int32()), ("ta", pa.int32()), ("tb", pa.int32()), *[(k, pa.list_(pa.string())) for k in ("left", "right")],
                                ("kept", pa.binary()), ("covariance", pa.binary())]))
                        else:
                            yield from (totals if form == "totals" else long)(left, right, s, meet)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The form from rows of a pair and its sums."""
        for b in batches:
            kept, cols = measured(*[b.column(c).to_numpy() for c in sums])
            kept = kept & ~(pc.equal(b.column("a"), b.column("b")).to_numpy(zero_copy_only=False)) if form == "correlation" else kept
            here = pa.array(kept)
            one, two = b.column("a").filter(here), b.column("b").filter(here)
            if form == "totals":
                if kept.any():
                    yield told(cols["n"][kept], cols["c"][kept], pc.equal(one, two).to_numpy(zero_copy_only=False))
            else:
                yield pa.RecordBatch.from_arrays([one, two, *[column(c, v[kept]) for c, v in cols.items()]], names=["a", "b", *cols])

    return packed, units, finished


def _tile_work() -> tuple[Callable, Callable]:
    """The two tasks of `_long_sums`, defined inside a function so that they travel whole and executors need no copy of this module."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The cells of one tile and block of times as one row."""
        (at, times), (of, names) = pd.factorize(pdf["ts"]), pd.factorize(pdf["symbol"])
        cells = {"at": at.astype("<u4").tobytes(), "of": of.astype("<u4").tobytes(), "v": pdf["v"].to_numpy("<f8").tobytes()}
        return pd.DataFrame([{"tile": pdf["tile"].iat[0], "block": pdf["block"].iat[0], "names": list(names), "times": list(times), **cells}])

    class Products:
        """Running sums of the pairs of two tiles, a block of times at a time."""

        def __init__(self, ta: int, tb: int):
            self.tiles, self.names, self.sums = (ta, tb), ({}, {}), np.zeros((len(SUMS), 0, 0))

        def add(self, rows: list[dict]) -> None:
            if {r["tile"] for r in rows} != set(self.tiles):
                return  # one of the tiles has nothing at these times
            sides = [next(r for r in rows if r["tile"] == t) for t in self.tiles]
            place: dict[str, int] = {}
            x = []
            for r, names in zip(sides, self.names):
                row, col = np.array([place.setdefault(t, len(place)) for t in r["times"]]), np.array([names.setdefault(c, len(names)) for c in r["names"]])
                x.append((row[np.frombuffer(r["at"], "<u4")], col[np.frombuffer(r["of"], "<u4")], np.frombuffer(r["v"], "<f8")))
            (xa, ma), (xb, mb) = (self.dense(len(place), len(names), *cells) for names, cells in zip(self.names, x))
            grown = np.zeros((len(SUMS), xa.shape[1], xb.shape[1])) if self.sums.shape[1:] != (xa.shape[1], xb.shape[1]) else None
            if grown is not None:
                grown[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
                self.sums = grown
            for i, (left, right) in enumerate(((ma, mb), (xa, mb), (ma, xb), (xa * xa, mb), (ma, xb * xb), (xa, xb))):
                self.sums[i] += left.T @ right

        @staticmethod
        def dense(times: int, names: int, at: np.ndarray, of: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, m = np.zeros((times, names)), np.zeros((times, names))
            x[at, of], m[at, of] = v, 1.0
            return x, m

        def pairs(self) -> Iterator[pa.RecordBatch]:
            """Every pair with common times, names in order; a pair inside one tile once."""
            na, nb = (pa.array(list(names), pa.string()) for names in self.names)
            left, right = (np.array(list(names), object) for names in self.names)
            for at in range(0, len(left), 32):
                n, sx, sy, sxx, syy, sxy = self.sums[:, at: at + 32]
                swap = (left[at: at + 32, None] > right[None, :]).astype(bool)
                i, j = np.nonzero((n > 0) & ~swap if self.tiles[0] == self.tiles[1] else n > 0)
                w = swap[i, j]
                one, two = na.take(pa.array(i + at)), nb.take(pa.array(j))
                either = lambda p, q: np.where(w, q[i, j], p[i, j])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pc.if_else(pa.array(w), two, one), pc.if_else(pa.array(w), one, two), pa.array(n[i, j]), pa.array(either(sx, sy)), pa.array(either(sy, sx)),
                    pa.array(either(sxx, syy)), pa.array(either(syy, sxx)), pa.array(sxy[i, j]),
                ], names=["a", "b", *SUMS])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of `packed` in the order of unit, block and tile to the pairs of every unit; holds one unit and one block."""
        unit, block, held, now = None, None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                here = (r["ta"], r["tb"], r["part"])
                if held and (here != unit or r["block"] != block):
                    now.add(held)
                    held = []
                if here != unit:
                    if now:
                        yield from now.pairs()
                    unit, now = here, Products(r["ta"], r["tb"])
                block = r["block"]
                held.append(r)
        if now:
            now.add(held)
            yield from now.pairs()

    return packed, products


def pairwise_moments(series: DataFrame, value: str, tiles: int | None = None, blocks: int | None = None) -> DataFrame:
    """Counts, sums and products of every pair of symbols over their common times, in long form (a <= b); see `_pairs`."""
    return _pairs(series, value, "sums", tiles, blocks).rows


def _landed(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read from there, for what reads them several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unrolled(rows: DataFrame) -> DataFrame:
    """A row a pair from the rows of a name and its pairs with others, where it is the last of the two or the first."""
    one, other, last, values = F.col("one"), F.col("_other"), F.col("last"), rows.columns[3:]
    each = rows.select("one", "last", F.posexplode("others").alias("_i", "_other"), *values)
    return each.select(
        F.when(last, other).otherwise(one).alias("a"), F.when(last, one).otherwise(other).alias("b"), *[F.get(c, F.col("_i")).alias(c) for c in values])


def _pairs(series: DataFrame, value: str, form: str, tiles: int | None = None, blocks: int | None = None, least: int = 1) -> Blocks:
    """One of `FORMS` over every pair of symbols and their common times, each pair once.

    Two passes: the mean of every symbol, then blocked matrix products of the distances from it, so that small moves of
    large values keep their digits. Symbols are hashed into ``tiles`` of up to about ``NAMES`` symbols and ``CELLS`` cells. A tile is one packed row in a
    partition of its own, and every two partitions meet in a task that reads both: a cell is written once, however many tiles there are, and a
    task holds two tiles and the sums of ``STRIP`` symbols and one tile. Repeated rows of a symbol and time count as their mean; null values,
    symbols and times do not count. Series of more than ``LONG`` cells on average, or where ``blocks`` are given for few tiles, go through `_long_sums`.
    """
    v, kind = F.col(value).cast("double"), dict(series.dtypes)["ts"]
    at = F.unix_micros("ts") if kind == "timestamp" else F.unix_date("ts") if kind == "date" else F.col("ts") if kind in ("int", "bigint") else F.col("ts").cast("string")
    cells = series.filter(v.isNotNull() & F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    cells = _landed(cells.select(F.col("symbol").cast("string").alias("symbol"), at.alias("ts"), v.alias("v")), "cells")
    n = cells.agg(F.approx_count_distinct("symbol").alias("s"), F.approx_count_distinct("ts").alias("t"), F.count(F.lit(1)).alias("c")).first()
    dealt = tiles or max(1, math.ceil(n["c"] / CELLS), math.ceil(n["s"] / NAMES), min(16, math.ceil(n["s"] / 256)))
    if n["c"] > LONG * n["s"] or (blocks and dealt * (dealt + 1) // 2 < UNITS):
        sums = _long_sums(cells, tiles or max(1, math.ceil(n["s"] / TILE)), blocks or max(1, math.ceil(n["t"] / TIMES)))
        if form == "sums":
            return Blocks(sums, 0)
        form = "covariance" if form == "blocks" else form
        return Blocks(sums.mapInArrow(_unit_work(form, least)[2], ("" if form == "totals" else "a string, b string, ") + FORMS[form]), 0)
    packed, units, _ = _unit_work(form, least)
    tile = F.pmod(F.hash("symbol"), F.lit(dealt)).alias("tile")
    kept = cells.select(tile, "symbol", "ts", "v").groupBy("tile").applyInArrow(
        packed, "tile int, names array<string>, times array<string>, held binary, of binary, v binary").repartitionById(dealt, F.col("tile"))
    left, right = (kept.select(*[F.col(c).alias(f"{s}_{c}") for c in kept.columns]) for s in "lr")
    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    if form in ("sums", "totals", "blocks"):
        return Blocks(met.mapInArrow(units, FORMS[form]), dealt)
    lists = ", ".join("{} array<{}>".format(*c.split()) for c in FORMS[form].split(", "))
    return Blocks(_unrolled(met.mapInArrow(units, f"one string, last boolean, others array<string>, {lists}")), dealt)


def _long_sums(cells: DataFrame, tiles: int, blocks: int) -> DataFrame:
    """The sums of every pair of symbols whose series are long, in long form.

    Times are hashed into ``blocks`` of about ``TIMES`` whatever their calendar density. The cells of a tile and block travel as one packed row,
    once for each tile it meets; a unit of two tiles adds up its blocks one after the other and emits each pair once, so nothing a pair long is
    shuffled. Only where there are fewer units than ``UNITS``, they are cut by time as well and their sums added per pair.
    """
    splits = min(blocks, math.ceil(UNITS / (tiles * (tiles + 1) // 2)))
    rows = cells.groupBy("symbol", "ts").agg(F.avg("v").alias("v"))
    means = rows.groupBy("symbol").agg(F.avg("v").alias("_m"))
    d = rows.join(means, "symbol").select(
        "symbol", F.col("ts").cast("string").alias("ts"), (F.col("v") - F.col("_m")).alias("v"), F.pmod(F.hash("symbol"), F.lit(tiles)).alias("tile"),
        F.pmod(F.hash("ts"), F.lit(blocks)).alias("block"))
    pack, products = _tile_work()
    packed = d.groupBy("tile", "block").applyInPandas(pack, "tile int, block int, names array<string>, times array<string>, at binary, of binary, v binary")
    unit = ["ta", "tb", "part"]
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.pmod("block", F.lit(splits)).alias("part"),
        "block", "tile", "names", "times", "at", "of", "v")
    parts = met.repartition(*unit).sortWithinPartitions(*unit, "block", "tile").mapInArrow(products, FORMS["sums"])
    if splits == 1:
        return parts
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlations(
    series: DataFrame, value: str = "close", tiles: int | None = None, least: float | None = None, most: int | None = None
) -> DataFrame:
    """Correlation of every pair of symbols over their common times, pairwise complete, a < b.

    ``least`` keeps pairs of at least that absolute correlation. ``most`` keeps a pair that is among the ``most`` strongest of one
    of its symbols (ties to the smaller partner); pairs without a correlation are dropped by either.
    """
    pairs = _pairs(series, value, "correlation", tiles).rows
    if least is not None:
        pairs = pairs.filter(F.abs("correlation") >= least)
    if most is None:
        return pairs
    ends = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o"))))
    w = Window.partitionBy("e.s").orderBy(F.abs("correlation").desc(), "e.o")
    top = pairs.filter(F.col("correlation").isNotNull()).withColumn("e", ends).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return top.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("correlation").alias("correlation"))


def simple_returns(series: DataFrame, block: Column | None = None, c: str = "close") -> DataFrame:
    s = fr.segment(series, 1, block=block)
    return fr.own(s.withColumn("r", fr.pct_change(F.col(c)))).filter(F.col("r").isNotNull()).select("symbol", "ts", "r")


def complete_rows(returns: DataFrame) -> DataFrame:
    """Rows of the dates on which every symbol has a return."""
    n = returns.groupBy("symbol").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n")).scalar()
    full = returns.groupBy("ts").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == n).select("ts")
    return returns.join(full, "ts", "left_semi").select("symbol", "ts", "r")


def covariance(returns: DataFrame, least: int = 30, tiles: int | None = None, blocks: bool = False) -> DataFrame | Blocks:
    """Sample covariance over complete rows in long form (a <= b); empty below ``least`` rows. With ``blocks`` as matrices, for what multiplies it."""
    m = _pairs(complete_rows(_landed(returns, "returns")), "r", "blocks" if blocks else "covariance", tiles, least=least)
    return m if blocks else m.rows


def shrunk_covariance(returns: DataFrame, least: int = 30, tiles: int | None = None) -> DataFrame:
    """Covariance shrunk toward a scaled identity (Ledoit and Wolf 2004), long form (a <= b)."""
    full = _landed(complete_rows(_landed(returns, "returns")), "complete")
    m, tot = (_pairs(full, "r", form, tiles, least=least).rows for form in ("population", "totals"))
    diag = F.col("a") == F.col("b")
    tot = tot.agg(F.sum("trace").alias("trace"), F.sum("p").alias("p"), F.max("n").alias("n"), F.sum("delta_").alias("delta_"))
    means = full.groupBy("symbol").agg(F.avg("r").alias("_m"))
    x2 = (F.col("r") - F.col("_m")) ** 2
    beta_ = full.join(means, "symbol").groupBy("ts").agg(F.sum(x2).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("beta_"))
    mu = F.col("trace") / F.col("p")
    d = (F.col("delta_") - 2 * mu * F.col("trace") + F.col("p") * mu * mu) / F.col("p")
    raw = (beta_.scalar() / F.col("n") - F.col("delta_")) / (F.col("p") * F.col("n"))
    s = tot.select(mu.alias("mu"), F.coalesce(div(F.least(raw, d), d), F.lit(0.0)).alias("shrinkage"))
    both = s.select(F.struct("shrinkage", "mu")).scalar()  # one pass over the pairs for both
    sh, mu_ = both["shrinkage"], both["mu"]
    return m.select("a", "b", ((1 - sh) * F.col("c") + F.when(diag, sh * mu_).otherwise(0.0)).alias("covariance"), sh.alias("shrinkage"))


def tail_measures(returns: DataFrame, keys, value: str = "r", confidence_z: float = Z95, q: float = 0.05, carry=()) -> DataFrame:
    """(keys, n_returns, var, n_tail, expected_shortfall, quantile, quantile_mean) and the aggregates ``carry`` per key, in two scans.

    VaR is the lower of the normal and the empirical quantile, 0 below 30 returns; the shortfall is the mean of the returns at or below
    it, VaR itself without any. ``quantile_mean`` is the mean at or below the empirical quantile. Null returns do not count.
    """
    m, s = F.avg(value), F.stddev_samp(value)
    t = fr.tails(returns, keys, value, q, F.when(F.count(value) < 30, 0.0).otherwise(m - confidence_z * s), carry)
    names = [c for c in t.columns if c not in {*keys, "_n", "_cut", "_q", "_n_cut", "_s_cut", "_n_q", "_s_q"}]
    by_cut = (F.col("_n") < 30) | (F.col("_cut") <= F.col("_q"))
    n_tail, total = (F.when(by_cut, F.col(f"_{x}_cut")).otherwise(F.col(f"_{x}_q")) for x in "ns")
    var = F.when(by_cut, F.col("_cut")).otherwise(F.col("_q"))
    return t.select(
        *keys, F.col("_n").alias("n_returns"), var.alias("var"), n_tail.alias("n_tail"), F.coalesce(div(total, n_tail), var).alias("expected_shortfall"),
        F.col("_q").alias("quantile"), div(F.col("_s_q"), F.col("_n_q")).alias("quantile_mean"), *names,
    )


def value_at_risk(returns: DataFrame, keys, value: str = "r", confidence_z: float = Z95, q: float = 0.05) -> DataFrame:
    """The lower of the normal and the empirical quantile; 0 below 30 returns."""
    return tail_measures(returns, keys, value, confidence_z, q).select(*keys, "n_returns", "var")


def expected_shortfall(returns: DataFrame, keys, value: str = "r") -> DataFrame:
    """Mean of the returns at or below VaR, else VaR."""
    return tail_measures(returns, keys, value).select(*keys, "var", "n_tail", "expected_shortfall")


def market_returns(returns: DataFrame) -> DataFrame:
    """Equal-weight mean return of all symbols per date."""
    return returns.groupBy("ts").agg(F.avg("r").alias("m"))


def aligned_with_market(returns: DataFrame, market: DataFrame) -> DataFrame:
    return returns.join(market, "ts")


def beta(returns: DataFrame, market: DataFrame, least: int = 30) -> DataFrame:
    """cov / var against the market; 1.0 below ``least`` common dates or for a flat market."""
    g = aligned_with_market(returns, market).groupBy("symbol").agg(
        F.covar_samp("r", "m").alias("_c"), F.var_samp("m").alias("_v"), F.count(F.lit(1)).alias("n_aligned")
    )
    b = F.when((F.col("n_aligned") >= least) & (F.col("_v") > 0), F.col("_c") / F.col("_v")).otherwise(1.0)
    return g.select("symbol", "n_aligned", b.alias("beta"))


def return_drawdown(returns: DataFrame, keys=("symbol",), value: str = "r", block: Column | None = None) -> DataFrame:
    """Deepest fall of the cumulated return below its running maximum, in one scan.

    Every block of a key gives four numbers of its running log sums: the total, the highest, the lowest and the deepest fall. They
    combine associatively, so a key is only a row a block (a calendar month unless given) when its blocks are put in order.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.select(*keys, "ts", (fr.default_block(returns) if block is None else block).alias("_block"), F.log1p(value).alias("_lr"))
    d = d.withColumn("_l", F.sum("_lr").over(w)).withColumn("_gap", F.col("_l") - F.max("_l").over(w))
    b = d.groupBy(*keys, "_block").agg(F.sum("_lr").alias("_sum"), F.max("_l").alias("_high"), F.min("_l").alias("_low"), F.min("_gap").alias("_gap"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    fall = F.least(F.col("_gap"), F.col("_base") + F.col("_low") - F.max(F.col("_base") + F.col("_high")).over(before))
    return b.withColumn("_fall", fall).groupBy(*keys).agg(F.abs(F.exp(F.min("_fall")) - 1).alias("max_drawdown"))


def position_risk(holdings: DataFrame, returns: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Risk row per position; symbols without history get the stated defaults."""
    total = holdings.agg(F.sum("market_value")).scalar()
    h = holdings.withColumn("position_size", F.col("market_value") / total)
    g = tail_measures(returns, ["symbol"], carry=[(F.avg("r") * 252).alias("_er"), (F.stddev_samp("r") * YEAR).alias("_vol")])
    g = g.select("symbol", "var", "_er", "_vol")
    b = beta(returns, market_returns(returns)).select("symbol", F.col("beta").alias("_beta"))
    j = h.join(g, "symbol", "left").join(b, "symbol", "left").join(return_drawdown(returns), "symbol", "left")
    known = F.col("_er").isNotNull()
    mv, vol = F.col("market_value"), F.col("_vol")
    return j.select(
        "symbol", "position_size", "market_value",
        F.when(known, F.abs("var") * mv).otherwise(0.02 * mv).alias("daily_var"),
        F.when(known, F.col("_er")).otherwise(0.0).alias("expected_return"),
        F.when(known, vol).otherwise(0.2).alias("volatility"),
        F.when(known, F.col("_beta")).otherwise(1.0).alias("beta"),
        F.when(known & (vol > 0), (F.col("_er") - risk_free) / vol).otherwise(0.0).alias("sharpe_ratio"),
        F.when(known, F.col("max_drawdown")).otherwise(0.0).alias("max_drawdown"),
        F.when(known, (F.col("position_size") * vol) ** 2).otherwise(0.0).alias("risk_contribution"),
    )


def portfolio_series(holdings: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted returns summed per date (one row per date)."""
    total = holdings.agg(F.sum("market_value")).scalar()
    w = holdings.select("symbol", (F.col("market_value") / total).alias("w"))
    s = returns.join(w, "symbol").groupBy("ts").agg(F.sum(F.col("r") * F.col("w")).alias("r"))
    return s.withColumn("book", F.lit("portfolio"))


def portfolio_risk(holdings: DataFrame, returns: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """One row of portfolio measures from the weighted return series and the single volatilities."""
    p = portfolio_series(holdings, returns)
    r = F.col("r")
    es = tail_measures(p, ["book"], carry=[
        (F.avg("r") * 252).alias("expected_return"), (F.stddev_samp("r") * YEAR).alias("volatility"),
        (F.stddev_samp(F.when(r < 0, r)) * YEAR).alias("_down"),
    ])
    dd = return_drawdown(p, ("book",))
    vols = returns.groupBy("symbol").agg((F.stddev_samp("r") * YEAR).alias("v"))
    h = holdings.join(vols, "symbol", "left").agg(
        F.sum("market_value").alias("total_value"), F.sum(F.col("market_value") ** 2).alias("_sq"),
        F.avg(F.coalesce("v", F.lit(0.2))).alias("_avg_vol"),
    ).withColumn("book", F.lit("portfolio"))
    j = h.join(es, "book", "left").join(dd, "book", "left")
    vol, er, down, mdd = F.col("volatility"), F.col("expected_return"), F.col("_down"), F.col("max_drawdown")
    return j.select(
        "total_value", (F.abs("var") * F.col("total_value")).alias("daily_var"), "expected_return", "volatility",
        F.when(vol > 0, (er - risk_free) / vol).otherwise(0.0).alias("sharpe_ratio"),
        F.when(down > 0, (er - risk_free) / down).otherwise(0.0).alias("sortino_ratio"), "max_drawdown",
        F.when(mdd > 0, er / mdd).otherwise(0.0).alias("calmar_ratio"),
        F.when(vol > 0, F.col("_avg_vol") / vol).otherwise(1.0).alias("diversification_ratio"),
        (F.col("_sq") / (F.col("total_value") * F.col("total_value"))).alias("concentration_risk"),
        (F.abs("expected_shortfall") * F.col("total_value")).alias("tail_risk"),
    )


def risk_violations(risk: DataFrame, max_risk: float = 0.02) -> DataFrame:
    """Violated limits of a portfolio row, one row each."""
    def v(kind, current, limit, severity):
        return F.when(current > limit, F.struct(F.lit(kind).alias("type"), current.alias("current"), limit.alias("limit"), F.lit(severity).alias("severity")))

    found = F.array_compact(F.array(
        v("var_limit", F.col("daily_var"), F.col("total_value") * max_risk, "high"),
        v("concentration_risk", F.col("concentration_risk"), F.lit(0.5), "medium"),
        v("max_drawdown", F.col("max_drawdown"), F.lit(0.15), "high"),
    ))
    return risk.withColumn("violations", found).select(
        F.size("violations").alias("risk_score"), (F.size("violations") == 0).alias("within_limits"), F.explode_outer("violations").alias("x")
    ).select("risk_score", "within_limits", "x.*")


def rebalance(current: DataFrame, target: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Full outer comparison of current and target weights; deviations above the threshold with side and amount."""
    total = current.agg(F.sum("market_value")).scalar()
    c = current.select("symbol", (F.col("market_value") / total).alias("_c"))
    j = c.join(target.select("symbol", F.col("weight").alias("_t")), "symbol", "full_outer")
    cw, tw = F.coalesce("_c", F.lit(0.0)), F.coalesce("_t", F.lit(0.0))
    return j.filter(F.abs(cw - tw) > threshold).select(
        "symbol", F.when(tw > cw, "increase").otherwise("decrease").alias("action"), cw.alias("current_weight"), tw.alias("target_weight"),
        F.abs(cw - tw).alias("deviation"), (F.abs(tw - cw) * total).alias("amount"),
    )


def trading_metrics(returns: DataFrame, keys=("symbol",), risk_free: float = 0.02) -> DataFrame:
    """Return, risk and win measures of a return series per key."""
    keys = list(keys)
    r = F.col("r")
    g = tail_measures(returns, keys, carry=[
        (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), F.avg(r).alias("_m"), (F.stddev_samp(r) * YEAR).alias("volatility"),
        (F.stddev_samp(F.when(r < 0, r)) * YEAR).alias("_down"), (F.count_if(r > 0) / F.count(r)).alias("win_rate"),
        F.sum(F.when(r > 0, r)).alias("_win"), F.abs(F.sum(F.when(r < 0, r))).alias("_loss"),
    ])
    j = g.drop("expected_shortfall").join(return_drawdown(returns, keys), keys)
    j = j.withColumn("annual_return", F.pow(1 + F.col("_m"), F.lit(252.0)) - 1)
    ar = F.col("annual_return")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return j.select(
        *keys, "total_return", "annual_return", "volatility", safe(ar - risk_free, F.col("volatility")).alias("sharpe_ratio"),
        safe(ar - risk_free, F.coalesce("_down", "volatility")).alias("sortino_ratio"), "max_drawdown", "win_rate",
        div(F.coalesce("_win", F.lit(0.0)), F.col("_loss")).alias("profit_factor"), safe(ar, F.col("max_drawdown")).alias("calmar_ratio"),
        F.col("quantile").alias("var_95"), F.col("quantile_mean").alias("expected_shortfall"),
    )


def _weigher() -> Callable:
    """The task of `equilibrium_returns`, defined inside a function so that it travels whole."""

    def toward(c: np.ndarray, kept: np.ndarray, names: list, of: list, w: dict) -> pa.RecordBatch:
        """For every name of a row the sum over the names ``of`` the columns, where a pair of it has a weight; null where all weights of its pairs are."""
        found = [w.get(x) for x in of]
        held, known = np.array([x in w for x in of], bool), np.array([x is not None for x in found], bool)
        totals = np.where(kept[:, known], c[:, known], 0.0) @ np.array([x for x in found if x is not None], float)
        here = kept[:, held].any(1)
        some = kept[:, known].any(1)[here]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).filter(pa.array(here)), pa.array(totals[here], mask=~some)], names=["symbol", "total"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at] for c in batch.schema.names}
                left, right = r["left"].as_py(), r["right"].as_py()
                c = np.frombuffer(r["covariance"].as_buffer(), "<f8").reshape(len(left), len(right))
                kept = np.frombuffer(r["kept"].as_buffer(), bool).reshape(c.shape) if len(r["kept"].as_py()) else np.ones(c.shape, bool)
                wa, wb = ({x["symbol"]: x["w"] for x in r[s].as_py() or ()} for s in ("wa", "wb"))
                yield toward(c, kept, left, right, wb)
                if r["meet"].is_valid:  # a symbol meets itself once
                    kept = kept & ~np.eye(*c.shape, -r["meet"].as_py(), dtype=bool)
                yield toward(c.T, kept.T, right, left, wa)

    return weighed


def equilibrium_returns(cov: DataFrame | Blocks, holdings: DataFrame, views: DataFrame, aversion: float = 3.0, view_share: float = 0.5) -> DataFrame:
    """λ·Σ·w from the covariance in long form or in blocks, blended with views where a symbol has one."""
    total = holdings.agg(F.sum("market_value")).scalar()
    w = holdings.select(F.col("symbol").alias("b"), (F.col("market_value") / total).alias("w"))
    if isinstance(cov, Blocks) and cov.tiles:
        one = w.filter(F.col("b").isNotNull()).groupBy(F.col("b").alias("symbol")).agg(F.sum("w").alias("w"))
        tile = F.pmod(F.hash("symbol"), F.lit(cov.tiles))
        of = lambda t, c: F.broadcast(one.groupBy(tile.alias(t)).agg(F.collect_list(F.struct("symbol", "w")).alias(c)))
        terms = cov.rows.join(of("ta", "wa"), "ta", "left").join(of("tb", "wb"), "tb", "left").mapInArrow(_weigher(), "symbol string, total double")
    else:
        long = cov.rows if isinstance(cov, Blocks) else cov
        sides = F.array(F.struct("a", "b"), F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = long.select("covariance", F.explode(F.array_compact(sides)).alias("_p")).select("_p.a", "_p.b", "covariance")  # one pass over the pairs
        terms = both.join(w, "b").select(F.col("a").alias("symbol"), (F.col("covariance") * F.col("w")).alias("total"))
    pi = terms.groupBy("symbol").agg((F.sum("total") * aversion).alias("equilibrium_return"))
    j = pi.join(views, "symbol", "left")
    mix = F.coalesce((1 - view_share) * F.col("equilibrium_return") + view_share * F.col("view"), F.col("equilibrium_return"))
    return j.select("symbol", "equilibrium_return", mix.alias("expected_return"))

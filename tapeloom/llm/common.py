"""What the operators share: tables in the shared folder, runs of sorted rows, a disjoint-set forest and distributed components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Where it is unset, a single-process session gets one of its own; any other fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to the shared folder: a lost executor costs no recomputation of what lies before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, null text as empty: further columns, whatever their names, do not matter."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows and `size` bytes in a text or binary column; a single longer row is a part of its own."""
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            n = int(np.clip(np.searchsorted(ends, done + size, "right") - at, 1, rows))
            yield b.slice(at, n)
            at += n


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of rows with equal integer keys, as columns; the rows come sorted by the keys. One run is held at a time."""
    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if held.empty:
            continue
        k = held[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
        cols = {c: held[c].to_numpy() for c in held.columns}
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield {c: v[s:e] for c, v in cols.items()}
        held = held.iloc[cuts[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in held.columns}


def blocks(batches: Iterable[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Frames of about `rows` rows that hold whole runs of the integer key; the rows come sorted by it."""
    held, size, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= enough:
            all_ = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(all_[key].to_numpy(), all_[key].iloc[-1]))
            if last:
                yield all_.iloc[:last]
            held, size = [all_.iloc[last:]], size - last
            enough = max(rows, 2 * size)
    if size:
        yield pd.concat(held, ignore_index=True)


class Forest:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        """(member, root) of each member that isn't its own root: the same components with one edge a member."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the undirected `edges` (a, b); isolated nodes are not listed.

    Alternating large-star and small-star rounds; each halves path lengths, and no node's neighbours are gathered in one row: the
    minimum is a partial aggregate, and the join back is one that adaptive execution can split. Rounds are cut by stored tables.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large.a == low.k).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()

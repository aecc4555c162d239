"""Near copies by SimHash fingerprints, searched with BK-trees.

A fingerprint has 64 bits: a bit is set if it is set in over half of the 64-bit hashes of the text's word shingles. Fingerprints
link when at most `radius` bits differ. Equal fingerprints are one class first, so groups of exact copies cost one row. By the
pigeonhole principle two fingerprints within the radius agree in at least one of `radius + 1` bands; a band value is a shard.
Each shard is cut into blocks of bounded size, and every pair of blocks is a task unit of its own: one block is the shard tree,
the other its queries. A hot shard thus becomes many units and no unit grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import Forest, components, runs, stored, texts

BITS = 64
#: Words handled at once, which bounds the memory that a very long text takes.
PART = 100_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many rows of 64-bit hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: A-Z lower-cased, words between ASCII white space, repeats counted; no word: zero."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    votes, n, digest = np.zeros(BITS, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        part = words[at: at + PART + shingle - 1]
        votes += set_bits(np.array([digest(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(shingle)), strict=False)], "<u8")[:, None])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under the Hamming distance; a child hangs at its distance from the parent. Queries go down as an array.

    Integers of more than 64 bits have `parts` 64-bit parts, the lowest first; their queries are rows of as many.
    """

    def __init__(self, values: Iterable[int], parts: int = 1) -> None:
        self.parts = parts
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in values:
            self.add(int(x))

    def add(self, x: int) -> None:
        at = 0
        while at < len(self.values):
            d = (x ^ self.values[at]).bit_count()
            if d == 0:
                return
            at = self.children[at].setdefault(d, len(self.values))
        self.values.append(x)
        self.children.append({})

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(tree value, positions of the queries within the radius of it). Only edges whose length can reach a hit are followed."""
        todo = [(0, np.arange(len(queries)))] if self.values else []
        while todo:
            at, who = todo.pop()
            value = np.frombuffer(self.values[at].to_bytes(8 * self.parts, "little"), "<u8")
            d = np.bitwise_count(queries[who] ^ value).astype(np.int64)
            d = d.sum(axis=1) if d.ndim > 1 else d
            if len(hits := who[d <= radius]):
                yield self.values[at], hits
            for edge, child in self.children[at].items():
                if len(sub := who[np.abs(d - edge) <= radius]):
                    todo.append((child, sub))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    source = texts(docs)
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def links(classes: DataFrame, radius: int = 2, block: int = 4096) -> DataFrame:
    """Edges (a, b) of fingerprints within the radius, reduced inside each unit to one edge a member: same components, no pair lists."""
    width = [BITS // (radius + 1) + (i < BITS % (radius + 1)) for i in range(radius + 1)]
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", sum(width[:i])).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for i, w in enumerate(width)]
    rows = classes.select("fp", F.explode(F.array(*bands)).alias("x")).select("fp", "x.band", "x.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    cut = rows.join(sizes, ["band", "value"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["band", "value", "low", "high"]
    cut = cut.select("band", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") - F.col("other")).alias("side"), "fp")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, unit):
            fps, forest = g["fp"].view(np.uint64), Forest()
            signed = {}
            queries = fps[g["side"] >= 0]
            for x, hits in BKTree(fps[g["side"] <= 0].tolist()).within(queries, radius):
                for y in queries[hits].tolist():
                    if x != y:
                        forest.join(x, y)
            found = forest.edges()
            if found:
                signed = np.array(found, np.uint64).view(np.int64)
                yield pd.DataFrame({"a": signed[:, 0], "b": signed[:, 1]})

    return cut.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(work, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id that links of at most `radius` differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated results. A row with a null
    doc_id gets the component of its fingerprint, null if nothing with an id is in it. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle, seed), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("root")), "simhash-classes")
    edges = stored(links(classes, radius), "simhash-links")
    found = components(edges)
    grouped = classes.join(found, classes.fp == found.node, "left").select("fp", "root", F.coalesce("component", "fp").alias("c"))
    least = grouped.groupBy("c").agg(F.min("root").alias("component_id"))
    ids = grouped.join(least, "c").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """The documents without those that a document of a smaller doc_id stands for; rows with a null doc_id stay.

    Repeated rows of a kept document stay as they are.
    """
    gone = near_copies(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")

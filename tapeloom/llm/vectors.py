"""Near-duplicate vectors by randomly rotated binary codes with correction factors, checked exactly where the bounds ask for it.

A unit vector, padded with zeros, is rotated at random; its code is the signs, its factor the inner product of the vector with its
code. `<code, q> / factor` is an unbiased estimate of the inner product with q, with an error of at most EPSILON standard
deviations, but for odds far below one in ten thousand. Candidates share one of several bands of code bits. In a bucket pairs whose upper
bound stays below the threshold are dropped, all others are computed in double precision. The number of bands follows from the
threshold, the wanted recall and the band width, and the width from the number of vectors, so buckets stay small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Forest, components, runs, stored

EPSILON = 4.0
#: Least bits of a code, and rows of a bucket's block.
BITS, BLOCK = 256, 2048
SEED = 9


def rotation(dim: int) -> np.ndarray:
    """`dim` orthonormal rows of random direction in code space."""
    bits = max(BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def found_share(cosine: float, width: int, count: int, bits: int = BITS) -> float:
    """The odds that a pair of this cosine shares one of `count` bands: the bands are drawn from the same bits, of which a binomial number differ."""
    p, out = math.acos(min(1.0, max(-1.0, cosine))) / math.pi, 0.0
    for d in range(bits + 1):
        odds = math.exp(math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(p) + (bits - d) * math.log1p(-p)) if 0 < p < 1 else float(d == p * bits)
        same = math.comb(bits - d, width) / math.comb(bits, width)
        out += odds * (1 - (1 - same) ** count)
    return out


def shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits in a band, and the fewest bands by which a pair at the threshold shares some band with the odds `recall`; a bucket has some 16 rows."""
    width = min(30, max(8, math.ceil(math.log2(max(2, n))) - 4))
    low, high = 0, 1
    while found_share(cosine, width, high) < recall:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if found_share(cosine, width, mid) >= recall else (mid, high)
    return width, high


def bands(width: int, count: int, bits: int) -> np.ndarray:
    """Places of the code bits of each band."""
    rng = np.random.default_rng(SEED + 1)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(count)])


def unit_rows(vectors: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """(id, raw) of the vectors that can link: not null, not zero, all components finite; raw are numbers of the kind."""
    source = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raws = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if v and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        keys.append(k)
                        raws.append((x + 0.0).tobytes())  # no negative zeros
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(raws, pa.binary())], names=["id", "raw"])

    return source.where("id is not null").mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, raw binary")


def normed(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(classes: DataFrame, places: np.ndarray, kind: str) -> DataFrame:
    """A row for each class and band: (band, bucket, id, n, raw, code, factor)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, own in b.groupby(b["raw"].str.len(), sort=True):
                turn = rotation_of(size // np.dtype(kind).itemsize)
                x = normed(np.frombuffer(b"".join(own["raw"]), kind).astype(float).reshape(len(own), -1)) @ turn
                sign = x > 0
                factor = np.abs(x).sum(axis=1) / math.sqrt(x.shape[1])
                codes = [c.tobytes() for c in np.packbits(sign, axis=1, bitorder="little")]
                for k, at in enumerate(places):
                    bucket = sign[:, at % sign.shape[1]] @ (1 << np.arange(len(at), dtype=np.int64)) + (size << 32)
                    yield pd.DataFrame({"band": k, "bucket": bucket, "id": own["id"], "n": own["n"], "raw": own["raw"], "code": codes, "factor": factor})

    return classes.mapInPandas(work, "band int, bucket long, id long, n long, raw binary, code binary, factor double")


def near(tree: dict[str, np.ndarray], query: dict[str, np.ndarray], cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs with at least this cosine: estimated from the codes, and computed where the upper bound allows it."""
    a, b = (normed(np.frombuffer(b"".join(x["raw"]), kind).astype(float).reshape(len(x["raw"]), -1)) for x in (tree, query))
    turn = rotation_of(a.shape[1])
    bits = turn.shape[1]
    sign = np.unpackbits(np.frombuffer(b"".join(tree["code"]), np.uint8).reshape(len(a), -1), axis=1, bitorder="little").astype(np.float32) * 2 - 1
    factor = tree["factor"].astype(float)
    estimate = (sign @ (b @ turn).T.astype(np.float32)) / (math.sqrt(bits) * factor[:, None])
    error = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / (bits - 1))
    i, j = np.nonzero(estimate + error[:, None] + 1e-5 >= cosine)
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        exact[at: at + (1 << 16)] = np.einsum("ij,ij->i", a[i[at: at + (1 << 16)]], b[j[at: at + (1 << 16)]])
    good = exact >= cosine
    return i[good], j[good]


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    """The rotation, kept by the worker."""
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return _ROTATIONS[dim]


def matched(rows: DataFrame, places: np.ndarray, cosine: float, kind: str) -> DataFrame:
    """(id, links, root): what each block pair adds to a class's links, and an edge that keeps the components.

    A large bucket is cut into blocks and each pair of blocks is a unit of work. A pair that an earlier band has found is left out.
    """
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("c")).where("c > 1")
    cut = rows.join(sizes, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    cut = cut.select("band", "bucket", "low", "high", (F.col("own") - F.col("other")).alias("side"), "id", "n", "raw", "code", "factor")
    unit = ["band", "bucket", "low", "high"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, unit):
            tree, query = ({k: v[side] for k, v in g.items()} for side in (g["side"] <= 0, g["side"] >= 0))
            if not len(tree["id"]) or not len(query["id"]):
                continue
            i, j = near(tree, query, cosine, kind)
            if g["low"][0] == g["high"][0]:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            bits = [np.unpackbits(np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x["id"]), -1), axis=1, bitorder="little") for x in (tree, query)]
            for at in places[: g["band"][0]]:
                keys = [x[:, at % x.shape[1]] @ (1 << np.arange(len(at), dtype=np.int64)) for x in bits]
                new = keys[0][i] != keys[1][j]
                i, j = i[new], j[new]
            links, forest = {}, Forest()
            for a, m, b, n in zip(tree["id"][i].tolist(), tree["n"][i].tolist(), query["id"][j].tolist(), query["n"][j].tolist(), strict=True):
                links[a] = links.get(a, 0) + n
                links[b] = links.get(b, 0) + m
                forest.join(a, b)
            if links:
                yield pd.DataFrame({"id": list(links), "links": list(links.values()), "root": [forest.root(x) for x in links]})

    return cut.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(work, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: linked vectors, the smallest id reachable by links, whether it is its own.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, link with nothing: a component of
    their own. Vectors of different lengths never link. Equal vectors are one class. Rows of one id and one vector count once; an id
    with several vectors has one component and at least the links of each. An empty table gives an empty result.
    """
    ids = vectors.select(F.col(key).alias("vec_id"))
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    usable = stored(unit_rows(vectors, key, vector, kind).distinct(), "vectors")
    classes = stored(usable.groupBy("raw").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n")), "vector-classes")
    count = classes.count()
    width, many = shape(count, cosine, recall)
    places = bands(width, many, BITS)
    found = stored(matched(coded(classes, places, kind), places, cosine, kind), "vector-links")
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").union(usable.join(classes, "raw").select(usable.id.cast("long").alias("a"), classes.id.alias("b")).where("a <> b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = classes.select("raw", F.col("id").alias("rep"), "n").join(links, F.col("rep") == F.col("id"), "left").select("raw", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = usable.join(per, "raw").groupBy(F.col("id").alias("_id")).agg(F.max("n_links").alias("n_links"))
    out = ids.join(own, F.col("vec_id") == F.col("_id"), "left").join(reach, F.col("vec_id") == F.col("node"), "left")
    type_ = ids.schema["vec_id"].dataType
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component").cast(type_), F.col("vec_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

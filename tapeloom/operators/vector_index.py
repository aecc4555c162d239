"""Inverted-file index of vectors: coarse lists, residual product codes, exact re-rank of the best.

The index is fitted on a bounded sample, but every vector is put into the list of its nearest centroid. A query looks at the codes in
its nearest lists only; the vectors of the best by code, a fixed number, are read and compared exactly. Lists, and queries of a list, over a number of rows
are split into blocks by hash, so a hot list is many tasks, none of which holds more than a block of each side.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Codewords of a part: a byte a code.
WORDS = 256
#: Rows of a block of vectors and of a block of queries.
VECTORS, QUERIES = 16384, 1024


class Index(NamedTuple):
    """Centroids of the lists, codewords (part, word, entries) of the residuals, the metric."""

    centroids: np.ndarray
    words: np.ndarray
    metric: str


def matrix(s: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(s.to_numpy()).astype(float) if len(s) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def nearest(x: np.ndarray, y: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[i: i + step], y).argmin(axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of the rows from seeds far apart; an empty cluster takes the row worst served."""
    found = [x[rng.integers(len(x))]]
    far = distances(x, found[0][None])[:, 0]
    for _ in range(1, min(k, len(x))):
        p = np.maximum(far, 0)
        found.append(x[rng.choice(len(x), p=p / p.sum())] if p.sum() > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, distances(x, found[-1][None])[:, 0])
    c = np.stack(found)
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for e in np.flatnonzero(n == 0):
            worst = int(((x - c[own]) ** 2).sum(axis=1).argmax())
            c[e], own[worst] = x[worst], e
    return c


def fit(vectors: DataFrame, lists: int | None = None, parts: int = 16, sample: int = 20_000, metric: str = "l2", rounds: int = 10, seed: int = 42) -> Index:
    """The index of (vec_id, embedding) from at most `sample` rows, those with the smallest hashes of vec_id.

    `lists`: 4 * sqrt(rows) of the table by default, at most a quarter of the sample. Rows without embedding are left out. The parts must
    divide the dimensions, else the largest number below that does is taken.
    """
    rows = vectors.where(F.col("embedding").isNotNull())
    n = rows.count()
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()  # at most `sample` rows
    x, rng = matrix(got["embedding"], metric), np.random.default_rng(seed)
    if not len(x):
        return Index(np.zeros((1, 1)), np.zeros((1, 1, 1)), metric)
    c = means(x, max(1, min(lists or round(4 * math.sqrt(n)), len(x) // 4)), rounds, rng)
    rest = x - c[nearest(x, c)]
    parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    words = []
    for own in np.split(rest, parts, axis=1):
        w = means(own, WORDS, rounds, rng)
        words.append(np.concatenate([w, np.repeat(w[:1], WORDS - len(w), axis=0)]))
    return Index(c, np.stack(words), metric)


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, code, embedding) of every vector: write it partitioned or sorted by `list`. Rows without embedding are left out."""
    send = vectors.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("struct<list:int,code:binary>")
    def put(e: pd.Series) -> pd.DataFrame:
        ix = send.value
        x = matrix(e, ix.metric)
        own = nearest(x, ix.centroids)
        rest = np.split(x - ix.centroids[own], len(ix.words), axis=1)
        codes = np.stack([nearest(r, w) for r, w in zip(rest, ix.words, strict=True)], axis=1).astype(np.uint8)
        return pd.DataFrame({"list": own, "code": [c.tobytes() for c in codes]})

    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding", put("embedding").alias("_x")).select("_x.list", "vec_id", "_x.code", "embedding")


def probes(queries: DataFrame, index: Index, count: int) -> DataFrame:
    """(query_id, embedding, list) for the `count` nearest lists of every query."""
    send = queries.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def near(e: pd.Series) -> pd.Series:
        ix = send.value
        d = distances(matrix(e, ix.metric), ix.centroids)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :count]))

    return queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", F.explode(near("embedding")).alias("list"))


def search(queries: DataFrame, coded: DataFrame, index: Index, k: int = 3, probe: float = 0.4, deep: int = 8) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest, score 1 - distance as in the exact search.

    Only codes are looked at in the lists, the nearest `probe` of all lists for each query; the k * `deep` best by code are the rows whose
    vectors are read, and their exact distances decide. Columns of `coded`: list, vec_id, code, embedding.
    """
    send = coded.sparkSession.sparkContext.broadcast(index)
    asked = probes(queries, index, max(1, round(len(index.centroids) * probe)))
    sizes = coded.groupBy("list").agg(F.count(F.lit(1)).alias("nv")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("nq")), "list")  # a row a list
    blocks = sizes.select("list", F.ceil(F.col("nv") / VECTORS).cast("int").alias("vb"), F.ceil(F.col("nq") / QUERIES).cast("int").alias("qb"))
    hot = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["list", "vblock", "qblock"]
    q = asked.join(blocks, "list").withColumn("qblock", hot("query_id", "qb")).withColumn("vblock", every("vb")).select("query_id", "embedding", *keys)
    v = coded.select("list", "vec_id", "code").join(blocks, "list").withColumn("vblock", hot("vec_id", "vb")).withColumn("qblock", every("qb")).select("vec_id", "code", *keys)
    q, v = q.toDF(*q.columns), v.toDF(*v.columns)  # columns of their own where both come from one table

    def by_code(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "near": []}
        if len(qs) and len(vs):
            ix = send.value
            ids, codes = vs["vec_id"].to_numpy(), np.stack([np.frombuffer(c, np.uint8) for c in vs["code"]]).astype(np.int64)
            centre, part = ix.centroids[int(vs["list"].iloc[0])], np.arange(len(ix.words))
            for query, x in zip(qs["query_id"].to_numpy(), matrix(qs["embedding"], ix.metric), strict=True):
                table = ((np.stack(np.split(x - centre, len(part)))[:, None, :] - ix.words) ** 2).sum(axis=2)
                near = table[part, codes].sum(axis=1)
                top = np.argsort(near, kind="stable")[: k * deep]
                out["query_id"].append(np.full(len(top), query)), out["vec_id"].append(ids[top]), out["near"].append(near[top])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()})

    kinds = queries.schema["query_id"].dataType.simpleString(), coded.schema["vec_id"].dataType.simpleString()
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(by_code, f"query_id {kinds[0]}, vec_id {kinds[1]}, near double")
    few = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))).filter(F.col("_n") <= k * deep).select("query_id", "vec_id")
    both = few.join(coded.select("vec_id", F.col("embedding").alias("_v")), "vec_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        d = ((matrix(a, index.metric) - matrix(b, index.metric)) ** 2).sum(axis=1)
        return pd.Series(d / 2 if index.metric == "cosine" else d)

    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    ranked = both.select("query_id", "vec_id", exact("_q", "_v").alias("distance")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "vec_id", (1 - F.col("distance")).alias("score"), "rank")


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries of `exact` and the share of its rows (query_id, vec_id) that are in `hits`."""
    both = exact.select("query_id", "vec_id").join(hits.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

"""Trained forests and boosted trees as flat node arrays: sent once with a checked size, all trees of a batch of rows walked together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.linear import number
from tapeloom.session import scratch

#: Rows walked at once.
STEP = 2048


class Trees(NamedTuple):
    """Nodes of all trees one behind the other: feature (-1 in a leaf), threshold, children, and the values of a leaf; where trees start, their weights."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return at


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over some tasks for every core, however few blocks their files have."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def flatten(model: Any, spark: Any, classes: bool = False, most_bytes: int = 256 << 20) -> Trees:
    """The nodes of a fitted model of numeric features, read back from its stored form. Over `most_bytes` of arrays are an error."""
    path = scratch(spark, "trees")
    model.write().overwrite().save(path)
    n = "nodeData"
    nodes = spark.read.parquet(f"{path}/data").select("treeID", *[F.col(f"{n}.{c}").alias(c) for c in ("id", "prediction", "leftChild", "rightChild", "impurityStats")], F.col(f"{n}.split.featureIndex").alias("f"), F.get(f"{n}.split.leftCategoriesOrThreshold", F.lit(0)).alias("t"))
    width = model.numClasses if classes else 1
    size = nodes.count() * (32 + 8 * width)
    if size > most_bytes:
        raise ValueError(f"trees of {size} bytes are too large to send to every task")
    p = nodes.toPandas().sort_values(["treeID", "id"], ignore_index=True)
    counts = p.groupby("treeID").size().to_numpy()
    roots = np.cumsum(counts) - counts
    start = np.repeat(roots, counts)
    if not np.array_equal(p["id"].to_numpy(), np.arange(len(p)) - start):
        raise ValueError("nodes of a tree are not numbered from 0 without gaps")
    if classes:
        stats = np.stack(p["impurityStats"].to_numpy())
        values = stats / stats.sum(axis=1, keepdims=True)
    else:
        values = p["prediction"].to_numpy()[:, None]
    weights = np.array(model.treeWeights, float)
    return Trees(p["f"].to_numpy(np.int32), p["t"].fillna(0.0).to_numpy(float), p["leftChild"].to_numpy() + start, p["rightChild"].to_numpy() + start, values, roots, weights)


def scored(df: DataFrame, trees: Trees, features: Sequence[str], kind: str) -> DataFrame:
    """`df` with `prediction` and `uncertainty`: `mean` of the trees and their deviation, `class` with the entropy of its mean probabilities,
    `sum` of the weighted trees or `sign` of it (no uncertainty). One Python step for all trees; missing features count as 0."""
    send = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<prediction:double,uncertainty:double>")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        t = send.value
        for cols in batches:
            cols = (cols,) if isinstance(cols, pd.Series) else cols
            x, out = np.stack([c.to_numpy(float) for c in cols], axis=1), []
            for at in range(0, len(x), STEP):
                v = t.values[t.leaves(x[at: at + STEP])]
                if kind == "class":
                    p = v.mean(axis=1)
                    out.append((p.argmax(axis=1).astype(float), -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)))
                elif kind == "mean":
                    out.append((v[:, :, 0].mean(axis=1), v[:, :, 0].std(axis=1)))
                else:
                    s = v[:, :, 0] @ t.weights
                    out.append(((s > 0).astype(float) if kind == "sign" else s, np.full(len(s), np.nan)))
            yield pd.DataFrame({"prediction": np.concatenate([a for a, _ in out]), "uncertainty": np.concatenate([b for _, b in out])} if out else {"prediction": pd.Series(dtype=float), "uncertainty": pd.Series(dtype=float)})

    out = df.withColumn("_scored", walk(*[number(f) for f in features]))
    return out.withColumns({"prediction": F.col("_scored.prediction"), "uncertainty": F.nanvl(F.col("_scored.uncertainty"), F.lit(None).cast("double"))}).drop("_scored")

"""Linear models from moments: one aggregate gives count, means and centred products per fold, and everything else is small matrices.

A fold's moments are those of its rows, so training on some folds is adding their moments, the error on a fold follows from its own,
and a prediction's moments are a linear map of them. No model reads the rows again; only scoring does, as a column expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Moments(NamedTuple):
    """Rows, means, and summed products of deviations of some columns; the label is the last one."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:  # type: ignore[override]
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n, self.products + other.products + np.outer(gap, gap) * self.n * other.n / n)

    def mapped(self, a: np.ndarray, shift: np.ndarray) -> Moments:
        """Moments of a @ columns + shift."""
        return Moments(self.n, a @ self.mean + shift, a @ self.products @ a.T)

    def picked(self, at: Sequence[int]) -> Moments:
        return Moments(self.n, self.mean[at], self.products[np.ix_(at, at)])


class Linear(NamedTuple):
    """Intercept and a coefficient for each column in order."""

    intercept: float
    coefficients: np.ndarray

    def column(self, features: Sequence[str]) -> Column:
        return sum((number(f) * float(c) for f, c in zip(features, self.coefficients, strict=True)), F.lit(float(self.intercept)))


def number(name: str) -> Column:
    """A feature as double; missing and NaN count as 0."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def total(parts: Iterable[Moments], width: int) -> Moments:
    found = Moments(0.0, np.zeros(width), np.zeros((width, width)))
    for m in parts:
        found = found + m
    return found


def gather(df: DataFrame, features: Sequence[str], label: str, fold: Column, most: int = 1000) -> dict[int, Moments]:
    """Moments per fold of all rows with a label; at most `most` folds reach the driver, more are an error."""
    cols = [*features, "_y"]
    d = df.where(F.col(label).isNotNull()).select(fold.cast("int").alias("_fold"), *[number(f).alias(f) for f in features], F.col(label).cast("double").alias("_y"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    g = d.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m"), F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("c"))
    rows = g.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} folds")
    out = {}
    for r in rows:
        c = np.zeros((len(cols), len(cols)))
        for (i, j), x in zip(pairs, r.c, strict=True):
            c[i, j] = c[j, i] = x * r.n
        out[r._fold] = Moments(float(r.n), np.array(r.m), c)
    return dict(sorted(out.items()))


def ridge(m: Moments, penalty: float = 0.1) -> Linear:
    """Least squares with `penalty` on the squared coefficients of standardised columns; constant columns have coefficient 0."""
    if not m.n:
        return Linear(0.0, np.zeros(len(m.mean) - 1))
    c = m.products / m.n
    x, xy = c[:-1, :-1].copy(), c[:-1, -1]
    x[np.diag_indices_from(x)] *= 1 + penalty
    b = np.linalg.lstsq(x, xy, rcond=1e-12)[0]
    return Linear(float(m.mean[-1] - b @ m.mean[:-1]), b)


def error(m: Moments, model: Linear) -> float:
    """Mean squared error of the model on the rows of the moments."""
    a = np.append(-model.coefficients, 1.0)
    return float((a @ m.mean - model.intercept) ** 2 + a @ m.products @ a / m.n) if m.n else float("nan")


def lasso(m: Moments, penalty: float, start: np.ndarray | None = None, tolerance: float = 1e-13, rounds: int = 100_000) -> Linear:
    """Half the mean squared error plus `penalty` times the absolute coefficients, by coordinate descent on the products."""
    c = m.products / max(m.n, 1.0)
    x, xy, b = c[:-1, :-1], c[:-1, -1], np.zeros(len(m.mean) - 1) if start is None else start.copy()
    scale = np.sqrt(np.diag(x)) + 1e-300
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(x) > 0):
            g = xy[j] - x[j] @ b + x[j, j] * b[j]
            new = np.sign(g) * max(abs(g) - penalty, 0.0) / x[j, j]
            moved, b[j] = max(moved, abs(new - b[j]) * scale[j]), new
        if moved <= tolerance * (np.sqrt(c[-1, -1]) + 1e-300):
            break
    return Linear(float(m.mean[-1] - b @ m.mean[:-1]), b)


def penalties(m: Moments, steps: int = 100, least: float = 1e-3) -> np.ndarray:
    """From the smallest penalty without any coefficient down to `least` of it, in equal ratios."""
    top = float(np.abs(m.products[:-1, -1]).max(initial=0.0)) / max(m.n, 1.0)
    return np.geomspace(top, top * least, steps) if top else np.zeros(1)


def cross_validated_lasso(folds: Mapping[int, Moments], steps: int = 100) -> tuple[Linear, float]:
    """The lasso on all folds at the penalty of the path with the lowest mean error on folds left out, and that penalty."""
    width = len(next(iter(folds.values())).mean) if folds else 1
    whole = total(folds.values(), width)
    path = penalties(whole, steps)
    errors = np.zeros(len(path))
    for f, own in folds.items():
        rest, b = total((m for g, m in folds.items() if g != f), width), None
        for i, p in enumerate(path):
            model = lasso(rest, p, b)
            b = model.coefficients
            errors[i] += error(own, model) / len(folds)
    best = float(path[int(errors.argmin())])
    return lasso(whole, best), best


def expanding_errors(folds: Mapping[int, Moments], penalty: float = 0.1) -> list[tuple[int, int, float]]:
    """(fold, rows, mean squared error) of every fold but the first, by the ridge trained on all folds before it."""
    out, seen = [], None
    for f, m in folds.items():
        if seen is not None:
            out.append((f, int(m.n), error(m, ridge(seen, penalty))))
        seen = m if seen is None else seen + m
    return out


class Ensemble(NamedTuple):
    """Base models trained without each fold and on all folds, the second stage over the former, the blend of the latter."""

    names: list[str]
    features: list[tuple[str, ...]]
    out_of_fold: dict[int, list[Linear]]
    whole: list[Linear]
    stage: Linear
    weights: np.ndarray


def ensemble(folds: Mapping[int, Moments], features: Sequence[str], models: Mapping[str, tuple[Sequence[str], float]]) -> Ensemble:
    """Stacked and blended ensembles of ridge models (columns, penalty). Weights are 1 / (mean error on folds left out + 1e-8), normalised."""
    columns = list(features)
    at = {n: [*(columns.index(f) for f in own), len(columns)] for n, (own, _) in models.items()}
    out, errors, stage = {}, np.zeros(len(models)), total((), len(models) + 1)
    for f, own in folds.items():
        rest = total((m for g, m in folds.items() if g != f), len(columns) + 1)
        out[f] = [ridge(rest.picked(at[n]), p) for n, (_, p) in models.items()]
        a = np.zeros((len(models) + 1, len(columns) + 1))
        a[-1, -1] = 1
        for i, (n, m) in enumerate(zip(models, out[f], strict=True)):
            a[i, at[n][:-1]] = m.coefficients
            errors[i] += error(own.picked(at[n]), m) / len(folds)
        stage = stage + own.mapped(a, np.array([*(m.intercept for m in out[f]), 0.0]))
    whole = total(folds.values(), len(columns) + 1)
    weights = 1.0 / (errors + 1e-8)
    return Ensemble(list(models), [tuple(own) for own, _ in models.values()], out, [ridge(whole.picked(at[n]), p) for n, (_, p) in models.items()], ridge(stage, 0.0), weights / weights.sum())


def score_ensemble(df: DataFrame, e: Ensemble, fold: Column) -> DataFrame:
    """`df` with p_<model> (trained without the row's fold), `stacked` over these, and `blended` over the models of all folds."""
    own = {}
    for i, n in enumerate(e.names):
        c = F.lit(None).cast("double")
        for f, models in e.out_of_fold.items():
            c = F.when(F.col("_fold") == f, models[i].column(e.features[i])).otherwise(c)
        own[f"p_{n}"] = c
    blended = sum((m.column(f) * float(w) for m, f, w in zip(e.whole, e.features, e.weights, strict=True)), F.lit(0.0))
    scored = df.withColumn("_fold", fold.cast("int")).withColumns({**own, "blended": blended}).drop("_fold")
    return scored.withColumn("stacked", sum((F.col(f"p_{n}") * float(c) for n, c in zip(e.names, e.stage.coefficients, strict=True)), F.lit(float(e.stage.intercept))))


def analysis_of_variance(df: DataFrame, features: Sequence[str], target: str, most: int = 1000) -> dict[str, float]:
    """F statistic of every feature against a class target, from counts, means and variances of the classes, at most `most` of them."""
    d = df.where(F.col(target).isNotNull())
    g = d.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(number(f)) for f in features]).alias("m"), F.array(*[F.var_pop(number(f)) for f in features]).alias("v"))
    rows = g.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes")
    n, m, v = np.array([r.n for r in rows], float), np.array([r.m for r in rows]).reshape(-1, len(features)), np.array([r.v for r in rows]).reshape(-1, len(features))
    if len(rows) < 2 or n.sum() <= len(rows):
        return dict.fromkeys(features, 0.0)
    between, within = (n[:, None] * (m - n @ m / n.sum()) ** 2).sum(axis=0) / (len(n) - 1), (n @ v) / (n.sum() - len(n))
    return {f: float(b / w) if w > 0 else 0.0 for f, b, w in zip(features, between, within, strict=True)}

"""Feature tables, training, ensembles, selection and drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import frames as fr
from tapeloom.functions.frames import div
from tapeloom.operators import indicators as ind
from tapeloom.operators import linear as lm
from tapeloom.operators import relational as rel
from tapeloom.operators import trees as tr
from tapeloom.operators.risk import trading_metrics

FEATURES = ("returns", "volatility", "sma_20", "sma_50", "ema_12", "ema_26", "rsi", "price_to_sma_20", "price_to_sma_50", "volume_ratio", "high_low_ratio", "close_position")


def feature_table(bars: DataFrame, horizons: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Indicators and forward targets of every bar; missing features count 0, missing targets stay null."""
    from tapeloom.functions.special import EMA_ROWS, ema_reach, ewm_mean, ewm_stretch, span_alpha

    reach = ema_reach(span_alpha(26))
    s = fr.segment(bars, lookback=reach, lookahead=max(horizons), rows=EMA_ROWS)
    c = F.col("close")
    s = s.withColumn("returns", fr.pct_change(c))
    s = s.withColumn("volatility", fr.std_n(F.col("returns"), 20))
    s = ind.add_rsi(ind.add_sma(s, (20, 50)))
    s = s.withColumns({
        "volume_ratio": div(F.col("volume"), fr.mean_n(F.col("volume"), 20)), "high_low_ratio": div(F.col("high"), F.col("low")),
        "close_position": div(c - F.col("low"), F.col("high") - F.col("low")),
    })
    for h in horizons:
        s = s.withColumn(f"target_return_{h}d", div(F.lead(c, h).over(fr.over()), c) - 1)
        s = s.withColumn(f"target_direction_{h}d", F.coalesce((F.col(f"target_return_{h}d") > 0).cast("int"), F.lit(0)))
    s = ewm_stretch(s, reach)
    s = s.withColumns({"ema_12": ewm_mean(c, span_alpha(12), reach), "ema_26": ewm_mean(c, span_alpha(26), reach)})
    s = s.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES})
    return fr.own(s).drop("_k", "_e")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vectors of all rows; a missing or NaN feature counts as 0, as in the feature table, and no row is left out."""
    filled = {f"_in_{i}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for i, f in enumerate(features)}
    return VectorAssembler(inputCols=list(filled), outputCol=out, handleInvalid="error").transform(df.withColumns(filled)).drop(*filled)


@contextmanager
def held_for_training(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """These columns of all rows, dealt evenly over the cores and held while models are fitted on them.

    A fit reads its rows once a level and more; from files they would be computed anew each time, in as few tasks as the files have blocks.
    Rows are sorted within a task, for what a tree draws depends on their order.
    """
    rows = tr.dealt(df.select(*dict.fromkeys(columns))).sortWithinPartitions(*dict.fromkeys(columns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def fitted(est: Estimator, train: DataFrame, label: str, features: Sequence[str]) -> Model:
    with held_for_training(train, [*features, label]) as rows:
        return est.fit(assemble(rows, features))


def forest_classifier(train: DataFrame, score: DataFrame, label: str, features: Sequence[str] = FEATURES, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Direction with the entropy of the mean class probabilities as uncertainty."""
    m = fitted(RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed), train, label, features)
    return tr.scored(score, tr.flatten(m, train.sparkSession, classes=True), features, "class")


def forest_regressor(train: DataFrame, score: DataFrame, label: str, features: Sequence[str] = FEATURES, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Expected value with the deviation over the single trees as uncertainty."""
    m = fitted(RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed), train, label, features)
    return tr.scored(score, tr.flatten(m, train.sparkSession), features, "mean")


def boosted(train: DataFrame, score: DataFrame, label: str, features: Sequence[str] = FEATURES, rounds: int = 50, depth: int = 5, classify: bool = False, seed: int = 42) -> DataFrame:
    """Boosted trees: the weighted sum, or for classes whether it is positive."""
    est = (GBTClassifier if classify else GBTRegressor)(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    m = fitted(est, train, label, features)
    return tr.scored(score, tr.flatten(m, train.sparkSession), features, "sign" if classify else "sum").drop("uncertainty")


def time_folds(df: DataFrame, k: int, ts: str = "ts") -> DataFrame:
    """Fold 1..k by the order of the distinct dates (a calendar-sized table)."""
    dates = df.select(ts).distinct().withColumn("fold", F.ntile(k).over(Window.orderBy(ts)))
    return df.join(dates, ts)


def cross_validate(df: DataFrame, label: str, features: Sequence[str], k: int = 4, penalty: float = 0.1) -> DataFrame:
    """(fold, rows, mse) of every fold from the second on: the ridge of all earlier folds, its error on the fold. One scan for all folds."""
    found = lm.gather(time_folds(df.filter(F.col(label).isNotNull()), k), features, label, F.col("fold"))
    return df.sparkSession.createDataFrame(lm.expanding_errors(found, penalty), "fold int, rows long, mse double")


# Ensembles -----------------------------------------------------------------------------------------------------

def _share(x: Column, keys: Sequence[str]) -> Column:
    return div(x, F.sum(x).over(Window.partitionBy(*keys)))


def ensemble_weights(perf: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Accuracy, or 1 / (1 + mse), at least 0.1, normalised over the models of a key; 0.5 without performance."""
    raw = F.when(F.col("is_direction"), F.greatest(F.lit(0.1), F.coalesce("accuracy", F.lit(0.5)))).when(F.col("mse").isNotNull(), F.greatest(F.lit(0.1), 1.0 / (1.0 + F.col("mse")))).otherwise(0.5)
    return perf.withColumn("_w", raw).withColumn("weight", _share(F.col("_w"), keys)).drop("_w")


def fold_score_weights(scores: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Mean fold accuracy, or 1 / (mean mse + 1e-8), normalised over the models of a key."""
    g = scores.groupBy(*keys, "model").agg(F.avg("score").alias("_s"), F.max("is_direction").alias("_d"))
    return g.withColumn("_w", F.when(F.col("_d"), F.col("_s")).otherwise(1.0 / (F.col("_s") + 1e-8))).withColumn("weight", _share(F.col("_w"), keys)).drop("_w", "_s", "_d")


def ensemble_predict(preds: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted prediction, root of the summed squared weighted uncertainties, confidence of at least 0.1."""
    j = preds.join(weights.select("model", "weight"), "model")
    g = j.groupBy(*keys).agg(F.sum(F.col("predicted") * F.col("weight")).alias("prediction"), F.sqrt(F.sum((F.col("uncertainty") * F.col("weight")) ** 2)).alias("uncertainty"))
    return g.withColumn("confidence", F.greatest(F.lit(0.1), 1.0 / (1.0 + F.col("uncertainty"))))


def smooth_weights(old: DataFrame, perf: DataFrame) -> DataFrame:
    """0.7 old + 0.3 share of the new performance; models without one keep their weight."""
    total = perf.agg(F.sum("performance")).scalar()
    j = old.join(perf, "model", "left")
    fresh = 0.7 * F.col("weight") + 0.3 * F.col("performance") / total
    return j.select("model", F.when((total > 0) & F.col("performance").isNotNull(), fresh).otherwise(F.col("weight")).alias("weight"))


def stacked(train: DataFrame, label: str, models: dict[str, tuple[Sequence[str], float]], key: str, k: int = 3, fold: Column | None = None) -> DataFrame:
    """Rows with a label, the out-of-fold prediction of every base model, the second stage over them, and the blend by fold-score weights.

    `models`: name to (columns, penalty). Folds are by key hash unless given. All models come from one aggregate.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(k)) if fold is None else fold
    d = train.filter(F.col(label).isNotNull())
    features = list(dict.fromkeys(f for own, _ in models.values() for f in own))
    return lm.score_ensemble(d, lm.ensemble(lm.gather(d, features, label, fold), features, models), fold)


def walk_forward(returns: DataFrame, origin: str, train_days: int = 180, test_days: int = 60, expanding: bool = False) -> DataFrame:
    """Trading measures of every test window. A row finds its window by arithmetic on its date: no range join."""
    day = F.datediff(F.col("ts"), F.lit(origin).cast("date"))
    w = F.floor((day - train_days) / test_days)
    t = returns.withColumn("window", w).filter(F.col("window") >= 0)
    m = trading_metrics(t, ("symbol", "window"))
    start = F.lit(0) if expanding else F.col("window") * test_days
    return m.withColumns({"train_from": start, "train_to": F.col("window") * test_days + train_days})


# Importance ----------------------------------------------------------------------------------------------------

def coefficient_importance(coefs: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Absolute coefficient over the total; equal shares when all are zero."""
    w = Window.partitionBy(*keys)
    share = div(F.abs("coefficient"), F.sum(F.abs("coefficient")).over(w))
    return coefs.withColumn("importance", F.coalesce(share, 1.0 / F.count(F.lit(1)).over(w)))


def mean_importance(importance: DataFrame) -> DataFrame:
    """Mean over models, normalised; equal shares when nothing is known."""
    g = importance.groupBy("feature").agg(F.avg("importance").alias("_i"))
    w = Window.partitionBy(F.lit(0))
    return g.select("feature", F.coalesce(div(F.col("_i"), F.sum("_i").over(w)), 1.0 / F.count(F.lit(1)).over(w)).alias("importance"))


def _ranked(df: DataFrame, key: str, seed: str, keep: Sequence[str]) -> DataFrame:
    """Rows numbered in a seeded pseudo-random order; numbers come from block counts over hash prefixes."""
    d = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).withColumn("_one", F.lit(0))
    kw = {"keys": ("_one",), "order": ("_h", key)}
    c = fr.carried(d, {"n": (F.sum, F.lit(1))}, block=F.substring("_h", 1, 3), **kw)
    pos = F.col("_off") + F.row_number().over(Window.partitionBy("_one", "_block").orderBy("_h", key))
    return c.withColumn("_r", pos).select("_r", *keep)


def permutation_importance(df: DataFrame, key: str, coefs: dict[str, float]) -> DataFrame:
    """Rise of the mean squared prediction of a linear model when one column is permuted, floored at 0, normalised."""
    cols = list(coefs)
    pred = lambda c: sum((F.col(x) * w for x, w in c.items()), F.lit(0.0))
    base = df.agg(F.avg(pred(coefs) ** 2)).scalar()
    out = None
    for c in cols:
        a = _ranked(df, key, f"a{c}", cols)
        b = _ranked(df, key, f"b{c}", [c]).withColumnRenamed(c, "_x")
        p = a.join(b, "_r").withColumn(c, F.col("_x"))
        row = p.agg(F.lit(c).alias("feature"), F.greatest(F.lit(0.0), F.avg(pred(coefs) ** 2) - base).alias("raw"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("importance", F.coalesce(div(F.col("raw"), F.sum("raw").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


# Feature cleaning and selection --------------------------------------------------------------------------------

def clean_features(df: DataFrame, cols: Sequence[str], most_null: float = 0.5, limit: float = 0.95) -> DataFrame:
    """One row per column: null share, highest correlation with an earlier kept-by-nulls column, and whether it stays.

    Gaps are filled forward per symbol, then with 0. Correlations of all pairs come from one aggregate.
    """
    shares = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in cols]).first()
    valid = [c for c in cols if shares[c] <= most_null]
    filled = rel.align_features([df.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in valid])])
    pairs = [(a, b) for i, a in enumerate(valid) for b in valid[i + 1:]]
    g = filled.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(float(shares[c])).alias("null_share"),
                     (F.greatest(F.lit(0.0), *[F.coalesce(F.col(f"`{a}|{b}`"), F.lit(0.0)) for a, b in pairs if b == c]) if any(b == c for _, b in pairs) else F.lit(0.0)).alias("highest_corr"),
                     F.lit(c in valid).alias("_v")) for c in cols]
    x = g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return x.withColumn("kept", F.col("_v") & (F.col("highest_corr") <= limit)).drop("_v")


def correlation_selection(df: DataFrame, cols: Sequence[str], target: str, threshold: float = 0.1, most: int = 100) -> DataFrame:
    """Absolute correlation of every feature with the target; those at the threshold, best first, at most ``most``."""
    g = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in cols])
    g = g.unpivot([], list(cols), "feature", "score")
    return g.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "feature").limit(most)


def f_test_selection(df: DataFrame, cols: Sequence[str], target: str, k: int) -> DataFrame:
    """k features with the highest F statistic against a class target, by name where equal."""
    found = sorted(lm.analysis_of_variance(df, cols, target).items(), key=lambda x: (-x[1], x[0]))[:k]
    return df.sparkSession.createDataFrame(found, "feature string, score double")


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10, by_rank: bool = False) -> DataFrame:
    """Mutual information of every binned feature with a class target, from joint counts.

    Bins are of equal width, or, `by_rank`, between exact quantiles: a value stands in the bin of the first edge that it is not above, so
    equal values share a bin and a rare extreme does not squeeze the others into one. A feature without a value stands in the first bin.
    """
    if by_rank:
        q = fr.exact_quantiles(df, [], list(cols), [i / bins for i in range(1, bins)])
        edges = q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("quantiles"))).alias(c) for c in cols]).select(F.struct("*")).scalar()
        binned = {c: sum((F.when(F.col(c) > edges[c][i], 1).otherwise(0) for i in range(bins - 1)), F.lit(0)) for c in cols}
    else:
        lim = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
        s = lim.select(F.struct("*")).scalar()
        binned = {c: F.coalesce(F.least(F.floor(div((F.col(c) - s[f"lo_{c}"]) * bins, s[f"hi_{c}"] - s[f"lo_{c}"])), F.lit(bins - 1)), F.lit(0)) for c in cols}
    d = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), *[x.cast("bigint").alias(c) for c, x in binned.items()])
    j = d.unpivot(["y"], list(cols), "feature", "bin").groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")
    n = F.sum("n").over(wf)
    px, py = F.sum("n").over(Window.partitionBy("feature", "bin")), F.sum("n").over(Window.partitionBy("feature", "y"))
    return j.withColumn("_t", F.col("n") / n * F.ln(F.col("n") * n / (px * py))).groupBy("feature").agg(F.sum("_t").alias("score"))


def lasso_selection(df: DataFrame, cols: Sequence[str], target: str, fold: Column, least: float = 0.0) -> tuple[DataFrame, lm.Linear, float]:
    """Features whose lasso coefficient is over `least` in size, largest first; with the model and its cross-validated penalty."""
    model, penalty = lm.cross_validated_lasso(lm.gather(df, cols, target, fold))
    found = sorted(((c, abs(float(b))) for c, b in zip(cols, model.coefficients, strict=True) if abs(b) > least), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(found, "feature string, score double"), model, penalty


def lasso_conditions(df: DataFrame, cols: Sequence[str], target: str, model: lm.Linear, penalty: float, tolerance: float = 1e-7) -> DataFrame:
    """(feature, optimal): whether the slope of the error along each coefficient is what the penalty allows, counted on the rows."""
    d = df.filter(F.col(target).isNotNull()).select(*[lm.number(c).alias(c) for c in cols], (F.col(target).cast("double") - model.column(cols)).alias("_rest"))
    g = d.agg(*[F.covar_pop(c, "_rest").alias(c) for c in cols], F.stddev_pop("_rest").alias("_s"), *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    rows = []
    for i, (c, b) in enumerate(zip(cols, model.coefficients, strict=True)):
        slack = tolerance * (F.col("_s") * F.col(f"_s{i}") + penalty)
        fine = F.abs(F.col(c)) <= penalty + slack if b == 0 else F.abs(F.col(c) - float(np.sign(b)) * penalty) <= slack
        rows.append(F.struct(F.lit(c).alias("feature"), fine.alias("optimal")))
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def forest_importance(df: DataFrame, cols: Sequence[str], target: str, classify: bool = False, trees: int = 50, depth: int = 5, seed: int = 42) -> dict[str, float]:
    est = (RandomForestClassifier if classify else RandomForestRegressor)(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)
    m = fitted(est, df.filter(F.col(target).isNotNull()), target, cols)
    return dict(zip(cols, map(float, m.featureImportances.toArray()), strict=True))


def forest_selection(df: DataFrame, cols: Sequence[str], target: str, k: int, **how: int) -> DataFrame:
    """The k features of highest forest importance."""
    found = sorted(forest_importance(df, cols, target, **how).items(), key=lambda x: (-x[1], x[0]))[:k]
    return df.sparkSession.createDataFrame(found, "feature string, score double")


def recursive_elimination(df: DataFrame, cols: Sequence[str], target: str, fold: Column, folds: int = 3, classify: bool = False, trees: int = 50, depth: int = 5, seed: int = 42) -> DataFrame:
    """(feature, rank, kept): the weakest by forest importance goes, one a round; as many stay as have the lowest error on folds left out.

    Each fold eliminates by its own training rows; the number with the best mean score decides, fewer features where equal. `rank` is 1
    for kept features, then the order in which the others went, last out first.
    """
    d = df.filter(F.col(target).isNotNull()).select(*[lm.number(c).alias(c) for c in cols], F.col(target), fold.cast("int").alias("_fold"))
    y = F.col(target).cast("double")
    est = RandomForestClassifier if classify else RandomForestRegressor

    def rounds(train: DataFrame, test: DataFrame | None) -> tuple[list[str], dict[int, float]]:
        left, out, errors = list(cols), [], {}
        while left:
            m = est(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(assemble(train, left))
            if test is not None:
                s = tr.scored(test, tr.flatten(m, df.sparkSession, classes=classify), left, "class" if classify else "mean")
                wrong = (F.col("prediction") != y).cast("double") if classify else (F.col("prediction") - y) ** 2
                errors[len(left)] = s.agg(F.avg(wrong)).first()[0] or 0.0
            weight = dict(zip(left, m.featureImportances.toArray(), strict=True))
            out.append(min(left, key=lambda c: (weight[c], c)))
            left.remove(out[-1])
        return out, errors

    with held_for_training(d, d.columns) as d:
        scores = [rounds(d.filter(F.col("_fold") != f), d.filter(F.col("_fold") == f))[1] for f in range(folds)]
        best = min(range(1, len(cols) + 1), key=lambda n: (sum(s[n] for s in scores), n))
        order = rounds(d, None)[0][::-1]
    rows = [(c, 1 if i < best else i - best + 2, i < best) for i, c in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, kept boolean")


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, one aggregate for all columns."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).select(F.struct("*")).scalar()
    return df.withColumns({f"{c}_scaled": div(F.col(c) - s[f"m_{c}"], s[f"s_{c}"]) for c in cols})


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range with exact quantiles, two scans for all columns."""
    q = fr.exact_quantiles(df, [], cols, (0.25, 0.5, 0.75))
    s = q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("quantiles"))).alias(c) for c in cols]).select(F.struct("*")).scalar()
    return df.withColumns({f"{c}_robust": div(F.col(c) - s[c][1], s[c][2] - s[c][0]) for c in cols})


# Drift ---------------------------------------------------------------------------------------------------------

def ks_statistics(reference: DataFrame, current: DataFrame, least: int = 10) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per common numeric column.

    Values are counted per side, and both distribution functions run over equally full ranges of values, so no column is ordered in one task.
    """
    long = rel.common_numeric_long(reference, current).filter(F.col("value").isNotNull())
    c = long.groupBy("column_name", "value").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    kw = {"keys": ("column_name",), "order": ("value",)}
    cnt = {k: F.col(k).cast("double") for k in ("a", "b")}
    tot = c.groupBy("column_name").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    c = fr.value_blocks(c, ["column_name"], "value")
    d = fr.carried(c, {k: (F.sum, x) for k, x in cnt.items()}, block=F.col("_part"), **kw)
    d = d.withColumns({f"_r{k}": fr.running_sum(k, x, **kw) for k, x in cnt.items()}).join(tot, "column_name")
    d = d.filter((F.col("_na") >= least) & (F.col("_nb") >= least))
    return d.groupBy("column_name").agg(F.max(F.abs(F.col("_ra") / F.col("_na") - F.col("_rb") / F.col("_nb"))).alias("ks"))


def moment_shift(reference: DataFrame, current: DataFrame, least: int = 10) -> DataFrame:
    """Mean of the standardised shift of mean and deviation per common numeric column."""
    g = rel.common_numeric_long(reference, current).groupBy("column_name").agg(*[
        f(F.when(F.col("side") == s, F.col("value"))).alias(f"{n}{s}") for s in ("a", "b") for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    g = g.filter((F.col("na") >= least) & (F.col("nb") >= least))
    base = F.col("sa") + 1e-8
    return g.select("column_name", ((F.abs(F.col("ma") - F.col("mb")) / base + F.abs(F.col("sa") - F.col("sb")) / base) / 2).alias("shift"))


def mean_vector_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """1 - |correlation| of the column means; 1 when it is undefined."""
    g = rel.common_numeric_long(reference, current).groupBy("column_name").agg(*[F.avg(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("a", "b")])
    return g.agg(F.coalesce(1 - F.abs(F.corr("a", "b")), F.lit(1.0)).alias("drift_score"))


def drift_decision(per_column: DataFrame, score: str, n_reference: Column, n_current: Column, threshold: float = 0.15, least: int = 100) -> DataFrame:
    """Mean score and decision; without enough samples on both sides there is no drift."""
    g = per_column.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("_s"))
    enough = (n_reference >= least) & (n_current >= least)
    g = g.withColumn("drift_score", F.when(enough, F.col("_s")).otherwise(0.0))
    return g.select("drift_score", (F.col("drift_score") > threshold).alias("drift_detected"), F.when(enough, "ok").otherwise("insufficient_data").alias("status"))

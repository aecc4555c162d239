"""Model queries. Linear models have the same normal equations in SQL; forests and the lasso are compared by facts that any right result has."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.operators import ml
from tapeloom.plans.fragments import P, ewm_list, frame, lagged, roll
from tapeloom.plans.on_windows import RSI_CTE, rsi_sql
from tapeloom.plans.registry import Query

QUERIES: list[Query] = []
Y = repr(math.sqrt(252.0))


def q(key, plan, out, sql=None):
    QUERIES.append(Query(key, plan, out, sql))


FT = f"""WITH a AS (SELECT symbol, ts, {rsi_sql(14)} AS rsi FROM ({RSI_CTE}) y), r AS (SELECT *, close / {lagged()} - 1 AS r FROM bars),
l AS (SELECT symbol, ts, {ewm_list('xa', 2 / 13)} AS ema_12, {ewm_list('xb', 2 / 27)} AS ema_26 FROM (SELECT symbol, ts, list(close) OVER {frame(230)} AS xa, list(close) OVER {frame(480)} AS xb FROM bars) z),
b AS (SELECT symbol, ts, r AS returns, {roll('stddev_samp', 'r', 20)} AS volatility, {roll('avg', 'close', 20)} AS sma_20, {roll('avg', 'close', 50)} AS sma_50, volume / ({roll('avg', 'volume', 20)}) AS volume_ratio,
 (close - low) / nullif(high - low, 0) AS close_position, lead(close, 5) OVER ({P}) / close - 1 AS target_return_5d FROM r)
SELECT b.symbol, b.ts, coalesce(returns, 0) AS returns, coalesce(volatility, 0) AS volatility, coalesce(sma_50, 0) AS sma_50, ema_12, ema_26, coalesce(a.rsi, 0) AS rsi, coalesce(volume_ratio, 0) AS volume_ratio, coalesce(close_position, 0) AS close_position,
 target_return_5d, CASE WHEN target_return_5d > 0 THEN 1 ELSE 0 END AS target_direction_5d FROM b JOIN a ON a.symbol = b.symbol AND a.ts = b.ts JOIN l ON l.symbol = b.symbol AND l.ts = b.ts"""
q("m01_feature_table", lambda t: ml.feature_table(t.bars()), "symbol ts returns:6 volatility:5 sma_50:3 ema_12:3 ema_26:3 rsi:4 volume_ratio:6 close_position:6 target_return_5d:6 target_direction_5d:l", FT)
FEW = ("rsi", "iv", "volatility", "momentum_score", "sentiment")
numeric = lambda t: t.feats().withColumn("value_", F.col("expected_return") + F.col("sentiment") / 4).withColumn("up", (F.col("prediction") > 0).cast("int")).drop("prediction")
split = lambda t: (numeric(t).filter("event_id % 4 <> 0"), numeric(t).filter("event_id % 4 = 0"))
HELD = "SELECT event_id, {} FROM feats WHERE event_id % 4 = 0"


def judged(model, t):
    """Rows not trained on with what every tree model must keep to: predictions near the labels' range, and on its own rows an error below that of their mean."""
    train, test = split(t)
    known = train.agg(F.min("value_"), F.max("value_"), F.var_pop("value_")).first()
    s = model(train, numeric(t), "value_", FEW)
    own = s.filter("event_id % 4 <> 0").agg(F.avg((F.col("prediction") - F.col("value_")) ** 2) < known[2]).scalar()
    return s.filter("event_id % 4 = 0").withColumns({"beats_mean": own, "gap": F.greatest(F.col("prediction") - known[1], known[0] - F.col("prediction")) / (known[1] - known[0])})


def direction(t):
    train, test = split(t)
    s = ml.forest_classifier(train, test, "up", FEW)
    return s.withColumns({"is_class": F.col("prediction").isin(0.0, 1.0), "entropy_fits": F.col("uncertainty").between(0.0, math.log(2) + 1e-9), "label": F.col("up")})


def target(t):
    return judged(ml.forest_regressor, t).withColumns({"in_range": F.col("gap") <= 1e-9, "deviates": F.col("uncertainty") >= 0})


q("m02_forest_direction", direction, "event_id:l is_class:b entropy_fits:b label:l", HELD.format("true AS is_class, true AS entropy_fits, CASE WHEN prediction > 0 THEN 1 ELSE 0 END AS label"))
q("m02_forest_target", target, "event_id:l in_range:b beats_mean:b deviates:b", HELD.format("true AS in_range, true AS beats_mean, true AS deviates"))
q("m03_boosted_trees", lambda t: judged(ml.boosted, t).withColumn("in_range", F.col("gap") <= 1), "event_id:l in_range:b beats_mean:b", HELD.format("true AS in_range, true AS beats_mean"))
q("m04_time_folds", lambda t: ml.time_folds(t.bars().select("symbol", "ts"), 5), "symbol ts fold:l", "SELECT symbol, b.ts, fold FROM bars b JOIN (SELECT ts, ntile(5) OVER (ORDER BY ts) AS fold FROM (SELECT DISTINCT ts FROM bars) d) f ON b.ts = f.ts")


def moments_sql(features, label, source, where, group):
    """One row: means and population covariances of the features and the label over the rows of `source`."""
    cols = [*features, label]
    parts = [f"avg({c}) AS m{i}" for i, c in enumerate(cols)]
    parts += [f"covar_pop({cols[i]}, {cols[j]}) AS c{i}_{j}" for i in range(len(features)) for j in range(i, len(cols))]
    return f"SELECT {group} AS g, {', '.join(parts)} FROM {source} WHERE {where}"


def solved_sql(moments, n, penalty):
    """g, b0 .. b<n-1> and the intercept a of the ridge for each row of moments, by elimination."""
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    first = ", ".join(f"{c(i, j)}{f' * {1 + penalty}' if i == j else ''} AS a{i}_{j}" for i in range(n) for j in range(n + 1))
    means = ", ".join(f"m{i}" for i in range(n + 1))
    sql = f"SELECT g, {means}, {first} FROM ({moments}) z"
    for k in range(n):
        cells = ", ".join(f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(n) for j in range(k + 1, n + 1))
        sql = f"SELECT g, {means}, {cells} FROM ({sql}) z"
    b = ", ".join(f"a{i}_{n} AS b{i}" for i in range(n))
    return f"SELECT g, {b}, m{n} - ({' + '.join(f'a{i}_{n} * m{i}' for i in range(n))}) AS a FROM ({sql}) z"


def predicted(features, model):
    return " + ".join([f"{model}.a", *(f"{model}.b{i} * {f}" for i, f in enumerate(features))])


VALUED = "SELECT *, expected_return + sentiment / 4 AS value_ FROM feats"
q("m04_cross_validation", lambda t: ml.cross_validate(numeric(t), "value_", FEW, 4), "fold:l rows:l mse:5", f"""
WITH d AS (SELECT v.*, fold FROM ({VALUED}) v JOIN (SELECT ts, ntile(4) OVER (ORDER BY ts) AS fold FROM (SELECT DISTINCT ts FROM feats) x) f ON v.ts = f.ts),
m AS ({solved_sql(' UNION ALL '.join(moments_sql(FEW, 'value_', 'd', f'fold < {i}', i) for i in (2, 3, 4)), len(FEW), 0.1)})
SELECT fold, count(*) AS rows, avg(pow({predicted(FEW, 'm')} - value_, 2)) AS mse FROM d JOIN m ON d.fold = m.g GROUP BY 1""")
perf = lambda t: t.runs().groupBy(F.col("condition").alias("target"), "model").agg(F.avg("accuracy").alias("accuracy"), F.avg(F.col("latency") / 10).alias("mse")).withColumn("is_direction", F.col("target") == "C0")
PERF = "SELECT condition AS target, model, avg(accuracy) AS accuracy, avg(latency / 10) AS mse, condition = 'C0' AS is_direction FROM runs GROUP BY 1, 2"
WTS = f"SELECT target, model, w / sum(w) OVER (PARTITION BY target) AS weight FROM (SELECT *, CASE WHEN is_direction THEN greatest(0.1, accuracy) ELSE greatest(0.1, 1 / (1 + mse)) END AS w FROM ({PERF}) p) x"
q("m05_ensemble_weights", lambda t: ml.ensemble_weights(perf(t)), "target model weight:6", WTS)
pw = lambda t: ml.ensemble_weights(perf(t).filter("target = 'C1'"))
q("m06_ensemble_predict", lambda t: ml.ensemble_predict(t.predictions().withColumn("day", F.to_date("ts")).withColumn("uncertainty", 1 - F.col("confidence")), pw(t), ["day"]), "day prediction:3 uncertainty:5 confidence:5", f"""
SELECT day, p AS prediction, u AS uncertainty, greatest(0.1, 1 / (1 + u)) AS confidence FROM (SELECT CAST(ts AS DATE) AS day, sum(predicted * weight) AS p, sqrt(sum(((1 - confidence) * weight) ** 2)) AS u
 FROM predictions p JOIN ({WTS}) w ON p.model = w.model AND target = 'C1' GROUP BY 1) x""")
q("m07_smooth_weights", lambda t: ml.smooth_weights(pw(t).select("model", "weight"), t.runs().filter("model <> 'error'").groupBy("model").agg(F.avg("accuracy").alias("performance"))), "model weight:6", f"""
WITH p AS (SELECT model, avg(accuracy) AS a FROM runs WHERE model <> 'error' GROUP BY 1) SELECT w.model, CASE WHEN a IS NULL THEN weight ELSE 0.7 * weight + 0.3 * a / (SELECT sum(a) FROM p) END AS weight FROM ({WTS}) w LEFT JOIN p ON w.model = p.model WHERE target = 'C1'""")
CL = ("price", "volume", "twice", "mostly_null")
messy = lambda t: t.quotes().select("symbol", F.col("quote_id").alias("ts"), "price", "volume", (F.col("volume") * 2.0 + F.col("quote_id") % 7).alias("twice"), F.when(F.col("quote_id") % 3 == 0, 1.0).alias("mostly_null"))


def cleaned(t):
    d = messy(t).withColumn("ts", F.timestamp_seconds(F.col("ts") * 3600).cast("timestamp_ntz"))
    return ml.clean_features(d, CL)


FILL = lambda c, e: f"coalesce(last_value({e} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY quote_id), 0) AS {c}"
q("m08_clean_features", cleaned, "column_name null_share:5 highest_corr:4 kept:b", f"""
WITH f AS (SELECT {FILL('p', 'price')}, {FILL('v', 'volume')}, {FILL('w', '(volume * 2 + quote_id % 7)')} FROM quotes), n AS (SELECT avg(CASE WHEN price IS NULL THEN 1e0 ELSE 0e0 END) AS np, avg(CASE WHEN volume IS NULL THEN 1e0 ELSE 0e0 END) AS nv, avg(CASE WHEN quote_id % 3 <> 0 THEN 1e0 ELSE 0e0 END) AS nm FROM quotes),
c AS (SELECT abs(corr(p, v)) AS pv, abs(corr(p, w)) AS pw, abs(corr(v, w)) AS vw FROM f)
SELECT 'price' AS column_name, np AS null_share, 0 AS highest_corr, true AS kept FROM n UNION ALL SELECT 'volume', nv, pv, pv <= 0.95 FROM n, c UNION ALL SELECT 'twice', nv, greatest(pw, vw), greatest(pw, vw) <= 0.95 FROM n, c UNION ALL SELECT 'mostly_null', nm, 0, false FROM n""")
q("m09_correlation_selection", lambda t: ml.correlation_selection(numeric(t), FEW, "value_", 0.01), "feature score:5", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, expected_return + sentiment / 4)) AS score FROM feats HAVING abs(corr({f}, expected_return + sentiment / 4)) >= 0.01" for f in FEW))
ANOVA = lambda f: f"""SELECT '{f}' AS feature, sum(n * pow(m - w, 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (
 SELECT CASE WHEN prediction > 0 THEN 1 ELSE 0 END AS up, count(*)::DOUBLE AS n, avg({f}) AS m, var_pop({f}) AS v FROM feats GROUP BY 1) c, (SELECT avg({f}) AS w FROM feats) a"""  # noqa: E731
q("m10_f_test_selection", lambda t: ml.f_test_selection(numeric(t), list(FEW), "up", 3), "feature score:3", "SELECT * FROM (" + " UNION ALL ".join(ANOVA(f) for f in FEW) + ") x ORDER BY score DESC LIMIT 3")
MI = lambda f: f"""SELECT '{f}' AS feature, sum(n / tot * ln(n * tot / (px * py))) AS score FROM (SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY b) AS px, sum(n) OVER (PARTITION BY y) AS py FROM (
 SELECT least(floor(({f} - lo) * 10 / (hi - lo)), 9) AS b, CASE WHEN prediction > 0 THEN 1 ELSE 0 END AS y, count(*)::DOUBLE AS n FROM feats, (SELECT min({f}) AS lo, max({f}) AS hi FROM feats) m GROUP BY 1, 2) a) b"""  # noqa: E731
q("m11_mutual_information", lambda t: ml.mutual_information(numeric(t), FEW, "up"), "feature score:6", " UNION ALL ".join(MI(f) for f in FEW))
MIQ = lambda f: f"""SELECT '{f}' AS feature, sum(n / tot * ln(n * tot / (px * py))) AS score FROM (SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY b) AS px, sum(n) OVER (PARTITION BY y) AS py FROM (
 SELECT len(list_filter(edges, lambda e: e < {f})) AS b, CASE WHEN prediction > 0 THEN 1 ELSE 0 END AS y, count(*)::DOUBLE AS n FROM feats, (SELECT quantile_cont({f}::DOUBLE, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS edges FROM feats) m GROUP BY 1, 2) a) b"""  # noqa: E731
q("m11_information_by_rank", lambda t: ml.mutual_information(numeric(t), FEW, "up", by_rank=True), "feature score:6", " UNION ALL ".join(MIQ(f) for f in FEW))
FOLD = "event_id % 3"


def lasso(t):
    d = numeric(t)
    found, model, penalty = ml.lasso_selection(d, FEW, "value_", F.expr(FOLD))
    on_path = float(max(abs(m) for m in ml.lm.total(ml.lm.gather(d, FEW, "value_", F.expr(FOLD)).values(), len(FEW) + 1).products[:-1, -1])) / d.count()
    facts = ml.lasso_conditions(d, FEW, "value_", model, penalty)
    return facts.join(found, "feature", "left").withColumns({"highest_penalty": F.lit(on_path), "penalty_fits": F.lit(on_path * 1e-3 * (1 - 1e-9) <= penalty <= on_path * (1 + 1e-9))})


def forest(t):
    s = ml.forest_selection(numeric(t), FEW, "value_", 3)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("feature").alias("features"), F.min(F.col("score").between(0, 1)).alias("shares"), (F.sum("score") <= 1 + 1e-9).alias("at_most_one"), F.max(F.col("feature").isin("sentiment")).alias("has_sentiment"))


def elimination(t):
    s = ml.recursive_elimination(numeric(t), FEW, "value_", F.expr(FOLD), trees=20)
    return s.select("feature", F.col("rank").between(1, len(FEW)).alias("ranked"), (F.col("kept") == (F.col("rank") == 1)).alias("consistent"), F.when(F.col("feature") == "sentiment", F.col("kept")).alias("sentiment_kept"))


EACH = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in FEW)
q("m12_selection_lasso", lasso, "feature optimal:b highest_penalty:5 penalty_fits:b", f"SELECT feature, true AS optimal, greatest({', '.join(f'abs(covar_pop({f}, value_))' for f in FEW)}) AS highest_penalty, true AS penalty_fits FROM ({VALUED}) v, ({EACH}) e GROUP BY feature")
q("m12_selection_forest", forest, "rows:l features:l shares:b at_most_one:b has_sentiment:b", "SELECT 3 AS rows, 3 AS features, true AS shares, true AS at_most_one, true AS has_sentiment")
q("m12_selection_elimination", elimination, "feature ranked:b consistent:b sentiment_kept:b", f"SELECT feature, true AS ranked, true AS consistent, CASE WHEN feature = 'sentiment' THEN true END AS sentiment_kept FROM ({EACH}) e")
q("m13_standard_scale", lambda t: ml.standard_scale(t.feats(), ("rsi", "premium")), "event_id:l rsi_scaled:5 premium_scaled:5", """
SELECT event_id, (rsi - m1) / s1 AS rsi_scaled, (premium - m2) / s2 AS premium_scaled FROM feats, (SELECT avg(rsi) AS m1, stddev_pop(rsi) AS s1, avg(premium) AS m2, stddev_pop(premium) AS s2 FROM feats) x""")
q("m13_robust_scale", lambda t: ml.robust_scale(t.feats(), ("rsi", "premium")), "event_id:l rsi_robust:5 premium_robust:5", """
SELECT event_id, (rsi - b1) / (c1 - a1) AS rsi_robust, (premium - b2) / (c2 - a2) AS premium_robust FROM feats, (SELECT quantile_cont(rsi, 0.25) AS a1, quantile_cont(rsi, 0.5) AS b1, quantile_cont(rsi, 0.75) AS c1,
 quantile_cont(premium, 0.25) AS a2, quantile_cont(premium, 0.5) AS b2, quantile_cont(premium, 0.75) AS c2 FROM feats) x""")
RK = lambda s: f"row_number() OVER (ORDER BY md5(concat(CAST(event_id AS VARCHAR), '{s}')), event_id)"
CO = {"iv": 2.0, "sentiment": -0.5, "premium": 0.1}
PRED = " + ".join(f"{c} * {w}" for c, w in CO.items())
PERM = lambda c: f"""SELECT '{c}' AS feature, greatest(0, avg(pow({' + '.join((f"b.x * {w}" if k == c else f"a.{k} * {w}") for k, w in CO.items())}, 2)) - (SELECT avg(pow({PRED}, 2)) FROM feats)) AS raw
 FROM (SELECT *, {RK('a' + c)} AS r FROM feats) a JOIN (SELECT {c} AS x, {RK('b' + c)} AS r FROM feats) b ON a.r = b.r"""  # noqa: E731
q("m14_permutation_importance", lambda t: ml.permutation_importance(t.feats().select("event_id", *CO), "event_id", CO), "feature importance:5", "SELECT feature, raw / sum(raw) OVER () AS importance FROM (" + " UNION ALL ".join(PERM(c) for c in CO) + ") x")
halves = lambda t: [t.quotes().filter(c).select("price", "volume") for c in ("ts < '1997-06-01'", "ts >= '1997-06-01'")]
SIDE = "SELECT price, volume, ts < TIMESTAMP '1997-06-01' AS a FROM quotes"
KS = lambda c: f"""SELECT '{c}' AS column_name, max(abs(ra / na - rb / nb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM (
 SELECT {c} AS v, count(CASE WHEN a THEN 1 END)::DOUBLE AS a, count(CASE WHEN NOT a THEN 1 END)::DOUBLE AS b FROM ({SIDE}) s WHERE {c} IS NOT NULL GROUP BY 1) x) y"""  # noqa: E731
q("m15_ks_drift", lambda t: ml.ks_statistics(*halves(t)), "column_name ks:6", f"{KS('price')} UNION ALL {KS('volume')}")
SH = lambda c: f"SELECT '{c}' AS column_name, (abs(ma - mb) / (sa + 1e-8) + abs(sa - sb) / (sa + 1e-8)) / 2 AS shift FROM (SELECT avg(CASE WHEN a THEN {c} END) AS ma, avg(CASE WHEN NOT a THEN {c} END) AS mb, stddev_samp(CASE WHEN a THEN {c} END) AS sa, stddev_samp(CASE WHEN NOT a THEN {c} END) AS sb FROM ({SIDE}) s) x"
q("m16_moment_shift", lambda t: ml.moment_shift(*halves(t)), "column_name shift:6", f"{SH('price')} UNION ALL {SH('volume')}")
DC = ("rsi", "iv", "premium", "volatility")
q("m17_mean_vector_drift", lambda t: ml.mean_vector_drift(*[t.feats().filter(c).select(*DC) for c in ("event_id % 2 = 0", "event_id % 2 = 1")]), "drift_score:6",
  "SELECT 1 - abs(corr(a, b)) AS drift_score FROM (" + " UNION ALL ".join(f"SELECT avg(CASE WHEN event_id % 2 = 0 THEN {c} END) AS a, avg(CASE WHEN event_id % 2 = 1 THEN {c} END) AS b FROM feats" for c in DC) + ") x")
q("m18_drift_decision", lambda t: ml.drift_decision(ml.ks_statistics(*halves(t)), "ks", *[h.agg(F.count(F.lit(1))).scalar() for h in halves(t)], threshold=0.005), "drift_score:6 drift_detected:b status",
  f"SELECT avg(ks) AS drift_score, avg(ks) > 0.005 AS drift_detected, 'ok' AS status FROM ({KS('price')} UNION ALL {KS('volume')}) x")
BASES = {"trend": (("rsi", "momentum_score"), 0.0), "value": (("iv", "volatility", "sentiment"), 0.1)}


def ensemble_sql():
    """Both base models without each fold and on all rows, their errors, the second stage and the blend."""
    ctes, out, whole = [f"d AS (SELECT *, event_id % 3 AS fold FROM ({VALUED}) v)"], [], []
    for n, (own, penalty) in BASES.items():
        ctes.append(f"m_{n} AS ({solved_sql(' UNION ALL '.join(moments_sql(own, 'value_', 'd', f'fold <> {i}', i) for i in range(3)), len(own), penalty)})")
        ctes.append(f"w_{n} AS ({solved_sql(moments_sql(own, 'value_', 'd', 'true', 0), len(own), penalty)})")
        out.append(f"{predicted(own, 'm_' + n)} AS p_{n}")
        whole.append(f"{predicted(own, 'w_' + n)} AS q_{n}")
    ctes.append(f"p AS (SELECT d.*, {', '.join(out + whole)} FROM d {' '.join(f'JOIN m_{n} ON m_{n}.g = d.fold CROSS JOIN w_{n}' for n in BASES)})")
    ctes.append(f"e AS (SELECT {', '.join(f'1 / (avg(e_{n}) + 1e-8) AS e_{n}' for n in BASES)} FROM (SELECT fold, {', '.join(f'avg(pow(p_{n} - value_, 2)) AS e_{n}' for n in BASES)} FROM p GROUP BY 1) x)")
    ctes.append(f"s AS ({solved_sql(moments_sql([f'p_{n}' for n in BASES], 'value_', 'p', 'true', 0), len(BASES), 0.0)})")
    sum_ = " + ".join(f"e_{n}" for n in BASES)
    blend = " + ".join(f"q_{n} * e_{n}" for n in BASES)
    return f"WITH {', '.join(ctes)} SELECT event_id, {', '.join(f'p_{n}' for n in BASES)}, {predicted([f'p_{n}' for n in BASES], 's')} AS stacked, ({blend}) / ({sum_}) AS blended FROM p, e, s"


q("m19_stacked_ensemble", lambda t: ml.stacked(numeric(t), "value_", BASES, "event_id", fold=F.expr(FOLD)), "event_id:l p_trend:5 p_value:5 stacked:5 blended:5", ensemble_sql())
WF = "SELECT symbol, CAST(floor((date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) - 180) / 60e0) AS BIGINT) AS w, ts, r FROM strategy"
q("m20_walk_forward", lambda t: ml.walk_forward(t.strategy(), "1995-01-01").withColumnRenamed("window", "window_"), "symbol window_:l total_return:5 win_rate:6 var_95:6 max_drawdown:6 train_from:l train_to:l", f"""
WITH x AS (SELECT * FROM ({WF}) z WHERE w >= 0), g AS (SELECT symbol, w, exp(sum(ln(1 + r))) - 1 AS tr, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS wr, quantile_cont(r, 0.05) AS q FROM x GROUP BY 1, 2),
d AS (SELECT symbol, w, abs(min(exp(lc - pk) - 1)) AS mdd FROM (SELECT *, max(lc) OVER (PARTITION BY symbol, w ORDER BY ts) AS pk FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol, w ORDER BY ts) AS lc FROM x) a) b GROUP BY 1, 2)
SELECT g.symbol, g.w AS "window", tr AS total_return, wr AS win_rate, q AS var_95, mdd AS max_drawdown, g.w * 60 AS train_from, g.w * 60 + 180 AS train_to FROM g JOIN d ON g.symbol = d.symbol AND g.w = d.w""".replace('"window"', "window_"))
q("m21_fold_score_weights", lambda t: ml.fold_score_weights(t.runs().select(F.col("condition").alias("target"), "model", F.when(F.col("condition") == "C0", F.col("accuracy")).otherwise(F.col("latency")).alias("score"), (F.col("condition") == "C0").alias("is_direction"))), "target model weight:6", """
SELECT target, model, w / sum(w) OVER (PARTITION BY target) AS weight FROM (SELECT condition AS target, model, CASE WHEN condition = 'C0' THEN avg(accuracy) ELSE 1 / (avg(latency) + 1e-8) END AS w FROM runs GROUP BY 1, 2) x""")
coefs = lambda t: t.runs().groupBy("model", F.col("template").alias("feature")).agg((F.avg("sharpe_ratio") - 1).alias("coefficient"))
COEF = "SELECT model, template AS feature, avg(sharpe_ratio) - 1 AS coefficient FROM runs GROUP BY 1, 2"
IMP = f"SELECT model, feature, abs(coefficient) / sum(abs(coefficient)) OVER (PARTITION BY model) AS importance FROM ({COEF}) c"
q("m22_coefficient_importance", lambda t: ml.coefficient_importance(coefs(t)), "model feature importance:6", IMP)
q("m23_mean_importance", lambda t: ml.mean_importance(ml.coefficient_importance(coefs(t))), "feature importance:6", f"SELECT feature, i / sum(i) OVER () AS importance FROM (SELECT feature, avg(importance) AS i FROM ({IMP}) x GROUP BY 1) y")

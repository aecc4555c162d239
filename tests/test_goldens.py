"""Known cases: option values, positions, anomalies, finance sentences, scenario trees, streams against batch."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import chain as ch
from tapeloom.operators import quality as ql
from tapeloom.operators import signals as sg
from tapeloom.operators import text as tx
from tapeloom.streaming import streams as st


@pytest.fixture(scope="module")
def contracts(spark):
    rows, i = [], 0
    for k in (80.0, 100.0, 110.0, 125.0):
        for side in ("call", "put"):
            rows.append((i, "A", side, k, 100.0, 1.0, 0.25))
            i += 1
    return spark.createDataFrame(rows, "contract_id bigint, symbol string, put_call string, strike double, underlying double, t double, hist_vol double")


def test_parity_bounds_and_early_exercise(contracts):
    v = ch.add_lattice(ch.add_lattice(ch.add_black_scholes(contracts)), american=False, out="european")
    rows = v.collect()
    by = {(r["strike"], r["put_call"]): r for r in rows}
    for k in (80.0, 100.0, 110.0, 125.0):
        c, p = by[k, "call"], by[k, "put"]
        assert c["bs_value"] - p["bs_value"] == pytest.approx(100 - k * math.exp(-0.05), abs=1e-4)
        assert c["delta"] - p["delta"] == pytest.approx(1.0, abs=1e-12)
        assert p["lattice_value"] >= max(p["european"], k - 100) - 1e-9
        assert c["lattice_value"] == pytest.approx(c["european"], abs=1e-9)
        assert c["european"] == pytest.approx(c["bs_value"], abs=0.06)


def test_normal_distribution(spark):
    from statistics import NormalDist

    from tapeloom.functions.special import norm_cdf

    xs = [-9.0, -7.2, -3.3, -1.0, 0.0, 0.4, 2.5, 6.9, 8.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", norm_cdf(F.col("x")))
    for r in d.collect():
        assert r["p"] == pytest.approx(NormalDist().cdf(r["x"]), abs=1e-14)


def test_implied_vol_round_trip_and_bounds(contracts):
    v = ch.add_price(contracts, out="px")
    v = v.withColumn("iv", ch.implied_vol(F.col("px"))).withColumn("none", ch.implied_vol(F.lit(1000.0)))
    for r in v.collect():
        assert r["iv"] == pytest.approx(0.25, abs=1e-6) and r["none"] is None


def test_dividend_case(spark):
    d = spark.createDataFrame([(0, "A", "call", 100.0, 100.0, 1.0, 0.25)], "contract_id bigint, symbol string, put_call string, strike double, underlying double, t double, v double")
    assert 0 < ch.add_price(d, "v", "x", 0.05, 0.02).first()["x"] < 20


def test_position_actions(spark):
    rows = [(1, 2.0, 3.2), (2, 5.0, 6.6), (3, 10.0, 7.5), (4, 4.0, 4.6), (5, 3.0, None)]
    pos = spark.createDataFrame([(i, e, 1) for i, e, _ in rows], "contract_id bigint, entry_price double, quantity int")
    px = spark.createDataFrame([(i, None, None, p, 100.0) for i, _, p in rows if p], "contract_id bigint, bid double, ask double, last double, underlying double")
    got = {r["contract_id"]: (r["action"], round(r["pnl_percent"], 6)) for r in ch.monitor_positions(pos, px).collect()}
    assert got == {1: ("take_profit", 60.0), 2: ("consider_exit", 32.0), 3: ("stop_loss", -25.0), 4: ("hold", 15.0), 5: ("hold", 0.0)}


def _series(spark, values):
    rows = [("AAA", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v), 1000.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume double")


def test_anomaly_goldens(spark):
    b = _series(spark, [150, 151, 149, 150, 152, 148, 150, 151, 149, 200])
    assert [r["type"] for r in ql.bar_anomalies(b).collect()] == ["price_outlier"]
    s = _series(spark, [10, 11, 10, 12, 11, 10, 11, 12, 50, 11])
    hit = ql.zscore_anomalies(s, ["symbol"], "close", 2.0, population=True, least=3).collect()
    assert [r["close"] for r in hit] == [50.0]
    assert ql.zscore_anomalies(s, ["symbol"], "close", 3.0, population=True, least=3).count() == 0
    assert ql.zscore_anomalies(_series(spark, [5] * 8), ["symbol"], "close", 1.0).count() == 0


def test_finance_lexicon_sentences(spark):
    cases = [("shares rally on strong demand", 1.3 + 1.2), ("not strong", -1.2 * 0.8), ("significantly weak results", -1.2 * 1.2), ("management sees rally", 1.3 * 1.08), ("", 0.0)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r["i"]: r["lex_score"] for r in tx.lexicon_score(d).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_scenario_tree_shapes(spark):
    tree = '{"base_case": "60% flat", "bull_case": "30% up", "bear_case": "10% down"}'
    answers = ['{"scenario_tree": %s}' % tree, '{"trades": [{"ticker": "X"}, {"scenario_tree": %s}]}' % tree, "```json\n{\"scenario_tree\": %s,}\n```" % tree, 'text "scenario_tree": %s end' % tree, "loose " + tree.replace('"', "'"), "nothing here", ""]
    d = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r["i"]: r["m"] for r in d.withColumn("m", tx.scenario_tree(F.col("a"))).collect()}
    for i in range(5):
        assert got[i]["bull_case"] == "30% up", i
    assert got[5] is None and got[6] is None


def test_text_cleaning(spark):
    d = spark.createDataFrame([("  a\té b  " + "x" * 10,)], "t string")
    assert d.select(tx.clean_text(F.col("t"), 6)).first()[0] == "a b xx..."


def test_stream_of_many_batches_equals_batch(spark, tmp_path):
    vals = [100 + (i * 7 % 5) + (300 if i % 17 == 0 else 0) for i in range(60)]
    b = _series(spark, vals)
    for i in range(6):
        lo = dt.datetime(2024, 1, 1) + dt.timedelta(days=10 * i)
        b.filter((F.col("ts") >= lo) & (F.col("ts") < lo + dt.timedelta(days=10))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = st.read_files(spark, str(tmp_path / "in"), "symbol string, ts timestamp_ntz, close double, volume double")
    got = sorted(tuple(r) for r in st.anomaly_stream(s, st.Place(str(tmp_path / "out"), str(tmp_path / "mark"))).select("ts", "type").collect())
    want = sorted(tuple(r) for r in ql.bar_anomalies(b).select("ts", "type").collect())
    assert got == want and want


def test_count_triggers_over_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 40, i * 40 + 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
    s = st.read_files(spark, str(tmp_path / "n"), "id bigint")
    got = sorted(tuple(r) for r in st.count_triggers(s, {"retrain": 50}, st.Place(str(tmp_path / "out"), str(tmp_path / "mark"))).collect())
    assert got == [("retrain", 50), ("retrain", 100)]


def test_ranking_counts_only_its_own_company_words(spark):
    from tapeloom.operators import relational

    rows = [("AAPL", "new iphone"), ("AAPL", "apple pie"), ("NVDA", "a gpu"), ("META", "facebook stock"), ("GOOG", "google")]
    out = relational.relevance_score(spark.createDataFrame(rows, "symbol string, headline string"), "headline")
    assert [(r.symbol, round(r.relevance, 2)) for r in out.collect()] == [("AAPL", 0.0), ("AAPL", 0.6), ("NVDA", 0.0), ("META", 0.7), ("GOOG", 0.0)]


def test_missing_features_leave_no_row_out(spark):
    from tapeloom.operators import ml

    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 2.0), (3, 0.5, 0.5)], "id long, a double, b double")
    out = ml.assemble(df, ("a", "b"))
    assert out.columns == ["id", "a", "b", "features"]
    assert [r.features.toArray().tolist() for r in out.orderBy("id").collect()] == [[1.0, 0.0], [0.0, 2.0], [0.5, 0.5]]


def test_value_without_history_uses_the_contracts_own_volatility(contracts):
    spark = contracts.sparkSession
    priced = ch.add_price(contracts.withColumn("vol", F.lit(0.4)), "vol", "last").drop("vol", "hist_vol").withColumns(
        {"bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double"), "volume": F.lit(500), "open_interest": F.lit(500)}
    ).filter(F.col("last") > 0.01)
    none = spark.createDataFrame([], "symbol string, hist_vol double")
    rows = ch.mispricing(priced, none).collect()
    assert rows
    for r in rows:
        assert r["hist_vol"] == pytest.approx(0.4, abs=1e-4) and r["bs_value"] == pytest.approx(r["last"], abs=1e-4)
        assert r["fair_value"] == pytest.approx(ch.BS_WEIGHT * r["bs_value"] + ch.LATTICE_WEIGHT * r["lattice_value"], abs=1e-9)


def test_low_iv_rank_is_an_entry_signal(contracts):
    spark = contracts.sparkSession
    cheap = contracts.drop("hist_vol").withColumns({"last": F.lit(0.5), "bid": F.lit(None).cast("double"), "ask": F.lit(None).cast("double"), "volume": F.lit(500), "open_interest": F.lit(500)})
    vols = cheap.select("symbol").distinct().withColumn("hist_vol", F.lit(0.4))
    for rank, want in ((10.0, True), (30.0, False)):
        out = ch.opportunity_analysis(ch.mispricing(cheap, vols, ranks=vols.select("symbol", F.lit(rank).alias("iv_rank")))).collect()
        assert out and all(("Low IV rank - good entry" in r["entry_signals"]) == want for r in out)


def plain_pick(signals, budget):
    """The pick of one pack, one signal after the other."""
    used, picked = 0, []
    for rank, name, words in sorted((-(w * (1.0 if first else 0.5)), s, n) for s, w, first, n in signals if n):
        kept = None
        if used + int(words * 1.3) <= budget:
            kept = words
        elif -rank > 0.5 and used < budget:
            kept = min(words, budget - used)
        if kept:
            used += int(kept * 1.3)
            picked.append((name, kept))
    return used, picked


def test_budgeted_pick_against_plain_loop(spark):
    rng, rows = random.Random(3), []
    for pack in range(12):
        many = 400 if pack == 0 else rng.randrange(1, 40)
        sizes = [0, 1, 2, 7, 200] if pack % 2 else list(range(60))
        rows += [(pack, f"s{i:04d}", round(rng.random(), 2), rng.random() < 0.5, rng.choice(sizes)) for i in range(many)]
    df = spark.createDataFrame(rows, "pack int, signal string, weight double, priority boolean, words int")
    got = {r["pack"]: (r["used"], [tuple(x) for x in r["picked"]]) for r in tx.budgeted_pick(df, 100).collect()}
    want = {p: plain_pick([r[1:] for r in rows if r[0] == p], 100) for p in range(12)}
    assert got == {p: v for p, v in want.items() if p in got} and all(v == (0, []) for p, v in want.items() if p not in got)
    assert any(n < 7 for _, picked in want.values() for _, n in picked)


def test_feature_limits_are_parameters(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(12))], [f"c{i}" for i in range(12)])
    cols = df.columns
    assert len(sg.pairwise_features(df, cols).columns) == 12 + 3 * 66
    assert len(sg.pairwise_features(df, cols, 50, 10).columns) == 12 + 51
    assert len(sg.polynomial_features(df, cols).columns) == 12 + 66
    assert len(sg.polynomial_features(df, cols, 5).columns) == 12 + 10


def test_zone_rule_reads_the_landed_text(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+00:00",), ("2024-01-01T00:00:00",), ("2024-01-01T00:00:00-05:00",), (None,)], "at string")
    out = ql.RuleSet([ql.zone_rule(lambda: F.col("at"))]).apply(df)
    assert [r["is_valid"] for r in out.collect()] == [True, True, False, False, False]

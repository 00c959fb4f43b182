"""Goldens, invariants and recoveries on literal inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import alignment, backtest, boosting, breadth, cleaning, econometrics, folds, montecarlo, allocation, rules, tabular
from tidemark.sources import tables


def series(spark, name, values, **more):
    day = dt.date(2020, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), None if v is None else float(v), *[float(c[i]) for c in more.values()]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, ts date, {name} double" + "".join(f", {c} double" for c in more))


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("ts").collect()]


def test_positions_golden(spark):
    df = folds.positions(series(spark, "z", [0, 2.5, 2, 0, -2.5, -1, 0]), "z", 2.0, 0.0, ["symbol"], "ts")
    assert ordered(df, "position") == [0, -1, -1, 0, 1, 1, 0]


def test_positions_keep_state_when_z_is_missing():
    assert folds.band_positions(np.array([3, math.nan, 1, -1]), 2.0, 0.0).tolist() == [-1, -1, -1, 0]


def test_ewm_gap_rule():
    got = folds.ewm_values(np.array([1, math.nan, 3, 4]), 0.5)
    assert np.allclose(got, [1, 1, 7 / 3, 19 / 6])
    assert math.isnan(folds.ewm_values(np.array([1.0, 2.0]), 0.5, min_count=2)[0])


def test_pair_backtest_golden(spark):
    df = series(spark, "y", [10, 11, 12, 13, 14], x=[5] * 5, position=[1] * 5)
    out = ordered(backtest.pair_backtest(df, ["symbol"], "ts", 0.0, 0.0), "pnl")
    assert out[0] is None and out[1] == pytest.approx(0.1)


def test_flat_book_earns_nothing(spark):
    df = series(spark, "y", range(10, 60), x=range(20, 70), position=[0] * 50)
    assert {p for p in ordered(backtest.pair_backtest(df, ["symbol"], "ts", 0.5), "pnl")} <= {None, 0.0}


def test_cost_never_raises_return(spark):
    df = series(spark, "y", [10, 12, 11, 13, 12, 14], x=[5] * 6, position=[0, 1, 0, -1, 0, 1])
    total = [sum(p or 0 for p in ordered(backtest.pair_backtest(df, ["symbol"], "ts", 0.5, c), "pnl")) for c in (0.0, 5.0, 20.0)]
    assert total == sorted(total, reverse=True)


def test_split_at_seventy(spark):
    df = backtest.split_rows(series(spark, "v", range(100)), ["symbol"], "ts", 7, 0, ("train", "-", "test"))
    assert [r for r in ordered(df, "split")].index("test") == 70


def test_rules_match_a_loop(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1.2, 300)
    got = ordered(rules.hold(series(spark, "z", z), rules.baseline(-1, 1), ["z"], ["symbol"], "ts"), "position")
    state, expected = 0.0, [0.0]
    for v in z[:-1]:
        state = 1.0 if v < -1 else 0.0 if v > 1 else state
        expected.append(state)
    assert got == expected


def test_round_trips_count_flips(spark):
    df = series(spark, "position", [0, 1, 1, -1, 0, 0, 1])
    r = backtest.round_trips(df, ["symbol"], "ts").first()
    assert (r["n_trades"], r["avg_holding"], r["time_in_market"]) == (3, pytest.approx(4 / 3), pytest.approx(4 / 7))


def exits(mode, target, close, high=None, low=None, **p):
    high, low = high or close, low or close
    return folds.exit_scan(mode, *[np.array(v, float) for v in (target, high, low, close, [1.0] * len(close))], folds.EXIT | p)


def test_stop_fires_before_profit():
    out = exits("fixed", [1, 1, 1], [100, 100, 100], high=[100, 110, 100], low=[100, 90, 100])
    assert out["exit_reason"] == ["enter", "stop_loss", "enter"] and out["position"].tolist() == [1, 0, 1]


def test_flip_skips_the_exit_test_and_time_stop():
    assert exits("fixed", [1, -1, -1], [100, 50, 50])["exit_reason"] == ["enter", "flip", ""]
    assert exits("time", [1, 1, 1, 1], [100] * 4, bars=2)["exit_reason"] == ["enter", "", "time_stop", "enter"]


def test_trailing_extreme_moves_before_the_stop():
    assert exits("trailing", [1, 1], [100, 100], high=[100, 120], low=[100, 107], trail=0.1)["exit_reason"][1] == "trailing_stop"


def test_ols_recovers_a_line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    r = econometrics.ols(series(spark, "y", 1.5 + 2 * x + rng.normal(0, 0.01, 500), x=x), ["symbol"], "y", ["x"]).first()
    assert r["const_b"] == pytest.approx(1.5, abs=0.01) and r["x_b"] == pytest.approx(2, abs=0.01) and r["r2"] > 0.99


def test_adf_rejects_noise_and_keeps_a_walk(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=800)
    tau = lambda v: econometrics.adf(series(spark, "v", v), ["symbol"], "ts", "v").first()["tau"]
    assert tau(noise) < -10 and tau(np.cumsum(noise)) > -3.5


def test_engle_granger_and_ou(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=1000))
    r = econometrics.engle_granger(series(spark, "y", 0.5 + 1.2 * x + rng.normal(0, 0.5, 1000), x=x), ["symbol"], "ts").first()
    assert r["beta"] == pytest.approx(1.2, abs=0.05) and r["ecm_lambda"] < 0 and r["cointegrated"]
    e = [0.0]
    for s in rng.normal(0, 0.1, 3000):
        e.append(0.9 * e[-1] + s)
    ou = econometrics.ou_fit(series(spark, "residual", e), ["symbol"], "ts").first()
    assert ou["theta"] == pytest.approx(-math.log(0.9), rel=0.2) and abs(ou["mu"]) < 0.1


def test_johansen_finds_the_relation(spark):
    rng = np.random.default_rng(11)
    lx = np.cumsum(rng.normal(0, 0.02, 1500)) + 3
    r = econometrics.johansen(series(spark, "y", np.exp(0.2 + 0.8 * lx + rng.normal(0, 0.02, 1500)), x=np.exp(lx)), ["symbol"], "ts").first()
    assert r["rank"] >= 1 and abs(r["beta"]) == pytest.approx(0.8, abs=0.1) and r["max_root"] < 1


def test_johansen_by_canonical_correlations(spark):
    """The eigenvalues are the squared canonical correlations of differences and lagged levels given the lagged differences."""
    rng = np.random.default_rng(12)
    lx = np.cumsum(rng.normal(0, 0.02, 400)) + 3
    ly = 0.5 + 0.6 * lx + rng.normal(0, 0.03, 400)
    r = econometrics.johansen(series(spark, "y", np.exp(ly), x=np.exp(lx)), ["symbol"], "ts", most_lags=1).first()
    level = np.stack([ly, lx], axis=1)
    diff = np.diff(level, axis=0)
    z = np.concatenate([np.ones((398, 1)), diff[:-1]], axis=1)
    rest = lambda a: a - z @ np.linalg.solve(z.T @ z, z.T @ a)
    q = lambda a: np.linalg.qr(a)[0]
    canonical = np.linalg.svd(q(rest(diff[1:])).T @ q(rest(level[1:-1])))[1] ** 2
    assert r["trace0"] == pytest.approx(-398 * np.log(1 - canonical).sum()) and r["trace1"] == pytest.approx(-398 * math.log(1 - canonical[1]))
    assert r["max0"] == pytest.approx(-398 * math.log(1 - canonical[0])) and r["aic_lag"] == 1


def test_johansen_of_degenerate_series(spark):
    rng = np.random.default_rng(13)
    x = np.exp(np.cumsum(rng.normal(0, 0.02, 200)))
    for y in (x, 2 * x, np.ones(200), np.where(np.arange(200) < 195, -1.0, x)):
        r = econometrics.johansen(series(spark, "y", y, x=x), ["symbol"], "ts").first()
        assert r["rank"] is None and r["trace0"] is None and r["beta"] is None
    assert econometrics.johansen(series(spark, "y", x[:5], x=x[:5]), ["symbol"], "ts").first()["aic_lag"] is None


def test_rolling_adf_equals_the_plain_one(spark):
    rng = np.random.default_rng(3)
    e = np.cumsum(rng.normal(size=80)) * 0.3 + rng.normal(size=80)
    got = ordered(econometrics.rolling_adf(series(spark, "e", e), ["symbol"], "ts", "e", 30), "tau")
    alone = econometrics.adf(series(spark, "e", e[20:50]), ["symbol"], "ts", "e").first()["tau"]
    assert got[50] == pytest.approx(alone, rel=1e-6) and got[10] is None


def test_interval_join_and_gaps(spark):
    d = lambda n: dt.date(2020, 1, n)
    calendar = spark.createDataFrame([(d(n),) for n in range(1, 6)], "date date")
    spells = spark.createDataFrame([("a", None, d(2)), ("a", d(2), d(3)), ("b", d(4), None), ("c", d(9), None)], "symbol string, in_date date, out_date date")
    got = sorted((r["symbol"], r["date"].day) for r in alignment.members_by_day(calendar, spells).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)]


def test_expanding_rank(spark):
    df = alignment.expanding_rank(series(spark, "x", [1, None, 1, 2, 0]), "x", "p", "symbol", "ts")
    assert ordered(df, "p") == pytest.approx([50, None, 50, 250 / 3, 12.5]) or ordered(df, "p")[1] is None


def test_breadth_of_an_empty_day_is_null(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), None, False)], "symbol string, date date, close double, valid boolean")
    assert breadth.breadth(df).first()["above_ma"] is None


def test_average_rank_and_skewness(spark):
    df = series(spark, "x", [1, 2, 2, None, 3])
    assert ordered(df.withColumn("r", R.average_rank("x", "symbol")), "r") == [1, 2.5, 2.5, None, 4]
    v = [1.0, 2.0, 2.5, 9.0, 4.0]
    n, m = len(v), np.mean(v)
    expected = n / ((n - 1) * (n - 2)) * sum(((x - m) / np.std(v, ddof=1)) ** 3 for x in v)
    assert series(spark, "x", v).agg(R.sample_skewness("x").alias("s")).first()["s"] == pytest.approx(expected)


def test_rsi_without_losses_is_100(spark):
    assert ordered(X.rsi(series(spark, "close", range(1, 20)), 14, "r"), "r")[-1] == 100


def test_cleaning(spark):
    df = spark.createDataFrame([("1,234.5", "2020/01/02"), ("x", "20200102"), (None, "02.01.2020"), ("7", "no")], "n string, d string")
    rows = df.select(cleaning.number(F.col("n")).alias("n"), cleaning.mixed_date(F.col("d")).alias("d")).collect()
    assert [r["n"] for r in rows] == [1234.5, None, None, 7.0] and [str(r["d"]) for r in rows] == ["2020-01-02"] * 3 + ["None"]
    assert df.limit(1).select(cleaning.slug(F.lit(" A--b/C! ")).alias("s")).first()["s"] == "a_b_c"


def test_encoding_of_unseen_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = tabular.encode(spark.createDataFrame([("b",), ("z",)], "k string"), tabular.label_codes(train, "k"), "k").collect()
    assert [r["k"] for r in got] == [1, 1]


def test_exact_paths_price_near_black_scholes(spark):
    got = montecarlo.terminal(spark, 20_000, 1, "exact").agg(*montecarlo.discounted(montecarlo.call_payoff(F.col("price"), 100.0), 0.05, 1.0)).first()
    assert abs(got["price"] - 10.4506) < 4 * got["se"]


def test_mean_variance_prefers_the_better_asset():
    w = allocation.mean_variance(np.array([0.3, 0.0, -0.5]), np.eye(3) * 0.04)
    assert w.sum() == pytest.approx(1) and w[0] > w[1] >= w[2] == 0


def test_cube_counts_rows_by_bin_and_time(spark):
    rng = np.random.default_rng(21)
    rows = [(i, float(rng.integers(0, 6)), None if i % 50 == 0 else float(rng.normal()), int(rng.random() < 0.4)) for i in range(2400)]
    df = spark.createDataFrame([*rows, (2400, 1.0, 1.0, None)], "t long, a double, b double, y int")
    data = boosting.time_cube(df, ["a", "b"], "y", "t", bins=8)
    assert data.rows.sum() == 2400 and data.positives.sum() == sum(r[3] for r in rows)
    assert data.rows.shape[0] == 120 and 10 <= data.rows.sum(axis=1).min() <= data.rows.sum(axis=1).max() <= 30
    assert [(k, b) for k, _, b in boosting.fold_parts(5)] == [(k, (20 * k, 20 * k + 20)) for k in range(1, 6)]
    cuts = boosting.edges(df, ["a", "b"], 8)
    for i, (_, a, b, _) in enumerate(rows[:60]):
        expected = [0 if v is None else 1 + sum(v > c for c in cuts[n]) for n, v in (("a", a), ("b", b))]
        assert any((cell == expected).all() and data.rows[:, j].any() for j, cell in enumerate(data.bins)), i


def test_a_tree_takes_the_best_split():
    rng = np.random.default_rng(22)
    for _ in range(50):
        x, n = rng.integers(0, 5, (40, 3)), rng.integers(1, 20, 40).astype(float)
        g = rng.normal(0, 1, 40) * n
        node, gains = boosting.grow(x, n, g, 1, 30)
        best = 1e-12
        for j in range(3):
            for cut in range(4):
                left = x[:, j] <= cut
                a, b = n[left].sum(), n[~left].sum()
                if a >= 30 and b >= 30:
                    best = max(best, g[left].sum() ** 2 / a + g[~left].sum() ** 2 / b - g.sum() ** 2 / n.sum())
        assert gains.sum() == pytest.approx(best if best > 1e-12 else 0.0)
        assert node.max() <= 1


def test_boosting_on_the_cube_fits_and_area_counts_pairs():
    rng = np.random.default_rng(23)
    x = np.array([(i, j) for i in range(8) for j in range(4)])
    rows = rng.integers(20, 60, len(x))
    positives = rng.binomial(rows, 1 / (1 + np.exp(-(x[:, 0] - 3.5 + 2 * (x[:, 1] > 1)))))
    *_, (score, gains) = boosting.boost(x, rows, positives, 100, 0.1, 3, 10, 0.85)
    share = boosting.forest(x, rows, positives, 100, 6, 2)
    order = np.repeat(np.arange(len(x)), rows)
    label = np.concatenate([np.arange(n) < p for n, p in zip(rows, positives)])
    for s in (score, share):
        v = s[order]
        wins = (v[label][:, None] > v[~label][None, :]).mean() + (v[label][:, None] == v[~label][None, :]).mean() / 2
        assert boosting.auc(s, rows, positives) == pytest.approx(wins) and wins > 0.85
    assert np.abs(1 / (1 + np.exp(-score)) - positives / rows).mean() < 0.12 and gains[0] > gains[1] > 0
    found = boosting.measures(score, rows, positives)
    yes = score[order] > 0
    assert found["accuracy"] == pytest.approx((yes == label).mean()) and found["precision"] == pytest.approx(label[yes].mean()) and found["recall"] == pytest.approx(yes[label].mean())


def test_grid_search_and_curves(spark):
    rng = np.random.default_rng(24)
    rows = [(i, float(rng.integers(0, 8)), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, int(rng.random() < 1 / (1 + math.exp(3.5 - a)))) for i, a, b in rows], "t long, a double, b double, y int")
    data = boosting.time_cube(df, ["a", "b"], "y", "t")
    found = boosting.grid_search(spark, data, [5, 20], [0.1, 0.2], [2], [10], [0.8]).toPandas()
    assert len(found) == 2 * 2 * 5 and (found["auc"] > 0.8).all()
    *_, (score, _) = boosting.boost(data.bins, *data.part(0, 40), 5, 0.1, 2, 10, 0.8)
    row = found[(found["rounds"] == 5) & (found["rate"] == 0.1) & (found["fold"] == 2)].iloc[0]
    assert row["auc"] == pytest.approx(boosting.auc(score, *data.part(40, 60)))
    params = {"rounds": 20, "rate": 0.1, "depth": 2, "leaf": 10, "subsample": 0.8}
    curve = boosting.learning_curve(data, params, [0.2, 1.0])
    assert curve[0][1] < curve[1][1] and curve[1][4] > 0.8
    kept = {f: k for f, *_, k in boosting.importance_stability(data, params)}
    assert kept["a"] and boosting.stability(data, params)["auc"]["gap"] < 0.1
    assert [boosting.gap_label(g) for g in (-0.1, 0.02, 0.07, 0.3)] == ["excellent", "acceptable", "concerning", "severe"]


def test_demo_bars_are_consistent(spark):
    df = tables.demo_bars(spark, ["A"], 50)
    assert df.where("high < greatest(open, close) or low > least(open, close)").count() == 0 and df.count() == 50


def test_entry_without_language_model_folders(tmp_path):
    """The registry imports and fills without the llm folder."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 200 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})

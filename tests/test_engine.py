"""Windows, metrics, quality, universe, folds, overfitting, significance, cross-section: against plain loops and numpy."""

import math
import random
from datetime import UTC, date, datetime, timedelta
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import crosssection, folds, overfit, quality, regimes, significance, universe, windows

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def series(spark, values, step=timedelta(hours=1), key="A"):
    return spark.createDataFrame([(key, T0 + i * step, float(v)) for i, v in enumerate(values)], "k string, time timestamp, v double")


# --- windows and metrics ------------------------------------------------------------------------------------------------------------------


def test_closed_form_sharpe(spark):
    x = np.random.default_rng(0).normal(size=1000)
    x = (x - x.mean()) / x.std(ddof=1) * 0.01 + 1.5 / math.sqrt(252) * 0.01
    got = series(spark, x).agg(metrics.sharpe("v", 252.0).alias("s")).first()["s"]
    assert got == pytest.approx(1.5, abs=1e-9)
    assert significance.from_returns(x, 10) > 0.9
    assert series(spark, [0.1, 0.1]).agg(metrics.sharpe("v", 252.0).alias("s")).first()["s"] is None
    assert series(spark, [0.1]).agg(metrics.sharpe("v", 252.0).alias("s")).first()["s"] is None


def test_metrics_leave_nan_and_null_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-2.0,)], "v double")
    row = df.agg(metrics.hit_rate("v").alias("h"), metrics.profit_factor("v").alias("p"), metrics.sortino("v", 1.0).alias("s"), metrics.value_at_risk("v", 0.5).alias("q")).first()
    assert row["h"] == 0.5 and row["p"] == 0.5 and row["q"] == -0.5 and row["s"] == pytest.approx(-0.5 / math.sqrt(2))
    assert series(spark, [1, 2]).agg(metrics.profit_factor("v").alias("p")).first()["p"] == float("inf")


def test_longest_drawdown(spark):
    rng = random.Random(1)
    for _ in range(6):
        e = [100.0]
        for _ in range(60):
            e.append(max(1.0, e[-1] + rng.choice([-1, -1, 0, 1, 1])))
        longest, i, peak = 0, 0, 0
        for i in range(len(e)):
            if e[i] >= e[peak]:
                if i - peak > 1 or any(e[j] < e[peak] for j in range(peak, i)):
                    longest = max(longest, (i - peak) * 9)
                peak = i
        if any(x < e[peak] for x in e[peak:]):
            longest = max(longest, (len(e) - 1 - peak) * 9)
        got = windows.longest_drawdown(series(spark, e, timedelta(hours=9)), "v", ["k"], "time").first()["days"]
        assert got == longest // 24


def test_as_of(spark):
    rng = random.Random(2)
    left = [("a" if rng.random() < 0.5 else "b", T0 + timedelta(minutes=rng.randrange(500)), i) for i in range(80)]
    right = [("a" if rng.random() < 0.5 else "b", T0 + timedelta(minutes=m), float(m)) for m in rng.sample(range(20, 500), 60)]
    got = windows.as_of(spark.createDataFrame(left, "k string, t timestamp, i long"), spark.createDataFrame(right, "k string, u timestamp, x double"), ["k"], "t", "u", ["x"])
    want = {i: max((x for kk, u, x in right if kk == k and u <= t), default=None) for k, t, i in left}
    assert {r["i"]: r["x"] for r in got.collect()} == want


def test_rolling_needs_a_full_window(spark):
    df = series(spark, [1, 2, 3, 4])
    got = [r["m"] for r in df.select("time", windows.rolling(F.avg, F.col("v"), ["k"], "time", 3).alias("m")).orderBy("time").collect()]
    late = [r["m"] for r in df.select("time", windows.rolling(F.avg, F.col("v"), ["k"], "time", 3, shifted=True).alias("m")).orderBy("time").collect()]
    assert got == [None, None, 2.0, 3.0] and late == [None, None, None, 2.0]


def test_modal_gap_and_ties(spark):
    even = series(spark, [1] * 4)
    odd = spark.createDataFrame([("A", T0), ("A", T0 + timedelta(hours=1)), ("A", T0 + timedelta(hours=3))], "k string, time timestamp")
    assert windows.modal_gap(even, ["k"], "time").first()["gap_us"] == 3_600_000_000
    assert windows.modal_gap(odd, ["k"], "time").first()["gap_us"] is None
    assert windows.monotonic_breaks(odd.union(odd.limit(1)), ["k"], "time", ["time"]).first()["breaks"] == 1


def test_capacity_and_missing_volume(spark):
    legs = spark.createDataFrame([("r", T0, "A", 100.0), ("r", T0, "B", 300.0)], "run string, time timestamp, symbol string, notional double")
    adv = spark.createDataFrame([("A", 1e6), ("B", 1e6)], "symbol string, adv double")
    assert metrics.capacity(legs, adv, ["run"]).first()["capacity"] == pytest.approx(0.01 * 1e6 / 0.75)
    with pytest.raises(Exception, match="no daily volume for B"):
        metrics.capacity(legs, adv.where("symbol = 'A'"), ["run"]).collect()


# --- quality --------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clean_bars(spark):
    rows = [("A", m, T0 + timedelta(hours=i), T0 + timedelta(hours=i, minutes=59, seconds=59), 100.0, 101.0, 99.0, 100.5, 5.0, 500.0, 3, T0 + timedelta(days=9)) for m in ("spot", "perp_usdt") for i in range(48)]
    return spark.createDataFrame(rows, "symbol string, market string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades long, ingested_at timestamp")


def run_suite(spark, bars, rates=(1e-4,) * 6):
    funding = spark.createDataFrame([("A", T0 + timedelta(hours=8 * i), float(r)) for i, r in enumerate(rates)], "symbol string, funding_time timestamp, funding_rate double")
    members = spark.createDataFrame([("A", 1, ["A"])], "symbol string, rank int, spot_pairs array<string>")
    listed = spark.createDataFrame([("A", m, T0) for m in ("spot", "perp_usdt", "perp_funding")], "symbol string, market string, listing timestamp")
    return {(r["name"].split("_")[0], r["market"]): r["severity"] for r in quality.suite(bars, funding, members, listed).collect()}


def test_clean_archive_passes(spark, clean_bars):
    got = run_suite(spark, clean_bars)
    assert set(got.values()) == {"INFO"} and {n for n, _ in got} == {*(f"K{i}" for i in range(1, 9)), *(f"F{i}" for i in range(1, 5)), "C1", "X1"}


@pytest.mark.parametrize(
    ("change", "check", "severity"),
    [
        ({"high": "CASE WHEN hour(open_time) = 3 THEN 90 ELSE high END"}, "K3", "ERROR"),
        ({"volume": "-volume"}, "K4", "ERROR"),
        ({"close": "CASE WHEN hour(open_time) = 3 THEN 70 ELSE close END", "low": "60"}, "K6", "WARN"),
        ({"close": "CASE WHEN market = 'spot' THEN close ELSE close * 1.03 END", "high": "200"}, "K7", "WARN"),
        ({"close": "CASE WHEN market = 'spot' THEN close ELSE close * 1.2 END", "high": "200"}, "K7", "ERROR"),
        ({"ingested_at": "open_time"}, "K8", "ERROR"),
        ({"open": "100", "high": "100", "low": "100", "close": "100", "volume": "0"}, "K5", "WARN"),
        ({"close_time": "open_time"}, "X1", "ERROR"),
        ({"market": "'spot'"}, "C1", "ERROR"),
    ],
)
def test_one_defect_one_finding(spark, clean_bars, change, check, severity):
    bad = clean_bars.withColumns({c: F.expr(f"cast({e} as {dict(clean_bars.dtypes)[c]})") for c, e in change.items()})
    assert {s for (n, _), s in run_suite(spark, bad).items() if n == check} == {severity}


def test_gaps_repeats_and_rates(spark, clean_bars):
    thin = clean_bars.where("not (market = 'spot' and hour(open_time) = 5)")
    assert run_suite(spark, thin)["K1", "spot"] == "ERROR"
    assert run_suite(spark, clean_bars.union(clean_bars.limit(1)))["K2", None] == "ERROR"
    assert run_suite(spark, clean_bars, [0.006] * 6)["F3", None] == "WARN" and run_suite(spark, clean_bars, [0.03] * 6)["F3", None] == "ERROR"


# --- universe -------------------------------------------------------------------------------------------------------------------------------


def test_universe(spark):
    rows = [
        ("AAAUSDT", "AAA", "USDT", "PERPETUAL", "TRADING", date(2020, 1, 1), 10.0, 1.0, 5),
        ("BBBUSDT", "BBB", "USDT", "PERPETUAL", "TRADING", date(2020, 1, 1), 30.0, 1.0, 5),
        ("CCCUSDT", "CCC", "USDT", "PERPETUAL", "TRADING", date(2024, 5, 1), 99.0, 0.0, 5),
        ("DDDUSDT", "DDD", "USDT", "PERPETUAL", "TRADING", None, 99.0, 1.0, 5),
        ("EEEUSDT", "EEE", "USDT", "CURRENT_QUARTER", "TRADING", date(2020, 1, 1), 99.0, 1.0, 5),
    ]
    c = spark.createDataFrame(rows, "api_symbol string, base_asset string, quote_asset string, contract_type string, status string, onboard_date date, quote_volume double, last_price double, trades long")
    spot = spark.createDataFrame([("BBB", "BBBUSDC", 1.0), ("BBB", "BBBUSDT", 7.0), ("BBB", "BBBEUR", None)], "base_asset string, pair string, volume double")
    u, r = universe.snapshot(c, spot, "2024-06-01", 365, 10)
    got = u.orderBy("rank").collect()
    assert [(x["api_symbol"], x["rank"], x["spot_pairs"], x["primary_spot_quote_volume"]) for x in got] == [("BBBUSDT", 1, ["BBBUSDT", "BBBUSDC", "BBBEUR"], 7.0), ("AAAUSDT", 2, [], 0.0)]
    assert {(x["api_symbol"], x["reason"], x["is_primary_reason"]) for x in r.collect()} == {("CCCUSDT", "invalid_price", True), ("CCCUSDT", "listing_age", False), ("DDDUSDT", "listing_age", True)}
    order = [(t["market"], t["symbol"]) for t in universe.tasks(u).orderBy("rank", "seq").collect()]
    assert order == [("perp_usdt", "BBBUSDT"), ("spot", "BBBUSDT"), ("spot", "BBBUSDC"), ("spot", "BBBEUR"), ("perp_funding", "BBBUSDT"), ("perp_usdt", "AAAUSDT"), ("perp_funding", "AAAUSDT")]


# --- folds, overfitting, significance ---------------------------------------------------------------------------------------------------------


def test_purged_folds_part(spark):
    s = series(spark, range(103), timedelta(days=1))
    rows = folds.purged(s, 5, timedelta(days=2)).collect()
    tests = {}
    for r in rows:
        if r["role"] == "test":
            tests.setdefault(r["fold_id"], set()).add(r["i"])
    assert sorted(map(len, tests.values())) == [20, 20, 20, 20, 23] and set().union(*tests.values()) == set(range(103))
    for r in rows:
        if r["role"] == "train":
            t = tests[r["fold_id"]]
            assert not min(t) - 2 <= r["i"] <= max(t) + 2
    with pytest.raises(ValueError):
        folds.purged(s, 1, timedelta(0))
    with pytest.raises(ValueError):
        folds.expanding(s, timedelta(0), timedelta(1), timedelta(1))


def plain_pbo(m, s):
    t, n = m.shape
    cut = [i * (t // s) for i in range(s)] + [t]
    parts = [m[a:b] for a, b in zip(cut, cut[1:])]

    def ratio(x):
        with np.errstate(all="ignore"):
            return np.where(x.max(0) > x.min(0), x.mean(0) / x.std(0, ddof=1), np.nan)

    bad = []
    for inside in combinations(range(s), s // 2):
        a, b = ratio(np.concatenate([parts[i] for i in inside])), ratio(np.concatenate([parts[i] for i in range(s) if i not in inside]))
        k = int(np.nanargmax(a))
        if np.isnan(b[k]):
            continue
        rank = int((b <= b[k]).sum())
        bad.append(rank / (n + 1) < 0.5)
    return len(bad), float(np.mean(bad))


def test_pbo_of_more_partitions(spark):
    m = np.random.default_rng(1).normal(0, 0.01, (60, 8))
    long = spark.createDataFrame([(i, k, float(m[i, k])) for i in range(60) for k in range(8)], "i long, trial_id long, ret double")
    row = overfit.probability(overfit.splits(long, 18, largest=None)).first()
    assert (row["n_splits"], pytest.approx(row["pbo"])) == plain_pbo(m, 18)
    with pytest.raises(ValueError):
        overfit.splits(long, 32, largest=None)


@pytest.mark.parametrize(("t", "n", "s"), [(120, 9, 6), (97, 12, 8)])
def test_pbo_is_the_loop(spark, t, n, s):
    m = np.random.default_rng(t).normal(0, 0.01, (t, n))
    m[:, 0] = 0.0
    long = spark.createDataFrame([(i, k, float(m[i, k])) for i in range(t) for k in range(n)], "i long, trial_id long, ret double")
    row = overfit.probability(overfit.splits(long, s)).first()
    assert (row["n_splits"], pytest.approx(row["pbo"])) == plain_pbo(m, s)
    for wrong in (3, 5, 18):
        with pytest.raises(ValueError):
            overfit.splits(long, wrong)
    with pytest.raises(ValueError):
        overfit.splits(long.where("trial_id < 4"), s)


def test_expected_maximum():
    assert significance.expected_max_sharpe(1) == 0.0
    z = NormalDist().inv_cdf
    assert significance.expected_max_sharpe(100) == pytest.approx((1 - 0.5772156649015329) * z(0.99) + 0.5772156649015329 * z(1 - 1 / (100 * math.e)))
    for bad in (0, 2.5, True):
        with pytest.raises((TypeError, ValueError)):
            significance.expected_max_sharpe(bad)
    with pytest.warns(UserWarning):
        significance.deflated_sharpe(0.1, n_trials=2, n_obs=100, skew=0, kurt_excess=0)


def test_bootstrap_is_reproducible(spark):
    x = np.random.default_rng(3).normal(0.001, 0.01, 400)
    one = significance.interval(spark, x, "run", n_trials=20, n_bootstrap=60)
    two = significance.interval(spark, x, "run", n_trials=20, n_bootstrap=60)
    assert one == two and one[1] < one[0] < one[2] and one != significance.interval(spark, x, "other", n_trials=20, n_bootstrap=60)
    block = significance.interval(spark, x, "run", n_trials=20, n_bootstrap=60, block=20)
    assert block[1] < block[2]
    with pytest.raises(ValueError):
        significance.replicates(spark, x, "run", n_trials=20, block=401)


def test_noise_does_not_look_like_skill():
    m = np.random.default_rng(42).normal(0, 0.01, (1000, 100))
    best = m[:, (m.mean(0) / m.std(0, ddof=1)).argmax()]
    assert significance.from_returns(best, 100) < 0.95 < significance.from_returns(best, 1)


# --- regimes, cross-section -------------------------------------------------------------------------------------------------------------------


def test_labels_do_not_see_their_own_return(spark):
    x = np.random.default_rng(4).normal(0, 0.01, 300)
    df = series(spark, x).withColumnRenamed("v", "ret")
    y = x.copy()
    y[250] = 0.5
    for kind in ("vol", "trend"):
        at = T0 + timedelta(hours=250)
        a, b = (regimes.classify(d, ["k"]).where((F.col("regime_kind") == kind) & (F.unix_seconds("time") == int(at.timestamp()))).first()["regime_label"] for d in (df, series(spark, y).withColumnRenamed("v", "ret")))
        assert a == b
    n = {r["regime_kind"]: r["count"] for r in regimes.classify(df, ["k"]).groupBy("regime_kind").count().collect()}
    assert n == {"vol": 270, "trend": 100, "etf": 300}


def test_ols_is_least_squares(spark):
    rng = np.random.default_rng(5)
    b, c = rng.normal(size=200), rng.normal(size=200)
    a = 0.3 + 2 * b - c + rng.normal(0, 0.1, 200)
    got = crosssection.ols(spark.createDataFrame([*map(lambda r: tuple(map(float, r)), zip(a, b, c))], "a double, b double, c double"), "a", ["b", "c"])
    design = np.column_stack([np.ones(200), b, c])
    beta, rss, *_ = np.linalg.lstsq(design, a, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)
    assert np.allclose([got["b_alpha"], got["b_b"], got["b_c"]], beta) and np.allclose([got["se_alpha"], got["se_b"], got["se_c"]], se)
    assert got["r2"] == pytest.approx(1 - rss[0] / ((a - a.mean()) ** 2).sum())


def test_verdicts():
    assert [crosssection.verdict(*x) for x in ((0.6, 0.4), (0.6, 0.8), (0.2, 0.1), (0.4, 0.5))] == ["PROCEED", "KILL", "KILL", "AMBIGUOUS"]


def test_baskets(spark):
    rows = [(f"s{i:02d}", T0, float(i), 0.01 * i, 0.001 * i) for i in range(10)]
    p = spark.createDataFrame(rows, "symbol string, week timestamp, signal double, ret double, fund_sum double")
    r = crosssection.baskets(p).first()
    assert r["price_ret"] == pytest.approx(0.5 * (0.01 - 0.08)) and r["funding_ret"] == pytest.approx(0.5 * (0.008 - 0.001)) and r["n_eligible"] == 10
    assert crosssection.baskets(p.where("signal > 0")).first()["ret"] == 0.0


def test_benchmark_returns(spark):
    t0 = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [("A", "spot", t0 + timedelta(hours=i), 100.0 * 1.01**i) for i in range(49)] + [("A", "perp_usdt", t0, 5.0)]
    k = spark.createDataFrame(rows, "symbol string, market string, open_time timestamp, close double")
    hourly = regimes.benchmark_returns(k, "A", t0, t0 + timedelta(hours=48), "1h").collect()
    assert len(hourly) == 48 and hourly[0]["ret"] == pytest.approx(0.01)
    daily = [r["ret"] for r in regimes.benchmark_returns(k, "A", t0, t0 + timedelta(hours=47)).orderBy("time").collect()]
    assert daily == pytest.approx([1.01**23 - 1, 1.01**24 - 1])
    for bad in (("A", t0.replace(tzinfo=None), t0, "1d"), ("A", t0, t0, "1w"), ("B", t0, t0, "1d")):
        with pytest.raises(ValueError):
            regimes.benchmark_returns(k, *bad)


def test_many_verdicts_are_the_single_ones(spark):
    from quantloom.plans import registry as R

    rng, runs, strata = random.Random(7), [], []
    values = [None, float("nan"), -0.1, 0.0, 0.4, 0.6]
    for i in range(120):
        runs.append((f"r{i}", rng.choice(values), rng.choice([None, 0.4, 0.6]), rng.choice([None, float("nan"), -0.1, -0.4])))
        strata += [(f"r{i}", k, n, rng.choice(values[1:])) for k, n in R.REGIME_GATES if rng.random() < 0.8]
    got = {r["run_id"]: r for r in R.judged(spark.createDataFrame(runs, "run_id string, dsr_lo double, pbo double, max_dd double"), spark.createDataFrame(strata, "run_id string, regime_kind string, regime_label string, sharpe double")).collect()}
    for run, lo, pbo, dd in runs:
        verdict, blocking, missing = R.verdict({"max_dd": dd}, {(k, n): s for r, k, n, s in strata if r == run}, float("nan") if lo is None else lo, pbo)
        assert (got[run]["verdict"], got[run]["missing"], [b.split("=")[0] for b in got[run]["blocking"]]) == (verdict, missing, [b.split("=")[0].split(" ")[0] if not b.startswith("regime") else b.split("=")[0] for b in blocking]), run


def test_panel_of_named_runs(spark):
    from quantloom.plans import registry as R

    t0 = datetime(2026, 1, 1, tzinfo=UTC)
    runs = spark.createDataFrame([("r1", "a", "validated", "clean", t0), ("r2", "a", "validated", "clean", t0 + timedelta(1)), ("r3", "b", "validated", "clean", t0), ("r4", "c", "failed", "clean", t0), ("r5", "d", "validated", "clean", t0)], "run_id string, strategy_id string, status string, corrections_diff_status string, registered_at timestamp").withColumn("metrics_summary_json", F.lit("{}"))
    curves = spark.createDataFrame([(r, t0 + timedelta(hours=i), float(i)) for r, n in (("r1", 9), ("r2", 3), ("r3", 4)) for i in range(n)], "run_id string, time timestamp, period_ret_net double")
    out = R.named_panel(runs, curves, ["a", "b"]).collect()
    assert len(out) == 8 and sum(r["alpha_active"] for r in out) == 7 and R.named_panel(runs, curves, []).count() == 0
    for bad, what in ((["a", "a"], "twice"), (["c"], "no validated"), (["zz"], "no validated"), (["d"], "no curve")):
        with pytest.raises(ValueError, match=what):
            R.named_panel(runs, curves, bad)


def test_families_and_sweeps(spark):
    from quantloom.operators import carry
    from quantloom.plans import family

    rng, t0, rows = random.Random(4), datetime(2026, 1, 1, tzinfo=UTC), []
    for s in "AB":
        for i in range(24 * 12):
            rows.append((s, t0 + timedelta(hours=i), rng.gauss(0, 0.002), rng.gauss(0, 0.002), rng.gauss(1e-5, 3e-5) if i % 8 == 0 else None))
    bars = spark.createDataFrame(rows, "symbol string, open_time timestamp, spot_ret double, perp_ret double, funding_rate double")
    base = carry.hysteresis(bars, carry.CarryParams(ma_lookback=3))
    spans = {"cut": "2026-01-05", "long": timedelta(days=6), "short": timedelta(days=2)}
    trials = family.tied_grid(bars, [1e-6, 4e-6], [4, 6], carry.RatchetParams(ma_lookback=2, min_hold=1))
    assert [(r["compression_exit"], r["compression_reentry"], r["compression_lookback"]) for r in trials.orderBy("trial_id").collect()] == [(1e-6, 2e-6, 4), (1e-6, 2e-6, 6), (4e-6, 8e-6, 4), (4e-6, 8e-6, 6)]
    found = family.swept(bars, trials, base, **spans).collect()
    floor = {r["symbol"]: r for r in family.summary(base, ["symbol"], **spans).collect()}
    for r in found:
        assert r["dominance"] == sum(r[n] >= floor[r["symbol"]][n] - 0.05 for n in family.WINDOWS)
    for s in "AB":
        mine = [r for r in found if r["symbol"] == s]
        order = sorted(mine, key=lambda r: (-r["dominance"], -r["post_sharpe"], r["trial_id"]))
        assert [r["place"] for r in order] == [1, 2, 3, 4]
        gap = {r["compression_lookback"]: r["gap"] for r in family.flatness(spark.createDataFrame(found)).where(F.col("symbol") == s).collect()}
        for n in (4, 6):
            x = [r["post_sharpe"] for r in mine if r["compression_lookback"] == n]
            assert gap[n] == pytest.approx(max(x) - min(x))
    both = family.compared({"v2": base, "v3": carry.ratchet(bars, trials.where("trial_id = 0"))}, **spans).collect()
    assert {(r["variant"], r["symbol"]) for r in both} == {(v, s) for v in ("v2", "v3") for s in "AB"}
    for r in both:
        if r["variant"] == "v2":
            assert r["full_sharpe"] == pytest.approx(floor[r["symbol"]]["full_sharpe"]) and r["n_transitions"] == floor[r["symbol"]]["n_transitions"]
    for r in family.gated(spark.createDataFrame(both)).collect():
        assert r["clears"] == (min(r["full_sharpe"], r["long_sharpe"], r["post_sharpe"]) >= 0 and r["max_dd"] >= -0.3)
    assert family.trial_returns(bars, trials, "A").count() == 4 * 288 and family.recommendation(3) == "candidate"

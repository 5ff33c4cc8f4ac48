"""Command lines, reports, halts, the strategy interface, curated universes, the earlier suite, trials of callables, the alpha document."""

import argparse
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import cli, schemas
from quantloom.operators import carry, crosssection, overfit, quality, significance, universe
from quantloom.plans import registry, reports
from quantloom.sources import archive, exchange
from quantloom.streaming import control

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def test_halts_are_sustained_and_armed_again(spark):
    levels = [0, 6, 0, 6, 6, 6, 2, 6, 2, 2, 2, 6, 6]
    x = spark.createDataFrame([("A", T0 + timedelta(hours=8 * i), float(v)) for i, v in enumerate(levels)], "symbol string, time timestamp, dd double")
    rule = control.Rule("P2", F.col("dd") > 5, 2, F.col("dd") < 3, 3)
    got = [(r["time"], r["change"], r["action"]) for r in control.held(x, [rule], "live").orderBy("time").collect()]
    at = lambda i: (T0 + timedelta(hours=8 * i)).replace(tzinfo=None)
    want, halted, bad, calm = [], False, 0, 0
    for i, v in enumerate(levels):
        bad, calm = (bad + 1 if v > 5 else 0), (calm + 1 if v < 3 else 0)
        if not halted and bad >= 2:
            halted = True
            want.append((at(i), "halt", "flat"))
        elif halted and calm >= 3:
            halted = False
            want.append((at(i), "resume", None))
    assert got == want and len(want) == 3
    assert control.held(x, [rule], "paper").where("change = 'halt'").first()["action"] == "alert"
    for bad in (lambda: control.held(x, [rule], "test"), lambda: control.Rule("P9", F.lit(True), 1, F.lit(True), 1), lambda: control.Rule("P1", F.lit(True), 0, F.lit(True), 1)):
        with pytest.raises(ValueError):
            bad()


def test_a_strategy_behind_the_interface():
    p = carry.RatchetParams(ma_lookback=2, compression_lookback=3, min_hold=1)
    s, machine, rates = control.RatchetStrategy(p), carry.Ratchet(), []
    for r in [1e-4, 2e-4, 3e-4, -5e-4, -5e-4, 1e-4, 6e-4, 9e-4]:
        rates.append(r)
        want = machine.step(*(round(sum(rates[-n:]) / n, 12) if len(rates) >= n else None for n in (2, 3)), p)
        assert s.compute_target_position(rates[-s.length :]) == control.TargetPosition(want, p.capital_per_leg * want)


def test_reports(spark, tmp_path):
    rows = [{"a": "x|y", "n": 12345, "v": 1.5, "ok": True, "no": None}]
    assert reports.ascii_table(rows, ["a", "n", "v"]).splitlines()[3] == "x|y | 12,345 | 1.5000" and reports.cell(None) == "-" and reports.cell(True) == "yes"
    text = reports.markdown("Title", {"One": (rows, ["a", "ok", "no"]), "Two": ([], ["a"])})
    assert "| x\\|y | yes | - |" in text and text.endswith("No rows.\n")
    reports.write_text(text, tmp_path / "d" / "r.md")
    assert (tmp_path / "d" / "r.md").read_text(encoding="utf-8") == text
    q = spark.createDataFrame([("K1_coverage", "ERROR", "A", "spot"), ("k1[A]", "ERROR", "A", "spot"), ("F3_rate", "ERROR", None, None), ("K2_x", "INFO", None, None)], "name string, severity string, symbol string, market string")
    assert {r["category"]: r["n"] for r in reports.error_categories(q).collect()} == {"k1": 2, "f3": 1}
    done = [exchange.Outcome(exchange.Task("spot", "A"), k) for k in ("done", "nothing", "skipped_no_listing", "failed")]
    said = reports.archive_summary(done, q, 2_500_000)
    assert "4 (1 done, 1 with nothing to fetch, 1 skipped, 1 failed)" in said and "3 ERROR, 0 WARN, 1 INFO" in said and "f3=1, k1=2" in said and "series in error: 1" in said and "2.5 MB" in said
    with pytest.raises(ValueError):
        reports.rows_of(spark.range(reports.ROWS + 1))
    assert reports.archive_bytes(spark, [str(tmp_path / "none")]) == 0


def test_curated_universe_and_observed_listings(spark):
    tickers = spark.createDataFrame([("BTCUSDT", 100.0, 5.0, 10), ("SOLUSDT", 50.0, 1.0, 0), ("ORDIUSDT", 9.0, 1.0, 3), ("ETHUSDT", 1.0, 1.0, 1)], "api_symbol string, quote_volume double, last_price double, trades long")
    listed = spark.createDataFrame([("BTCUSDT", date(2019, 9, 8)), ("SOLUSDT", date(2020, 9, 14)), ("ORDIUSDT", date(2024, 1, 1)), ("ETHUSDT", None)], "api_symbol string, listing_date date")
    spot = spark.createDataFrame([("BTC", "BTCUSDT", 7.0), ("BTC", "BTCFDUSD", 9.0)], "base_asset string, pair string, volume double")
    got = {r["symbol"]: r for r in universe.curated(tickers, listed, spot).collect()}
    assert {s: r["rank"] for s, r in got.items()} == {"BTC-USDT": 1, "SOL-USDT": 3} and got["BTC-USDT"]["spot_pairs"] == ["BTCFDUSD", "BTCUSDT"]
    assert got["SOL-USDT"]["avg_trade_size"] == 0.0 and got["SOL-USDT"]["min_listing_days_threshold"] == 730 and got["SOL-USDT"]["spot_pairs"] == []
    wide = universe.curated(tickers, listed, spot, wide=True).collect()
    assert len(wide) == 3 and {r["total_candidates"] for r in wide} == {21} and {r["min_listing_days_threshold"] for r in wide} == {365}
    probed = spark.createDataFrame([("A", "spot", T0), ("B", "spot", T0), ("C", "spot", T0)], "symbol string, market string, listing timestamp")
    bars = spark.createDataFrame([("A", "spot", T0 + timedelta(minutes=30)), ("B", "spot", T0 + timedelta(hours=2)), ("D", "spot", T0)], "symbol string, market string, open_time timestamp")
    assert {r["symbol"]: r["diverged"] for r in universe.observed_listings(probed, bars).collect()} == {"A": False, "B": True, "C": False, "D": False}


def bars_of(spark, hours, **change):
    rows = [("A", m, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1, milliseconds=-1), 100.0, 101.0, 99.0, change.get(i, 100.0) if m == "spot" else 100.0, 1.0, 1.0, 1, T0 + timedelta(days=9)) for m in ("spot", "perp_usdt") for i in range(hours)]
    return spark.createDataFrame(rows, "symbol string, market string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades long, ingested_at timestamp")


def test_the_earlier_suite(spark):
    bars = bars_of(spark, 24).withColumn("close", F.expr("CASE WHEN hour(open_time) = 5 AND market = 'spot' THEN 130.0 ELSE close END")).withColumn("high", F.greatest("high", "close"))
    paid = spark.createDataFrame([("A", T0 + timedelta(hours=8 * i), r) for i, r in enumerate((1e-4, 6e-3, 1e-4))], "symbol string, funding_time timestamp, funding_rate double")
    listed = spark.createDataFrame([("A", "spot", T0), ("A", "perp_usdt", T0)], "symbol string, market string, listing timestamp")
    got = {}
    for r in quality.earlier_suite(bars, paid, listed).collect():
        got.setdefault(r["name"], []).append(r["severity"])
    assert got == {"K1_coverage": ["INFO"] * 2, "F2_funding_coverage": ["INFO"], "K2_duplicates": ["INFO"], "K3_ohlc": ["INFO"], "K4_non_negative": ["INFO"], "K5_stale": ["INFO"], "K6_extreme_returns": ["WARN"], "F1_alignment": ["INFO"], "F3_rate_range": ["WARN"], "F4_duplicates": ["INFO"], "X1_funding_in_bar": ["INFO"]}


def test_trials_of_a_callable(spark):
    sets, df = overfit.enumerated(spark, lambda a, b: [a * i + b for i in range(4)], {"a": [1, 2], "b": [0.5]})
    assert sets == [{"a": 1, "b": 0.5}, {"a": 2, "b": 0.5}] and {(r["trial_id"], r["i"]): r["ret"] for r in df.collect()}[1, 3] == 6.5
    for grid in ({}, {"a": []}):
        with pytest.raises(ValueError, match="empty"):
            overfit.enumerated(spark, lambda **k: [1.0], grid)
    with pytest.raises(ValueError, match="before"):
        overfit.enumerated(spark, lambda a: [0.0] * a, {"a": [1, 2]})


def test_alpha_document_and_clients():
    runs = pd.DataFrame([("r1", "a", "v2", "validated", "pass", "d", T0, '{"sharpe": 2.0}'), ("r2", "a", "v2", "validated", "pass", "d", T0 + timedelta(1), '{"sharpe": -1.0}'), ("r3", "b", "v3", "failed", None, "d", T0, None), ("r4", "c", "v3", "validated", "fail", "d", T0, None)], columns=["run_id", "strategy_id", "variant", "status", "verdict", "data_version", "registered_at", "metrics_summary_json"])
    doc = registry.alpha_document(runs, {"a": ["short history"]})
    assert set(doc) == {"a", "c"} and doc["a"]["run_id"] == "r2" and doc["a"]["status"] == "pass-with-caveats" and doc["a"]["forward_sharpe"] == (-0.5, -0.3) and doc["c"]["status"] == "fail"
    closed = []

    class Transport:
        def __call__(self, url, params):
            return 418, {}, ""

        def close(self):
            closed.append(1)

    with exchange.EarlierClient(Transport(), lambda s: None) as c, pytest.raises(exchange.ApiError) as e:
        c.get("u", {})
    assert type(e.value) is exchange.ApiError and closed == [1]
    with pytest.raises(exchange.RateLimitError):
        exchange.Client(Transport(), lambda s: None).get("u", {})


def test_command_lines(spark, tmp_path):
    assert cli.sample_window("30d") == timedelta(days=30) and cli.sample_window("24h") == timedelta(hours=24) and cli.task_types(" spot,perp_usdt ") == ("spot", "perp_usdt")
    for bad in ("30", "d", "3w"):
        with pytest.raises(ValueError):
            cli.sample_window(bad)
    with pytest.raises(ValueError):
        cli.task_types("bonds")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])
    root = str(tmp_path)
    members = spark.createDataFrame([(T0, date(2026, 1, 1), date(2026, 1, 31), 1, "A", "AUSDT", ["A"], date(2026, 1, 1))], "as_of timestamp, period_start date, period_end date, rank int, symbol string, api_symbol string, spot_pairs array<string>, listing_date date")
    archive.write_snapshot(members, members.limit(0), f"{root}/universe", "perp_usdt", date(2026, 1, 1))
    n = 24 * 6
    k = schemas.conform(bars_of(spark, n).withColumns({"taker_buy_base": F.lit(0.0), "taker_buy_quote": F.lit(0.0), "source": F.lit("t")}), schemas.KLINES)
    f = spark.createDataFrame([("A", T0 + timedelta(hours=8 * i), 1e-4 if i % 5 else -2e-4, None, T0, "t") for i in range(n // 8)], schemas.FUNDING)
    archive.upsert_klines(spark, f"{root}/klines", k)
    archive.upsert_funding(spark, f"{root}/funding", f)
    said, seen = [], []
    args = cli.parser().parse_args(["archive", "--root", root, "--snapshot", "2026-01", "--end", "2026-01-07"])
    assert cli.run_archive(spark, args, lambda t, end: seen.append((t.market, end)) or ("done", 1), say=said.append) == 0
    assert [m for m, _ in seen] == ["perp_usdt", "spot", "perp_funding"] and "3 done" in said[0] and "0 ERROR" in said[0] and len(list((tmp_path / "audit").iterdir())) == 1

    def banned(t, end):
        raise exchange.RateLimitError("418")

    assert cli.run_archive(spark, args, banned, say=said.append) == 11 and cli.run_archive(spark, args, banned, say=said.append) == 11
    for command in ("sweep", "compare"):
        said.clear()
        assert cli.run_family(spark, argparse.Namespace(command=command, root=root, symbols="A"), say=said.append) == 0
        assert "full_sharpe" in said[0]
    with pytest.raises(SystemExit):
        cli.main(["archive", "--root", root, "--snapshot", "2026-01"])


def test_residual_is_what_least_squares_leave(spark):
    rows = [(float(i % 7) - 2.5 + 0.3 * (i % 5), float(i % 5)) for i in range(60)] + [(None, 1.0)]
    x = spark.createDataFrame(rows, "y double, x double")
    one, left = crosssection.ols(x, "y", ["x"]), np.array([y for y, _ in rows[:-1]])
    left = left - one["b_x"] * np.array([v for _, v in rows[:-1]])
    ratio, r2 = crosssection.residual(x, "y", "x", 52.0)
    assert ratio == pytest.approx(left.mean() / left.std(ddof=1) * 52**0.5) and r2 == pytest.approx(one["r2"])
    assert crosssection.residual(x.withColumn("x", F.lit(1.0)), "y", "x", 52.0)[0] == 0.0


def test_deflated_ratios_of_many_series_are_the_ratio_of_each(spark):
    g = np.random.default_rng(3)
    series = {"a": g.normal(0.05, 1, 300), "b": g.normal(-0.1, 2, 50), "c": np.array([0.1, -0.2, 0.3]), "d": np.full(20, 0.1), "e": g.normal(3, 0.1, 40)}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("a", None), ("a", float("nan"))]
    got = {r["k"]: r["dsr"] for r in significance.deflated(spark.createDataFrame(rows, "k string, r double"), "r", ["k"], 20).collect()}
    for k, x in series.items():
        want = significance.from_returns(x, 20)
        assert got[k] is None if want != want else got[k] == pytest.approx(want, abs=1e-12)
    assert got["c"] is None and got["d"] is None

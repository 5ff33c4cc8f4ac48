import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import carry, overfit

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def market(spark, rates, spot=None, perp=None, symbol="AAA"):
    """Eight hourly bars for each rate, a settlement at the first of them."""
    n = 8 * len(rates)
    spot, perp = spot or [50_000.0] * n, perp or spot or [50_000.0] * n
    bars = [(symbol, m, T0 + timedelta(hours=i), float(x[i])) for m, x in (("spot", spot), ("perp_usdt", perp)) for i in range(n)]
    paid = [(symbol, T0 + timedelta(hours=8 * i), float(r)) for i, r in enumerate(rates)]
    return spark.createDataFrame(bars, "symbol string, market string, open_time timestamp, close double"), spark.createDataFrame(paid, "symbol string, funding_time timestamp, funding_rate double")


def states(spark, rates, **params):
    bars = carry.assemble(*market(spark, rates))
    trials = overfit.grid(spark, {k: [v] for k, v in (carry.RatchetParams().as_dict() | params).items() if k not in ("fee_bps", "capital_per_leg")})
    return [r["regime_state"] for r in carry.ratchet(bars, trials).orderBy("open_time").collect()]


def flips(x):
    return sum(a != b for a, b in zip(x, x[1:]))


def test_positive_funding_stays_active(spark):
    told = carry.hysteresis(carry.assemble(*market(spark, [2e-4] * 42)), carry.CarryParams())
    assert carry.transitions(told).first()["n_transitions"] == 0
    legs = carry.legs(told)
    assert legs.where("leg_id = 1 and notional > 0").count() == 336
    assert legs.agg(F.sum("funding_paid")).first()[0] < 0
    curve = [r["equity"] for r in carry.equity(carry.costs(legs)).orderBy("time").collect()]
    assert curve[0] == pytest.approx(1000) and curve[-1] > curve[0]


def test_negative_funding_exits_once_and_pays(spark):
    told = carry.hysteresis(carry.assemble(*market(spark, [-2e-4] * 42)), carry.CarryParams())
    assert carry.transitions(told).first()["n_transitions"] == 1
    assert told.orderBy(F.desc("open_time")).first()["regime_state"] == 0
    assert carry.costs(carry.legs(told)).agg(F.sum("fees")).first()[0] == pytest.approx(500 * 0.001 + 500 * 0.00045)


@pytest.mark.parametrize("rate", [3e-4, -3e-4])
def test_funding_sign(spark, rate):
    legs = carry.legs(carry.hysteresis(carry.assemble(*market(spark, [rate] * 3)), carry.CarryParams()))
    paid = {round(r["funding_paid"], 9) for r in legs.where("leg_id = 1").collect()}
    assert paid == {0.0, round(-500 * rate, 9)}


def test_equity_is_the_recursion(spark):
    rng = random.Random(3)
    n = 8 * 60
    spot, perp = [50_000.0], [50_000.0]
    for _ in range(n - 1):
        step = rng.gauss(0, 0.01)
        spot.append(spot[-1] * (1 + step))
        perp.append(perp[-1] * (1 + step + rng.gauss(0, 0.002)))
    told = carry.hysteresis(carry.assemble(*market(spark, [rng.gauss(0, 3e-4) for _ in range(60)], spot, perp)), carry.CarryParams(ma_lookback=3))
    legs = carry.costs(carry.legs(told), "vip_3", carry.linear_slippage(5)).persist()
    got = carry.equity(legs).orderBy("time").collect()
    by = {}
    for r in legs.collect():
        g, c = by.get(r["time"], (0.0, 0.0))
        by[r["time"]] = (g + r["weight"] * r["leg_ret"], c + r["fees"] + r["funding_paid"] + r["slippage"])
    e = None
    for r in got:
        g, c = by[r["time"]]
        e = 1000.0 if e is None else e * (1 + g) - c
        assert r["equity"] == pytest.approx(e, rel=1e-10)
    assert sum(v for k, v in carry.curve_faults(carry.equity(legs)).first().asDict().items() if k != "symbol") == 0


def test_hysteresis_is_the_loop(spark):
    rng = random.Random(5)
    rates = [rng.gauss(0, 2e-4) for _ in range(300)]
    p = carry.CarryParams(ma_lookback=4)
    got = [r["regime_state"] for r in carry.hysteresis(carry.assemble(*market(spark, rates)), p).orderBy("open_time").collect()]
    state, want = 1, []
    for i in range(len(rates)):
        if i >= 3:
            ma = round(sum(rates[i - 3 : i + 1]) / 4, 12)
            state = 0 if ma < p.exit_threshold else 1 if ma > p.reentry_threshold else state
        want += [state] * 8
    assert got == want and flips(want) > 10
    with pytest.raises(ValueError):
        carry.hysteresis(carry.assemble(*market(spark, [1e-4])), carry.CarryParams(exit_threshold=1.0))


def test_ratchet_trajectories(spark):
    steady = states(spark, [5e-4] * 200)
    assert steady[: 119 * 8] == [0] * (119 * 8) and set(steady[119 * 8 :]) == {1}
    crater = states(spark, [5e-4] * 150 + [-2e-4] * 100)
    assert max(crater) == 1 and crater[-1] == 0
    squeezed = states(spark, [5e-4] * 130 + [2e-6] * 200)
    assert flips(squeezed) == 2 and squeezed[-1] == 0


def test_ratchet_holds_for_its_least_number(spark):
    got = states(spark, [5e-4] * 21 + [-5e-4] * 40, ma_lookback=3, compression_lookback=3, min_hold=21)
    at = [i // 8 for i in range(1, len(got)) if got[i] != got[i - 1]]
    assert at == [20, 41]  # entered at the 21st settlement; the exit waits for 21 more


def test_costs_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([("A", 0, "moon", T0, 1.0)], "symbol string, leg_id int, market string, time timestamp, notional double")
    with pytest.raises(ValueError):
        carry.costs(df, "vip_99")
    with pytest.raises(Exception, match="unknown market"):
        carry.costs(df).collect()
    with pytest.raises(ValueError):
        carry.linear_slippage(-1)


def test_empty_inputs_give_empty_frames(spark):
    k, f = (x.limit(0) for x in market(spark, [1e-4]))
    told = carry.hysteresis(carry.assemble(k, f), carry.CarryParams())
    assert carry.equity(carry.costs(carry.legs(told))).count() == 0


def test_earlier_study(spark):
    k, f = market(spark, [1e-4] * 6 + [-3e-4] * 30)
    always = carry.always_on(k, f).persist()
    want = 999.0 * math.prod(1 + 0.5 * r for r in [1e-4] * 6 + [-3e-4] * 30)
    assert always.orderBy(F.desc("open_time")).first()["equity"] == pytest.approx(want)
    out = carry.switched(always, 3, -1e-4, 5e-5)
    assert carry.transitions(out).first()["n_transitions"] == 1


def plain_equity(rows, nav=1000.0):
    out = []
    for i, (g, c) in enumerate(rows):
        e = out[-1] if out else nav
        out.append(nav if i == 0 else e * (1 + g - (c / e if e > 0 else 0.0)))
    return out


def wiped(spark, series):
    """One leg a bar whose weighted return is g and whose fees are c."""
    rows = [(s, T0 + timedelta(hours=i), 1.0, float(g), float(c), 0.0, 0.0) for s, x in series.items() for i, (g, c) in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, time timestamp, weight double, leg_ret double, fees double, funding_paid double, slippage double")


def test_equity_of_wiped_out_books_is_the_recursion(spark):
    series = {
        "below": [(0, 1), (0.1, 1), (-1.2, 1), (0.05, 1), (-0.3, 1)], "nothing": [(0, 1), (0.1, 1), (-1.0, 0), (0.05, 1), (0.2, 1)], "costs": [(0, 1), (0.1, 1), (0.0, 2000), (0.05, 1), (-0.1, 3)],
        "fine": [(0, 5), (0.1, 1), (-0.2, 1), (0.05, 2), (0, 0)], "minus": [(0, 0), (-1.0, 5), (0.1, 1), (0.1, 1), (0, 0)], "first": [(-2.0, 7), (0.1, 1), (-0.5, 1), (0.2, 1), (0.1, 1)],
    }
    got = {}
    for r in carry.equity(wiped(spark, series)).orderBy("time").collect():
        got.setdefault(r["symbol"], []).append(r)
    for s, x in series.items():
        want = plain_equity(x)
        assert [r["equity"] for r in got[s]] == pytest.approx(want, rel=1e-10, abs=1e-12), s
        assert all(b["equity"] == pytest.approx(a["equity"] * (1 + b["period_ret_net"]), abs=1e-9) for a, b in zip(got[s], got[s][1:])), s
    faults = {r["symbol"]: r["not_positive"] for r in carry.curve_faults(carry.equity(wiped(spark, series))).collect()}
    assert faults["fine"] == 0 and all(faults[s] for s in series if s not in ("fine", "first"))


def test_compounding_counts_total_losses(spark):
    from quantloom.functions import metrics
    from quantloom.operators import windows

    x = spark.createDataFrame([(k, i, float(r)) for k, rs in {"a": (0.1, -1.5, 0.2), "b": (0.1, -1.0, 0.2), "c": (0.1, 0.2), "d": (-1.5, -1.5)}.items() for i, r in enumerate(rs)], "k string, i int, r double")
    got = {r["k"]: r["x"] for r in x.groupBy("k").agg(windows.compounded(F.col("r")).alias("x")).collect()}
    assert got == pytest.approx({"a": 1.1 * -0.5 * 1.2 - 1, "b": -1.0, "c": 0.32, "d": -0.75})
    with pytest.raises(ValueError, match="unit"):
        metrics.resampled(x, "3fortnights")


def test_resampling_units(spark):
    from quantloom.functions import metrics

    rows = [("A", T0 + timedelta(hours=i), 100.0 + i, 0.01) for i in range(24 * 9)]
    c = spark.createDataFrame(rows, "symbol string, time timestamp, equity double, period_ret_net double")
    four = metrics.resampled(c, "4h").orderBy("period").collect()
    assert len(four) == 54 and four[0]["equity"] == 103.0 and four[1]["ret"] == pytest.approx(1.01**4 - 1) and four[1]["pnl"] == 4.0
    week = metrics.resampled(c, "1w").orderBy("period").collect()
    assert [r["period"].weekday() for r in week] == [0, 0] and metrics.resampled(c, "day").count() == 9


def test_curve_contract(spark):
    from quantloom import schemas

    rows = [("r", T0 + timedelta(hours=i), 100.0 * 1.01**i, 0.01, 0.01 if i else 0.0, 100.0 * 1.01**i - 100) for i in range(5)]
    kinds = schemas.EQUITY_CURVE
    make = lambda rows: spark.createDataFrame(rows, kinds)
    assert carry.checked_curve(make(rows)).count() == 5 and carry.checked_curve(make([])).count() == 0
    spoilt = [rows[:2] + [(*rows[2][:2], v, *rows[2][3:])] + rows[3:] for v in (None, float("nan"), -1.0, 105.0)]
    spoilt += [rows + [rows[-1]], rows[:3] + [("r", None, *rows[3][2:])], rows[:4] + [(*rows[4][:5], 1e6)]]
    for bad in spoilt:
        with pytest.raises(ValueError, match="not an equity curve"):
            carry.checked_curve(make(bad))
    with pytest.raises(ValueError, match="columns"):
        carry.checked_curve(make(rows).withColumn("equity", F.col("equity").cast("float")))

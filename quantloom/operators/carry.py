"""The delta-neutral carry strategy: bars, regime states, legs, costs, attribution and equity, for all symbols (and trials) at once.

A frame's series are told apart by `keys` (symbol, or symbol and trial_id); every step is a window or an aggregate over them, so nothing
loops over symbols or parameter sets.  Only the ratcheted state machine is a fold in Python, and only settlement rows reach it."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.operators import windows
from quantloom.session import shipped

# Taker rates by market and tier; maker rates are not used by the backtest.
TAKER = {
    "spot": {"regular": 0.0010, "vip_1": 0.0010, "vip_2": 0.0010, "vip_3": 0.0006, "vip_4": 0.00054, "vip_5": 0.00048},
    "perp_usdt": {"regular": 0.00045, "vip_1": 0.00040, "vip_2": 0.00035, "vip_3": 0.00032, "vip_4": 0.00030, "vip_5": 0.00027},
}
MAKER = {
    "spot": {"regular": 0.0010, "vip_1": 0.00090, "vip_2": 0.00080, "vip_3": 0.00042, "vip_4": 0.00042, "vip_5": 0.00036},
    "perp_usdt": {"regular": 0.00018, "vip_1": 0.00016, "vip_2": 0.00014, "vip_3": 0.00012, "vip_4": 0.00010, "vip_5": 0.00008},
}


@dataclass(frozen=True)
class CarryParams:
    """The two-threshold variant.  fee_bps is part of the identity of a run but has no effect: costs come from the tiers."""

    ma_lookback: int = 21
    exit_threshold: float = -1e-4
    reentry_threshold: float = 5e-5
    capital_per_leg: float = 500.0
    fee_bps: float = 10.0

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class RatchetParams:
    """The variant with a second, slow mean whose size must stay open, and a least number of settlements between changes."""

    ma_lookback: int = 21
    exit_threshold: float = -1e-4
    reentry_threshold: float = 5e-5
    compression_lookback: int = 120
    compression_exit: float = 5e-6
    compression_reentry: float = 1e-5
    min_hold: int = 21
    capital_per_leg: float = 500.0
    fee_bps: float = 10.0

    def as_dict(self) -> dict:
        return asdict(self)


def assemble(klines: DataFrame, funding: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """keys, open_time, spot_close, perp_close, funding_rate (null between settlements), spot_ret, perp_ret: hours with both markets.

    The two markets meet in one aggregation instead of a self-join."""
    side = {m: F.max(F.when(F.col("market") == m, F.col("close"))) for m in ("spot", "perp_usdt")}
    bars = klines.groupBy(*keys, "open_time").agg(side["spot"].alias("spot_close"), side["perp_usdt"].alias("perp_close")).where("spot_close is not null and perp_close is not null")
    rates = funding.select(*keys, F.col("funding_time").alias("open_time"), "funding_rate")
    bars = bars.join(rates, [*keys, "open_time"], "left")
    return bars.withColumns({"spot_ret": windows.pct_change("spot_close", keys, "open_time"), "perp_ret": windows.pct_change("perp_close", keys, "open_time")})


def settlement_mean(keys: list[str], n: int) -> Column:
    """The mean of the last n settled rates at settlement rows, rounded so that engines agree at thresholds; null elsewhere."""
    settled = F.col("funding_rate").isNotNull()
    mean = windows.rolling(F.avg, F.col("funding_rate"), [*keys, settled], "open_time", n)
    return F.when(settled, F.round(mean, 12))


def hysteresis(bars: DataFrame, p: CarryParams, keys: list[str] = ["symbol"]) -> DataFrame:
    """bars with regime_state: 1 from the start, 0 after a mean below exit, 1 again after one above re-entry.

    Between thresholds the state holds, so it is the last decisive settlement's; no fold is needed while exit <= re-entry."""
    if p.exit_threshold > p.reentry_threshold:
        raise ValueError("exit_threshold must not exceed reentry_threshold")
    told = bars.withColumn("_ma", settlement_mean(keys, p.ma_lookback))
    decided = F.when(F.col("_ma") < p.exit_threshold, 0).when(F.col("_ma") > p.reentry_threshold, 1)
    return told.withColumn("regime_state", F.coalesce(windows.forward_filled(decided, keys, "open_time"), F.lit(1)).cast("tinyint")).drop("_ma")


@dataclass
class Ratchet:
    """The ratcheted machine, one settlement at a time; batch and stream share it."""

    state: int = 0
    since: int = 0

    def step(self, fast: float | None, slow: float | None, p: RatchetParams) -> int:
        """fast, slow: the means at this settlement, None while they lack values.  Every settlement counts towards the least hold."""
        self.since += 1
        if fast is not None and slow is not None and self.since >= p.min_hold:
            size = abs(slow)
            leave = self.state == 1 and (fast < p.exit_threshold or size < p.compression_exit)
            enter = self.state == 0 and fast > p.reentry_threshold and size > p.compression_reentry
            if leave or enter:
                self.state, self.since = 1 - self.state, 0
        return self.state


def ratchet(bars: DataFrame, trials: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """bars for each row of trials (trial_id and the fields of RatchetParams), with trial_id and regime_state, 0 before any entry.

    The settlement rows of one series and one trial go through the fold together; all other rows take their state from a window."""
    names = [f for f in RatchetParams.__dataclass_fields__ if f in trials.columns]
    both = [*keys, "trial_id"]
    rates = bars.where("funding_rate is not null").select(*keys, "open_time", "funding_rate").crossJoin(F.broadcast(trials))  # a stated, small grid
    kinds = ", ".join(f"`{k}` {dict(bars.dtypes)[k]}" for k in keys)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("open_time")
        p, machine = RatchetParams(**{n: rows[n].iloc[0].item() for n in names}), Ratchet()
        fast, slow = (rows["funding_rate"].rolling(n).mean().round(12) for n in (p.ma_lookback, p.compression_lookback))
        states = [machine.step(None if pd.isna(a) else a, None if pd.isna(b) else b, p) for a, b in zip(fast, slow, strict=True)]
        return rows[[*both, "open_time"]].assign(state=states)

    shipped(bars.sparkSession)
    states = rates.groupBy(*both).applyInPandas(fold, f"{kinds}, trial_id long, open_time timestamp, state int")
    out = bars.crossJoin(F.broadcast(trials)).join(states, [*both, "open_time"], "left")
    return out.withColumn("regime_state", F.coalesce(windows.forward_filled(F.col("state"), both, "open_time"), F.lit(0)).cast("tinyint")).drop("state")


def transitions(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """keys, n_transitions."""
    before = F.lag("regime_state").over(windows.over(keys, "open_time"))
    return bars.select(*keys, (F.col("regime_state") != before).alias("_c")).groupBy(*keys).agg(F.count_if("_c").alias("n_transitions"))


def legs(bars: DataFrame, capital_per_leg: float = 500.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """Two rows for each bar: leg 0 long spot, leg 1 short perpetual; weights in shares of both legs' capital."""
    s = F.col("regime_state").cast("double")
    paid = F.when(s > 0, -F.lit(capital_per_leg) * s * F.coalesce("funding_rate", F.lit(0.0))).otherwise(0.0)

    def leg(number: int, market: str, side: str, weight: Column, ret: str, funding: Column) -> Column:
        return F.struct(F.lit(number).cast("short").alias("leg_id"), F.lit(market).alias("market"), F.lit(side).alias("side"), weight.alias("weight"), (F.lit(capital_per_leg) * s).alias("notional"), F.col(ret).alias("leg_ret"), funding.alias("funding_paid"))

    both = F.array(leg(0, "spot", "long", 0.5 * s, "spot_ret", F.lit(0.0)), leg(1, "perp_usdt", "short", -0.5 * s, "perp_ret", paid))
    return bars.select(*keys, F.col("open_time").alias("time"), F.inline(both))


def zero_slippage(traded: Column) -> Column:
    return F.lit(0.0)


def linear_slippage(bps: float):
    """Proportional to what is traded."""
    if bps < 0:
        raise ValueError("slippage must not be negative")
    return lambda traded: traded * (bps / 10000)


def costs(positions: DataFrame, fee_tier: str = "regular", slippage=zero_slippage, keys: list[str] = ["symbol"]) -> DataFrame:
    """positions with fees and slippage of what each leg trades; the first row of a leg trades nothing.

    slippage: Column of traded notional -> Column; a pandas UDF serves for models that columns cannot say."""
    if fee_tier not in TAKER["spot"]:
        raise ValueError(f"unknown fee tier: {fee_tier}")
    before = F.lag("notional").over(windows.over([*keys, "leg_id"], "time"))
    traded = F.coalesce(F.abs(F.col("notional") - before), F.lit(0.0))
    rate = F.coalesce(*[F.when(F.col("market") == m, F.lit(t[fee_tier])) for m, t in TAKER.items()], F.raise_error(F.concat(F.lit("unknown market: "), "market")).cast("double"))
    return positions.withColumn("_t", traded).withColumns({"fees": F.col("_t") * rate, "slippage": slippage(F.col("_t"))}).drop("_t")


def funding_direction(side: Column, rate: Column) -> Column:
    """What a side earns of a rate: a short gets it, a long pays it."""
    return F.when(side == "short", rate).when(side == "long", -rate)


def contributions(costed: DataFrame, capital_per_leg: float = 500.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """keys, time, contrib_pnl, position_notional, weight_net."""
    nav = 2 * capital_per_leg
    return costed.groupBy(*keys, "time").agg(
        (F.sum(F.col("weight") * F.col("leg_ret")) * nav - F.sum("fees") - F.sum("funding_paid") - F.sum("slippage")).alias("contrib_pnl"),
        F.abs(F.sum("weight") * nav).alias("position_notional"),
        F.sum("weight").alias("weight_net"),
    )


def equity(costed: DataFrame, capital_per_leg: float = 500.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """keys, time, equity, period_ret_gross, period_ret_net, cumulative_pnl.

    The recursion e(t) = e(t-1) (1 + g(t)) - c(t) has the closed form e = P (nav - sum c / P) with P the running product of 1 + g, so
    window sums give it, up to the first bar that leaves nothing: a loss of all or more (g <= -1), or costs above what is left.  From there on
    nothing is charged: e(t) = e(t-1) (1 + g(t)), whose sign the losses beyond 1 turn.  The first bar holds the capital; its costs are not
    charged."""
    nav = 2 * capital_per_leg
    w = windows.over(keys, "time")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bar = costed.groupBy(*keys, "time").agg(F.sum(F.col("weight") * F.col("leg_ret")).alias("_g"), F.sum(F.col("fees") + F.col("funding_paid") + F.col("slippage")).alias("_c"))
    bar = bar.withColumn("_first", F.row_number().over(w) == 1)
    bar = bar.withColumns({"_g": F.when(F.col("_first"), 0.0).otherwise(F.col("_g")), "_c": F.when(F.col("_first"), 0.0).otherwise(F.col("_c"))})
    bar = bar.withColumn("_p", F.exp(F.sum(F.when(F.col("_g") > -1, F.log1p("_g"))).over(running)))
    bar = bar.withColumn("_e", F.col("_p") * (nav - F.sum(F.col("_c") / F.col("_p")).over(running)))
    bar = bar.withColumn("_dead", F.coalesce(F.max((F.col("_g") <= -1) | (F.col("_e") <= 0)).over(before), F.lit(False)))
    # The bar at which nothing is left, and what it leaves; later bars are multiples of that.
    last = F.when(F.col("_g") > -1, F.col("_e")).otherwise(F.lag("_e").over(w) * (1 + F.col("_g")) - F.col("_c"))
    bar = bar.withColumn("_e", F.when(~F.col("_dead"), last))
    held = F.last("_e", ignorenulls=True).over(running)
    later = 1 + windows.compounded(F.when(F.col("_dead"), F.col("_g")), running)
    bar = bar.withColumn("equity", F.when(F.col("_dead"), held * later).otherwise(F.col("_e")))
    net = F.col("_g") - F.when(F.col("_dead"), 0.0).otherwise(F.coalesce(F.col("_c") / F.lag("equity").over(w), F.lit(0.0)))
    return bar.select(*keys, "time", "equity", F.col("_g").alias("period_ret_gross"), net.alias("period_ret_net"), (F.col("equity") - nav).alias("cumulative_pnl"))


def curve_faults(curve: DataFrame, keys: list[str] = ["symbol"], rtol: float = 1e-9) -> DataFrame:
    """keys, and how many rows break each rule of an equity curve: missing or not increasing times, equity that is missing, NaN or not
    positive, a step that period_ret_net does not explain, gains that are not those since the first row.  Time order is the frame's own, so
    ties count as breaks."""
    w = windows.over(keys, "time")
    before, start = F.lag("equity").over(w), F.first("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    due = before * (1 + F.col("period_ret_net"))
    bad = {
        "time_breaks": F.col("time").isNull() | (F.col("time") <= F.lag("time").over(w)),
        "not_positive": F.col("equity").isNull() | F.isnan("equity") | (F.col("equity") <= 0),
        "recursion_breaks": F.abs(F.col("equity") - due) > rtol * F.abs(due),
        "pnl_breaks": F.col("cumulative_pnl").isNull() | (F.abs(F.col("cumulative_pnl") - (F.col("equity") - start)) > rtol * F.greatest(F.abs("cumulative_pnl"), F.lit(rtol))),
    }
    return curve.select(*keys, *[c.alias(n) for n, c in bad.items()]).groupBy(*keys).agg(*[F.count_if(n).alias(n) for n in bad])


def checked_curve(curve: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """curve, if it has exactly the persisted columns and types and no row breaks a rule; else ValueError names what does.  Empty curves pass."""
    if [(f.name, f.dataType) for f in curve.schema] != [(f.name, f.dataType) for f in schemas.EQUITY_CURVE]:
        raise ValueError(f"not the columns of an equity curve: {curve.schema.simpleString()}")
    rules = curve_faults(curve, keys).columns[len(keys) :]
    found = curve_faults(curve, keys).agg(*[F.sum(n).alias(n) for n in rules]).first().asDict()
    if bad := {n: v for n, v in found.items() if v}:
        raise ValueError(f"not an equity curve: {bad}")
    return curve


def always_on(klines: DataFrame, funding: DataFrame, capital: float = 1000.0, fee_bps: float = 10.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """The earlier study's first variant: always in the position; keys, open_time, funding_income, ret, equity."""
    bars = assemble(klines, funding, keys)
    bars = bars.withColumn("funding_income", F.coalesce("funding_rate", F.lit(0.0)))
    bars = bars.withColumn("ret", F.col("spot_ret") - F.col("perp_ret") + 0.5 * F.col("funding_income"))
    grown = 1 + windows.compounded(F.col("ret"), windows.over(keys, "open_time").rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("equity", F.lit(capital * (1 - fee_bps / 10000)) * grown)


def switched(bars: DataFrame, lookback: int, exit_at: float, reenter_at: float, capital: float = 1000.0, fee_bps: float = 10.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """The earlier study's second variant on the first's bars: returns only while the state is 1, half the fee at each change; zero
    funding income does not count as a settlement there.  keys, open_time, regime_state, ret, equity."""
    paid = F.col("funding_income") != 0
    mean = F.when(paid, F.round(windows.rolling(F.avg, F.col("funding_income"), [*keys, paid], "open_time", lookback), 12))
    told = bars.withColumn("_ma", mean)
    state = F.coalesce(windows.forward_filled(F.when(F.col("_ma") < exit_at, 0).when(F.col("_ma") > reenter_at, 1), keys, "open_time"), F.lit(1))
    told = told.withColumn("regime_state", state.cast("int"))
    w = windows.over(keys, "open_time")
    flip = (F.col("regime_state") != F.coalesce(F.lag("regime_state").over(w), F.lit(1))).cast("double")
    told = told.withColumn("ret", F.col("ret") * F.col("regime_state") - flip * (fee_bps / 10000 / 2))
    return told.withColumn("equity", F.lit(capital * (1 - fee_bps / 10000)) * (1 + windows.compounded(F.col("ret"), w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_ma")

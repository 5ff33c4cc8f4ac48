"""Whole families of carry runs as one job: every symbol, variant and parameter set is a series of the same frames.

What the questions have in common is a summary of each series: Sharpe ratios over the whole curve, its last spans and the time after a cut,
the worst drawdown, the share of active bars, the transitions and the final equity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import carry, overfit, windows

# The cut, the spans, the tolerance and the drawdown gate of a comparison; the grid of a sweep and how re-entry follows exit.
CUT, LONG, SHORT = "2024-01-11", timedelta(days=365), timedelta(days=90)
TOLERANCE, DRAWDOWN = 0.05, 0.30
EXITS, LOOKBACKS, REENTRY = [0.000005, 0.00001, 0.000015, 0.00002, 0.00003, 0.00005], [60, 90, 120], 2.0
WINDOWS = ["full_sharpe", "long_sharpe", "short_sharpe", "post_sharpe"]


def summary(bars: DataFrame, keys: list[str], *, capital_per_leg: float = 500.0, fee_tier: str = "regular", slippage=carry.zero_slippage, cut: str = CUT, long: timedelta = LONG, short: timedelta = SHORT, ppy: float = 8760.0) -> DataFrame:
    """keys, n_obs, the four ratios of WINDOWS, max_dd, active_fraction, n_transitions, final_equity of every series of bars with states.

    A ratio without two returns or without variation is 0."""
    legs = carry.costs(carry.legs(bars, capital_per_leg, keys), fee_tier, slippage, keys)
    curve = carry.equity(legs, capital_per_leg, keys)
    w = windows.over(keys, "time")
    c = curve.withColumn("_dd", windows.drawdown("equity", keys, "time")).withColumn("_end", F.max("time").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    micros = lambda d: d // timedelta(microseconds=1)
    since = lambda d: F.unix_micros("time") >= F.unix_micros("_end") - micros(d)
    r = F.col("period_ret_net")
    c = c.withColumns({"_full": r, "_long": F.when(since(long), r), "_short": F.when(since(short), r), "_post": F.when(F.col("time") >= F.lit(cut).cast("timestamp"), r)})
    graded = c.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), *[F.coalesce(metrics.sharpe_population(f"_{n.split('_')[0]}", ppy), F.lit(0.0)).alias(n) for n in WINDOWS],
        F.min("_dd").alias("max_dd"), F.max_by("equity", "time").alias("final_equity"),
    )
    before = F.lag("regime_state").over(windows.over(keys, "open_time"))
    active = bars.select(*keys, F.col("regime_state").alias("_s"), before.alias("_b")).groupBy(*keys).agg(F.avg((F.col("_s") > 0).cast("double")).alias("active_fraction"), F.count_if(F.col("_s") != F.col("_b")).alias("n_transitions"))
    return graded.join(active, keys)


def gated(found: DataFrame) -> DataFrame:
    """A summary with clears: no ratio but that of the short span is negative, and the drawdown is within the limit."""
    return found.withColumn("clears", (F.col("full_sharpe") >= 0) & (F.col("long_sharpe") >= 0) & (F.col("post_sharpe") >= 0) & (F.col("max_dd") >= -DRAWDOWN))


def compared(variants: dict[str, DataFrame], keys: list[str] = ["symbol"], **spans) -> DataFrame:
    """variant and the summary of each series of each variant; variants: name -> bars with states.  One pass over all of them."""
    both = None
    for name, bars in variants.items():
        one = bars.select(F.lit(name).alias("variant"), *keys, "open_time", "spot_ret", "perp_ret", "funding_rate", F.col("regime_state").cast("int").alias("regime_state"))
        both = one if both is None else both.unionByName(one)
    return summary(both, ["variant", *keys], **spans)


def tied_grid(bars: DataFrame, exits: Sequence[float] = EXITS, lookbacks: Sequence[int] = LOOKBACKS, base: carry.RatchetParams | None = None) -> DataFrame:
    """trial_id from 0 and the ratchet's parameters: each compression exit with each lookback, re-entry at REENTRY times the exit."""
    names = {k: v for k, v in (base or carry.RatchetParams()).as_dict().items() if k not in ("fee_bps", "capital_per_leg")}
    rows = [names | {"compression_exit": float(x), "compression_reentry": float(x) * REENTRY, "compression_lookback": int(n)} for x in exits for n in lookbacks]
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in rows[0].items())
    return bars.sparkSession.createDataFrame([(i, *row.values()) for i, row in enumerate(rows)], f"trial_id long, {kinds}")


def swept(bars: DataFrame, trials: DataFrame, baseline: DataFrame, **spans) -> DataFrame:
    """symbol, trial_id, the parameters that vary, the summary, dominance (the windows in which the trial beats or nearly beats the symbol's
    baseline) and place among the symbol's trials.  baseline: bars with states of the variant to beat."""
    found = summary(carry.ratchet(bars, trials), ["symbol", "trial_id"], **spans)
    floor = summary(baseline, ["symbol"], **spans).select("symbol", *[F.col(n).alias(f"_{n}") for n in WINDOWS])
    beats = sum((F.col(n) >= F.col(f"_{n}") - TOLERANCE).cast("int") for n in WINDOWS)
    met = found.join(floor, "symbol").withColumn("dominance", beats).drop(*[f"_{n}" for n in WINDOWS])
    met = met.join(F.broadcast(trials.select("trial_id", "compression_exit", "compression_lookback")), "trial_id")  # a stated, small grid
    order = [F.desc("dominance"), F.desc("post_sharpe"), F.asc("trial_id")]
    return met.withColumn("place", F.row_number().over(windows.over(["symbol"], order)))


def flatness(found: DataFrame) -> DataFrame:
    """symbol, compression_lookback, gap, verdict of swept(): the spread of the ratio after the cut over the exits."""
    return overfit.surface(found, ["symbol", "compression_lookback"], "post_sharpe")


def trial_returns(bars: DataFrame, trials: DataFrame, symbol: str, capital_per_leg: float = 500.0) -> DataFrame:
    """i, trial_id, ret of a symbol's trials, for overfit.splits."""
    keys = ["symbol", "trial_id"]
    told = carry.ratchet(bars.where(F.col("symbol") == symbol), trials)
    curve = carry.equity(carry.costs(carry.legs(told, capital_per_leg, keys), keys=keys), capital_per_leg, keys)
    return curve.select((F.row_number().over(windows.over(keys, "time")).cast("long") - 1).alias("i"), "trial_id", F.col("period_ret_net").alias("ret"))


def recommendation(dominance: int) -> str:
    """What a best trial's dominance over the four windows means."""
    return {4: "supersede", 3: "candidate", 2: "keep"}.get(dominance, "investigate")

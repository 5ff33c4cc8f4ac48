"""Return and risk metrics as aggregate columns: null where the statistic is undefined.  Nulls and NaNs of the input are left out.

Each function takes the name of a return column and gives a Column for groupBy().agg(), so a table of many runs is graded in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators import windows


def clean(ret: str) -> Column:
    return F.when(~F.isnan(ret), F.col(ret))


def sharpe(ret: str, ppy: Column | float) -> Column:
    """mean / sample deviation, per year; null for fewer than 2 values or constant ones."""
    r = clean(ret)
    return F.when((F.count(r) >= 2) & (F.max(r) != F.min(r)), F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(ppy)))


def sharpe_population(ret: str, ppy: float) -> Column:
    """With the population deviation; 0 instead of null."""
    r = clean(ret)
    return F.coalesce(F.when(F.max(r) != F.min(r), F.avg(r) / F.stddev_pop(r) * math.sqrt(ppy)), F.lit(0.0))


def sortino(ret: str, ppy: float, target: float = 0.0) -> Column:
    r = clean(ret)
    down = F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r - target, F.lit(0.0)), 2))))  # least() alone would make nulls 0
    return F.when((F.count(r) >= 2) & (down > 0), (F.avg(r) - target) / down * math.sqrt(ppy))


def hit_rate(ret: str) -> Column:
    r = clean(ret)
    return F.avg((r > 0).cast("double"))


def profit_factor(ret: str) -> Column:
    """Gains over losses; infinite without losses, null without either."""
    r = clean(ret)
    gain, loss = F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf")))


def skew(ret: str) -> Column:
    """Bias-corrected; null for fewer than 3 values."""
    r, n = clean(ret), F.count(clean(ret)).cast("double")
    return F.when((n >= 3) & (F.max(r) != F.min(r)), F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(ret: str) -> Column:
    """Bias-corrected excess; null for fewer than 4 values."""
    r, n = clean(ret), F.count(clean(ret)).cast("double")
    return F.when((n >= 4) & (F.max(r) != F.min(r)), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6))


def value_at_risk(ret: str, q: float = 0.05) -> Column:
    return F.percentile(clean(ret), F.lit(q))


def expected_shortfall(df: DataFrame, ret: str, keys: list[str], q: float = 0.05) -> DataFrame:
    """keys, cvar: the mean of the returns at or below the q-quantile."""
    bound = df.groupBy(*keys).agg(value_at_risk(ret, q).alias("_var"))
    return df.join(bound, keys).where(F.col(ret) <= F.col("_var")).groupBy(*keys).agg(F.avg(clean(ret)).alias("cvar"))


def max_drawdown(curve: DataFrame, equity: str, keys: list[str], order: str) -> DataFrame:
    """keys, max_dd."""
    return curve.select(*keys, windows.drawdown(equity, keys, order).alias("_dd")).groupBy(*keys).agg(F.min("_dd").alias("max_dd"))


def calmar(curve: DataFrame, equity: str, keys: list[str], order: str, ppy: float) -> DataFrame:
    """keys, calmar: growth per year over the worst drawdown; null without one."""
    dd = curve.withColumn("_dd", windows.drawdown(equity, keys, order)).groupBy(*keys).agg(F.min("_dd").alias("dd"), F.count("*").alias("n"), F.min_by(equity, order).alias("e0"), F.max_by(equity, order).alias("e1"))
    growth = F.pow(F.col("e1") / F.col("e0"), F.lit(ppy) / (F.col("n") - 1)) - 1
    return dd.select(*keys, F.when((F.col("dd") < 0) & (F.col("n") > 1), growth / F.abs("dd")).alias("calmar"))


def turnover_per_year(legs: DataFrame, curve: DataFrame, keys: list[str], ppy: float) -> DataFrame:
    """keys, turnover: traded notional over mean equity, per year."""
    moved = F.abs(F.col("notional") - F.lag("notional").over(windows.over([*keys, "symbol", "leg_id"], "time")))
    traded = legs.select(*keys, moved.alias("_m")).groupBy(*keys).agg(F.sum("_m").alias("_m"))
    return curve.groupBy(*keys).agg(F.avg("equity").alias("_e"), F.count("*").alias("_n")).join(traded, keys).select(*keys, (F.coalesce("_m", F.lit(0.0)) / F.col("_e") * ppy / F.col("_n")).alias("turnover"))


def capacity(legs: DataFrame, adv: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """keys, capacity: the smallest over symbols of share * daily volume over the symbol's largest weight in the mean book.

    adv: symbol, adv.  A symbol without volume fails when the result is computed."""
    book = legs.groupBy(*keys, "time").agg(F.sum(F.abs("notional")).alias("_g")).groupBy(*keys).agg(F.avg("_g").alias("_g"))
    most = legs.groupBy(*keys, "symbol").agg(F.max(F.abs("notional")).alias("_n")).where("_n > 0").join(adv, "symbol", "left").join(book, keys)
    known = F.coalesce("adv", F.raise_error(F.concat(F.lit("no daily volume for "), "symbol")).cast("double"))
    return most.groupBy(*keys).agg(F.min(F.lit(share) * known / (F.col("_n") / F.col("_g"))).alias("capacity"))


def standard_error(sr: Column, n: Column, sk: Column, ku: Column) -> Column:
    """Of a per-period Sharpe ratio under non-normal returns; null where undefined."""
    var = 1 - sk * sr + (ku + 2) / 4 * sr * sr
    return F.when((n >= 2) & (var > 0), F.sqrt(var / n))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution at z: half, and the density times the sum of z^(2k+1) / (1*3*...*(2k+1)), whose terms all have z's
    sign; 0 or 1 beyond eight deviations.  To some 1e-15, and without Python."""
    start = F.struct(z.alias("total"), z.alias("term"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, add)["total"]
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi))


#: Units of resample(): what a count of them may be, and their length where it is fixed.
UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def resampled(curve: DataFrame, every: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """Curves by a longer period: the last equity, compounded returns, gains since the first period's equity.

    every: a calendar unit (day, week, month, quarter, year) or a count and a letter of UNITS ("4h", "1d"), counted from the epoch, weeks
    from Mondays; other letters are refused."""
    import re

    if m := re.fullmatch(r"([1-9][0-9]*)([a-z]+)", every):
        if m[2] not in UNITS:
            raise ValueError(f"unknown unit: {every}")
        size, shift = int(m[1]) * UNITS[m[2]], 4 * 86400 if m[2] == "w" else 0
        name, start = "period", F.timestamp_seconds(F.floor((F.unix_seconds("time") - shift) / size) * size + shift)
    elif every in ("day", "week", "month", "quarter", "year", "hour"):
        name, start = every, F.date_trunc(every, "time")
    else:
        raise ValueError(f"unknown unit: {every}")
    x = curve.groupBy(*keys, start.alias(name)).agg(F.max_by("equity", "time").alias("equity"), windows.compounded(F.col("period_ret_net")).alias("ret"))
    return x.withColumn("pnl", F.col("equity") - F.first("equity").over(windows.over(keys, name)))

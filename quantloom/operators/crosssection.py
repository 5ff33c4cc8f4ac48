"""Cross-sectional signals on a weekly panel, basket returns, regressions and the verdict on a thesis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import windows

SHARE, LEAST_ELIGIBLE = 0.30, 10


def weekly(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """symbol, week, first_close, last_close, fund_sum, fund_n from bars and settlements; weeks begin on Monday.  A week's settlements
    that are missing count as 0."""
    week = F.date_trunc("week", "open_time").alias("week")
    price = bars.groupBy("symbol", week).agg(F.min_by("close", "open_time").alias("first_close"), F.max_by("close", "open_time").alias("last_close"))
    paid = funding.groupBy("symbol", F.date_trunc("week", "funding_time").alias("week")).agg(F.sum("funding_rate").alias("fund_sum"), F.count("*").alias("fund_n"))
    return price.join(paid, ["symbol", "week"], "left").fillna(0, ["fund_sum", "fund_n"])


def with_returns(panel: DataFrame) -> DataFrame:
    """panel with ret, the change from the first to the last price within the week."""
    return panel.withColumn("ret", F.col("last_close") / F.col("first_close") - 1)


def funding_signal(panel: DataFrame, short: int = 2, long: int = 13) -> DataFrame:
    """panel with signal: the mean of the last `short` weeks' funding less the median of the last `long`, none of them this week's."""
    f = F.col("fund_sum")
    mean = windows.rolling(F.avg, f, ["symbol"], "week", short, shifted=True)
    middle = windows.rolling(lambda v: F.percentile(v, F.lit(0.5)), f, ["symbol"], "week", long, shifted=True)
    return panel.withColumn("signal", F.round(mean - middle, 12))


def momentum_signal(panel: DataFrame, weeks: int = 2) -> DataFrame:
    """panel with signal: minus the mean return of the last `weeks`, not this one's."""
    return panel.withColumn("signal", F.round(-windows.rolling(F.avg, F.col("ret"), ["symbol"], "week", weeks, shifted=True), 12))


def baskets(panel: DataFrame, share: float = SHARE, least: int = LEAST_ELIGIBLE, keys: list[str] = []) -> DataFrame:
    """keys, week, n_eligible, price_ret, funding_ret, ret: half long the symbols of the lowest signals, half short those of the highest, by
    week; ties by symbol; weeks with too few symbols return 0.  A week's cross-section is one window partition."""
    w = Window.partitionBy(*keys, "week")
    x = panel.where("signal is not null and ret is not null")
    x = x.withColumns({"n": F.count("*").over(w), "lo": F.row_number().over(w.orderBy("signal", "symbol"))})
    x = x.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    long, short = F.col("lo") <= F.col("k"), F.col("lo") > F.col("n") - F.col("k")
    mean = lambda side, v: F.avg(F.when(side, F.col(v)))
    enough = F.max("n") >= least
    out = x.groupBy(*keys, "week").agg(
        F.max("n").alias("n_eligible"),
        F.when(enough, 0.5 * (mean(long, "ret") - mean(short, "ret"))).otherwise(0.0).alias("price_ret"),
        F.when(enough, 0.5 * (mean(short, "fund_sum") - mean(long, "fund_sum"))).otherwise(0.0).alias("funding_ret"),
    )
    return out.withColumn("ret", F.col("price_ret") + F.col("funding_ret"))


def aligned(panel: DataFrame) -> DataFrame:
    """week, a, b, c of the weeks that have all three: the returns of the funding and of the momentum baskets, and the mean of all symbols.
    Both signals are ranked in one pass, as two kinds of rows."""
    both = momentum_signal(funding_signal(panel).withColumnRenamed("signal", "_a"))
    kinds = F.array(F.struct(F.lit("a").alias("kind"), F.col("_a").alias("signal")), F.struct(F.lit("b").alias("kind"), F.col("signal")))
    found = baskets(both.select("symbol", "week", "ret", "fund_sum", F.inline(kinds)), keys=["kind"])
    side = found.groupBy("week").agg(*[F.max(F.when(F.col("kind") == k, F.col("ret"))).alias(k) for k in "ab"]).where("a is not null and b is not null")
    return side.join(panel.groupBy("week").agg(F.avg("ret").alias("c")), "week")


def residual(df: DataFrame, y: str, x: str, periods: float) -> tuple[float, float]:
    """The yearly Sharpe ratio of y less its beta to x, and R2 of y on x: from the moments of one aggregation.  0 where there is no ratio."""
    full = df.dropna(subset=[y, x])
    m = full.agg(*[f(*c).alias(n) for n, f, c in (("my", F.avg, [y]), ("mx", F.avg, [x]), ("vy", F.var_samp, [y]), ("vx", F.var_samp, [x]), ("c", F.covar_samp, [y, x]))]).first()
    if not m["vx"] or not m["vy"]:
        return 0.0, float("nan")
    beta = m["c"] / m["vx"]
    left = m["vy"] - beta * m["c"]
    return ((m["my"] - beta * m["mx"]) / left**0.5 * periods**0.5 if left > 0 else 0.0), beta * m["c"] / m["vy"]


def ols(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients, standard errors, t and R2 of y on xs and a constant: moments in one aggregation, a tiny system on the driver."""
    terms = {"_1": F.lit(1.0), **{x: F.col(x) for x in xs}, "_y": F.col(y)}
    names = list(terms)
    full = df.dropna(subset=[y, *xs])
    sums = full.agg(*[F.sum(terms[a] * terms[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    k = len(xs) + 1
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    n = m[0, 0]
    if n <= k:
        raise ValueError("too few rows")
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, k]
    rss = m[k, k] - beta @ m[:k, k]
    tss = m[k, k] - m[0, k] ** 2 / n
    se = np.sqrt(np.diag(inverse) * rss / (n - k))
    out = {"n": float(n), "r2": float(1 - rss / tss) if tss > 0 else float("nan")}
    for i, name in enumerate(["alpha", *xs]):
        out |= {f"b_{name}": float(beta[i]), f"se_{name}": float(se[i]), f"t_{name}": float(beta[i] / se[i]) if se[i] > 0 else float("nan")}
    return out


def verdict(residual_sharpe: float, r2: float) -> str:
    """PROCEED for a clear, independent residual; KILL for a weak or explained one; else AMBIGUOUS."""
    if residual_sharpe >= 0.5 and r2 < 0.5:
        return "PROCEED"
    return "KILL" if residual_sharpe < 0.3 or r2 > 0.7 else "AMBIGUOUS"

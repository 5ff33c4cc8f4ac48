"""Market regimes of a benchmark series, and metrics of curves within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import windows

VOL_WINDOW, TREND_WINDOW, LOW_Q, HIGH_Q, ETF_CUT = 30, 200, 0.33, 0.67, "2024-01-11"


def nearest_rank(df: DataFrame, value: str, keys: list[str], qs: list[float]) -> DataFrame:
    """keys and q_0, q_1, ...: quantiles as the value at rank round((n - 1) q), without interpolation.

    The ranks come from one window; each quantile is then an aggregate over it."""
    w = windows.Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * q + 0.5), F.col("_v"))).alias(f"q_{i}") for i, q in enumerate(qs)])


def classify(returns: DataFrame, keys: list[str], ret: str = "ret", vol_window: int = VOL_WINDOW, trend_window: int = TREND_WINDOW, cut: str = ETF_CUT) -> DataFrame:
    """keys, time, regime_kind, regime_label in long form; rows whose windows are not yet full have no label of that kind.

    Volatility terciles are over the whole sample; both windows end one row before, so a label does not see its own return."""
    dev = windows.rolling(F.stddev_samp, F.col(ret), keys, "time", vol_window, shifted=True)
    total = windows.rolling(F.sum, F.col(ret), keys, "time", trend_window, shifted=True)
    told = returns.select(*keys, "time", F.round(dev, 12).alias("_vol"), F.round(total, 12).alias("_trend"))
    told = told.join(nearest_rank(told, "_vol", keys, [LOW_Q, HIGH_Q]), keys, "left")
    vol = F.when(F.col("_vol") <= F.col("q_0"), "low").when(F.col("_vol") <= F.col("q_1"), "mid").when(F.col("_vol").isNotNull(), "high")
    trend = F.when(F.col("_trend") > 0, "bull").when(F.col("_trend").isNotNull(), "bear")
    etf = F.when(F.col("time") < F.lit(cut).cast("timestamp"), "pre_etf").otherwise("post_etf")
    labels = F.array(*[F.struct(F.lit(k).alias("regime_kind"), v.alias("regime_label")) for k, v in (("vol", vol), ("trend", trend), ("etf", etf))])
    return told.select(*keys, "time", F.inline(labels)).where("regime_label is not null")


def stratify(curve: DataFrame, labels: DataFrame, keys: list[str], ppy: float, on: list[str] = ["time"]) -> DataFrame:
    """keys, regime_kind, regime_label, n_obs, sharpe, ann_return, max_dd, hit_rate; groups of fewer than 2 bars are left out.

    The drawdown is that of the group's bars one after another, as if they followed each other."""
    met = curve.join(labels.select(*on, "regime_kind", "regime_label"), on)
    by = [*keys, "regime_kind", "regime_label"]
    met = met.withColumn("_dd", windows.drawdown("equity", by, "time"))
    out = met.groupBy(*by).agg(
        F.count("*").alias("n_obs"),
        metrics.sharpe("period_ret_net", ppy).alias("sharpe"),
        (F.avg("period_ret_net") * ppy).alias("ann_return"),
        F.min("_dd").alias("max_dd"),
        metrics.hit_rate("period_ret_net").alias("hit_rate"),
    )
    return out.where("n_obs >= 2")


def benchmark_returns(klines: DataFrame, symbol: str, start, end, every: str = "1d", market: str = "spot") -> DataFrame:
    """time, ret: a symbol's bar returns in [start, end], both included, the first bar without one; "1d" compounds them by calendar day, "1h"
    leaves them.  start and end have a zone; no bars in between are refused."""
    if every not in ("1h", "1d"):
        raise ValueError(f"1h or 1d, not {every}")
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("start and end need a zone")
    x = klines.where((F.col("symbol") == symbol) & (F.col("market") == market) & (F.col("open_time") >= F.lit(start)) & (F.col("open_time") <= F.lit(end)))
    if not x.limit(1).count():
        raise ValueError(f"no {market} bars of {symbol} from {start} to {end}")
    x = x.select("symbol", F.col("open_time").alias("time"), windows.pct_change("close", ["symbol"], "open_time", None).alias("ret")).where("ret is not null")
    if every == "1h":
        return x.select("time", "ret")
    return x.groupBy(F.date_trunc("day", "time").alias("time")).agg(windows.compounded(F.col("ret")).alias("ret"))

"""Deflated Sharpe ratios and their bootstrap intervals.  Replicates are rows: each draws from the broadcast returns with a seed of its
own, so any number of executors gives the same interval."""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.session import shipped

EULER = 0.5772156649015329
#: Returns (values) that are sent to all executors for resampling.
LONGEST = 4_000_000


def expected_max_sharpe(n_trials: int) -> float:
    """Of n independent standard normal ratios."""
    if isinstance(n_trials, bool) or not isinstance(n_trials, int):
        raise TypeError("n_trials must be an integer")
    if n_trials < 1:
        raise ValueError("n_trials must be positive")
    if n_trials == 1:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e))


def standard_error(sr: float, n: int, skew: float, kurt: float) -> float:
    var = 1 - skew * sr + (kurt + 2) / 4 * sr * sr if n >= 2 else math.nan
    return math.sqrt(var / n) if n >= 2 and var > 0 else math.nan


def deflated_sharpe(sr: float, *, n_trials: int, n_obs: int, skew: float, kurt_excess: float) -> float:
    """The probability that the ratio exceeds what the best of n_trials would show by luck."""
    if n_trials < 10:
        warnings.warn("fewer than 10 trials: the deflation is rough", stacklevel=2)
    se = standard_error(sr, n_obs, skew, kurt_excess)
    return NormalDist().cdf(sr / se - expected_max_sharpe(n_trials)) if se == se and sr == sr else math.nan


def from_returns(x: np.ndarray, n_trials: int) -> float:
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 4 or x.max() == x.min():
        return math.nan
    d = x - x.mean()
    m2 = (d**2).mean()
    g1, g2 = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2 - 3
    skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return deflated_sharpe(float(x.mean() / x.std(ddof=1)), n_trials=n_trials, n_obs=n, skew=float(skew), kurt_excess=float(kurt))


def deflated(returns: DataFrame, ret: str, keys: list[str], n_trials: int) -> DataFrame:
    """keys, dsr of every series in one aggregation: from_returns() as columns; null where it is undefined."""
    x = returns.groupBy(*keys).agg(metrics.sharpe(ret, 1.0).alias("sr"), F.count(metrics.clean(ret)).alias("n"), metrics.skew(ret).alias("sk"), metrics.kurtosis(ret).alias("ku"))
    se = metrics.standard_error(*map(F.col, ("sr", "n", "sk", "ku")))
    z = x.select(*keys, F.when(F.col("n") >= 4, F.col("sr") / se - expected_max_sharpe(n_trials)).alias("z"))
    return z.select(*keys, metrics.normal_cdf(F.col("z")).alias("dsr"))


def seed(run_id: str, salt: str, replicate: int | None = None) -> int:
    """64 bits of a digest of the run, the use and, for distributed draws, the replicate."""
    text = f"{run_id}:{salt}" if replicate is None else f"{run_id}:{salt}:{replicate}"
    return int(hashlib.sha256(text.encode()).hexdigest()[:16], 16)


def rng(run_id: str, salt: str) -> np.random.Generator:
    return np.random.default_rng(seed(run_id, salt))


def replicates(spark: SparkSession, returns: np.ndarray, run_id: str, *, n_trials: int, n_bootstrap: int = 1000, block: int | None = None) -> DataFrame:
    """replicate, dsr: resampled deflated ratios; single values, or blocks of consecutive ones joined and cut to length."""
    x = np.asarray(returns, float)
    x = x[np.isfinite(x)]
    if n_bootstrap < 1 or block is not None and not 1 <= block <= len(x):
        raise ValueError("at least one replicate, and blocks within the sample")
    if len(x) > LONGEST:
        raise ValueError(f"more than {LONGEST} returns: resample by coarser periods")
    shipped(spark)
    sent = spark.sparkContext.broadcast(x)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = sent.value
        for b in batches:
            out = []
            for k in b["id"]:
                g = np.random.default_rng(seed(run_id, "block" if block else "iid", int(k)))
                if block:
                    starts = g.integers(0, len(x) - block + 1, -(-len(x) // block))
                    at = (starts[:, None] + np.arange(block)).ravel()[: len(x)]
                else:
                    at = g.integers(0, len(x), len(x))
                out.append(from_returns(x[at], n_trials))
            yield pd.DataFrame({"replicate": b["id"], "dsr": out})

    return spark.range(n_bootstrap).mapInPandas(draw, "replicate long, dsr double")


def interval(spark: SparkSession, returns: np.ndarray, run_id: str, *, n_trials: int, n_bootstrap: int = 1000, confidence: float = 0.95, block: int | None = None) -> tuple[float, float, float]:
    """The deflated ratio and the bounds of its percentile interval; NaNs where it is undefined."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    x = np.asarray(returns, float)
    point = from_returns(x, n_trials)
    found = replicates(spark, x, run_id, n_trials=n_trials, n_bootstrap=n_bootstrap, block=block).where("not isnan(dsr)")
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    q = found.selectExpr(f"percentile(dsr, array({lo}, {hi})) q").first()["q"]
    return (point, q[0], q[1]) if q else (point, math.nan, math.nan)

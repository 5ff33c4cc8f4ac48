"""Probability of backtest overfitting by combinatorially symmetric cross-validation, relationally.

Each trial's returns are reduced to moments by time partition; a split is a bit mask over the partitions.  The moments of every mask over
the first half of the partitions, and over the second, are made once (2^(S/2) rows a trial); a split's in-sample moments are those of its two
halves put together, its out-of-sample moments those of the opposite halves.  All C(S, S/2) splits are enumerated, a row for each and
trial: 12,870 a trial at S = 16, 2.7 million at S = 24."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partitions that are taken without being told that more are meant: 2.7 million splits a trial at 24 should not come by mistake.
LARGEST = 16


def partitions_for(n_obs: int, asked: int | None, largest: int | None = LARGEST) -> int:
    """largest: None lifts the guard; any even number of partitions of 2 rows at least is then valid."""
    if asked is None:
        if n_obs >= 64:
            return 16
        if n_obs >= 32:
            return 8
        raise ValueError("too few rows for a default number of partitions")
    if asked < 4 or asked % 2 or 2 * asked > n_obs or largest is not None and asked > largest:
        raise ValueError(f"partitions must be even, from 4 to {largest}, and of 2 rows at least")
    return asked


def splits(returns: DataFrame, n_partitions: int | None = None, largest: int | None = LARGEST) -> DataFrame:
    """split_id, best_trial, is_sharpe, rank, omega, logit of each split; returns: i, trial_id, ret.

    best_trial is the best in sample (the lowest id among equals); rank counts the trials that it is no worse than out of sample."""
    shape = returns.agg(F.countDistinct("trial_id").alias("n"), (F.max("i") - F.min("i") + 1).alias("t"), F.min("i").alias("i0")).first()
    if shape["n"] < 8:
        raise ValueError("at least 8 trials")
    s = partitions_for(shape["t"], n_partitions, largest)
    part = F.least(F.floor((F.col("i") - shape["i0"]) / (shape["t"] // s)), F.lit(s - 1)).cast("int")
    centre = returns.groupBy("trial_id").agg(F.avg("ret").alias("m"))  # sums of squares of centred values do not cancel
    cells = returns.join(centre, "trial_id").groupBy(part.alias("p"), "trial_id", "m").agg(F.count("ret").alias("n"), F.sum(F.col("ret") - F.col("m")).alias("x"), F.sum(F.pow(F.col("ret") - F.col("m"), 2)).alias("xx"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    half, full = s // 2, (1 << s // 2) - 1
    # Of each half, the moments of the partitions inside a mask and of those outside it.
    subsets = cells.withColumns({"h": (F.col("p") >= half).cast("int"), "bit": F.col("p") % half}).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(full))))
    inside = F.expr("(shiftright(mask, bit) & 1) = 1")
    sums = {"n": F.sum, "x": F.sum, "xx": F.sum, "lo": F.min, "hi": F.max}
    halves = subsets.groupBy("h", "mask", "trial_id", "m").agg(*[fn(F.when(inside if side == "in" else ~inside, F.col(c))).alias(f"{c}_{side}") for side in ("in", "out") for c, fn in sums.items()])
    one = halves.where("h = 0").drop("h").withColumnRenamed("mask", "low")
    two = halves.where("h = 1").drop("h", "m").toDF("high", "trial_id", *[f"{c}_{side}2" for side in ("in", "out") for c in sums])
    masks = returns.sparkSession.range(1 << s).where(F.bit_count("id") == half).select(F.col("id").alias("split_id"), F.col("id").bitwiseAND(full).cast("int").alias("low"), F.shiftright("id", half).cast("int").alias("high"))
    met = masks.join(one, "low").join(two, ["high", "trial_id"])

    def ratio(side: str):
        total = lambda c: F.coalesce(f"{c}_{side}", F.lit(0)) + F.coalesce(f"{c}_{side}2", F.lit(0))
        n, x = total("n"), total("x")
        lo, hi = F.least(f"lo_{side}", f"lo_{side}2"), F.greatest(f"hi_{side}", f"hi_{side}2")
        return F.when((hi > lo) & (n > 1), F.round((F.col("m") + x / n) / F.sqrt((total("xx") - x * x / n) / (n - 1)), 10))

    wide = met.select("split_id", "trial_id", ratio("in").alias("ins"), ratio("out").alias("out"))
    best = wide.where("ins is not null").groupBy("split_id").agg(F.max_by(F.struct("trial_id", "ins", "out"), F.struct("ins", (-F.col("trial_id")).alias("t"))).alias("b"))
    ranked = wide.join(best, "split_id").groupBy("split_id", "b").agg(F.count_if(F.col("out") <= F.col("b.out")).alias("rank"))
    omega = F.col("rank") / F.lit(shape["n"] + 1)
    return ranked.where("b.out is not null").select("split_id", F.col("b.trial_id").alias("best_trial"), F.col("b.ins").alias("is_sharpe"), "rank", omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"))


def probability(found: DataFrame) -> DataFrame:
    """n_splits, pbo: the share of splits whose best trial falls below the middle out of sample."""
    return found.agg(F.count("*").alias("n_splits"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo"))


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """trial_id and a column for each parameter: every combination, the last parameter moving fastest."""
    rows = [(i, *combo) for i, combo in enumerate(product(*values.values()))]
    kinds = ", ".join(f"{k} {'double' if isinstance(v[0], float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame(rows, f"trial_id long, {kinds}")


def enumerated(spark: SparkSession, strategy: Callable[..., Sequence[float]], values: dict[str, list]) -> tuple[list[dict], DataFrame]:
    """The parameter sets of a grid and i, trial_id, ret of what a callable returns for each: for strategies that only exist as code on the
    driver.  Empty grids, returns that are no series and series of different lengths are refused."""
    if not values or not all(values.values()):
        raise ValueError("an empty grid")
    sets, rows, length = [dict(zip(values, combo, strict=True)) for combo in product(*values.values())], [], None
    for k, params in enumerate(sets):
        series = [float(r) for r in strategy(**params)]
        if length is not None and len(series) != length:
            raise ValueError(f"{len(series)} returns for {params}, {length} before")
        length = len(series)
        rows += [(i, k, r) for i, r in enumerate(series)]
    return sets, spark.createDataFrame(rows, "i long, trial_id long, ret double")


def ranked_trials(graded: DataFrame) -> DataFrame:
    """Trials by how many of the baseline's windows they beat or nearly beat (within 0.05), then by the ratio after the cut, then by id;
    graded: trial_id, dominance, post_sharpe."""
    order = [F.desc("dominance"), F.desc_nulls_last("post_sharpe"), F.asc("trial_id")]
    return graded.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def surface(graded: DataFrame, by: str | list[str], of: str = "post_sharpe") -> DataFrame:
    """by, gap, verdict: the spread of a ratio over the other parameters: FLAT under 1, KNIFE-EDGE over 2."""
    gap = F.max(of) - F.min(of)
    return graded.groupBy(*([by] if isinstance(by, str) else by)).agg(gap.alias("gap")).withColumn("verdict", F.when(F.col("gap") < 1.0, "FLAT").when(F.col("gap") > 2.0, "KNIFE-EDGE").otherwise("MODERATE"))

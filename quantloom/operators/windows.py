"""Ordered operators over keyed series: returns, rolling statistics, runs, drawdowns, latest rows, as-of matches.

Every window is partitioned by the series' keys, so all series of a table are worked on in one job; where several of these are used
on the same keys and order, Spark sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: str | list):
    """The running window of a series."""
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, (str, Column)) else order))


def pct_change(value: str, keys: list[str], order: str, first: float | None = 0.0) -> Column:
    """value / its predecessor - 1; the first row of a series gets `first`."""
    change = F.col(value) / F.lag(value).over(over(keys, order)) - 1
    return change if first is None else F.coalesce(change, F.lit(first))


def rolling(fn, value: Column, keys: list, order: str, n: int, shifted: bool = False) -> Column:
    """fn over the last n rows (before this one, if shifted); null until there are n values."""
    w = over(keys, order).rowsBetween(*((-n, -1) if shifted else (-(n - 1), 0)))
    return F.when(F.count(value).over(w) == n, fn(value).over(w))


def forward_filled(value: Column, keys: list[str], order: str) -> Column:
    return F.last(value, ignorenulls=True).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def run_ids(flag: Column, keys: list[str], order: str) -> Column:
    """A number that goes up wherever flag differs from the row before."""
    w = over(keys, order)
    return F.sum(F.when(flag == F.lag(flag).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """keys, run_start, run_end, run_len of each run of rows where flag holds."""
    marked = df.withColumn("_run", run_ids(F.col(flag), keys, order)).where(flag)
    return marked.groupBy(*keys, "_run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("run_len")).drop("_run")


def latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row for each key: the first in the order newest."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("_nth", n).where("_nth = 1").drop("_nth")


def compounded(ret: Column, w=None) -> Column:
    """The product of 1 + ret, less 1: of a group, or over a window.  A loss of all and losses beyond it count with zero and their sign;
    nulls are left out."""
    over_ = (lambda c: c) if w is None else (lambda c: c.over(w))
    size = F.when(ret > -1, F.log1p(ret)).when(ret < -1, F.ln(F.abs(1 + ret)))
    lost, turned = over_(F.count_if(ret == -1)), over_(F.count_if(ret < -1))
    sign = F.when(lost > 0, 0.0).when(turned % 2 == 1, -1.0).otherwise(1.0)
    return F.when(over_(F.count(ret)) > 0, sign * F.exp(F.coalesce(over_(F.sum(size)), F.lit(0.0))) - 1)


def drawdown(equity: str, keys: list[str], order: str) -> Column:
    """equity relative to its running maximum, less 1; never above 0."""
    top = F.max(equity).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(equity) / top - 1


def longest_drawdown(curve: DataFrame, equity: str, keys: list[str], order: str) -> DataFrame:
    """keys, days: whole days from the last bar at a peak to the first that reaches it again, or to the last bar; 0 without any."""
    w = over(keys, order)
    top = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = curve.select(*keys, order, (F.col(equity) >= top).alias("_peak"), F.max(order).over(Window.partitionBy(*keys)).alias("_end"))
    # A peak followed by a lower bar opens an episode that ends at the next peak.
    ahead = marked.withColumn("_next", F.lead("_peak").over(w))
    ahead = ahead.withColumn("_back", F.first(F.when(F.col("_peak"), F.col(order)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    spent = F.when(F.col("_peak") & ~F.coalesce("_next", F.lit(True)), F.unix_micros(F.coalesce("_back", "_end")) - F.unix_micros(order))
    return ahead.withColumn("_spent", spent).groupBy(*keys).agg(F.expr("coalesce(max(_spent), 0) div 86400000000").alias("days"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, carry: list[str]) -> DataFrame:
    """left with, from the latest row of right at or before its time, the columns carry (null without one).

    Both sides go through one window over their union: a shuffle by keys and no join, whatever the distances in time."""
    cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(F.struct(*carry)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_l"), F.struct(*carry).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(*keys, "_l.*", *[F.col("_r")[c].alias(c) for c in carry])


def modal_gap(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, gap_us: the most frequent distance of neighbours, in microseconds; null where two are equally frequent or there is none."""
    gap = F.unix_micros(order) - F.unix_micros(F.lag(order).over(over(keys, order)))
    counts = df.select(*keys, gap.alias("gap_us")).groupBy(*keys, "gap_us").agg(F.count("gap_us").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"), F.max_by("gap_us", "n").alias("gap_us"), F.collect_list("n").alias("all"))
    tied = F.size(F.filter("all", lambda x: x == F.col("n"))) > 1
    return best.select(*keys, F.when((F.col("n") > 0) & ~tied, F.col("gap_us")).alias("gap_us"))


def monotonic_breaks(df: DataFrame, keys: list[str], order: str, by: list) -> DataFrame:
    """keys, breaks: how many rows, in the order `by`, are not later than the row before."""
    before = F.lag(order).over(over(keys, by))
    return df.select(*keys, (F.col(order) <= before).alias("_b")).groupBy(*keys).agg(F.count_if("_b").alias("breaks"))

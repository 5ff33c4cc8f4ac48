"""Cross-validation folds as rows: (fold_id, i, time, role).  The folds of a row follow from its time, or from its number, so each row is
expanded by exactly the folds that it is in; nothing is matched by range."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Stretches of time in which rows are numbered apart.
STRETCHES = 256


def indexed(series: DataFrame, time: str = "time") -> DataFrame:
    """i, time: positions from 0 in time order.  Rows are numbered within stretches of equal length; how many come before each stretch is a
    sum over STRETCHES counts, so no task orders the whole series."""
    x = series.select(F.col(time).alias("time")).withColumn("_t", F.unix_micros("time"))
    ends = x.agg(F.min("_t").alias("a"), F.max("_t").alias("b")).first()
    if ends["a"] is None:
        return x.select(F.lit(0).cast("long").alias("i"), "time").where("false").select("time", "i")
    x = x.withColumn("_s", F.expr(f"(_t - {ends['a']}) div {(ends['b'] - ends['a']) // STRETCHES + 1}"))
    before = x.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_0"))
    nth = F.row_number().over(Window.partitionBy("_s").orderBy("_t"))
    return x.withColumn("_i", nth).join(F.broadcast(before), "_s").select("time", (F.col("_i") - 1 + F.col("_0")).cast("long").alias("i"))  # STRETCHES rows


def _us(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


def purged(series: DataFrame, n_splits: int, embargo: timedelta) -> DataFrame:
    """n_splits blocks of equal length, the last with the rest; train is what lies outside the test block and the embargo on both
    sides of it, ends included in the gap."""
    if n_splits < 2 or embargo < timedelta(0):
        raise ValueError("at least two splits and no negative embargo")
    x = indexed(series)
    n = x.agg(F.count("*")).first()[0]
    if n < n_splits:
        raise ValueError("fewer rows than splits")
    x = x.withColumn("block", F.least(F.floor(F.col("i") / (n // n_splits)), F.lit(n_splits - 1)))
    bounds = x.groupBy(F.col("block").alias("fold_id")).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    met = x.withColumn("fold_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long")))).join(F.broadcast(bounds), "fold_id")  # n_splits rows
    gap = F.expr(f"timestamp_micros(unix_micros(a) - {_us(embargo)})"), F.expr(f"timestamp_micros(unix_micros(b) + {_us(embargo)})")
    role = F.when(F.col("block") == F.col("fold_id"), "test").when((F.col("time") < gap[0]) | (F.col("time") > gap[1]), "train")
    return met.select("fold_id", "i", "time", role.alias("role")).where("role is not null")


def _stepped(series: DataFrame, train: timedelta | None, test: timedelta, step: timedelta, min_train: timedelta) -> DataFrame:
    if min(test, step, min_train, train or test) <= timedelta(0):
        raise ValueError("spans must be positive")
    x = indexed(series).withColumn("t", F.unix_micros("time"))
    ends = x.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends["a"] is None or ends["a"] + _us(min_train) > ends["b"]:
        return x.select(F.lit(0).cast("long").alias("fold_id"), "i", "time", F.lit("").alias("role")).where("false")
    base, by = ends["a"] + _us(min_train), _us(step)
    last = (ends["b"] - base) // by  # the number of the last cut
    # Cut k lies at base + k * step: the row is tested by the cuts in (t - test, t], and trains those after t (by t + train at most).
    upto = lambda shift: F.floor((F.col("t") - base + shift).cast("decimal(20,0)") / by)
    here = upto(0)
    ranges = [("test", upto(-_us(test)) + 1, here), ("train", here + 1, upto(_us(train)) if train else F.lit(last))]
    each = F.array(*[F.struct(F.lit(role).alias("role"), F.greatest(a.cast("long"), F.lit(0).cast("long")).alias("a"), F.least(b.cast("long"), F.lit(last).cast("long")).alias("b")) for role, a, b in ranges])
    met = x.select("i", "time", F.inline(each)).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("k"), "i", "time", "role")
    # Folds without a test or a train row are not counted.
    whole = met.groupBy("k").agg(F.countDistinct("role").alias("roles")).where("roles = 2")
    whole = whole.select("k", (F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("fold_id"))
    return met.join(whole, "k").select("fold_id", "i", "time", "role")


def walk_forward(series: DataFrame, train: timedelta, test: timedelta, step: timedelta, min_train: timedelta) -> DataFrame:
    """Training windows of at most `train` before each cut, test windows of `test` after it; cuts every `step` from the first time plus
    min_train."""
    return _stepped(series, train, test, step, min_train)


def expanding(series: DataFrame, test: timedelta, step: timedelta, min_train: timedelta) -> DataFrame:
    """The same with all that is before the cut for training."""
    return _stepped(series, None, test, step, min_train)

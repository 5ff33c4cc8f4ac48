"""Domain tables from the star-schema and event tables: deterministic stand-ins for an exchange archive.

klines from events (the price is 10000 + value, so returns stay small), funding from 8-hour buckets of events, a weekly panel, a universe
and its spot pairs from lineitem, part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, market, open_time, close_time, open, high, low, close, volume, quote_volume, trades, ingested_at: hourly bars of each market."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "spot").otherwise("perp_usdt").alias("market"),
        F.date_trunc("hour", "ts").alias("open_time"),
        "ts", "event_id", "value", (F.col("value") + 10000).alias("price"),
    )
    bars = e.groupBy("symbol", "market", "open_time").agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"),
        F.sum("value").alias("volume"),
        F.sum("price").alias("quote_volume"),
        F.count("*").alias("trades"),
    )
    closed = F.timestamp_micros(F.unix_micros("open_time") + HOUR * 1_000_000 - 1000)
    return bars.withColumns({"close_time": closed, "ingested_at": F.lit("2024-02-01 00:00:00").cast("timestamp")})


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, funding_time, funding_rate: one settlement every 8 hours."""
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (8 * HOUR)) * (8 * HOUR))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), bucket.alias("funding_time"), "value")
    return e.groupBy("symbol", "funding_time").agg(F.round((F.avg("value") - 50) / 1e5, 12).alias("funding_rate"))


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, time, ret: day-on-day change of revenue; a long series for regimes and folds."""
    from quantloom.operators.windows import pct_change

    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("time")).agg(F.round(F.sum("l_extendedprice"), 2).alias("close")).withColumn("run_id", F.lit("revenue"))
    return d.withColumn("ret", pct_change("close", ["run_id"], "time", None)).where("ret is not null")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, week, close, first_close, last_close, fund_sum, fund_n: prices by brand and ISO week, and a carry-like rate."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x = li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.date_trunc("week", "l_shipdate").alias("week"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    return x.groupBy("symbol", "week").agg(
        F.min_by(price, order).alias("first_close"),
        F.max_by(price, order).alias("last_close"),
        F.round(F.sum("l_discount") - 0.05 * F.count("*"), 6).alias("fund_sum"),
        F.count("*").alias("fund_n"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """api_symbol, base_asset, quote_asset, contract_type, status, onboard_date, quote_volume, last_price, trades: listed contracts with
    their tickers, from parts and what was sold of them."""
    part = table(spark, sf_dir, "part")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("quote_volume"), F.count("*").alias("trades"), F.min("l_shipdate").cast("date").alias("onboard_date"))
    return part.join(sold, "p_partkey").select(
        F.concat(F.lit("P"), F.col("p_partkey"), F.lit("USDT")).alias("api_symbol"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("base_asset"),
        F.lit("USDT").alias("quote_asset"),
        F.when(F.col("p_size") % 5 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contract_type"),
        F.when(F.col("p_size") % 7 == 0, "SETTLING").otherwise("TRADING").alias("status"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("onboard_date")).alias("onboard_date"),
        "quote_volume",
        F.when(F.col("p_partkey") % 13 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("last_price"),
        "trades",
    )


def spot_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_asset, pair, volume: what each supplier sold of a part, as spot pairs."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.groupBy(F.concat(F.lit("P"), F.col("l_partkey")).alias("base_asset"), "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("volume"))
    return pairs.select("base_asset", F.concat("base_asset", F.lit("S"), "l_suppkey").alias("pair"), "volume")

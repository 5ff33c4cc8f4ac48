"""The tradable universe: candidates, eligibility with reasons, spot pairs, ranking, tasks, listing dates and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the exchange's contract information.
PERPETUAL, TRADING = "PERPETUAL", "TRADING"


def perpetuals(contracts: DataFrame, quote: str = "USDT") -> DataFrame:
    return contracts.where((F.col("contract_type") == PERPETUAL) & (F.col("status") == TRADING) & (F.col("quote_asset") == quote))


def listing_days(onboard: Column, as_of: Column) -> Column:
    return F.datediff(as_of, onboard)


def verdicts(candidates: DataFrame, as_of: str, min_days: int) -> DataFrame:
    """candidates with failures: (reason, observed, threshold) in order of weight; an unknown listing date counts as 0 days."""
    days = F.coalesce(listing_days(F.col("onboard_date"), F.lit(as_of).cast("date")), F.lit(0)).cast("double")

    def failure(reason: str, bad: Column, observed: Column, threshold: float) -> Column:
        return F.when(bad, F.struct(F.lit(reason).alias("reason"), observed.alias("observed_value"), F.lit(float(threshold)).alias("threshold")))

    price = F.col("last_price")
    found = F.array(failure("invalid_price", price.isNull() | F.isnan(price) | (price <= 0), F.coalesce(price, F.lit(0.0)), 0.0), failure("listing_age", days < min_days, days, min_days))
    return candidates.withColumn("failures", F.filter(found, lambda f: f.isNotNull()))


def eligible(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("failures") == 0).drop("failures")


def rejections(judged: DataFrame) -> DataFrame:
    """api_symbol, reason, observed_value, threshold, is_primary_reason: a row for each reason, the first of a symbol primary."""
    each = judged.select("api_symbol", F.posexplode("failures").alias("_p", "f"))
    return each.select("api_symbol", "f.*", (F.col("_p") == 0).alias("is_primary_reason"))


def with_spot(candidates: DataFrame, spot: DataFrame) -> DataFrame:
    """candidates with spot_pairs (by volume, largest first, then by name) and the volume of the first; [] and 0 without any.
    spot: base_asset, pair, volume; the pairs of one asset are few."""
    v = F.coalesce("volume", F.lit(0.0))
    listed = spot.groupBy("base_asset").agg(F.array_sort(F.collect_list(F.struct((-v).alias("neg"), "pair"))).alias("p"))
    x = candidates.join(listed, "base_asset", "left")
    return x.select(*candidates.columns, F.coalesce(F.col("p.pair"), F.array().cast("array<string>")).alias("spot_pairs"), F.coalesce(-F.element_at("p", 1)["neg"], F.lit(0.0)).alias("primary_spot_quote_volume"))


def top(candidates: DataFrame, n: int) -> DataFrame:
    """The n of the greatest quote volume (ties by symbol) with rank from 1.  The limit is the feature, and makes the ranking cheap."""
    order = [F.desc("quote_volume"), F.asc("api_symbol")]
    best = candidates.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def snapshot(contracts: DataFrame, spot: DataFrame, as_of: str, min_days: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The ranked universe and the rejections of one moment."""
    judged = verdicts(perpetuals(contracts), as_of, min_days)
    return with_spot(top(eligible(judged), n), spot), rejections(judged)


def as_of(snapshots: DataFrame, when: str) -> DataFrame:
    """The rows of the snapshot whose month holds `when` and that was taken by then; set-based, for many months at once."""
    t = F.lit(when).cast("timestamp")
    return snapshots.where((F.col("as_of") <= t) & F.lit(when).cast("date").between(F.col("period_start"), F.col("period_end")))


def tasks(universe: DataFrame) -> DataFrame:
    """seq, rank, market, symbol: the fetch order, by rank the perpetual, its spot pairs, its funding."""

    def task(market: str, symbol: Column) -> Column:
        return F.struct(F.lit(market).alias("market"), symbol.alias("symbol"))

    each = F.concat(F.array(task("perp_usdt", F.col("api_symbol"))), F.transform("spot_pairs", lambda p: task("spot", p)), F.array(task("perp_funding", F.col("api_symbol"))))
    return universe.select("rank", F.posexplode(each).alias("seq", "t")).select("rank", "seq", "t.market", "t.symbol")


def listing_effective(listings: DataFrame, bars: DataFrame, keys: list[str] = ["symbol", "market"]) -> DataFrame:
    """keys, listing: the earlier of the stated date and the first archived bar; either alone if the other is unknown."""
    first = bars.groupBy(*keys).agg(F.min("open_time").alias("_first"))
    return listings.join(first, keys, "left").select(*keys, F.least("listing", "_first").alias("listing"))


def canonical(api_symbol: Column, base: Column) -> Column:
    """BTCUSDT with base BTC as BTC-USDT."""
    return F.concat(base, F.lit("-"), F.substr(api_symbol, F.length(base) + 1))


def api(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("-"), F.lit(""))


# The assets of the curated universes, in order of rank, and the days that each asks a listing to have.
CURATED = ["BTC", "ETH", "SOL", "BNB", "XRP", "DOGE", "ADA", "AVAX", "LINK", "DOT", "MATIC", "UNI", "LTC", "ATOM", "TRX"]
CURATED_WIDE = [*CURATED, "ORDI", "1000LUNC", "1000PEPE", "TAO", "HYPE", "BIO"]
CURATED_DAYS, CURATED_WIDE_DAYS = 730, 365


def curated(tickers: DataFrame, listings: DataFrame, spot: DataFrame, wide: bool = False, bases: list[str] | None = None, quote: str = "USDT") -> DataFrame:
    """rank (the place in the list), base_asset, api_symbol, symbol, quote_volume, last_price, trades, avg_trade_size, listing_date, spot_pairs,
    primary_spot_quote_volume, total_candidates, min_listing_days_threshold: a stated list of assets instead of a ranking.

    Assets without a ticker or without a listing date are left out and keep their rank free; the threshold is a label.  tickers: api_symbol,
    quote_volume, last_price, trades; listings: api_symbol, listing_date; spot: base_asset, pair, volume."""
    names = bases or (CURATED_WIDE if wide else CURATED)
    ranked = tickers.sparkSession.createDataFrame([(i, b, f"{b}{quote}") for i, b in enumerate(names, 1)], "rank int, base_asset string, api_symbol string")
    x = ranked.join(tickers.select("api_symbol", "quote_volume", "last_price", "trades"), "api_symbol").join(listings.where("listing_date is not null").select("api_symbol", "listing_date"), "api_symbol")
    x = x.withColumns({
        "symbol": canonical(F.col("api_symbol"), F.col("base_asset")), "avg_trade_size": F.when(F.col("trades") > 0, F.col("quote_volume") / F.col("trades")).otherwise(0.0),
        "total_candidates": F.lit(len(names)), "min_listing_days_threshold": F.lit(CURATED_WIDE_DAYS if wide else CURATED_DAYS),
    })
    return with_spot(x, spot)


def observed_listings(probed: DataFrame, bars: DataFrame, hours: float = 1.0, keys: list[str] = ["symbol", "market"]) -> DataFrame:
    """keys, listing (the first archived bar; the probed date where there is none), diverged (whether the two are further apart than that)."""
    first = bars.groupBy(*keys).agg(F.min("open_time").alias("_first"))
    x = probed.join(first, keys, "full_outer")
    apart = F.abs(F.unix_micros("_first") - F.unix_micros("listing")) > int(hours * 3_600_000_000)
    return x.select(*keys, F.coalesce("_first", "listing").alias("listing"), F.coalesce(apart, F.lit(False)).alias("diverged"))

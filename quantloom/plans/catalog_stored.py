"""Catalog entries on what is written and read again: the archive, runs, snapshots and streams; on halts that are armed again, listings,
curated universes and deflated ratios.  Each has the same in SQL.

Files of these entries go to a folder of the application under spark.checkpoint.dir (a temporary one where that is unset, as in tests),
one folder for each entry, which is written anew each time."""

from __future__ import annotations

import tempfile
from datetime import UTC, date, datetime
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.operators import carry, significance, universe
from quantloom.plans import catalog_market as M
from quantloom.plans.catalog_family import _READ
from quantloom.plans.catalog_market import D, FU, E, K, T
from quantloom.plans.registering import query, shown
from quantloom.sources import adapters as A
from quantloom.sources import archive
from quantloom.streaming import control, events, paper

_temporary: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """An empty folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="quantloom-"))
        top = _temporary[0]
    path = f"{top}/stored-{spark.sparkContext.applicationId}/{name}"
    fs, at = archive._fs(spark, path)
    fs.delete(at(path), True)
    return path


# --- the archive ------------------------------------------------------------------------------------------------------------------------


def _complete(bars: DataFrame, ingested_at: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return bars.withColumns({"taker_buy_base": none, "taker_buy_quote": none, "source": F.lit("table"), "ingested_at": F.lit(ingested_at).cast("timestamp")})


def _archived(s: SparkSession, d: str, name: str) -> str:
    """The root of an archive of all bars, into which late bars came as a stream: a third of them, with another close."""
    top = folder(s, name)
    bars = A.klines(s, d)
    archive.upsert_klines(s, f"{top}/bars", _complete(bars, "2024-02-01"))
    late = _complete(bars.where("trades % 3 = 0").withColumn("close", F.col("close") + 1), "2024-02-02")
    schemas.conform(late, schemas.KLINES).write.parquet(f"{top}/late")
    stream = s.readStream.schema(schemas.KLINES).parquet(f"{top}/late")
    paper.upsert_stream(s, stream, f"{top}/bars", f"{top}/checkpoint").awaitTermination()
    return f"{top}/bars"


@query("archive_year", f"WITH {K} SELECT symbol, market, {T.format('open_time')} AS open_time, round(CASE WHEN trades % 3 = 0 THEN close + 1 ELSE close END, 6) AS close, CAST(CASE WHEN trades % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seen FROM k WHERE year(open_time) = 2024")
def _(s, d):
    """A year of an archive that was upserted twice, the second time by a stream."""
    bars = archive.load(s, _archived(s, d, "archive_year"), schemas.KLINES).where("year = 2024")
    return shown(bars.withColumn("seen", F.dayofmonth("ingested_at")), "symbol market open_time:t close:6 seen:l")


@query("archive_corrections", f"WITH {K} SELECT symbol, market, {T.format('open_time')} AS time, 'close' AS field, round(close, 6) AS old_value, round(close + 1, 6) AS new_value FROM k WHERE trades % 3 = 0")
def _(s, d):
    """What the second upsert corrected, as it was filed."""
    root = _archived(s, d, "archive_corrections")
    return shown(s.read.schema(schemas.CORRECTIONS).parquet(f"{root}/_corrections/*"), "symbol market time:t field old_value:6 new_value:6")


@query("run_replaced", f"WITH {E} SELECT symbol AS run_id, {T.format('time')} AS time, round(equity + CASE WHEN symbol < 'm' THEN 0 ELSE 1 END, 6) AS equity FROM e")
def _(s, d):
    """All runs, of which some are written again with other rows: only their own rows go."""
    root = folder(s, "run_replaced")
    curve = M.curve(s, d).select(F.lit("carry").alias("strategy"), F.col("symbol").alias("run_id"), "time", "equity")
    archive.replace_run(curve.withColumn("equity", F.col("equity") + 1), root)
    archive.replace_run(curve.where("run_id < 'm'"), root)
    return shown(s.read.schema("run_id string, time timestamp, equity double").parquet(root), "run_id time:t equity:6")


_JOINED = "j0 AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS quote_volume, count(*) AS trades, CAST(min(l_shipdate) AS DATE) AS onboard_date FROM lineitem GROUP BY 1), ca AS (SELECT 'P' || p_partkey AS base_asset, 'P' || p_partkey || 'USDT' AS api_symbol, j0.quote_volume, j0.trades, CASE WHEN p_partkey % 11 <> 0 THEN onboard_date END AS onboard_date FROM part JOIN j0 ON l_partkey = p_partkey)"


@query("snapshot_as_of", f"WITH {_JOINED} SELECT api_symbol, quote_volume, trades FROM ca WHERE trades > 5")
def _(s, d):
    """A month's universe, written with what was rejected and read as of a day of that month."""
    root, first = folder(s, "snapshot_as_of"), date(2024, 1, 1)
    c = A.candidates(s, d)
    taken = c.where("trades > 5").withColumns({"as_of": F.lit("2024-01-02").cast("timestamp"), "period_start": F.lit("2024-01-01").cast("date"), "period_end": F.lit("2024-01-31").cast("date")})
    archive.write_snapshot(taken, c.where("trades <= 5"), root, "perp_usdt", first)
    return archive.universe_as_of(s, root, "perp_usdt", datetime(2024, 1, 20, tzinfo=UTC)).select("api_symbol", "quote_volume", "trades")


# --- streams ----------------------------------------------------------------------------------------------------------------------------

_MACHINE = carry.RatchetParams(ma_lookback=3, exit_threshold=-1e-5, reentry_threshold=5e-6, compression_lookback=6, compression_exit=2e-6, compression_reentry=4e-6, min_hold=2)


@query(
    "stream_targets",
    f"""WITH RECURSIVE {FU}, st AS (SELECT symbol, funding_time AS time, row_number() OVER w AS i, CASE WHEN count(*) OVER w3 = 3 THEN round(avg(funding_rate) OVER w3, 12) END AS fast, CASE WHEN count(*) OVER w6 = 6 THEN round(avg(funding_rate) OVER w6, 12) END AS slow FROM f
  WINDOW w AS (PARTITION BY symbol ORDER BY funding_time), w3 AS (PARTITION BY symbol ORDER BY funding_time ROWS 2 PRECEDING), w6 AS (PARTITION BY symbol ORDER BY funding_time ROWS 5 PRECEDING)),
m(symbol, i, state, since) AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT) FROM st
  UNION ALL SELECT st.symbol, st.i, CASE WHEN x.flip THEN 1 - m.state ELSE m.state END, CASE WHEN x.flip THEN 0 ELSE m.since + 1 END
  FROM m JOIN st ON st.symbol = m.symbol AND st.i = m.i + 1,
  LATERAL (SELECT coalesce(m.since + 1 >= 2 AND fast IS NOT NULL AND slow IS NOT NULL AND CASE WHEN m.state = 1 THEN fast < -1e-5 OR abs(slow) < 2e-6 ELSE fast > 5e-6 AND abs(slow) > 4e-6 END, false) AS flip) x)
SELECT st.symbol, {T.format('st.time')} AS time, CAST(m.state AS BIGINT) AS regime_state, 5e2 * m.state AS target_notional, false AS late FROM st JOIN m ON m.symbol = st.symbol AND m.i = st.i
UNION ALL SELECT symbol, {T.format('time')}, NULL, NULL, true FROM st WHERE i % 4 = 0""",
)
def _(s, d):
    """The ratcheted strategy on settlements that come as files, in two runs from one checkpoint; what the second brings again is late."""
    top = folder(s, "stream_targets")
    settled = A.funding(s, d).withColumnRenamed("funding_time", "time")
    nth = F.expr("row_number() over (partition by symbol order by time)")
    for rows in (settled, settled.withColumn("_n", nth).where("_n % 4 = 0").drop("_n")):
        rows.write.mode("append").parquet(f"{top}/settlements")
        stream = s.readStream.schema("symbol string, time timestamp, funding_rate double").parquet(f"{top}/settlements")
        out = paper.targets(stream, _MACHINE).writeStream.format("parquet").option("path", f"{top}/targets").option("checkpointLocation", f"{top}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return shown(s.read.parquet(f"{top}/targets"), "symbol time:t regime_state:l target_notional late")


@query("stream_log", "SELECT event_id, epoch_us(ts) // 1000000 AS time, event_type AS symbol FROM events WHERE event_id % 50 <> 0")
def _(s, d):
    """The event log as a stream: lines cut short are skipped, lines that were written twice come once."""
    top = folder(s, "stream_log")
    e = A.table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("mark").alias("kind"), F.col("ts").alias("time"), F.lit("1").alias("version"), F.col("event_type").alias("symbol"), F.lit("{}").alias("payload"))).alias("line"))
    lines = e.select(F.when(F.col("event_id") % 50 == 0, F.substring("line", 1, 20)).otherwise(F.col("line")).alias("value"))
    lines.unionByName(lines).write.text(f"{top}/log")
    out = events.stream(s, f"{top}/log", late="365 days").writeStream.format("parquet").option("path", f"{top}/events").option("checkpointLocation", f"{top}/checkpoint")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return shown(s.read.parquet(f"{top}/events"), "event_id:l time:t symbol")


# --- halts, listings, lists of assets, deflated ratios ------------------------------------------------------------------------------------


def _rule_sql(priority: str, breach: str, n: int, clear: str, calm: int, action: str) -> str:
    return f"""SELECT symbol, {T.format('time')} AS time, '{priority}' AS priority, CASE WHEN v = 1 THEN 'halt' ELSE 'resume' END AS change, CASE WHEN v = 1 THEN '{action}' END AS action FROM (
  SELECT *, coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY time), 0) AS b FROM (SELECT symbol, time, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), 0) AS v FROM (
    SELECT symbol, time, CASE WHEN sum(CAST({breach} AS INT)) OVER (PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING) = {n} THEN 1 WHEN sum(CAST({clear} AS INT)) OVER (PARTITION BY symbol ORDER BY time ROWS {calm - 1} PRECEDING) = {calm} THEN 0 END AS u FROM rd))) WHERE v <> b"""


_RULES = [("P1", "level > 51", 2, "level < 51", 2, "flat_cancel_exit_dump_alert"), ("P3", "level < 48", 3, "level > 49", 1, "flat")]


@query("halts_rearmed", f"WITH {_READ} " + " UNION ALL ".join(_rule_sql(*r) for r in _RULES))
def _(s, d):
    readings = A.table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time")).agg(F.round(F.avg("value"), 9).alias("level"))
    rules = [control.Rule(p, F.expr(breach), n, F.expr(clear), calm) for p, breach, n, clear, calm, _action in _RULES]
    return shown(control.held(readings, rules, "live"), "symbol time:t priority change action")


@query(
    "observed_listings",
    f"""WITH {K}, pr AS (SELECT event_type AS symbol, 'spot' AS market, min(ts) AS listing FROM events GROUP BY 1 UNION ALL SELECT event_type, 'option', min(ts) FROM events GROUP BY 1), ob AS (SELECT symbol, market, min(open_time) AS t FROM k WHERE open_time >= TIMESTAMP '2024-01-01 01:00:00' GROUP BY 1, 2)
SELECT symbol, market, epoch_us(coalesce(t, listing)) // 1000000 AS listing, coalesce(abs(epoch_us(t) - epoch_us(listing)) > 1800000000, false) AS diverged FROM pr FULL JOIN ob USING (symbol, market)""",
)
def _(s, d):
    e = A.table(s, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.min("ts").alias("listing"))
    probed = e.withColumn("market", F.lit("spot")).unionByName(e.withColumn("market", F.lit("option")))
    return shown(universe.observed_listings(probed, A.klines(s, d).where("open_time >= timestamp'2024-01-01 01:00:00'"), 0.5), "symbol market listing:t diverged")


_LIST = [f"P{i}" for i in range(5, 200, 13)]


@query(
    "universe_curated",
    f"""WITH {_JOINED}, li AS (SELECT unnest(range(1, {len(_LIST) + 1})) AS rank)
SELECT rank, base_asset, api_symbol, round(quote_volume / trades, 6) AS avg_trade_size, {T.format('onboard_date')} AS listing_date, CAST({len(_LIST)} AS BIGINT) AS total_candidates, 730::BIGINT AS min_listing_days_threshold FROM li JOIN ca ON base_asset = 'P' || (5 + 13 * (rank - 1)) WHERE onboard_date IS NOT NULL""",
)
def _(s, d):
    c = A.candidates(s, d)
    found = universe.curated(c, c.select("api_symbol", F.col("onboard_date").alias("listing_date")), A.spot_tickers(s, d), bases=_LIST)
    return shown(found.withColumn("listing_date", F.col("listing_date").cast("timestamp")), "rank:l base_asset api_symbol avg_trade_size:6 listing_date:t total_candidates:l min_listing_days_threshold:l")


_TRIALS = 20


@query(
    "deflated_sharpe",
    f"""WITH {E}, {D}, al AS (SELECT symbol AS run_id, r FROM e UNION ALL SELECT run_id, ret FROM d),
x AS (SELECT run_id, CASE WHEN max(r) <> min(r) THEN avg(r) / stddev_samp(r) END AS sr, count(r) AS n, skewness(r) AS sk, kurtosis(r) AS ku FROM al GROUP BY run_id),
z AS (SELECT run_id, sr / sqrt((1 - sk * sr + (ku + 2) / 4 * sr * sr) / n) - ({(1 - significance.EULER) * NormalDist().inv_cdf(1 - 1 / _TRIALS) + significance.EULER * NormalDist().inv_cdf(1 - 1 / (_TRIALS * 2.718281828459045))!r}) AS z FROM x),
i AS (SELECT run_id, greatest(-12e0, least(12e0, z)) AS z FROM z)
SELECT run_id, round(0.5e0 + list_sum(list_transform(range(0, 2001), lambda k: exp(-pow(z * k / 2000, 2) / 2) * CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)) * z / 6000 / sqrt(2 * pi()), 9) + 0e0 AS dsr FROM i""",
)
def _(s, d):
    """Of every curve and of the daily series; the SQL integrates the density by Simpson's rule."""
    returns = M.curve(s, d).select(F.col("symbol").alias("run_id"), F.col("period_ret_net").alias("ret")).unionByName(A.daily_returns(s, d).select("run_id", "ret"))
    return significance.deflated(returns, "ret", ["run_id"], _TRIALS).select("run_id", (F.round("dsr", 9) + 0.0).alias("dsr"))

"""Catalog entries on quality, the universe, upserts, folds, overfitting, the cross-section, earlier studies and the registry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import carry, crosssection, folds, overfit, quality, universe, windows
from quantloom.plans.catalog_market import _RATCHET, FU, PPY, B, D, K, T, adv, bars, ratcheted  # noqa: F401
from quantloom.plans.registering import query, shown
from quantloom.sources import adapters as A
from quantloom.sources import archive

LISTED = "TIMESTAMP '2024-01-01'"
TIERS = "tr AS (SELECT symbol, CASE WHEN row_number() OVER (ORDER BY symbol) <= 2 THEN 'majors' ELSE 'small_caps' END AS tier FROM (SELECT DISTINCT event_type AS symbol FROM events))"


def members(s: SparkSession, d: str) -> DataFrame:
    """symbol, rank, spot_pairs: the symbols as a small universe; ranks from 9, so that two are majors."""
    sym = A.table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct()
    return sym.withColumn("rank", F.row_number().over(Window.orderBy("symbol")) + 8).withColumn("spot_pairs", F.array("symbol"))


def tiers(s, d):
    return members(s, d).select("symbol", quality.tier(F.col("rank")).alias("tier"))


def listings(s, d):
    sym = A.table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct()
    markets = F.explode(F.array(*[F.lit(m) for m in ("spot", "perp_usdt", "perp_funding")])).alias("market")
    return sym.select("symbol", markets).withColumn("listing", F.lit("2024-01-01").cast("timestamp"))


_COV = "CASE WHEN share >= {} THEN 'INFO' WHEN share >= {} THEN 'WARN' ELSE 'ERROR' END"


@query("qc_k1_coverage", f"WITH {K}, x AS (SELECT symbol, market, count(*) AS n, CAST((epoch_us(max(open_time)) - epoch_us({LISTED})) // 3600000000 + 1 AS BIGINT) AS expected FROM k GROUP BY symbol, market), y AS (SELECT *, round(n / expected, 9) AS share FROM x) SELECT *, {_COV.format(0.999, 0.99)} AS severity, {_COV.format(0.999, 0.99)} <> 'ERROR' AS passed FROM y")
def _(s, d):
    return quality.coverage(A.klines(s, d), listings(s, d).where("market <> 'perp_funding'"), ["symbol", "market"], "open_time", 1, 0.999, 0.99)


@query("qc_k2_duplicates", f"WITH {K}, u AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE trades % 5 = 0) SELECT count(*) AS n FROM (SELECT 1 FROM u GROUP BY symbol, market, open_time HAVING count(*) > 1)")
def _(s, d):
    k = A.klines(s, d)
    return quality.duplicates(k.unionByName(k.where("trades % 5 = 0")), ["symbol", "market", "open_time"])


@query("qc_k3_ohlc", f"WITH {K}, x AS (SELECT open, close, low, CASE WHEN trades % 7 = 0 THEN low - 1 ELSE high END AS high FROM k) SELECT count(*) FILTER (WHERE high < greatest(open, close) OR low > least(open, close) OR high < low) AS n FROM x")
def _(s, d):
    return quality.ohlc_faults(A.klines(s, d).withColumn("high", F.when(F.col("trades") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))))


@query("qc_k4_non_negative", f"WITH {K} SELECT count(*) FILTER (WHERE volume - 100 < 0 OR quote_volume < 0 OR trades < 0) AS n FROM k")
def _(s, d):
    return quality.negatives(A.klines(s, d).withColumn("volume", F.col("volume") - 100))


@query(
    "qc_k5_stale",
    f"""WITH {K}, x AS (SELECT symbol, market, open_time, trades <= 4 AS flat FROM k),
y AS (SELECT *, CASE WHEN flat = lag(flat) OVER w THEN 0 ELSE 1 END AS c FROM x WINDOW w AS (PARTITION BY symbol, market ORDER BY open_time)),
z AS (SELECT *, sum(c) OVER (PARTITION BY symbol, market ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT symbol, market, {T.format('min(open_time)')} AS run_start, {T.format('max(open_time)')} AS run_end, count(*) AS run_len FROM z WHERE flat GROUP BY symbol, market, run HAVING count(*) >= 3""",
)
def _(s, d):
    k = A.klines(s, d).withColumn("thin", F.col("trades") <= 4)
    flat = k.withColumns({c: F.when(F.col("thin"), 1.0).otherwise(F.col("trades") + i) for i, c in enumerate(("open", "high", "low", "close"), 2)}).withColumn("volume", F.when(F.col("thin"), 0.0).otherwise(1.0))
    return shown(quality.stale_runs(flat, least=3), "symbol market run_start:t run_end:t run_len")


@query("qc_k6_extreme", f"WITH {K}, {TIERS} SELECT symbol, market, count(*) FILTER (WHERE abs(ln((close - 9800) / (open - 9800))) > CASE tier WHEN 'majors' THEN 0.2 ELSE 0.5 END) AS n FROM k JOIN tr USING (symbol) GROUP BY symbol, market")
def _(s, d):
    moved = A.klines(s, d).withColumns({"open": F.col("open") - 9800, "close": F.col("close") - 9800})
    return quality.extremes(moved, tiers(s, d))


@query("qc_k7_basis", f"WITH {B}, {TIERS}, x AS (SELECT symbol, abs(perp_close - spot_close) / (spot_close - 9000) AS off, tier FROM b JOIN tr USING (symbol)), y AS (SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE off > CASE tier WHEN 'majors' THEN 0.02 ELSE 0.1 END) AS n_warn, count(*) FILTER (WHERE off > CASE tier WHEN 'majors' THEN 0.1 ELSE 0.25 END) AS n_fail FROM x GROUP BY symbol) SELECT *, CASE WHEN n_fail > 0 THEN 'ERROR' WHEN n_warn > 0 THEN 'WARN' ELSE 'INFO' END AS severity FROM y")
def _(s, d):
    return quality.basis(A.klines(s, d).withColumn("close", F.col("close") - 9000), tiers(s, d))


@query("qc_k8_partial_bar", f"WITH {K} SELECT count(*) FILTER (WHERE close_time >= TIMESTAMP '2024-01-20') AS n FROM k")
def _(s, d):
    return quality.partial_bars(A.klines(s, d).withColumn("ingested_at", F.lit("2024-01-20").cast("timestamp")))


@query("qc_f1_alignment", f"WITH {K} SELECT count(*) FILTER (WHERE hour(open_time) NOT IN (0, 8, 16) OR minute(open_time) <> 0 OR second(open_time) <> 0) AS n FROM k")
def _(s, d):
    return quality.misaligned(A.klines(s, d).withColumnRenamed("open_time", "funding_time"))


@query("qc_f2_coverage", f"WITH {FU}, x AS (SELECT symbol, count(*) AS n, CAST((epoch_us(max(funding_time)) - epoch_us(greatest({LISTED}, min(funding_time)))) // 28800000000 + 1 AS BIGINT) AS expected FROM f GROUP BY symbol), y AS (SELECT *, round(n / expected, 9) AS share FROM x) SELECT *, {_COV.format(0.9995, 0.99)} AS severity, {_COV.format(0.9995, 0.99)} <> 'ERROR' AS passed FROM y")
def _(s, d):
    return quality.coverage(A.funding(s, d), listings(s, d).where("market = 'perp_funding'").select("symbol", "listing"), ["symbol"], "funding_time", 8, 0.9995, 0.99)


@query("qc_f3_rate_range", f"WITH {FU} SELECT count(*) FILTER (WHERE abs(funding_rate * 1000) > 0.005) AS n_warn, count(*) FILTER (WHERE abs(funding_rate * 1000) > 0.02) AS n_fail FROM f")
def _(s, d):
    return quality.rate_range(A.funding(s, d).withColumn("funding_rate", F.col("funding_rate") * 1000))


@query("qc_f4_duplicates", f"WITH {FU}, u AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE funding_rate > 0) SELECT count(*) AS n FROM (SELECT 1 FROM u GROUP BY symbol, funding_time HAVING count(*) > 1)")
def _(s, d):
    f = A.funding(s, d)
    return quality.duplicates(f.unionByName(f.where("funding_rate > 0")), ["symbol", "funding_time"])


_X1 = "SELECT f.symbol, count(*) AS n, count(*) FILTER (WHERE p.open_time IS NULL OR f.funding_time >= p.close_time) AS n_bad FROM f ASOF LEFT JOIN (SELECT * FROM k WHERE market = 'perp_usdt') p ON f.symbol = p.symbol AND f.funding_time >= p.open_time GROUP BY f.symbol"


@query("qc_x1_funding_in_bar", f"WITH {K}, {FU} {_X1}")
def _(s, d):
    return quality.uncovered_settlements(A.funding(s, d), A.klines(s, d))


@query("qc_c1_universe_legs", f"WITH {K} SELECT symbol, count(*) FILTER (WHERE market = 'spot') AS n_spot, count(*) FILTER (WHERE market = 'perp_usdt') AS n_perp, count(*) FILTER (WHERE market = 'spot') > 0 AND count(*) FILTER (WHERE market = 'perp_usdt') > 0 AS passed FROM k GROUP BY symbol")
def _(s, d):
    return quality.missing_legs(members(s, d), A.klines(s, d))


def _suite_sql() -> str:
    """All checks on the tables as they are, by series and then over all."""
    text = lambda **at: " || ".join(f"'{'{' if i == 0 else ','}\"{k}\":' || {v}" for i, (k, v) in enumerate(at.items())) + " || '}'"
    row = lambda name, severity, details, source, symbol="NULL", market="NULL": f"SELECT '{name}' AS name, {severity} <> 'ERROR' AS passed, {severity} AS severity, {symbol} AS symbol, {market} AS market, {details} AS details_json FROM {source}"
    error, warn = "CASE WHEN n > 0 THEN 'ERROR' ELSE 'INFO' END", "CASE WHEN n > 0 THEN 'WARN' ELSE 'INFO' END"
    both = "CASE WHEN n_fail > 0 THEN 'ERROR' WHEN n_warn > 0 THEN 'WARN' ELSE 'INFO' END"
    grid = "(SELECT *, round(n / expected, 9) AS share FROM (SELECT symbol, {m} count(*) AS n, CAST((epoch_us(max({t})) - epoch_us({a})) // {h} + 1 AS BIGINT) AS expected FROM {f} GROUP BY ALL))"
    count = lambda condition, table: f"(SELECT count(*) FILTER (WHERE {condition}) AS n FROM {table})"
    more = lambda table, keys: f"(SELECT count(*) AS n FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) > 1))"
    n = text(n="n")
    parts = [
        row("K1_coverage", _COV.format(0.999, 0.99), text(n="n", expected="expected", share="share"), grid.format(m="market,", t="open_time", a=LISTED, h=3600000000, f="k"), "symbol", "market"),
        row("F2_funding_coverage", _COV.format(0.9995, 0.99), text(n="n", expected="expected", share="share"), grid.format(m="", t="funding_time", a=f"greatest({LISTED}, min(funding_time))", h=28800000000, f="f"), "symbol"),
        row("K6_extreme_returns", warn, n, "(SELECT symbol, market, count(*) FILTER (WHERE abs(ln(close / open)) > CASE tier WHEN 'majors' THEN 0.2 ELSE 0.5 END) AS n FROM k JOIN tr USING (symbol) GROUP BY symbol, market)", "symbol", "market"),
        row("K7_spot_perp_basis", both, text(n_bars="n_bars", n_warn="n_warn", n_fail="n_fail"), "(SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE o > CASE tier WHEN 'majors' THEN 0.02 ELSE 0.1 END) AS n_warn, count(*) FILTER (WHERE o > CASE tier WHEN 'majors' THEN 0.1 ELSE 0.25 END) AS n_fail FROM (SELECT symbol, abs(perp_close - spot_close) / spot_close AS o FROM b) JOIN tr USING (symbol) GROUP BY symbol)", "symbol"),
        row("K2_duplicates", error, n, more("k", "symbol, market, open_time")),
        row("F4_duplicates", error, n, more("f", "symbol, funding_time")),
        row("K3_ohlc", error, n, count("high < greatest(open, close) OR low > least(open, close) OR high < low", "k")),
        row("K4_non_negative", error, n, count("volume < 0 OR quote_volume < 0 OR trades < 0", "k")),
        row("K5_stale", warn, n, "(SELECT count(*) AS n FROM (SELECT symbol, market, run FROM (SELECT *, sum(c) OVER (PARTITION BY symbol, market ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN flat = lag(flat) OVER (PARTITION BY symbol, market ORDER BY open_time) THEN 0 ELSE 1 END AS c FROM (SELECT *, open = high AND high = low AND low = close AND volume = 0 AS flat FROM k))) WHERE flat GROUP BY ALL HAVING count(*) >= 24))"),
        row("K8_partial_bar", error, n, count("close_time >= ingested_at", "k")),
        row("F1_alignment", error, n, count("epoch_us(funding_time) % 28800000000 <> 0", "f")),
        row("F3_rate_range", both, text(n_warn="n_warn", n_fail="n_fail"), "(SELECT count(*) FILTER (WHERE abs(funding_rate) > 0.005) AS n_warn, count(*) FILTER (WHERE abs(funding_rate) > 0.02) AS n_fail FROM f)"),
        row("C1_universe_legs", error, n, "(SELECT count(*) AS n FROM (SELECT symbol FROM k GROUP BY symbol HAVING count(*) FILTER (WHERE market = 'spot') = 0 OR count(*) FILTER (WHERE market = 'perp_usdt') = 0))"),
        row("X1_funding_in_bar", error, text(n="n", settlements="m"), f"(SELECT sum(n_bad)::BIGINT AS n, sum(n)::BIGINT AS m FROM ({_X1}))"),
    ]
    return f"WITH {B}, {TIERS} " + "\nUNION ALL ".join(parts)


@query("qc_suite", _suite_sql())
def _(s, d):
    return quality.suite(A.klines(s, d), A.funding(s, d), members(s, d), listings(s, d))


@query("qc_rollup", f"WITH {K}, x AS (SELECT symbol, market, count(*) AS n, CAST((epoch_us(max(open_time)) - epoch_us({LISTED})) // 3600000000 + 1 AS BIGINT) AS expected FROM k GROUP BY symbol, market), y AS (SELECT *, round(n / expected, 9) AS share FROM x), z AS (SELECT symbol, market, {_COV.format(0.6, 0.5)} AS severity FROM y) SELECT severity, count(*) AS n, count(DISTINCT symbol || '/' || market) AS n_series FROM z GROUP BY severity")
def _(s, d):
    k1 = quality.coverage(A.klines(s, d), listings(s, d).where("market <> 'perp_funding'"), ["symbol", "market"], "open_time", 1, 0.6, 0.5)
    return quality.rollup(k1)


# --- universe ---------------------------------------------------------------------------------------------------------------------------

AS_OF = "1998-09-01"
CAND = """cand AS (SELECT 'P' || p_partkey || 'USDT' AS api_symbol, 'P' || p_partkey AS base_asset, CASE WHEN p_size % 5 = 0 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type, CASE WHEN p_size % 7 = 0 THEN 'SETTLING' ELSE 'TRADING' END AS status,
  CASE WHEN p_partkey % 11 <> 0 THEN onboard END AS onboard_date, quote_volume, CASE WHEN p_partkey % 13 = 0 THEN 0e0 ELSE p_retailprice END AS last_price, trades
  FROM part JOIN (SELECT l_partkey, round(sum(l_extendedprice), 2) AS quote_volume, count(*) AS trades, CAST(min(l_shipdate) AS DATE) AS onboard FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
j AS (SELECT *, coalesce(last_price, 0) <= 0 AS bad_price, coalesce(date_diff('day', onboard_date, DATE '1998-09-01'), 0) AS days FROM cand WHERE contract_type = 'PERPETUAL' AND status = 'TRADING')"""
SPOTS = "sp AS (SELECT 'P' || l_partkey AS base_asset, 'P' || l_partkey || 'S' || l_suppkey AS pair, round(sum(l_extendedprice), 2) AS volume FROM lineitem GROUP BY l_partkey, l_suppkey)"


def judged(s, d):
    return universe.verdicts(universe.perpetuals(A.candidates(s, d)), AS_OF, 900)


@query("universe_candidates", f"WITH {CAND} SELECT api_symbol, base_asset, round(quote_volume, 2) AS quote_volume, trades FROM j")
def _(s, d):
    return shown(universe.perpetuals(A.candidates(s, d)), "api_symbol base_asset quote_volume:2 trades")


@query("universe_rejections", f"WITH {CAND} SELECT api_symbol, 'invalid_price' AS reason, coalesce(last_price, 0) AS observed_value, 0e0 AS threshold, true AS is_primary_reason FROM j WHERE bad_price UNION ALL SELECT api_symbol, 'listing_age', CAST(days AS DOUBLE), 900e0, NOT bad_price FROM j WHERE days < 900")
def _(s, d):
    return universe.rejections(judged(s, d))


@query("universe_topn", f"WITH {CAND} SELECT api_symbol, round(quote_volume, 2) AS quote_volume, row_number() OVER (ORDER BY quote_volume DESC, api_symbol) AS rank FROM j WHERE NOT bad_price AND days >= 900 QUALIFY rank <= 20")
def _(s, d):
    return shown(universe.top(universe.eligible(judged(s, d)), 20), "api_symbol quote_volume:2 rank:l")


@query("universe_spot_pairs", f"WITH {CAND}, {SPOTS}, g AS (SELECT base_asset, string_agg(pair, ',' ORDER BY volume DESC, pair) AS spot_pairs, max(volume) AS v FROM sp GROUP BY base_asset) SELECT api_symbol, coalesce(spot_pairs, '') AS spot_pairs, round(coalesce(v, 0), 2) AS primary_spot_quote_volume FROM j LEFT JOIN g USING (base_asset)")
def _(s, d):
    x = universe.with_spot(universe.perpetuals(A.candidates(s, d)), A.spot_tickers(s, d))
    return x.select("api_symbol", F.concat_ws(",", "spot_pairs").alias("spot_pairs"), F.round("primary_spot_quote_volume", 2).alias("primary_spot_quote_volume"))


@query("universe_point_in_time", "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS p FROM orders), s AS (SELECT CAST(p AS DATE) AS period_start, CAST(last_day(p) AS DATE) AS period_end, p + INTERVAL 2 day AS as_of FROM m) SELECT CAST(epoch(as_of) AS BIGINT) AS as_of FROM s WHERE as_of <= TIMESTAMP '1996-05-17' AND DATE '1996-05-17' BETWEEN period_start AND period_end")
def _(s, d):
    p = A.table(s, d, "orders").select(F.date_trunc("month", "o_orderdate").alias("p")).distinct()
    snaps = p.select(F.to_date("p").alias("period_start"), F.last_day("p").alias("period_end"), (F.col("p") + F.expr("interval 2 days")).alias("as_of"))
    return shown(universe.as_of(snaps, "1996-05-17").select("as_of"), "as_of:t")


@query(
    "task_expansion",
    f"""WITH {CAND}, {SPOTS}, t AS (SELECT api_symbol, base_asset, row_number() OVER (ORDER BY quote_volume DESC, api_symbol) AS rank FROM j WHERE NOT bad_price AND days >= 900 QUALIFY rank <= 20),
p AS (SELECT t.rank, t.api_symbol, pair, row_number() OVER (PARTITION BY t.rank ORDER BY volume DESC, pair) AS n FROM t JOIN sp USING (base_asset))
SELECT CAST(rank AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seq, 'perp_usdt' AS market, api_symbol AS symbol FROM t
UNION ALL SELECT rank, n, 'spot', pair FROM p
UNION ALL SELECT t.rank, coalesce(max(p.n), 0) + 1, 'perp_funding', t.api_symbol FROM t LEFT JOIN p ON p.rank = t.rank GROUP BY t.rank, t.api_symbol""",
)
def _(s, d):
    u, _r = universe.snapshot(A.candidates(s, d), A.spot_tickers(s, d), AS_OF, 900, 20)
    return shown(universe.tasks(u), "rank:l seq:l market symbol")


@query("listing_effective", f"WITH {K}, l AS (SELECT DISTINCT event_type AS symbol, unnest(['spot', 'perp_usdt']) AS market FROM events), x AS (SELECT symbol, market, CASE WHEN symbol < 'e' THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2023-12-01' END AS listing FROM l), f AS (SELECT symbol, market, min(open_time) AS o FROM k GROUP BY symbol, market) SELECT x.symbol, x.market, {T.format('least(listing, o)')} AS listing FROM x LEFT JOIN f USING (symbol, market)")
def _(s, d):
    stated = listings(s, d).where("market <> 'perp_funding'").withColumn("listing", F.when(F.col("symbol") < "e", F.lit("2024-01-02").cast("timestamp")).otherwise(F.lit("2023-12-01").cast("timestamp")))
    return shown(universe.listing_effective(stated, A.klines(s, d)), "symbol market listing:t")


@query("symbol_forms", f"WITH {CAND} SELECT api_symbol, base_asset || '-' || substr(api_symbol, length(base_asset) + 1) AS canonical, replace(base_asset || '-' || substr(api_symbol, length(base_asset) + 1), '-', '') AS api FROM j")
def _(s, d):
    c = universe.perpetuals(A.candidates(s, d)).withColumn("canonical", universe.canonical(F.col("api_symbol"), F.col("base_asset")))
    return c.select("api_symbol", "canonical", universe.api(F.col("canonical")).alias("api"))


# --- decoding and upserts -----------------------------------------------------------------------------------------------------------------


@query("decode_funding", "SELECT event_type AS symbol, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS funding_time, value / 1e4 AS funding_rate FROM events WHERE event_id % 9 <> 0")
def _(s, d):
    from datetime import UTC, datetime

    e = A.table(s, d, "events")
    raw = e.select(F.col("event_type").alias("symbol"), F.unix_millis("ts").alias("fundingTime"), F.when(F.col("event_id") % 9 == 0, "").otherwise((F.col("value") / 1e4).cast("string")).alias("fundingRate"), F.lit("").alias("markPrice"))
    return shown(archive.decode_funding(raw, "test", datetime(2024, 2, 1, tzinfo=UTC)), "symbol funding_time:t funding_rate")


_OLD = "old AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS price, count(*) AS trades, TIMESTAMP '2024-01-01' AS ingested_at FROM lineitem GROUP BY 1, 2), new AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN price * 1.01e0 ELSE price END AS price, CASE WHEN l_orderkey % 101 = 0 THEN trades + 1 ELSE trades END AS trades, TIMESTAMP '2024-01-02' AS ingested_at FROM old WHERE l_orderkey % 3 <> 1)"


def _versions(s, d):
    old = A.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("price"), F.count("*").alias("trades")).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    new = old.where("l_orderkey % 3 <> 1").withColumns({"price": F.when(F.col("l_orderkey") % 97 == 0, F.col("price") * 1.01).otherwise(F.col("price")), "trades": F.when(F.col("l_orderkey") % 101 == 0, F.col("trades") + 1).otherwise(F.col("trades")), "ingested_at": F.lit("2024-01-02").cast("timestamp")})
    return old, new


@query("corrections_long", f"WITH {_OLD}, p AS (SELECT o.l_orderkey, o.l_linenumber, o.price AS a, n.price AS b, o.trades AS c, n.trades AS d FROM old o JOIN new n USING (l_orderkey, l_linenumber)) SELECT l_orderkey, l_linenumber, 'price' AS field, round(a, 6) AS old_value, round(b, 6) AS new_value FROM p WHERE abs(b - a) > 1e-9 * greatest(abs(a), 1) UNION ALL SELECT l_orderkey, l_linenumber, 'trades', CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM p WHERE c <> d")
def _(s, d):
    old, new = _versions(s, d)
    found = archive.corrections(old.withColumn("symbol", F.concat_ws("/", "l_orderkey", "l_linenumber")), new.withColumn("symbol", F.concat_ws("/", "l_orderkey", "l_linenumber")), ["symbol"], ["price", "trades"], "symbol")
    key = F.split("symbol", "/")
    return found.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "field", F.round("old_value", 6).alias("old_value"), F.round("new_value", 6).alias("new_value"))


@query("upsert_latest", f"WITH {_OLD} SELECT l_orderkey, l_linenumber, round(price, 6) AS price, trades FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ingested_at DESC) = 1")
def _(s, d):
    return shown(archive.merged(*_versions(s, d), ["l_orderkey", "l_linenumber"]), "l_orderkey l_linenumber price:6 trades")


# --- folds --------------------------------------------------------------------------------------------------------------------------------

_I = f"{D}, i AS (SELECT row_number() OVER (ORDER BY time) - 1 AS i, time FROM d), n AS (SELECT count(*) AS n, min(time) AS t0, max(time) AS t1 FROM i)"


def _fold_rows(df):
    return df.groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.sum("i").alias("sum_i")).select(F.col("fold_id").cast("long").alias("fold_id"), "role", "n", "first_i", "last_i", "sum_i")


_FSUM = "SELECT CAST(fold_id AS BIGINT) AS fold_id, role, count(*) AS n, min(i) AS first_i, max(i) AS last_i, CAST(sum(i) AS BIGINT) AS sum_i FROM r WHERE role IS NOT NULL GROUP BY fold_id, role"


@query("cv_purged", f"WITH {_I}, b AS (SELECT i, time, least(i // (n // 5), 4) AS block FROM i, n), f AS (SELECT block AS fold_id, min(time) AS a, max(time) AS z FROM b GROUP BY block), r AS (SELECT fold_id, i, CASE WHEN block = fold_id THEN 'test' WHEN time < a - INTERVAL 3 day OR time > z + INTERVAL 3 day THEN 'train' END AS role FROM b, f) {_FSUM}")
def _(s, d):
    return _fold_rows(folds.purged(A.daily_returns(s, d), 5, timedelta(days=3)))


_STEPS = "c AS (SELECT unnest(generate_series(t0 + INTERVAL 400 day, t1, INTERVAL 150 day)) AS te, t0 FROM n), r0 AS (SELECT te, i, CASE WHEN time >= {} AND time < te THEN 'train' WHEN time >= te AND time < te + INTERVAL 100 day THEN 'test' END AS role FROM i, c), w AS (SELECT te, row_number() OVER (ORDER BY te) - 1 AS fold_id FROM (SELECT te FROM r0 WHERE role IS NOT NULL GROUP BY te HAVING count(DISTINCT role) = 2)), r AS (SELECT fold_id, i, role FROM r0 JOIN w USING (te))"


@query("cv_walk_forward", f"WITH {_I}, {_STEPS.format('greatest(t0, te - INTERVAL 300 day)')} {_FSUM}")
def _(s, d):
    return _fold_rows(folds.walk_forward(A.daily_returns(s, d), timedelta(days=300), timedelta(days=100), timedelta(days=150), timedelta(days=400)))


@query("cv_expanding", f"WITH {_I}, {_STEPS.format('t0')} {_FSUM}")
def _(s, d):
    return _fold_rows(folds.expanding(A.daily_returns(s, d), timedelta(days=100), timedelta(days=150), timedelta(days=400)))


# --- overfitting ----------------------------------------------------------------------------------------------------------------------------


def trial_returns(s, d):
    """i, trial_id, ret: ten momentum rules on the daily series."""
    r = A.daily_returns(s, d)
    w = windows.over(["run_id"], "time")
    r = r.withColumn("i", F.row_number().over(w).cast("long") - 1)
    r = r.withColumns({f"sign_{k}": F.coalesce(F.signum(F.lag("ret", k).over(w)), F.lit(0.0)) for k in range(1, 11)})
    rules = F.array(*[F.struct(F.lit(k).cast("long").alias("trial_id"), F.col(f"sign_{k}").alias("sign")) for k in range(1, 11)])
    return r.select("i", "ret", F.inline(rules)).select("i", "trial_id", F.round(F.col("ret") * F.col("sign") / 10, 10).alias("ret"))


_PBO = f"""WITH {D}, x AS (SELECT row_number() OVER (ORDER BY time) - 1 AS i, time, ret FROM d), n AS (SELECT count(*) AS t FROM x),
m AS (SELECT x.i, k AS trial_id, round(x.ret * coalesce(sign(y.ret), 0) / 10, 10) AS r FROM x CROSS JOIN (SELECT unnest(range(1, 11)) AS k) LEFT JOIN x y ON y.i = x.i - k),
c AS (SELECT least(i // (t // 8), 7) AS p, trial_id, r FROM m, n),
s AS (SELECT unnest(range(0, 256)) AS split_id), h AS (SELECT split_id FROM s WHERE bit_count(split_id) = 4),
g AS (SELECT split_id, trial_id, (split_id >> p) & 1 AS is_in, CASE WHEN max(r) > min(r) THEN round(avg(r) / stddev_samp(r), 10) END AS sr FROM h, c GROUP BY 1, 2, 3),
w AS (SELECT split_id, trial_id, max(sr) FILTER (WHERE is_in = 1) AS ins, max(sr) FILTER (WHERE is_in = 0) AS out_ FROM g GROUP BY 1, 2),
b AS (SELECT split_id, trial_id, ins, out_ FROM w QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY ins DESC NULLS LAST, trial_id) = 1),
k AS (SELECT b.split_id, b.trial_id AS best_trial, count(*) FILTER (WHERE w.out_ <= b.out_) AS rank FROM b JOIN w USING (split_id) GROUP BY 1, 2)"""


@query("pbo_splits", f"{_PBO} SELECT split_id, CAST(best_trial AS BIGINT) AS best_trial, rank, round(rank / 11e0, 9) AS omega FROM k")
def _(s, d):
    return shown(overfit.splits(trial_returns(s, d), 8), "split_id best_trial:l rank omega:9")


@query("pbo_cscv", f"{_PBO} SELECT count(*) AS n_splits, round(avg(CAST(rank / 11e0 < 0.5 AS INT)), 9) AS pbo FROM k")
def _(s, d):
    return shown(overfit.probability(overfit.splits(trial_returns(s, d), 8)), "n_splits pbo:9")


SWEEP = {"ma_lookback": [3], "exit_threshold": [-1e-5], "reentry_threshold": [5e-6], "compression_lookback": [4, 6, 8], "compression_exit": [1e-6, 4e-6], "compression_reentry": [2e-6, 8e-6], "min_hold": [2]}


@query("sweep_curves")
def _(s, d):
    """Every trial of the grid as one job: final equity and Sharpe by symbol and trial."""
    keys = ["symbol", "trial_id"]
    c = carry.equity(carry.costs(carry.legs(ratcheted(s, d, SWEEP), keys=keys), keys=keys), keys=keys)
    return c.groupBy(*keys).agg(F.round(metrics.sharpe_population("period_ret_net", PPY), 6).alias("sharpe"), F.round(F.max_by("equity", "time"), 6).alias("final_equity"))


_TG = f"""pg AS (SELECT trial_id, CASE WHEN sum(CAST(r <> 0 AS INT)) > 0 THEN avg(r) / stddev_pop(r) * sqrt(252e0) ELSE 0 END AS post_sharpe FROM m JOIN x USING (i) WHERE x.time >= TIMESTAMP '1997-01-01' GROUP BY trial_id),
pa AS (SELECT trial_id, avg(r) / stddev_pop(r) * sqrt(252e0) AS all_sharpe FROM m GROUP BY trial_id),
z AS (SELECT trial_id, CAST(post_sharpe >= -0.05 AS INT) + CAST(all_sharpe >= -0.05 AS INT) AS dominance, round(post_sharpe, 6) AS post_sharpe FROM pg JOIN pa USING (trial_id))"""


def _graded(s, d):
    r = A.daily_returns(s, d).withColumn("i", F.row_number().over(windows.over(["run_id"], "time")).cast("long") - 1).select("i", "time")
    x = trial_returns(s, d).join(r, "i")
    post = F.when(F.col("time") >= F.lit("1997-01-01").cast("timestamp"), F.col("ret"))
    g = x.withColumn("post", post).groupBy("trial_id").agg(metrics.sharpe_population("post", 252.0).alias("post_sharpe"), metrics.sharpe_population("ret", 252.0).alias("all_sharpe"))
    return g.select("trial_id", ((F.col("post_sharpe") >= -0.05).cast("int") + (F.col("all_sharpe") >= -0.05).cast("int")).alias("dominance"), F.round("post_sharpe", 6).alias("post_sharpe"))


@query("sweep_rank", f"{_PBO}, {_TG} SELECT trial_id, CAST(dominance AS BIGINT) AS dominance, post_sharpe, row_number() OVER (ORDER BY dominance DESC, post_sharpe DESC NULLS LAST, trial_id) AS place FROM z")
def _(s, d):
    return shown(overfit.ranked_trials(_graded(s, d)), "trial_id:l dominance:l post_sharpe place:l")


@query("sweep_surface", f"{_PBO}, {_TG}, y AS (SELECT CAST(trial_id % 2 AS BIGINT) AS arm, max(post_sharpe) - min(post_sharpe) AS gap FROM z GROUP BY 1) SELECT arm, round(gap, 6) AS gap, CASE WHEN gap < 1 THEN 'FLAT' WHEN gap > 2 THEN 'KNIFE-EDGE' ELSE 'MODERATE' END AS verdict FROM y")
def _(s, d):
    return shown(overfit.surface(_graded(s, d).withColumn("arm", F.col("trial_id") % 2), "arm"), "arm gap:6 verdict")


# --- cross-section --------------------------------------------------------------------------------------------------------------------------

_W = """wk AS (SELECT p_brand AS symbol, date_trunc('week', l_shipdate) AS week, arg_min(price, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS first_close, arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS last_close, round(sum(l_discount) - 0.05e0 * count(*), 6) AS fund_sum, count(*) AS fund_n
  FROM (SELECT *, round(l_extendedprice / l_quantity, 6) AS price FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pn AS (SELECT *, last_close / first_close - 1 AS ret FROM wk)"""
_FS = "sg AS (SELECT *, round(CASE WHEN count(fund_sum) OVER a = 2 THEN avg(fund_sum) OVER a END - CASE WHEN count(fund_sum) OVER b = 13 THEN median(fund_sum) OVER b END, 12) AS signal FROM pn WINDOW a AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING))"
_MS = "sg AS (SELECT *, round(-CASE WHEN count(ret) OVER a = 2 THEN avg(ret) OVER a END, 12) AS signal FROM pn WINDOW a AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))"
_BK = """bk0 AS (SELECT *, count(*) OVER (PARTITION BY week) AS n, row_number() OVER (PARTITION BY week ORDER BY signal, symbol) AS lo FROM sg WHERE signal IS NOT NULL AND ret IS NOT NULL),
bk1 AS (SELECT *, greatest(1, floor(n * 0.3e0)) AS q FROM bk0),
bk AS (SELECT week, max(n) AS n_eligible, CASE WHEN max(n) >= 10 THEN 5e-1 * (avg(ret) FILTER (WHERE lo <= q) - avg(ret) FILTER (WHERE lo > n - q)) ELSE 0 END AS price_ret, CASE WHEN max(n) >= 10 THEN 5e-1 * (avg(fund_sum) FILTER (WHERE lo > n - q) - avg(fund_sum) FILTER (WHERE lo <= q)) ELSE 0 END AS funding_ret FROM bk1 GROUP BY week)"""


def panel(s, d):
    return crosssection.with_returns(A.weekly_panel(s, d))


@query("weekly_panel", f"WITH {_W} SELECT symbol, {T.format('week')} AS week, round(first_close, 6) AS first_close, round(last_close, 6) AS last_close, fund_sum, fund_n, round(ret, 9) AS ret FROM pn")
def _(s, d):
    return shown(panel(s, d), "symbol week:t first_close:6 last_close:6 fund_sum fund_n ret:9")


@query("weekly_from_bars", f"WITH {K}, {FU}, p AS (SELECT symbol, date_trunc('week', open_time) AS week, arg_min(close, open_time) AS a, arg_max(close, open_time) AS z FROM k WHERE market = 'spot' GROUP BY 1, 2), g AS (SELECT symbol, date_trunc('week', funding_time) AS week, sum(funding_rate) AS fund_sum, count(*) AS fund_n FROM f GROUP BY 1, 2) SELECT symbol, {T.format('week')} AS week, round(a, 6) AS first_close, round(z, 6) AS last_close, round(coalesce(fund_sum, 0), 9) AS fund_sum, coalesce(fund_n, 0) AS fund_n FROM p LEFT JOIN g USING (symbol, week)")
def _(s, d):
    return shown(crosssection.weekly(A.klines(s, d).where("market = 'spot'"), A.funding(s, d)), "symbol week:t first_close:6 last_close:6 fund_sum:9 fund_n")


@query("xs_funding_returns", f"WITH {_W}, {_FS}, {_BK} SELECT {T.format('week')} AS week, n_eligible, round(price_ret, 9) AS price_ret, round(funding_ret, 9) AS funding_ret, round(price_ret + funding_ret, 9) AS ret FROM bk")
def _(s, d):
    return shown(crosssection.baskets(crosssection.funding_signal(panel(s, d))), "week:t n_eligible price_ret:9 funding_ret:9 ret:9")


@query("xs_momentum_returns", f"WITH {_W}, {_MS}, {_BK} SELECT {T.format('week')} AS week, n_eligible, round(price_ret, 9) AS price_ret, round(funding_ret, 9) AS funding_ret, round(price_ret + funding_ret, 9) AS ret FROM bk")
def _(s, d):
    return shown(crosssection.baskets(crosssection.momentum_signal(panel(s, d))), "week:t n_eligible price_ret:9 funding_ret:9 ret:9")


_AL = f"""fs AS (SELECT * FROM (WITH {_FS}, {_BK} SELECT week, price_ret + funding_ret AS a FROM bk)), ms AS (SELECT * FROM (WITH {_MS}, {_BK} SELECT week, price_ret + funding_ret AS b FROM bk)), mk AS (SELECT week, avg(ret) AS c FROM pn GROUP BY week), al AS (SELECT week, a, b, c FROM fs JOIN ms USING (week) JOIN mk USING (week))"""


def aligned(s, d):
    return crosssection.aligned(panel(s, d))


@query("aligned_returns", f"WITH {_W}, {_AL} SELECT {T.format('week')} AS week, round(a, 9) AS a, round(b, 9) AS b, round(c, 9) AS c FROM al")
def _(s, d):
    return shown(aligned(s, d), "week:t a:9 b:9 c:9")


@query("pearson", f"WITH {_W}, {_AL} SELECT round(corr(a, b), 8) AS ab, round(corr(a, c), 8) AS ac, round(corr(b, c), 8) AS bc FROM al")
def _(s, d):
    return aligned(s, d).agg(*[F.round(F.corr(x, y), 8).alias(x + y) for x, y in ("ab", "ac", "bc")])


@query("ols_one", f"WITH {_W}, {_AL} SELECT count(*) AS n, round(regr_slope(a, c), 8) AS beta, round(regr_intercept(a, c), 8) AS alpha, round(regr_r2(a, c), 8) AS r2 FROM al")
def _(s, d):
    x = aligned(s, d)
    return x.agg(F.count("*").alias("n"), F.round(F.regr_slope("a", "c"), 8).alias("beta"), F.round(F.regr_intercept("a", "c"), 8).alias("alpha"), F.round(F.regr_r2("a", "c"), 8).alias("r2"))


@query("ols_two", f"WITH {_W}, {_AL}, v AS (SELECT covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc, var_samp(b) AS bb, var_samp(c) AS cc FROM al) SELECT round((ab * cc - ac * bc) / (bb * cc - bc * bc), 7) AS b_b, round((ac * bb - ab * bc) / (bb * cc - bc * bc), 7) AS b_c FROM v")
def _(s, d):
    found = crosssection.ols(aligned(s, d), "a", ["b", "c"])
    return s.createDataFrame([(found["b_b"], found["b_c"])], "b_b double, b_c double").select(F.round("b_b", 7).alias("b_b"), F.round("b_c", 7).alias("b_c"))


@query(
    "thesis_verdict",
    f"""WITH {_W}, {_AL}, m AS (SELECT regr_slope(a, c) AS beta, regr_r2(a, c) AS r2 FROM al), g AS (SELECT any_value(r2) AS r2, coalesce(avg(a - beta * c) / stddev_samp(a - beta * c) * sqrt(52e0), 0) AS sr FROM al CROSS JOIN m)
SELECT CASE WHEN sr >= 0.5 AND r2 < 0.5 THEN 'PROCEED' WHEN sr < 0.3 OR r2 > 0.7 THEN 'KILL' ELSE 'AMBIGUOUS' END AS verdict FROM g""",
)
def _(s, d):
    ratio, r2 = crosssection.residual(aligned(s, d), "a", "c", 52.0)
    return s.createDataFrame([(crosssection.verdict(ratio, r2),)], "verdict string")


# --- the earlier study ------------------------------------------------------------------------------------------------------------------------

_P0 = f"""{B}, p1 AS (SELECT *, coalesce(funding_rate, 0) AS income, spot_ret - perp_ret + 5e-1 * coalesce(funding_rate, 0) AS ret FROM b),
p0 AS (SELECT *, 999e0 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)) AS equity FROM p1)"""
_P2 = f"""{_P0}, q0 AS (SELECT *, CASE WHEN income <> 0 AND count(*) OVER w = 6 THEN round(avg(income) OVER w, 12) END AS ma FROM p0 WINDOW w AS (PARTITION BY symbol, income <> 0 ORDER BY open_time ROWS 5 PRECEDING)),
q1 AS (SELECT *, coalesce(last_value(CASE WHEN ma < -2e-5 THEN 0 WHEN ma > 1e-5 THEN 1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 1) AS st FROM q0),
q2 AS (SELECT symbol, open_time, st, ret * st - CASE WHEN st <> coalesce(lag(st) OVER (PARTITION BY symbol ORDER BY open_time), 1) THEN 5e-4 ELSE 0 END AS ret FROM q1),
q AS (SELECT *, 999e0 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)) AS equity FROM q2)"""


def always(s, d):
    return carry.always_on(A.klines(s, d), A.funding(s, d))


def switched(s, d):
    return carry.switched(always(s, d), 6, -2e-5, 1e-5)


@query("carry_v1_phase0", f"WITH {_P0} SELECT symbol, {T.format('open_time')} AS open_time, round(ret, 10) AS ret, round(equity, 6) AS equity FROM p0")
def _(s, d):
    return shown(always(s, d), "symbol open_time:t ret:10 equity:6")


@query("carry_v2_phase0", f"WITH {_P2} SELECT symbol, {T.format('open_time')} AS open_time, CAST(st AS BIGINT) AS regime_state, round(ret, 10) AS ret, round(equity, 6) AS equity FROM q")
def _(s, d):
    return shown(switched(s, d), "symbol open_time:t regime_state:l ret:10 equity:6")


@query(
    "phase0_regime_table",
    f"""WITH {_P2}, y AS (SELECT symbol, date_trunc('day', open_time) AS day, exp(sum(ln(1 + ret))) - 1 AS r, arg_max(equity, open_time) AS equity FROM q GROUP BY 1, 2),
z AS (SELECT *, unnest(['full', CAST(year(day) AS VARCHAR), CASE WHEN day < TIMESTAMP '2024-01-11' THEN 'pre' ELSE 'post' END]) AS span FROM y),
w AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, span ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM z)
SELECT symbol, span, count(*) AS n, round(CASE WHEN max(r) <> min(r) THEN avg(r) / stddev_samp(r) * sqrt(365e0) END, 6) AS sharpe, round(min(dd), 9) AS max_dd, round(avg(CAST(r > 0 AS INT)), 9) AS hit_rate FROM w GROUP BY 1, 2""",
)
def _(s, d):
    y = switched(s, d).groupBy("symbol", F.date_trunc("day", "open_time").alias("time")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("r"), F.max_by("equity", "open_time").alias("equity"))
    spans = F.array(F.lit("full"), F.year("time").cast("string"), F.when(F.col("time") < F.lit("2024-01-11").cast("timestamp"), "pre").otherwise("post"))
    z = y.withColumn("span", F.explode(spans))
    z = z.withColumn("dd", windows.drawdown("equity", ["symbol", "span"], "time"))
    return z.groupBy("symbol", "span").agg(F.count("*").alias("n"), F.round(metrics.sharpe("r", 365.0), 6).alias("sharpe"), F.round(F.min("dd"), 9).alias("max_dd"), F.round(metrics.hit_rate("r"), 9).alias("hit_rate"))


_STATS = "count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(CAST(x > 0 AS INT)), 9) AS positive"


def _stats(df):
    x = F.col("funding_rate") * 1095 * 100
    return df.withColumn("x", x).groupBy(*[c for c in df.columns if c not in ("funding_rate", "funding_time", "x")]).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max"), F.round(F.avg((F.col("x") > 0).cast("int")), 9).alias("positive"))


@query("funding_yearly", f"WITH {FU}, y AS (SELECT symbol, CAST(year(funding_time) AS BIGINT) AS year, funding_rate * 1095 * 100 AS x FROM f) SELECT symbol, year, {_STATS} FROM y GROUP BY symbol, year")
def _(s, d):
    return _stats(A.funding(s, d).withColumn("year", F.year("funding_time").cast("long")))


@query("funding_regime", f"WITH {FU}, y AS (SELECT symbol, CASE WHEN funding_time < TIMESTAMP '2024-01-11' THEN 'pre_etf' ELSE 'post_etf' END AS regime, funding_rate * 1095 * 100 AS x FROM f) SELECT symbol, regime, {_STATS} FROM y GROUP BY symbol, regime")
def _(s, d):
    return _stats(A.funding(s, d).withColumn("regime", F.when(F.col("funding_time") < F.lit("2024-01-11").cast("timestamp"), "pre_etf").otherwise("post_etf")))


_QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("funding_percentiles", f"WITH {FU}, o AS (SELECT symbol, funding_rate AS v, row_number() OVER (PARTITION BY symbol ORDER BY funding_rate) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM f) SELECT symbol, {', '.join(f'max(v) FILTER (WHERE r = floor((n - 1) * {q}e0 + 0.5)) AS q_{i}' for i, q in enumerate(_QS))} FROM o GROUP BY symbol")
def _(s, d):
    from quantloom.operators.regimes import nearest_rank

    return nearest_rank(A.funding(s, d), "funding_rate", ["symbol"], _QS)


@query(
    "negative_runs",
    f"""WITH {FU}, x AS (SELECT symbol, funding_time, funding_rate < 0 AS neg FROM f), y AS (SELECT *, CASE WHEN neg = lag(neg) OVER w THEN 0 ELSE 1 END AS c FROM x WINDOW w AS (PARTITION BY symbol ORDER BY funding_time)),
z AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY funding_time ROWS UNBOUNDED PRECEDING) AS run FROM y), r AS (SELECT symbol, run, min(funding_time) AS a, max(funding_time) AS b, count(*) AS n FROM z WHERE neg GROUP BY symbol, run)
SELECT symbol, count(*) AS n_runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS total, {T.format('arg_max(a, (n, -epoch(a)))')} AS longest_start, {T.format('arg_max(b, (n, -epoch(a)))')} AS longest_end FROM r GROUP BY symbol""",
)
def _(s, d):
    r = windows.runs(A.funding(s, d).withColumn("neg", F.col("funding_rate") < 0), "neg", ["symbol"], "funding_time")
    first = F.struct("run_len", -F.unix_seconds("run_start"))
    out = r.groupBy("symbol").agg(F.count("*").alias("n_runs"), F.max("run_len").alias("longest"), F.sum("run_len").alias("total"), F.max_by("run_start", first).alias("longest_start"), F.max_by("run_end", first).alias("longest_end"))
    return shown(out, "symbol n_runs longest total longest_start:t longest_end:t")


# --- registry, panels -------------------------------------------------------------------------------------------------------------------------

_PANEL = f"""{_P0}, cv AS (SELECT symbol AS alpha_id, open_time AS time, ret, true AS active FROM p0 WHERE NOT (symbol = 'click' AND hour(open_time) < 6)), ts AS (SELECT DISTINCT time FROM cv), al AS (SELECT DISTINCT alpha_id FROM cv)"""


@query("oos_panel", f"WITH {_PANEL} SELECT al.alpha_id, {T.format('ts.time')} AS time, round(coalesce(ret, 0), 10) AS oos_ret, coalesce(active, false) AS alpha_active FROM ts CROSS JOIN al LEFT JOIN cv ON cv.alpha_id = al.alpha_id AND cv.time = ts.time")
def _(s, d):
    from quantloom.plans.registry import oos_panel

    c = always(s, d).select(F.col("symbol").alias("alpha_id"), F.col("open_time").alias("time"), "ret").withColumn("active", F.lit(True))
    return shown(oos_panel(c.where(~((F.col("alpha_id") == "click") & (F.hour("time") < 6)))), "alpha_id time:t oos_ret:10 alpha_active")


_RUNS = """ru AS (SELECT 'r' || o_orderkey AS run_id, 's' || (o_orderkey % 40) AS strategy_id, o_orderdate AS registered_at, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'complete' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'dirty' ELSE 'clean' END AS corr,
  (o_orderkey % 100) / 100e0 AS dsr, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 70) / 100e0 END AS pbo FROM orders)"""


@query("validated_latest", f"WITH {_RUNS} SELECT strategy_id, run_id FROM ru WHERE status = 'validated' AND corr = 'clean' AND dsr >= 0.5 AND pbo <= 0.5 QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY registered_at DESC, run_id DESC) = 1")
def _(s, d):
    from quantloom.plans.registry import validated

    k = F.col("o_orderkey")
    pbo = F.when(k % 3 != 0, (k % 70) / 100)
    runs = A.table(s, d, "orders").select(F.concat(F.lit("r"), k).alias("run_id"), F.concat(F.lit("s"), k % 40).alias("strategy_id"), F.col("o_orderdate").alias("registered_at"), F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "complete").otherwise("failed").alias("status"), F.when(k % 5 == 0, "dirty").otherwise("clean").alias("corrections_diff_status"), F.to_json(F.struct(((k % 100) / 100).alias("dsr_ci_lower"), pbo.alias("pbo")), {"ignoreNullFields": "false"}).alias("metrics_summary_json"))
    return validated(runs, {"dsr_ci_lower": (0.5, None), "pbo": (None, 0.5)}).select("strategy_id", "run_id")


@query("trial_counts", f"WITH {_RUNS} SELECT strategy_id, count(DISTINCT dsr) AS n_trials FROM ru GROUP BY strategy_id")
def _(s, d):
    k = F.col("o_orderkey")
    t = A.table(s, d, "orders").select(F.concat(F.lit("s"), k % 40).alias("strategy_id"), ((k % 100) / 100).cast("string").alias("params_hash"))
    return t.groupBy("strategy_id").agg(F.countDistinct("params_hash").alias("n_trials"))


@query("verdict_gates", f"WITH {_RUNS} SELECT run_id, CASE WHEN dsr > 0.5 AND coalesce(pbo, 0) <= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM ru")
def _(s, d):
    from quantloom.plans.registry import verdict_column

    k = F.col("o_orderkey")
    return A.table(s, d, "orders").select(F.concat(F.lit("r"), k).alias("run_id"), verdict_column((k % 100) / 100, F.when(k % 3 != 0, (k % 70) / 100), F.lit(-0.1)).alias("verdict"))


@query("dsr_interval")
def _(s, d):
    """The deflated Sharpe ratio of the daily series with both bootstrap intervals."""
    from quantloom.operators import significance

    r = [x["ret"] for x in A.daily_returns(s, d).orderBy("time").select("ret").collect()]  # one series, bounded by days
    rows = [(name, *significance.interval(s, r, "catalog", n_trials=20, n_bootstrap=200, block=block)) for name, block in (("iid", None), ("block", 20))]
    return s.createDataFrame(rows, "kind string, dsr double, lo double, hi double")

"""Catalog entries on bars, funding, strategies and metrics: each a DataFrame plan and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import carry, overfit, regimes, windows
from quantloom.plans.registering import query, shown
from quantloom.sources import adapters as A

PARAMS = carry.CarryParams(ma_lookback=6, exit_threshold=-2e-5, reentry_threshold=1e-5)
PPY = 8760.0

# SQL building blocks, each after the ones that it reads.
K = """ev AS (SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'perp_usdt' END AS market, date_trunc('hour', ts) AS open_time, ts, event_id, value, value + 10000 AS price FROM events),
k AS (SELECT symbol, market, open_time, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(value) AS volume, sum(price) AS quote_volume, count(*) AS trades, open_time + INTERVAL 1 hour - INTERVAL 1 millisecond AS close_time, TIMESTAMP '2024-02-01' AS ingested_at FROM ev GROUP BY symbol, market, open_time)"""
FU = """f AS (SELECT event_type AS symbol, make_timestamp((epoch_us(ts) // 28800000000) * 28800000000) AS funding_time, round((avg(value) - 50) / 1e5, 12) AS funding_rate FROM events GROUP BY 1, 2)"""
B = f"""{K}, {FU},
b0 AS (SELECT symbol, open_time, max(close) FILTER (WHERE market = 'spot') AS spot_close, max(close) FILTER (WHERE market = 'perp_usdt') AS perp_close FROM k GROUP BY symbol, open_time),
b AS (SELECT b0.symbol, b0.open_time, spot_close, perp_close, funding_rate, coalesce(spot_close / lag(spot_close) OVER w - 1, 0) AS spot_ret, coalesce(perp_close / lag(perp_close) OVER w - 1, 0) AS perp_ret
  FROM b0 LEFT JOIN f ON f.symbol = b0.symbol AND f.funding_time = b0.open_time WHERE spot_close IS NOT NULL AND perp_close IS NOT NULL WINDOW w AS (PARTITION BY b0.symbol ORDER BY b0.open_time))"""
S = f"""{B},
s0 AS (SELECT *, CASE WHEN funding_rate IS NOT NULL AND count(funding_rate) OVER w = 6 THEN round(avg(funding_rate) OVER w, 12) END AS ma FROM b WINDOW w AS (PARTITION BY symbol, funding_rate IS NOT NULL ORDER BY open_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, coalesce(last_value(CASE WHEN ma < -2e-5 THEN 0 WHEN ma > 1e-5 THEN 1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 1) AS regime_state FROM s0)"""
L = f"""{S},
l AS (SELECT symbol, open_time AS time, 0 AS leg_id, 'spot' AS market, 'long' AS side, 5e-1 * regime_state AS weight, 5e2 * regime_state AS notional, spot_ret AS leg_ret, 0e0 AS funding_paid FROM s
  UNION ALL SELECT symbol, open_time, 1, 'perp_usdt', 'short', -5e-1 * regime_state, 5e2 * regime_state, perp_ret, CASE WHEN regime_state > 0 THEN -5e2 * regime_state * coalesce(funding_rate, 0) ELSE 0e0 END FROM s)"""
C = f"""{L},
c0 AS (SELECT *, coalesce(abs(notional - lag(notional) OVER (PARTITION BY symbol, leg_id ORDER BY time)), 0) AS traded FROM l),
c AS (SELECT *, traded * CASE market WHEN 'spot' THEN 1e-3 ELSE 4.5e-4 END AS fees, traded * 2e-4 AS slippage FROM c0)"""
E = f"""{C},
e0 AS (SELECT symbol, time, sum(weight * leg_ret) AS g, sum(fees + funding_paid + slippage) AS c FROM c GROUP BY symbol, time),
e1 AS (SELECT symbol, time, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE g END AS g, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE c END AS c FROM e0 WINDOW w AS (PARTITION BY symbol ORDER BY time)),
e2 AS (SELECT *, exp(sum(ln(1 + g)) OVER w) AS p FROM e1 WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)),
e3 AS (SELECT *, p * (1e3 - sum(c / p) OVER w) AS equity FROM e2 WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)),
e AS (SELECT symbol, time, equity, g AS period_ret_gross, g - coalesce(c / lag(equity) OVER w, 0) AS r, equity - 1e3 AS cumulative_pnl FROM e3 WINDOW w AS (PARTITION BY symbol ORDER BY time))"""
D = """d0 AS (SELECT l_shipdate AS time, round(sum(l_extendedprice), 2) AS close FROM lineitem GROUP BY 1),
d AS (SELECT * FROM (SELECT 'revenue' AS run_id, time, close, close / lag(close) OVER (ORDER BY time) - 1 AS ret FROM d0) WHERE ret IS NOT NULL)"""
T = "CAST(epoch({}) AS BIGINT)"


def bars(s: SparkSession, d: str) -> DataFrame:
    return carry.assemble(A.klines(s, d), A.funding(s, d))


def states(s: SparkSession, d: str) -> DataFrame:
    return carry.hysteresis(bars(s, d), PARAMS)


def costed(s: SparkSession, d: str) -> DataFrame:
    return carry.costs(carry.legs(states(s, d)), slippage=carry.linear_slippage(2.0))


def curve(s: SparkSession, d: str) -> DataFrame:
    return carry.equity(costed(s, d))


@query("bars_hourly", f"WITH {K} SELECT symbol, market, {T.format('open_time')} AS open_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume, trades FROM k")
def _(s, d):
    return shown(A.klines(s, d), "symbol market open_time:t open:6 high:6 low:6 close:6 volume:4 trades")


@query("funding_8h", f"WITH {FU} SELECT symbol, {T.format('funding_time')} AS funding_time, funding_rate FROM f")
def _(s, d):
    return shown(A.funding(s, d), "symbol funding_time:t funding_rate")


@query("bars_assembled", f"WITH {B} SELECT symbol, {T.format('open_time')} AS open_time, round(spot_close, 6) AS spot_close, round(perp_close, 6) AS perp_close, funding_rate, round(spot_ret, 10) AS spot_ret, round(perp_ret, 10) AS perp_ret FROM b")
def _(s, d):
    return shown(bars(s, d), "symbol open_time:t spot_close:6 perp_close:6 funding_rate spot_ret:10 perp_ret:10")


@query("bars_spot_perp_join", f"WITH {K} SELECT a.symbol, {T.format('a.open_time')} AS open_time, round(b.close - a.close, 6) AS basis FROM k a JOIN k b ON a.symbol = b.symbol AND a.open_time = b.open_time AND a.market = 'spot' AND b.market = 'perp_usdt'")
def _(s, d):
    k = A.klines(s, d).select("symbol", "market", "open_time", "close")
    a, b = k.where("market = 'spot'"), k.where("market = 'perp_usdt'").withColumnRenamed("close", "p")
    return shown(a.join(b, ["symbol", "open_time"]).withColumn("basis", F.col("p") - F.col("close")), "symbol open_time:t basis:6")


@query("bars_funding_left", f"WITH {K}, {FU} SELECT k.symbol, k.market, {T.format('open_time')} AS open_time, funding_rate FROM k LEFT JOIN f ON f.symbol = k.symbol AND f.funding_time = k.open_time")
def _(s, d):
    f = A.funding(s, d).withColumnRenamed("funding_time", "open_time")
    return shown(A.klines(s, d).join(f, ["symbol", "open_time"], "left"), "symbol market open_time:t funding_rate")


@query("asof_funding_bar", f"WITH {K}, {FU} SELECT f.symbol, {T.format('f.funding_time')} AS funding_time, {T.format('p.open_time')} AS open_time, round(p.close, 6) AS close FROM f ASOF LEFT JOIN (SELECT * FROM k WHERE market = 'perp_usdt') p ON f.symbol = p.symbol AND f.funding_time >= p.open_time")
def _(s, d):
    perp = A.klines(s, d).where("market = 'perp_usdt'").select("symbol", "open_time", "close")
    met = windows.as_of(A.funding(s, d).select("symbol", "funding_time"), perp, ["symbol"], "funding_time", "open_time", ["open_time", "close"])
    return shown(met, "symbol funding_time:t open_time:t close:6")


@query("archive_bounds", f"WITH {K} SELECT symbol, market, {T.format('min(open_time)')} AS first_time, {T.format('max(open_time)')} AS last_time, count(*) AS n FROM k GROUP BY symbol, market")
def _(s, d):
    return shown(A.klines(s, d).groupBy("symbol", "market").agg(F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"), F.count("*").alias("n")), "symbol market first_time:t last_time:t n")


@query("hysteresis_state", f"WITH {S} SELECT symbol, {T.format('open_time')} AS open_time, CAST(regime_state AS BIGINT) AS regime_state FROM s")
def _(s, d):
    return shown(states(s, d), "symbol open_time:t regime_state:l")


_RATCHET = f"""WITH RECURSIVE {B},
st AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i,
  CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY open_time ROWS 2 PRECEDING) = 3 THEN round(avg(funding_rate) OVER (PARTITION BY symbol ORDER BY open_time ROWS 2 PRECEDING), 12) END AS fast,
  CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY open_time ROWS 3 PRECEDING) = 4 THEN round(avg(funding_rate) OVER (PARTITION BY symbol ORDER BY open_time ROWS 3 PRECEDING), 12) END AS slow
  FROM b WHERE funding_rate IS NOT NULL),
want AS (SELECT *, fast < -1e-5 OR abs(slow) < 2e-6 AS leaves, fast > 5e-6 AND abs(slow) > 4e-6 AS enters FROM st),
m(symbol, i, state, since) AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT) FROM want
  UNION ALL
  SELECT w.symbol, w.i, CASE WHEN x.flip THEN 1 - m.state ELSE m.state END, CASE WHEN x.flip THEN 0 ELSE m.since + 1 END
  FROM m JOIN want w ON w.symbol = m.symbol AND w.i = m.i + 1,
  LATERAL (SELECT coalesce(m.since + 1 >= 3 AND w.fast IS NOT NULL AND w.slow IS NOT NULL AND CASE WHEN m.state = 1 THEN w.leaves ELSE w.enters END, false) AS flip) x),
r AS (SELECT b.symbol, b.open_time, coalesce(last_value(m.state IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.open_time ROWS UNBOUNDED PRECEDING), 0) AS regime_state
  FROM b LEFT JOIN want w ON w.symbol = b.symbol AND w.open_time = b.open_time LEFT JOIN m ON m.symbol = w.symbol AND m.i = w.i)"""
RATCHET = carry.RatchetParams(ma_lookback=3, exit_threshold=-1e-5, reentry_threshold=5e-6, compression_lookback=4, compression_exit=2e-6, compression_reentry=4e-6, min_hold=3)


def ratcheted(s: SparkSession, d: str, values: dict | None = None) -> DataFrame:
    trials = overfit.grid(s, values or {k: [v] for k, v in RATCHET.as_dict().items() if k not in ("fee_bps", "capital_per_leg")})
    return carry.ratchet(bars(s, d), trials)


@query("ratchet_state", f"{_RATCHET} SELECT symbol, {T.format('open_time')} AS open_time, CAST(regime_state AS BIGINT) AS regime_state FROM r")
def _(s, d):
    return shown(ratcheted(s, d), "symbol open_time:t regime_state:l")


@query("ratchet_active_fraction", f"{_RATCHET} SELECT symbol, round(avg(CAST(regime_state > 0 AS INT)), 9) AS active_fraction FROM r GROUP BY symbol")
def _(s, d):
    return ratcheted(s, d).groupBy("symbol").agg(F.round(F.avg((F.col("regime_state") > 0).cast("int")), 9).alias("active_fraction"))


@query("legs", f"WITH {L} SELECT symbol, {T.format('time')} AS time, CAST(leg_id AS BIGINT) AS leg_id, market, side, weight, notional, round(leg_ret, 10) AS leg_ret, round(funding_paid, 12) AS funding_paid FROM l")
def _(s, d):
    return shown(carry.legs(states(s, d)), "symbol time:t leg_id:l market side weight notional leg_ret:10 funding_paid:12")


@query("costs", f"WITH {C} SELECT symbol, {T.format('time')} AS time, CAST(leg_id AS BIGINT) AS leg_id, round(fees, 9) AS fees, round(slippage, 9) AS slippage FROM c")
def _(s, d):
    return shown(costed(s, d), "symbol time:t leg_id:l fees:9 slippage:9")


@query("contrib", f"WITH {C} SELECT symbol, {T.format('time')} AS time, round(sum(weight * leg_ret) * 1e3 - sum(fees) - sum(funding_paid) - sum(slippage), 6) AS contrib_pnl, round(abs(sum(weight) * 1e3), 6) AS position_notional, round(sum(weight), 9) AS weight_net FROM c GROUP BY symbol, time")
def _(s, d):
    return shown(carry.contributions(costed(s, d)), "symbol time:t contrib_pnl:6 position_notional:6 weight_net:9")


# The recursion itself, a bar at a time.
ER = f"""{C},
e0 AS (SELECT symbol, time, sum(weight * leg_ret) AS g, sum(fees + funding_paid + slippage) AS c, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM c GROUP BY symbol, time),
e(symbol, time, i, equity, period_ret_gross, r) AS (
  SELECT symbol, time, i, 1e3, 0e0, 0e0 FROM e0 WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.time, n.i, e.equity * (1 + n.g - CASE WHEN e.equity > 0 THEN n.c / e.equity ELSE 0e0 END), n.g, n.g - CASE WHEN e.equity > 0 THEN n.c / e.equity ELSE 0e0 END FROM e JOIN e0 n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query("equity_curve", f"WITH RECURSIVE {ER} SELECT symbol, {T.format('time')} AS time, round(equity, 6) AS equity, round(period_ret_gross, 10) AS period_ret_gross, round(r, 10) AS period_ret_net, round(equity - 1e3, 6) AS cumulative_pnl FROM e")
def _(s, d):
    return shown(curve(s, d), "symbol time:t equity:6 period_ret_gross:10 period_ret_net:10 cumulative_pnl:6")


#: Rows of each curve that are spoilt, by their number.
_SPOILT = "CASE WHEN i % 50 = 7 THEN -equity WHEN i % 50 = 9 THEN equity * 1.001 WHEN i % 70 = 11 THEN NULL ELSE equity END"


@query(
    "equity_curve_faults",
    f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM e), sp AS (SELECT symbol, time, i, r, CASE WHEN i % 90 = 13 THEN cumulative_pnl + 1 ELSE cumulative_pnl END AS pnl, {_SPOILT} AS q FROM n),
ff AS (SELECT *, lag(q) OVER w * (1 + r) AS due, first_value(q) OVER w AS q0 FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY time))
SELECT symbol, CAST(0 AS BIGINT) AS time_breaks, count(*) FILTER (WHERE q IS NULL OR q <= 0) AS not_positive, count(*) FILTER (WHERE abs(q - due) > 1e-9 * abs(due)) AS recursion_breaks, count(*) FILTER (WHERE abs(pnl - (q - q0)) > 1e-9 * greatest(abs(pnl), 1e-9)) AS pnl_breaks FROM ff GROUP BY symbol""",
)
def _(s, d):
    n = curve(s, d).withColumn("i", F.row_number().over(windows.over(["symbol"], "time")))
    return carry.curve_faults(n.withColumns({"equity": F.expr(_SPOILT), "cumulative_pnl": F.expr("CASE WHEN i % 90 = 13 THEN cumulative_pnl + 1 ELSE cumulative_pnl END")}))


@query("transitions", f"WITH {S} SELECT symbol, count(*) FILTER (WHERE c) AS n_transitions FROM (SELECT symbol, regime_state <> lag(regime_state) OVER (PARTITION BY symbol ORDER BY open_time) AS c FROM s) GROUP BY symbol")
def _(s, d):
    return carry.transitions(states(s, d))


@query("active_fraction", f"WITH {L} SELECT symbol, round(avg(CAST(weight > 0 AS INT)), 9) AS active_fraction FROM l WHERE leg_id = 0 GROUP BY symbol")
def _(s, d):
    return carry.legs(states(s, d)).where("leg_id = 0").groupBy("symbol").agg(F.round(F.avg((F.col("weight") > 0).cast("int")), 9).alias("active_fraction"))


@query("funding_direction", f"WITH {L} SELECT symbol, {T.format('time')} AS time, side, round(CASE side WHEN 'short' THEN leg_ret ELSE -leg_ret END, 10) AS earned FROM l")
def _(s, d):
    return shown(carry.legs(states(s, d)).withColumn("earned", carry.funding_direction(F.col("side"), F.col("leg_ret"))), "symbol time:t side earned:10")


def graded(name: str, column, sql: str, digits: int = 6) -> None:
    """A metric of each symbol's net returns; the SQL reads r from e."""

    @query(name, f"WITH {E} SELECT symbol, round({sql}, {digits}) AS {name} FROM e GROUP BY symbol")
    def _(s, d):
        return curve(s, d).groupBy("symbol").agg(F.round(column("period_ret_net"), digits).alias(name))


_SR = "CASE WHEN count(r) >= 2 AND max(r) <> min(r) THEN avg(r) / stddev_samp(r) * sqrt(8760e0) END"
graded("sharpe", lambda r: metrics.sharpe(r, PPY), _SR)
graded("script_sharpe", lambda r: metrics.sharpe_population(r, PPY), "coalesce(CASE WHEN max(r) <> min(r) THEN avg(r) / stddev_pop(r) * sqrt(8760e0) END, 0)")
graded("sortino", lambda r: metrics.sortino(r, PPY), "CASE WHEN count(r) >= 2 AND avg(pow(least(r, 0), 2)) > 0 THEN avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(8760e0) END")
graded("hit_rate", metrics.hit_rate, "avg(CAST(r > 0 AS INT))", 9)
graded("profit_factor", metrics.profit_factor, "CASE WHEN sum(least(r, 0)) < 0 THEN sum(greatest(r, 0)) / -sum(least(r, 0)) END")
graded("skew", metrics.skew, "CASE WHEN count(r) >= 3 AND max(r) <> min(r) THEN skewness(r) END")
graded("kurtosis", metrics.kurtosis, "CASE WHEN count(r) >= 4 AND max(r) <> min(r) THEN kurtosis(r) END", 5)
graded("value_at_risk", metrics.value_at_risk, "quantile_cont(r, 0.05)", 10)


@query("cvar", f"WITH {E}, v AS (SELECT symbol, quantile_cont(r, 0.05) AS q FROM e GROUP BY symbol) SELECT symbol, round(avg(r), 10) AS cvar FROM e JOIN v USING (symbol) WHERE r <= q GROUP BY symbol")
def _(s, d):
    return shown(metrics.expected_shortfall(curve(s, d), "period_ret_net", ["symbol"]), "symbol cvar:10")


_DD = "dd AS (SELECT symbol, time, equity, equity / max(equity) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS x FROM e)"


@query("max_drawdown", f"WITH {E}, {_DD} SELECT symbol, round(min(x), 9) AS max_dd FROM dd GROUP BY symbol")
def _(s, d):
    return shown(metrics.max_drawdown(curve(s, d), "equity", ["symbol"], "time"), "symbol max_dd:9")


@query("calmar", f"WITH {E}, {_DD} SELECT symbol, round(CASE WHEN min(x) < 0 THEN (pow(arg_max(equity, time) / arg_min(equity, time), 8760e0 / (count(*) - 1)) - 1) / -min(x) END, 5) AS calmar FROM dd GROUP BY symbol")
def _(s, d):
    return shown(metrics.calmar(curve(s, d), "equity", ["symbol"], "time", PPY), "symbol calmar:5")


@query(
    "drawdown_duration",
    f"""WITH {D}, q AS (SELECT run_id, time, exp(sum(ln(1 + ret / 100)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM d),
m AS (SELECT *, equity >= max(equity) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM q),
g AS (SELECT *, sum(CAST(peak AS INT)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS ep FROM m),
x AS (SELECT run_id, ep, min(time) AS a, count(*) AS n FROM g GROUP BY run_id, ep),
y AS (SELECT run_id, n, a, coalesce(lead(a) OVER (ORDER BY ep), (SELECT max(time) FROM q)) AS z FROM x)
SELECT run_id, CAST(coalesce(max(epoch_us(z) - epoch_us(a)) FILTER (WHERE n > 1), 0) // 86400000000 AS BIGINT) AS days FROM y GROUP BY run_id""",
)
def _(s, d):
    r = A.daily_returns(s, d)
    c = r.withColumn("equity", F.exp(F.sum(F.log1p(F.col("ret") / 100)).over(windows.over(["run_id"], "time").rowsBetween(Window.unboundedPreceding, 0))))
    return windows.longest_drawdown(c, "equity", ["run_id"], "time")


@query("turnover", f"WITH {E}, m AS (SELECT symbol, sum(traded) AS t FROM c GROUP BY symbol) SELECT symbol, round(t / avg(equity) * 8760e0 / count(*), 6) AS turnover FROM e JOIN m USING (symbol) GROUP BY symbol, t")
def _(s, d):
    book = costed(s, d).withColumn("run", F.col("symbol"))  # each symbol is a run of its own here
    return shown(metrics.turnover_per_year(book, curve(s, d).withColumnRenamed("symbol", "run"), ["run"], PPY).withColumnRenamed("run", "symbol"), "symbol turnover:6")


@query("adv_30d", f"WITH {K} SELECT symbol, round(avg(quote_volume) * 24, 3) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM k WHERE market = 'perp_usdt') WHERE n <= 720 GROUP BY symbol")
def _(s, d):
    return shown(adv(s, d), "symbol adv:3")


def adv(s, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return A.klines(s, d).where("market = 'perp_usdt'").withColumn("n", F.row_number().over(w)).where("n <= 720").groupBy("symbol").agg((F.avg("quote_volume") * 24).alias("adv"))


@query(
    "capacity",
    f"""WITH {L}, v AS (SELECT symbol, avg(quote_volume) * 24 AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM k WHERE market = 'perp_usdt') WHERE n <= 720 GROUP BY symbol),
g AS (SELECT avg(x) AS g FROM (SELECT time, sum(abs(notional)) AS x FROM l GROUP BY time))
SELECT round(min(0.01 * adv / (n / g)), 3) AS capacity FROM (SELECT symbol, max(abs(notional)) AS n FROM l GROUP BY symbol HAVING n > 0) JOIN v USING (symbol), g""",
)
def _(s, d):
    x = carry.legs(states(s, d)).withColumn("run_id", F.lit("all"))
    return metrics.capacity(x, adv(s, d), ["run_id"]).select(F.round("capacity", 3).alias("capacity"))


@query("active_sharpe", f"WITH {E}, a AS (SELECT symbol, time, max(notional) > 0 AS on_ FROM l GROUP BY symbol, time) SELECT symbol, round({_SR}, 6) AS active_sharpe FROM e JOIN a USING (symbol, time) WHERE on_ GROUP BY symbol")
def _(s, d):
    active = carry.legs(states(s, d)).groupBy("symbol", "time").agg((F.max("notional") > 0).alias("active"))
    return curve(s, d).join(active, ["symbol", "time"]).where("active").groupBy("symbol").agg(F.round(metrics.sharpe("period_ret_net", PPY), 6).alias("active_sharpe"))


@query("modal_period", f"WITH {B}, g AS (SELECT symbol, epoch_us(open_time) - lag(epoch_us(open_time)) OVER (PARTITION BY symbol ORDER BY open_time) AS gap_us FROM b), n AS (SELECT symbol, gap_us, count(*) AS n FROM g WHERE gap_us IS NOT NULL GROUP BY symbol, gap_us), t AS (SELECT *, max(n) OVER (PARTITION BY symbol) AS m FROM n) SELECT symbol, CASE WHEN count(*) = 1 THEN max(gap_us) END AS gap_us FROM t WHERE n = m GROUP BY symbol")
def _(s, d):
    return windows.modal_gap(bars(s, d), ["symbol"], "open_time")


@query("resample_daily", f"WITH {E}, x AS (SELECT symbol, date_trunc('day', time) AS day, arg_max(equity, time) AS equity, exp(sum(ln(1 + r))) - 1 AS ret FROM e GROUP BY 1, 2) SELECT symbol, {T.format('day')} AS day, round(equity, 6) AS equity, round(ret, 9) AS ret, round(equity - first_value(equity) OVER (PARTITION BY symbol ORDER BY day), 6) AS pnl FROM x")
def _(s, d):
    return shown(metrics.resampled(curve(s, d), "day"), "symbol day:t equity:6 ret:9 pnl:6")


@query("window_sharpes", f"WITH {E}, t AS (SELECT *, max(time) OVER (PARTITION BY symbol) AS z FROM e), x AS (SELECT symbol, r, unnest(list_filter(['all', CASE WHEN time >= z - INTERVAL 10 DAY THEN 'last_10d' END, CASE WHEN time >= TIMESTAMP '2024-01-16' THEN 'post_cut' END], lambda v: v IS NOT NULL)) AS span FROM t) SELECT symbol, span, round({_SR}, 6) AS sharpe FROM x GROUP BY symbol, span")
def _(s, d):
    z = F.max("time").over(Window.partitionBy("symbol"))
    c = curve(s, d).withColumn("z", z)
    spans = F.array(F.lit("all"), F.when(F.col("time") >= F.col("z") - F.expr("interval 10 days"), "last_10d"), F.when(F.col("time") >= F.lit("2024-01-16").cast("timestamp"), "post_cut"))
    x = c.withColumn("span", F.explode(F.filter(spans, lambda v: v.isNotNull())))
    return x.groupBy("symbol", "span").agg(F.round(metrics.sharpe("period_ret_net", PPY), 6).alias("sharpe"))


@query("lo_standard_error", f"WITH {E}, x AS (SELECT symbol, avg(r) / stddev_samp(r) AS sr, count(r) AS n, skewness(r) AS sk, kurtosis(r) AS ku FROM e GROUP BY symbol HAVING count(r) >= 4 AND max(r) <> min(r)) SELECT symbol, round(CASE WHEN 1 - sk * sr + (ku + 2) / 4 * sr * sr > 0 THEN sqrt((1 - sk * sr + (ku + 2) / 4 * sr * sr) / n) END, 8) AS se FROM x")
def _(s, d):
    r = "period_ret_net"
    x = curve(s, d).groupBy("symbol").agg(metrics.sharpe(r, 1.0).alias("sr"), F.count(r).alias("n"), metrics.skew(r).alias("sk"), metrics.kurtosis(r).alias("ku")).where("n >= 4 and sr is not null")
    return x.select("symbol", F.round(metrics.standard_error(*map(F.col, ("sr", "n", "sk", "ku"))), 8).alias("se"))


@query("metric_bundle", f"WITH {E}, {_DD}, a AS (SELECT symbol, min(x) AS max_dd FROM dd GROUP BY symbol) SELECT symbol, count(*) AS n_obs, round({_SR}, 6) AS sharpe, round(avg(CAST(r > 0 AS INT)), 9) AS hit_rate, round(quantile_cont(r, 0.05), 10) AS var_5pct, round(any_value(max_dd), 9) AS max_dd FROM e JOIN a USING (symbol) GROUP BY symbol")
def _(s, d):
    r = "period_ret_net"
    c = curve(s, d).withColumn("dd", windows.drawdown("equity", ["symbol"], "time"))
    return c.groupBy("symbol").agg(F.count("*").alias("n_obs"), F.round(metrics.sharpe(r, PPY), 6).alias("sharpe"), F.round(metrics.hit_rate(r), 9).alias("hit_rate"), F.round(metrics.value_at_risk(r), 10).alias("var_5pct"), F.round(F.min("dd"), 9).alias("max_dd"))


@query("carry_flagship", f"WITH {E}, {_DD}, a AS (SELECT symbol, min(x) AS max_dd FROM dd GROUP BY symbol) SELECT symbol, count(*) AS n_bars, round({_SR}, 6) AS sharpe, round(any_value(max_dd), 9) AS max_dd, round(arg_max(equity, time), 6) AS final_equity FROM e JOIN a USING (symbol) GROUP BY symbol")
def _(s, d):
    c = curve(s, d).withColumn("dd", windows.drawdown("equity", ["symbol"], "time"))
    return c.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.round(metrics.sharpe("period_ret_net", PPY), 6).alias("sharpe"), F.round(F.min("dd"), 9).alias("max_dd"), F.round(F.max_by("equity", "time"), 6).alias("final_equity"))


_R = f"""{D}, v AS (SELECT time, ret, CASE WHEN count(ret) OVER w = 30 THEN round(stddev_samp(ret) OVER w, 12) END AS vol, CASE WHEN count(ret) OVER x = 200 THEN round(sum(ret) OVER x, 12) END AS trend FROM d
  WINDOW w AS (ORDER BY time ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), x AS (ORDER BY time ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
o AS (SELECT vol, row_number() OVER (ORDER BY vol) - 1 AS r, count(*) OVER () AS n FROM v WHERE vol IS NOT NULL),
q AS (SELECT max(vol) FILTER (WHERE r = floor((n - 1) * 0.33e0 + 0.5)) AS q0, max(vol) FILTER (WHERE r = floor((n - 1) * 0.67e0 + 0.5)) AS q1 FROM o),
g AS (SELECT time, 'vol' AS regime_kind, CASE WHEN vol <= q0 THEN 'low' WHEN vol <= q1 THEN 'mid' ELSE 'high' END AS regime_label FROM v, q WHERE vol IS NOT NULL
  UNION ALL SELECT time, 'trend', CASE WHEN trend > 0 THEN 'bull' ELSE 'bear' END FROM v WHERE trend IS NOT NULL
  UNION ALL SELECT time, 'etf', CASE WHEN time < TIMESTAMP '1998-01-01' THEN 'pre_etf' ELSE 'post_etf' END FROM v)"""


def labels(s, d):
    return regimes.classify(A.daily_returns(s, d), ["run_id"], cut="1998-01-01")


@query("regime_labels", f"WITH {_R} SELECT {T.format('time')} AS time, regime_kind, regime_label FROM g")
def _(s, d):
    return shown(labels(s, d), "time:t regime_kind regime_label")


@query(
    "regime_stratified",
    f"""WITH {_R}, u AS (SELECT time, ret / 100 AS r, exp(sum(ln(1 + ret / 100)) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)) AS equity FROM d),
z AS (SELECT regime_kind, regime_label, r, equity / max(equity) OVER (PARTITION BY regime_kind, regime_label ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM u JOIN g USING (time))
SELECT regime_kind, regime_label, count(*) AS n_obs, round(CASE WHEN max(r) <> min(r) THEN avg(r) / stddev_samp(r) * sqrt(252e0) END, 6) AS sharpe, round(avg(r) * 252, 8) AS ann_return, round(min(dd), 8) AS max_dd, round(avg(CAST(r > 0 AS INT)), 9) AS hit_rate FROM z GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(s, d):
    r = A.daily_returns(s, d).withColumn("period_ret_net", F.col("ret") / 100)
    c = r.withColumn("equity", F.exp(F.sum(F.log1p("period_ret_net")).over(windows.over(["run_id"], "time").rowsBetween(Window.unboundedPreceding, 0))))
    return shown(regimes.stratify(c, labels(s, d), ["run_id"], 252.0), "regime_kind regime_label n_obs sharpe:6 ann_return:8 max_dd:8 hit_rate:9")

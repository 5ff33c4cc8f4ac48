"""Catalog entries on families of runs, on stored and streamed events, and on judging: each a DataFrame plan and the same in SQL."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quantloom.functions import metrics
from quantloom.operators import carry, regimes, windows
from quantloom.plans import catalog_market as M
from quantloom.plans import family
from quantloom.plans.catalog_market import PARAMS, E, K, S, T
from quantloom.plans.registering import ORACLES, query, shown
from quantloom.sources import adapters as A

SPANS = {"cut": "2024-01-16", "long": timedelta(days=10), "short": timedelta(days=3)}
BASE = carry.RatchetParams(ma_lookback=3, exit_threshold=-1e-5, reentry_threshold=5e-6, min_hold=2)
EXITS, LOOKBACKS = [1e-6, 2e-6, 4e-6], [4, 6, 8]


def _machines(trials: list[tuple]) -> str:
    """The ratchet of trials (id, lookback, exit, re-entry), a settlement at a time; rr: symbol, trial_id, open_time, regime_state."""
    rows = ", ".join(f"(CAST({i} AS BIGINT), {n}, {x!r}, {y!r})" for i, n, x, y in trials)
    slow = ", ".join(f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(funding_rate) OVER w{n}, 12) END AS slow{n}" for n in (4, 6, 8))
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY open_time ROWS {n - 1} PRECEDING)" for n in (3, 4, 6, 8))
    return f"""tr(trial_id, cl, ce, cr) AS (VALUES {rows}),
st AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i, CASE WHEN count(*) OVER w3 = 3 THEN round(avg(funding_rate) OVER w3, 12) END AS fast, {slow} FROM b WHERE funding_rate IS NOT NULL WINDOW {frames}),
wa AS (SELECT *, CASE cl WHEN 4 THEN slow4 WHEN 6 THEN slow6 ELSE slow8 END AS slow FROM st CROSS JOIN tr),
want AS (SELECT *, fast < -1e-5 OR abs(slow) < ce AS leaves, fast > 5e-6 AND abs(slow) > cr AS enters FROM wa),
m(symbol, trial_id, i, state, since) AS (
  SELECT DISTINCT symbol, trial_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT) FROM want
  UNION ALL
  SELECT w.symbol, w.trial_id, w.i, CASE WHEN x.flip THEN 1 - m.state ELSE m.state END, CASE WHEN x.flip THEN 0 ELSE m.since + 1 END
  FROM m JOIN want w ON w.symbol = m.symbol AND w.trial_id = m.trial_id AND w.i = m.i + 1,
  LATERAL (SELECT coalesce(m.since + 1 >= 2 AND w.fast IS NOT NULL AND w.slow IS NOT NULL AND CASE WHEN m.state = 1 THEN w.leaves ELSE w.enters END, false) AS flip) x),
rr AS (SELECT b.symbol, t.trial_id, b.open_time, coalesce(last_value(m.state IGNORE NULLS) OVER (PARTITION BY b.symbol, t.trial_id ORDER BY b.open_time ROWS UNBOUNDED PRECEDING), 0) AS regime_state
  FROM b CROSS JOIN tr t LEFT JOIN want w ON w.symbol = b.symbol AND w.trial_id = t.trial_id AND w.open_time = b.open_time LEFT JOIN m ON m.symbol = w.symbol AND m.trial_id = w.trial_id AND m.i = w.i)"""


#: From states to curves, without slippage; a series' name is put together of its keys.
_TAIL = E[len(S) :].replace("traded * 2e-4 AS slippage", "0e0 AS slippage")
_SR = "coalesce(CASE WHEN max(r) {0} <> min(r) {0} THEN avg(r) {0} / stddev_pop(r) {0} * sqrt(8760e0) END, 0)"
_SUM = f"""dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS x, max(time) OVER (PARTITION BY symbol) AS z FROM e),
ac AS (SELECT symbol, avg(CAST(regime_state > 0 AS INT)) AS active_fraction, count(*) FILTER (WHERE c) AS n_transitions FROM (SELECT symbol, regime_state, regime_state <> lag(regime_state) OVER (PARTITION BY symbol ORDER BY open_time) AS c FROM s) GROUP BY symbol),
su AS (SELECT symbol, count(*) AS n_obs, {_SR.format("")} AS full_sharpe, {_SR.format("FILTER (WHERE time >= z - INTERVAL 10 DAY)")} AS long_sharpe, {_SR.format("FILTER (WHERE time >= z - INTERVAL 3 DAY)")} AS short_sharpe, {_SR.format("FILTER (WHERE time >= TIMESTAMP '2024-01-16')")} AS post_sharpe,
  min(x) AS max_dd, arg_max(equity, time) AS final_equity, any_value(active_fraction) AS active_fraction, any_value(n_transitions) AS n_transitions FROM dd JOIN ac USING (symbol) GROUP BY symbol)"""
_COLS = "n_obs, round(full_sharpe, 6) AS full_sharpe, round(long_sharpe, 6) AS long_sharpe, round(short_sharpe, 6) AS short_sharpe, round(post_sharpe, 6) AS post_sharpe, round(max_dd, 9) AS max_dd, round(final_equity, 6) AS final_equity, round(active_fraction, 9) AS active_fraction, n_transitions"
_SHOW = "n_obs full_sharpe:6 long_sharpe:6 short_sharpe:6 post_sharpe:6 max_dd:9 final_equity:6 active_fraction:9 n_transitions"
_SV = S.replace(",\ns AS (", ",\nsv AS (")
_GRID = [(i, n, x, x * family.REENTRY) for i, (x, n) in enumerate((x, n) for x in EXITS for n in LOOKBACKS)]
_SERIES = "s AS (SELECT {0} || '#' || rr.trial_id AS symbol, b.open_time, spot_ret, perp_ret, funding_rate, regime_state FROM b JOIN rr ON rr.symbol = b.symbol AND rr.open_time = b.open_time)".format("b.symbol")
_SWEPT = f"""WITH RECURSIVE {_SV}, {_machines(_GRID)},
s AS (SELECT b.symbol || '#' || rr.trial_id AS symbol, b.open_time, spot_ret, perp_ret, funding_rate, rr.regime_state FROM b JOIN rr ON rr.symbol = b.symbol AND rr.open_time = b.open_time
  UNION ALL SELECT symbol || '#-1', open_time, spot_ret, perp_ret, funding_rate, regime_state FROM sv){_TAIL}, {_SUM},
kk AS (SELECT split_part(symbol, '#', 1) AS sym, CAST(split_part(symbol, '#', 2) AS BIGINT) AS trial_id, * EXCLUDE (symbol) FROM su),
sw AS (SELECT t.sym AS symbol, t.* EXCLUDE (sym), CAST(t.full_sharpe >= v.full_sharpe - 0.05 AS INT) + CAST(t.long_sharpe >= v.long_sharpe - 0.05 AS INT) + CAST(t.short_sharpe >= v.short_sharpe - 0.05 AS INT) + CAST(t.post_sharpe >= v.post_sharpe - 0.05 AS INT) AS dominance
  FROM kk t JOIN kk v ON v.sym = t.sym AND v.trial_id = -1 WHERE t.trial_id >= 0)"""


def _swept(s, d):
    bars = M.bars(s, d)
    return family.swept(bars, family.tied_grid(bars, EXITS, LOOKBACKS, BASE), carry.hysteresis(bars, PARAMS), **SPANS)


@query("sweep_grid", f"{_SWEPT} SELECT symbol, trial_id, {_COLS}, CAST(dominance AS BIGINT) AS dominance, row_number() OVER (PARTITION BY symbol ORDER BY dominance DESC, post_sharpe DESC, trial_id) AS place FROM sw")
def _(s, d):
    return shown(_swept(s, d), f"symbol trial_id {_SHOW} dominance:l place:l")


@query("sweep_flatness", f"{_SWEPT}, g AS (SELECT symbol, CAST([4, 6, 8][1 + trial_id % 3] AS BIGINT) AS lookback, max(post_sharpe) - min(post_sharpe) AS gap FROM sw GROUP BY 1, 2) SELECT symbol, lookback, round(gap, 6) AS gap, CASE WHEN gap < 1 THEN 'FLAT' WHEN gap > 2 THEN 'KNIFE-EDGE' ELSE 'MODERATE' END AS verdict FROM g")
def _(s, d):
    return shown(family.flatness(_swept(s, d)).withColumnRenamed("compression_lookback", "lookback"), "symbol lookback:l gap:6 verdict")


_OLD = [(i, n, x, y) for i, (n, x, y) in enumerate((n, x, y) for n in (4, 6, 8) for x in (1e-6, 4e-6) for y in (2e-6, 8e-6))]
#: The plan of this entry stands with the other sweeps; its SQL folds a settlement at a time.
ORACLES["sweep_curves"] = f"""WITH RECURSIVE {_SV}, {_machines(_OLD)}, {_SERIES}{_TAIL}
SELECT split_part(symbol, '#', 1) AS symbol, CAST(split_part(symbol, '#', 2) AS BIGINT) AS trial_id, round({_SR.format("")}, 6) AS sharpe, round(arg_max(equity, time), 6) AS final_equity FROM e GROUP BY symbol"""


@query("family_gate", f"WITH {S}{_TAIL}, {_SUM} SELECT symbol, {_COLS}, su.full_sharpe >= 0 AND su.long_sharpe >= 0 AND su.post_sharpe >= 0 AND su.max_dd >= -0.3 AS clears FROM su")
def _(s, d):
    return shown(family.gated(family.summary(M.states(s, d), ["symbol"], **SPANS)), f"symbol {_SHOW} clears")


_BOTH = f"""WITH RECURSIVE {_SV}, {_machines(_GRID[4:5])},
s AS (SELECT b.symbol || '#v3' AS symbol, b.open_time, spot_ret, perp_ret, funding_rate, rr.regime_state FROM b JOIN rr ON rr.symbol = b.symbol AND rr.open_time = b.open_time
  UNION ALL SELECT symbol || '#v2', open_time, spot_ret, perp_ret, funding_rate, regime_state FROM sv){_TAIL}, {_SUM}"""


@query("variants_compared", f"{_BOTH} SELECT split_part(symbol, '#', 2) AS variant, split_part(symbol, '#', 1) AS symbol, {_COLS} FROM su")
def _(s, d):
    bars = M.bars(s, d)
    one = family.tied_grid(bars, EXITS, LOOKBACKS, BASE).where("trial_id = 4")
    return shown(family.compared({"v2": carry.hysteresis(bars, PARAMS), "v3": carry.ratchet(bars, one)}, **SPANS), f"variant symbol {_SHOW}")


# --- stored and streamed rows ---------------------------------------------------------------------------------------------------------------


@query("decode_bars", "SELECT event_type AS symbol, epoch_us(ts) // 1000000 AS open_time, CASE WHEN event_id % 97 <> 0 THEN round(value, 6) END AS close, CASE WHEN event_id % 89 <> 0 THEN event_id END AS trades FROM events")
def _(s, d):
    from quantloom.sources.archive import decode_klines

    text, ms = F.col("value").cast("string"), F.unix_millis("ts").cast("string")
    close, trades = F.when(F.col("event_id") % 97 == 0, "oops").otherwise(text), F.when(F.col("event_id") % 89 == 0, "").otherwise(F.col("event_id").cast("string"))
    raw = A.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.lit("spot").alias("market"), F.array(ms, text, text, text, close, text, ms, text, trades, text, text, F.lit("0")).alias("row"))
    return shown(decode_klines(raw, "table", datetime(2024, 2, 1, tzinfo=UTC)), "symbol open_time:t close:6 trades")


@query(
    "closed_bars",
    f"""WITH {K}, v AS (SELECT symbol, market, open_time, close_time, close, TIMESTAMP '2024-01-15 12:30:00' AS seen_at FROM k UNION ALL SELECT symbol, market, open_time, close_time, close + 1, TIMESTAMP '2024-01-20 00:30:00' FROM k WHERE market = 'spot')
SELECT symbol, market, {T.format('open_time')} AS open_time, round(close, 6) AS close FROM v WHERE close_time < seen_at QUALIFY row_number() OVER (PARTITION BY symbol, market, open_time ORDER BY seen_at DESC) = 1""",
)
def _(s, d):
    from quantloom.sources.archive import closed_bars

    k = A.klines(s, d).drop("ingested_at")
    seen = lambda df, at: df.withColumn("ingested_at", F.lit(at).cast("timestamp"))
    both = seen(k, "2024-01-15 12:30:00").unionByName(seen(k.where("market = 'spot'").withColumn("close", F.col("close") + 1), "2024-01-20 00:30:00"))
    return shown(closed_bars(both), "symbol market open_time:t close:6")


@query("event_log", "SELECT event_id, CASE WHEN value > 50 THEN 'mark' ELSE 'funding' END AS kind, epoch_us(ts) // 1000000 AS time, event_type AS symbol FROM events WHERE event_id % 50 <> 0 AND event_id % 31 <> 0")
def _(s, d):
    from quantloom.streaming.events import parsed

    kind = F.when(F.col("event_id") % 31 == 0, "nonsense").when(F.col("value") > 50, "mark").otherwise("funding")
    e = A.table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), kind.alias("kind"), F.col("ts").alias("time"), F.lit("1").alias("version"), F.col("event_type").alias("symbol"), F.lit("{}").alias("payload"))).alias("line"))
    lines = e.select(F.when(F.col("event_id") % 50 == 0, F.substring("line", 1, 20)).otherwise(F.col("line")).alias("value"))
    return shown(parsed(lines), "event_id:l kind time:t symbol")


_READ = "rd AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS time, round(avg(value), 9) AS level FROM events GROUP BY 1, 2)"


@query(
    "halts",
    f"""WITH {_READ}, h AS (SELECT symbol, time, sum(CAST(level > 52 AS INT)) OVER w3 = 3 AS a, sum(CAST(level < 45 AS INT)) OVER w2 = 2 AS b FROM rd WINDOW w3 AS (PARTITION BY symbol ORDER BY time ROWS 2 PRECEDING), w2 AS (PARTITION BY symbol ORDER BY time ROWS 1 PRECEDING)),
f AS (SELECT symbol, time, a AND NOT coalesce(lag(a) OVER w, false) AS a, b AND NOT coalesce(lag(b) OVER w, false) AS b FROM h WINDOW w AS (PARTITION BY symbol ORDER BY time))
SELECT symbol, {T.format('time')} AS time, 'P1' AS priority FROM f WHERE a UNION ALL SELECT symbol, {T.format('time')}, 'P3' FROM f WHERE b""",
)
def _(s, d):
    from quantloom.streaming.events import halts

    e = A.table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time")).agg(F.round(F.avg("value"), 9).alias("level"))
    return shown(halts(e, {"P1": (F.col("level") > 52, 3), "P3": (F.col("level") < 45, 2)}), "symbol time:t priority")


@query(
    "daily_reconcile",
    f"""WITH {E}, x AS (SELECT date_trunc('day', time) AS day, exp(sum(ln(1 + r))) - 1 AS a, exp(sum(ln(1 + r * 1.5e0 + 1e-6))) - 1 AS b, exp(sum(ln(1 + r * 1.5e0))) - 1 AS c FROM e WHERE symbol = 'click' GROUP BY 1)
SELECT {T.format('day')} AS day, round(a, 9) AS a, round(b, 9) AS b, round(CASE WHEN abs(b) > 0 THEN (a - b) / abs(b) END, 5) AS tracking_error, round(c - b, 9) AS correction_effect FROM x""",
)
def _(s, d):
    from quantloom.streaming.events import daily_reconcile

    c = M.curve(s, d).where("symbol = 'click'").select("time", F.col("period_ret_net").alias("ret"))
    return shown(daily_reconcile(c, c.withColumn("ret", F.col("ret") * 1.5 + 1e-6), c.withColumn("ret", F.col("ret") * 1.5)), "day:t a:9 b:9 tracking_error:5 correction_effect:9")


@query("monotonic_breaks", "SELECT symbol, count(*) FILTER (WHERE x) AS breaks FROM (SELECT event_type AS symbol, ts <= lag(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS x FROM events) GROUP BY symbol")
def _(s, d):
    e = A.table(s, d, "events").withColumnRenamed("event_type", "symbol")
    return windows.monotonic_breaks(e, ["symbol"], "ts", ["user_id", "event_id"])


@query(
    "benchmark_returns",
    f"""WITH {K}, x AS (SELECT open_time, close / lag(close) OVER (ORDER BY open_time) - 1 AS r FROM k WHERE symbol = 'click' AND market = 'spot' AND open_time BETWEEN TIMESTAMP '2024-01-03 05:00:00' AND TIMESTAMP '2024-01-25 00:00:00')
SELECT {T.format("date_trunc('day', open_time)")} AS time, round(exp(sum(ln(1 + r))) - 1, 10) AS ret FROM x WHERE r IS NOT NULL GROUP BY date_trunc('day', open_time)""",
)
def _(s, d):
    return shown(regimes.benchmark_returns(A.klines(s, d), "click", datetime(2024, 1, 3, 5, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC)), "time:t ret:10")


@query("resample_4h", f"WITH {E}, x AS (SELECT symbol, make_timestamp((epoch_us(time) // 14400000000) * 14400000000) AS period, arg_max(equity, time) AS equity, exp(sum(ln(1 + r))) - 1 AS ret FROM e GROUP BY 1, 2) SELECT symbol, {T.format('period')} AS period, round(equity, 6) AS equity, round(ret, 9) AS ret FROM x")
def _(s, d):
    return shown(metrics.resampled(M.curve(s, d), "4h"), "symbol period:t equity:6 ret:9")


_GATES = [("trend", "bull"), ("trend", "bear"), ("etf", "pre_etf"), ("etf", "post_etf")]


@query(
    "verdicts_judged",
    """WITH ru AS (SELECT 'r' || o_orderkey AS run_id, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 100) / 100e0 END AS lo, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 70) / 100e0 END AS pbo, -(o_orderkey % 40) / 100e0 AS dd FROM orders),
g AS (SELECT run_id, lo, pbo, dd, j, CASE WHEN (k + j) % 7 <> 0 THEN ((k * (j + 1)) % 20 - 2) / 10e0 END AS sr FROM ru CROSS JOIN (SELECT unnest(range(0, 4)) AS j))
SELECT run_id, CASE WHEN any_value(b) + count(*) FILTER (WHERE sr < 0) > 0 THEN 'fail' ELSE 'pass' END AS verdict, CAST(any_value(b) + count(*) FILTER (WHERE sr < 0) AS BIGINT) AS n_blocking, count(*) FILTER (WHERE sr IS NULL) AS n_missing
FROM (SELECT *, CAST(NOT coalesce(lo > 0.5, false) AS INT) + CAST(coalesce(pbo > 0.5, false) AS INT) + CAST(dd < -0.3 AS INT) AS b FROM g) GROUP BY run_id""",
)
def _(s, d):
    from quantloom.plans.registry import judged

    k = F.col("o_orderkey")
    ru = A.table(s, d, "orders").select(F.concat(F.lit("r"), k).alias("run_id"), k.alias("k"), F.when(k % 9 != 0, (k % 100) / 100).alias("dsr_lo"), F.when(k % 3 != 0, (k % 70) / 100).alias("pbo"), (-(k % 40) / 100).alias("max_dd"))
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("regime_kind"), F.lit(b).alias("regime_label")) for j, (a, b) in enumerate(_GATES)])
    strata = ru.select("run_id", "k", F.inline(each)).where("(k + j) % 7 <> 0").select("run_id", "regime_kind", "regime_label", (((F.col("k") * (F.col("j") + 1)) % 20 - 2) / 10).alias("sharpe"))
    return judged(ru, strata).select("run_id", "verdict", F.size("blocking").cast("long").alias("n_blocking"), F.size("missing").cast("long").alias("n_missing"))

"""One validated run, end to end: register, backtest, check, persist, grade, deflate, judge."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.functions import metrics
from quantloom.operators import carry, regimes, significance, windows
from quantloom.plans import registry as R
from quantloom.sources import archive

YEAR_US = 365 * 86400 * 1_000_000
CODE_VERSION = "1"


@dataclass(frozen=True)
class Artifacts:
    """What a strategy gives: bars with states, costed legs, attribution, the equity curve."""

    bars: DataFrame
    legs: DataFrame
    contrib: DataFrame
    curve: DataFrame


@dataclass
class Report:
    run_id: str
    verdict: str
    metrics: dict = field(default_factory=dict)
    regimes: list[dict] = field(default_factory=list)
    dsr: tuple[float, float, float] = (float("nan"),) * 3
    blocking: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def backtest(klines: DataFrame, funding: DataFrame, p: carry.CarryParams | carry.RatchetParams, *, fee_tier: str = "regular", slippage=carry.zero_slippage) -> Artifacts:
    """Either variant over every symbol of the inputs; empty inputs give empty frames of the same columns."""
    bars = carry.assemble(klines, funding)
    if isinstance(p, carry.RatchetParams):
        spark = klines.sparkSession
        trial = spark.createDataFrame([(0, *p.as_dict().values())], "trial_id long, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in p.as_dict().items()))
        told = carry.ratchet(bars, trial).drop("trial_id", *p.as_dict())
    else:
        told = carry.hysteresis(bars, p)
    legs = carry.costs(carry.legs(told, p.capital_per_leg), fee_tier, slippage)
    return Artifacts(told, legs, carry.contributions(legs, p.capital_per_leg), carry.equity(legs, p.capital_per_leg))


def graded(a: Artifacts, ppy: float, adv: DataFrame | None) -> dict:
    """The metric bundle of a one-symbol run, in one aggregation for the returns and one each for what has another shape."""
    r, k = "period_ret_net", ["symbol"]
    active = a.legs.groupBy("symbol", "time").agg((F.max("notional") > 0).alias("active"))
    c = a.curve.join(active, ["symbol", "time"], "left").withColumn("dd", windows.drawdown("equity", k, "time")).withColumn("on", F.when(F.col("active"), F.col(r)))
    row = c.groupBy("symbol").agg(
        F.count("*").alias("n_obs"), metrics.sharpe(r, ppy).alias("sharpe"), metrics.sharpe("on", ppy).alias("active_only_sharpe"), metrics.sortino(r, ppy).alias("sortino"),
        F.min("dd").alias("max_dd"), metrics.hit_rate(r).alias("hit_rate"), metrics.profit_factor(r).alias("profit_factor"), metrics.skew(r).alias("skew"), metrics.kurtosis(r).alias("kurtosis"),
        metrics.value_at_risk(r).alias("var_5pct"),
    ).first().asDict()
    book = a.legs.withColumn("run", F.lit("r"))
    one = lambda df, name: (x := df.first()) and x[name]
    row |= {
        "cvar_5pct": one(metrics.expected_shortfall(a.curve, r, k), "cvar"),
        "calmar": one(metrics.calmar(a.curve, "equity", k, "time", ppy), "calmar"),
        "max_dd_duration_days": one(windows.longest_drawdown(a.curve, "equity", k, "time"), "days"),
        "turnover_per_year": one(metrics.turnover_per_year(book, a.curve.withColumn("run", F.lit("r")), ["run"], ppy), "turnover"),
        "capacity_estimate_usd": one(metrics.capacity(book, adv, ["run"]), "capacity") if adv is not None else None,
        "n_transitions": one(carry.transitions(a.bars), "n_transitions"),
        "periods_per_year": ppy,
    }
    return {n: v for n, v in row.items() if n != "symbol"}


def _persist(a: Artifacts, run_id: str, strategy: str, root: str) -> None:
    for name, df, schema in (("leg", a.legs, schemas.BACKTEST_LEG), ("contrib", a.contrib, schemas.PER_SYMBOL_CONTRIB), ("equity", a.curve, schemas.EQUITY_CURVE)):
        out = schemas.conform(df.withColumn("run_id", F.lit(run_id)), schema).withColumn("strategy", F.lit(strategy))
        archive.replace_run(out, f"{root}/backtests/{name}")


def _write_header(spark: SparkSession, a: Artifacts, run_id: str, strategy: str, variant: str, p, universe: list[str], archive_state: dict, root: str) -> None:
    """One row about the run; writing it again replaces it.  Times are null for an empty curve."""
    seen = a.curve.agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n_bars"))
    fixed = {
        "run_id": run_id, "strategy_id": strategy, "variant": variant, "params_json": R.params_json(p.as_dict()), "params_hash": R.params_hash(p.as_dict()), "universe_json": json.dumps(universe),
        "data_version": archive_state["data_version"], "archive_max_kline_time": archive_state.get("archive_max_kline_time"), "qc_audit_run_ts": archive_state.get("qc_audit_run_ts"), "engine_version": CODE_VERSION,
    }
    out = seen.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("computed_at", F.current_timestamp())
    archive.replace_run(schemas.conform(out, schemas.BACKTEST_RESULT).withColumn("strategy", F.lit(strategy)), f"{root}/backtests/result")


def read_run(spark: SparkSession, root: str, run_id: str, table: str = "equity") -> DataFrame:
    """What a run has persisted: its equity, leg, contrib or result rows; empty for a run that has none."""
    schema = {"equity": schemas.EQUITY_CURVE, "leg": schemas.BACKTEST_LEG, "contrib": schemas.PER_SYMBOL_CONTRIB, "result": schemas.BACKTEST_RESULT}[table]
    if not archive._exists(spark, path := f"{root}/backtests/{table}"):
        return spark.createDataFrame([], schema)
    return schemas.conform(spark.read.parquet(path).where(F.col("run") == run_id), schema)


def run(
    spark: SparkSession, symbol: str, variant: str, p: carry.CarryParams | carry.RatchetParams, *, klines: DataFrame, funding: DataFrame, benchmark: DataFrame, root: str, archive_state: dict,
    adv: DataFrame | None = None, strategy: str | None = None, fee_tier: str = "regular", slippage=carry.zero_slippage, split: str = "full", n_bootstrap: int = 1000, pbo: float | None = None,
    plan: Callable[..., Artifacts] = backtest, state: str | Path | None = None,
) -> Report:
    """A run of one symbol.  benchmark: time, ret for the regimes.  root: a folder of any file system that Spark writes; state: the driver's
    folder of the ledgers, needed where root is not a local one.  A failure marks the run failed and is raised again; fewer than two
    bars are validated as a fail for want of data and are not logged as a trial."""
    strategy = strategy or f"carry_{variant}_{symbol}"
    if state is None and "://" in root and not root.startswith("file://"):
        raise ValueError("root is not a local folder: say where the ledgers lie (state)")
    ledger = R.Registry(Path(state) if state else Path(root.removeprefix("file://")) / "state")
    run_id = ledger.register(strategy, variant, p.as_dict(), archive_state)
    try:
        a = plan(klines.where(F.col("symbol") == symbol), funding.where(F.col("symbol") == symbol), p, fee_tier=fee_tier, slippage=slippage)
        a = Artifacts(a.bars, a.legs.persist(), a.contrib, a.curve.persist())
        carry.checked_curve(schemas.conform(a.curve.withColumn("run_id", F.lit(run_id)), schemas.EQUITY_CURVE))
        _persist(a, run_id, strategy, root)
        _write_header(spark, a, run_id, strategy, variant, p, [symbol], archive_state, root)
    except Exception:
        ledger.transition(run_id, schemas.RUNNING, schemas.FAILED)
        raise
    try:
        report = _grade(spark, a, ledger, run_id, strategy, p, benchmark, archive_state, adv, split, n_bootstrap, pbo, root)
    finally:
        a.legs.unpersist()
        a.curve.unpersist()
    return report


def _grade(spark, a, ledger, run_id, strategy, p, benchmark, archive_state, adv, split, n_bootstrap, pbo, root) -> Report:
    n = a.curve.count()
    if n < 2:
        ledger.transition(run_id, schemas.RUNNING, schemas.COMPLETE)
        ledger.transition(run_id, schemas.COMPLETE, schemas.VALIDATED, verdict="fail", metrics={"reason": "insufficient_data", "n_obs": n})
        return Report(run_id, "fail", {"n_obs": n}, blocking=["insufficient_data"])
    gap = windows.modal_gap(a.curve, ["symbol"], "time").first()["gap_us"]
    if gap is None:
        raise R.AmbiguousPeriodicityError("the curve's period is ambiguous")
    ppy = YEAR_US / gap
    found = graded(a, ppy, adv)
    ledger.log_trial(strategy, p.as_dict(), data_version=archive_state["data_version"], split=split, realized_sharpe=float("nan") if found["sharpe"] is None else found["sharpe"], n_obs=n)
    n_trials = ledger.count_trials(strategy, archive_state["data_version"])
    labels = regimes.classify(benchmark.withColumn("b", F.lit(0)), ["b"]).drop("b")
    strata = regimes.stratify(a.curve.withColumn("run_id", F.lit(run_id)), labels, ["run_id"], ppy)
    rows = [r.asDict() for r in strata.collect()]  # at most seven
    if rows:
        schemas.conform(spark.createDataFrame(rows, strata.schema), schemas.REGIME_METRICS).write.mode("overwrite").parquet(f"{root}/backtests/regimes/strategy={strategy}/run={run_id}")
    returns = np.array([r["period_ret_net"] for r in a.curve.orderBy("time").select("period_ret_net").collect()])  # one curve; the bootstrap bounds it
    dsr = significance.interval(spark, returns, run_id, n_trials=n_trials, n_bootstrap=n_bootstrap)
    verdict, blocking, missing = R.verdict(found, {(r["regime_kind"], r["regime_label"]): r["sharpe"] for r in rows}, dsr[1], pbo)
    ledger.transition(run_id, schemas.RUNNING, schemas.COMPLETE)
    drift = ledger.check_corrections(run_id, archive_state["data_version"])
    summary = found | {"dsr": dsr[0], "dsr_ci_lower": dsr[1], "dsr_ci_upper": dsr[2], "pbo": pbo, "code_version": CODE_VERSION}
    ledger.transition(run_id, schemas.COMPLETE, schemas.VALIDATED, verdict=verdict, metrics=summary, corrections=drift)
    return Report(run_id, verdict, found, rows, dsr, blocking, missing)

"""Runs and trials: small ledgers on the driver under locks, and the set-based questions asked of them.

A ledger is a Parquet file that is rewritten whole and replaced by a rename; it holds one row per run or trial, thousands at most."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.operators import windows
from quantloom.sources.archive import Lock

# Status changes that are allowed, and the gates of a verdict.
ALLOWED = {("running", "complete"), ("running", "failed"), ("complete", "validated"), ("complete", "failed"), ("failed", "running")}
GATE_DSR, GATE_PBO, GATE_MAX_DD, GATE_REGIME = 0.5, 0.5, 0.30, 0.0
REGIME_GATES = [("trend", "bull"), ("trend", "bear"), ("etf", "pre_etf"), ("etf", "post_etf")]


class StaleStatusError(RuntimeError):
    """The run is not in the state that the caller thought."""


class TrialMismatchError(RuntimeError):
    """A trial was logged before with another result."""


class AmbiguousPeriodicityError(ValueError):
    """A curve without one most frequent period."""


class FrequencyMismatchError(ValueError):
    """Curves of different periods cannot share a panel."""


#: What is left of a backtest's Sharpe ratio ahead: a decision of sizing, which no gate reads.
HAIRCUT = (0.30, 0.50)


def forward_sharpe(sharpe: float | None) -> tuple[float, float] | None:
    """The span in which a backtest's ratio is expected to lie ahead; the smaller first, also of a negative one."""
    return None if sharpe is None else tuple(sorted((sharpe * HAIRCUT[0], sharpe * HAIRCUT[1])))


def alpha_document(runs: pd.DataFrame, caveats: dict[str, list[str]] | None = None) -> dict:
    """A record for each strategy's latest validated run: status, gates, what is expected ahead, and stated caveats.  For people to read and keep."""
    out = {}
    for r in runs[runs["status"] == schemas.VALIDATED].sort_values("registered_at").to_dict("records"):
        m = json.loads(r["metrics_summary_json"]) if isinstance(r["metrics_summary_json"], str) else {}
        notes = (caveats or {}).get(r["strategy_id"], [])
        status = "fail" if r["verdict"] != "pass" else "pass-with-caveats" if notes else "pass"
        out[r["strategy_id"]] = {"run_id": r["run_id"], "variant": r["variant"], "status": status, "data_version": r["data_version"], "metrics": m, "forward_sharpe": forward_sharpe(m.get("sharpe")), "caveats": notes}
    return out


# --- canonical parameters -----------------------------------------------------------------------------------------------------------------


def canonical(value: object) -> object:
    """Numbers as floats, keys as sorted strings; NaN, infinities and tuples are refused, as they would not come back the same."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return float(value)
    if isinstance(value, list):
        return [canonical(v) for v in value]
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be strings")
        return {k: canonical(value[k]) for k in sorted(value)}
    raise TypeError(f"no canonical form: {type(value).__name__}")


def params_json(params: dict) -> str:
    return json.dumps(canonical(params), sort_keys=True, separators=(",", ":"), allow_nan=False)


def params_hash(params: dict) -> str:
    return hashlib.sha256(params_json(params).encode()).hexdigest()


def sanitised(value: object) -> object:
    """For JSON: NaN and infinities as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): sanitised(v) for k, v in value.items()}
    return [sanitised(v) for v in value] if isinstance(value, (list, tuple)) else value


# --- ledgers --------------------------------------------------------------------------------------------------------------------------------


class Registry:
    """Run and trial ledgers under one folder."""

    def __init__(self, root: str | Path, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        self.root, self.now = Path(root), now

    def _read(self, path: Path, columns: list[str]) -> pd.DataFrame:
        return pd.read_parquet(path) if path.exists() else pd.DataFrame({c: pd.Series(dtype="object") for c in columns})

    def _write(self, df: pd.DataFrame, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{os.getpid()}.{uuid.uuid4().hex[:6]}")
        df.to_parquet(part, index=False)
        os.replace(part, path)

    @property
    def _runs(self) -> Path:
        return self.root / "registry" / "runs.parquet"

    def _trials(self, strategy: str) -> Path:
        return self.root / "trial_log" / f"strategy={strategy}" / "trials.parquet"

    def _lock(self, path: Path) -> Lock:
        return Lock(path.with_suffix(".lock"))

    def runs(self) -> pd.DataFrame:
        return self._read(self._runs, schemas.RUN_REGISTRY.names)

    def register(self, strategy: str, variant: str, params: dict, archive_state: dict) -> str:
        row = dict.fromkeys(schemas.RUN_REGISTRY.names) | {
            "run_id": str(uuid.uuid4()), "strategy_id": strategy, "variant": variant, "params_hash": params_hash(params), "data_version": archive_state["data_version"],
            "archive_max_kline_time": archive_state.get("archive_max_kline_time"), "registered_at": self.now(), "status": schemas.RUNNING, "corrections_diff_status": "clean",
        }
        with self._lock(self._runs):
            df = self.runs()
            self._write(pd.concat([df, pd.DataFrame([row])], ignore_index=True) if len(df) else pd.DataFrame([row]), self._runs)
        return row["run_id"]

    def get(self, run_id: str) -> dict:
        df = self.runs()
        found = df[df["run_id"] == run_id]
        if found.empty:
            raise KeyError(run_id)
        return found.iloc[0].to_dict()

    def transition(self, run_id: str, before: str, after: str, *, verdict: str | None = None, metrics: dict | None = None, corrections: str | None = None) -> None:
        """Compare and set, under the lock.  Metrics and verdict come with complete -> validated only."""
        if (before, after) not in ALLOWED:
            raise ValueError(f"not allowed: {before} -> {after}")
        if (metrics is not None or verdict is not None) and (before, after) != (schemas.COMPLETE, schemas.VALIDATED):
            raise ValueError("metrics and verdict come with validation")
        with self._lock(self._runs):
            df = self.runs()
            at = df.index[df["run_id"] == run_id]
            if not len(at):
                raise KeyError(run_id)
            if (seen := df.at[at[0], "status"]) != before:
                raise StaleStatusError(f"{run_id} is {seen}, not {before}")
            change = {"status": after, "verdict": verdict, "metrics_summary_json": None if metrics is None else json.dumps(sanitised(metrics), sort_keys=True), "corrections_diff_status": corrections}
            for c, v in change.items():
                if v is not None:
                    df[c] = df[c].astype("object")
                    df.at[at[0], c] = v
            self._write(df, self._runs)

    def check_corrections(self, run_id: str, now_version: str) -> str:
        """dirty if the archive's correction files are no longer those of the run."""
        mark = lambda v: v.rpartition("+")[2]
        return "clean" if mark(self.get(run_id)["data_version"]) == mark(now_version) else "dirty"

    def log_trial(self, strategy: str, params: dict, *, data_version: str, split: str, realized_sharpe: float, n_obs: int, overwrite: bool = False, tol: float = 1e-9) -> int:
        """The trial's number.  The same result again changes nothing; another is refused, or replaces the row under its old number."""
        if split not in schemas.SPLITS:
            raise ValueError(f"unknown split: {split}")
        path, h = self._trials(strategy), params_hash(params)
        with self._lock(path):
            df = self._read(path, schemas.TRIAL_LOG.names)
            same = df[(df["params_hash"] == h) & (df["data_version"] == data_version) & (df["split"] == split)]
            number = int(df["trial_id"].max()) + 1 if len(df) else 1
            if len(same):
                old = same.iloc[0]
                number = int(old["trial_id"])
                close = abs(old["realized_sharpe"] - realized_sharpe) <= tol or math.isnan(old["realized_sharpe"]) and math.isnan(realized_sharpe)
                if close and not overwrite:
                    return number
                if not close and not overwrite:
                    raise TrialMismatchError(f"{strategy} {h[:8]}: {old['realized_sharpe']} before, {realized_sharpe} now")
                df = df.drop(same.index)
            row = {"strategy_id": strategy, "trial_id": number, "params_hash": h, "params_json": params_json(params), "evaluated_at": self.now(), "data_version": data_version, "split": split, "realized_sharpe": realized_sharpe, "n_obs": n_obs}
            self._write(pd.concat([df, pd.DataFrame([row])], ignore_index=True) if len(df) else pd.DataFrame([row]), path)
        return number

    def trials(self, strategy: str, data_version: str | None = None) -> pd.DataFrame:
        df = self._read(self._trials(strategy), schemas.TRIAL_LOG.names)
        return df if data_version is None else df[df["data_version"] == data_version]

    def count_trials(self, strategy: str, data_version: str | None = None) -> int:
        """Distinct parameter sets; exact, as it enters the deflation."""
        return int(self.trials(strategy, data_version)["params_hash"].nunique())

    def frame(self, spark: SparkSession) -> DataFrame:
        if not self._runs.exists():
            return spark.createDataFrame([], schemas.RUN_REGISTRY)
        return spark.createDataFrame(self.runs().astype("object").where(lambda d: d.notna(), None).values.tolist(), schemas.RUN_REGISTRY)


# --- set-based questions ----------------------------------------------------------------------------------------------------------------------


def validated(runs: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The latest validated, clean run of each strategy whose metrics lie within limits; a metric that is asked for but null excludes."""
    x = runs.where("status = 'validated' and corrections_diff_status = 'clean'")
    for name, (low, high) in limits.items():
        v = F.get_json_object("metrics_summary_json", f"$.{name}").cast("double")
        x = x.where(v.isNotNull())
        x = x if low is None else x.where(v >= low)
        x = x if high is None else x.where(v <= high)
    return windows.latest(x, ["strategy_id"], [F.desc("registered_at"), F.desc("run_id")])


def oos_panel(curves: DataFrame) -> DataFrame:
    """alpha_id, time, oos_ret, alpha_active: every strategy at every time that any has; 0 and inactive where it has none.

    curves: alpha_id, time, ret, active.  The strategies are a short list, so each time is expanded by it in place."""
    names = sorted(r["alpha_id"] for r in curves.select("alpha_id").distinct().collect())
    grid = curves.select("time").distinct().select("time", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("alpha_id"))
    out = grid.join(curves, ["alpha_id", "time"], "left")
    return out.select("alpha_id", "time", F.coalesce("ret", F.lit(0.0)).alias("oos_ret"), F.coalesce("active", F.lit(False)).alias("alpha_active"))


def named_panel(runs: DataFrame, curves: DataFrame, names: list[str]) -> DataFrame:
    """checked_panel of the latest validated, clean run of each named strategy; curves: run_id, time, period_ret_net.  A name twice, one
    without such a run, and a run without a curve are refused; no names give an empty panel."""
    if len(names) != len(set(names)):
        raise ValueError(f"named twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
    chosen = validated(runs.where(F.col("strategy_id").isin(names)), {}).select(F.col("strategy_id").alias("alpha_id"), "run_id")
    known = {r["alpha_id"] for r in chosen.collect()}  # as many as names at most
    if absent := [n for n in names if n not in known]:
        raise ValueError(f"no validated run: {absent}")
    found = curves.join(chosen, "run_id").select("alpha_id", "time", F.col("period_ret_net").alias("ret"), F.lit(True).alias("active"))
    if empty := [n for n in names if n not in {r["alpha_id"] for r in found.select("alpha_id").distinct().collect()}]:
        raise ValueError(f"no curve: {empty}")
    return schemas.conform(checked_panel(found) if names else oos_panel(found), schemas.OOS_RETURNS_PANEL)


def checked_panel(curves: DataFrame) -> DataFrame:
    """oos_panel of curves that all have the same period."""
    gaps = [r["gap_us"] for r in windows.modal_gap(curves, ["alpha_id"], "time").select("gap_us").distinct().collect()]
    if len(gaps) > 1 or gaps == [None]:
        raise FrequencyMismatchError(f"periods differ or are ambiguous: {gaps}")
    return oos_panel(curves)


def verdict_column(dsr_lo: Column, pbo: Column, max_dd: Column) -> Column:
    """The gates that need no regimes, over many runs at once."""
    ok = (dsr_lo > GATE_DSR) & ~F.isnan(dsr_lo) & (F.coalesce(pbo, F.lit(0.0)) <= GATE_PBO) & (max_dd >= -GATE_MAX_DD)
    return F.when(ok, "pass").otherwise("fail")


def judged(runs: DataFrame, strata: DataFrame) -> DataFrame:
    """run_id, verdict, blocking, missing of many runs at once, by the same gates as verdict().  runs: run_id, dsr_lo, pbo, max_dd; strata: run_id,
    regime_kind, regime_label, sharpe."""
    names = F.concat("regime_kind", F.lit(":"), "regime_label")
    seen = strata.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(names, "sharpe"))).alias("by"), F.collect_set(names).alias("there"))  # a run has seven regimes at most
    x = runs.join(seen, "run_id", "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
    clear = lambda c: F.coalesce(c, F.lit(False))
    gates = [
        F.when(~clear((F.col("dsr_lo") > GATE_DSR) & ~F.isnan("dsr_lo")), F.lit("dsr_ci_lower")), F.when(clear(F.col("pbo") > GATE_PBO), F.lit("pbo")),
        F.when(~clear((F.col("max_dd") >= -GATE_MAX_DD) & ~F.isnan("max_dd")), F.lit("max_dd")),
    ]
    for kind, label in REGIME_GATES:
        sr = F.col("by")[f"{kind}:{label}"]
        gates.append(F.when(F.array_contains("there", f"{kind}:{label}") & ~clear((sr >= GATE_REGIME) & ~F.isnan(sr)), F.lit(f"regime_sharpe_negative:{label}")))
    blocking = F.array_compact(F.array(*gates))
    missing = F.array_compact(F.array(*[F.when(~F.array_contains("there", f"{k}:{n}"), F.lit(f"regime_absent:{n}")) for k, n in REGIME_GATES]))
    return x.select("run_id", F.when(F.size(blocking) > 0, "fail").otherwise("pass").alias("verdict"), blocking.alias("blocking"), missing.alias("missing"))


def verdict(metrics: dict, regimes: dict[tuple[str, str], float], dsr_lo: float, pbo: float | None) -> tuple[str, list[str], list[str]]:
    """pass or fail, what blocks, and what is only missing; regimes: (kind, label) -> Sharpe."""
    blocking, missing = [], []
    if not dsr_lo > GATE_DSR:
        blocking.append(f"dsr_ci_lower={dsr_lo:.4f} not > {GATE_DSR}")
    if pbo is not None and pbo > GATE_PBO:
        blocking.append(f"pbo={pbo:.4f} > {GATE_PBO}")
    dd = metrics.get("max_dd")
    if dd is None or not dd >= -GATE_MAX_DD:
        blocking.append(f"max_dd={dd} below -{GATE_MAX_DD} or undefined")
    for kind, label in REGIME_GATES:
        if (kind, label) not in regimes:
            missing.append(f"regime_absent:{label}")
        elif not (regimes[kind, label] is not None and regimes[kind, label] >= GATE_REGIME):
            blocking.append(f"regime_sharpe_negative:{label}={regimes[kind, label]}")
    return ("fail" if blocking else "pass"), blocking, missing

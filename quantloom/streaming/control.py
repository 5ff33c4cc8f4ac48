"""What the paper and live pipelines do around a strategy: halts that must be sustained and re-armed, their actions, and the interface by which
a strategy is plugged in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators import windows
from quantloom.operators.carry import Ratchet, RatchetParams
from quantloom.streaming.events import PRIORITIES

# What each priority does in either mode.
ACTIONS = {
    "paper": {"P0": "flat_exit", "P1": "flat_exit_dump", "P2": "alert", "P3": "alert", "P4": "alert", "P5": "log_maintain"},
    "live": {"P0": "flat_cancel_exit", "P1": "flat_cancel_exit_dump_alert", "P2": "flat", "P3": "flat", "P4": "flat", "P5": "log_maintain"},
}


@dataclass(frozen=True)
class Rule:
    """A trigger that must hold for `sustained` readings in a row, and what must hold for `calm` readings before it is armed again."""

    priority: str
    breach: Column
    sustained: int
    clear: Column
    calm: int

    def __post_init__(self) -> None:
        if self.priority not in PRIORITIES or min(self.sustained, self.calm) < 1:
            raise ValueError(f"not a rule: {self.priority}, {self.sustained}, {self.calm}")


def held(readings: DataFrame, rules: list[Rule], mode: str, keys: list[str] = ["symbol"]) -> DataFrame:
    """keys, time, priority, change (halt or resume), action: where a rule's halt begins and where it is armed again.

    A run of breaches that is broken before `sustained` counts from the start; while a halt lasts, further breaches change nothing.  The
    state is the last of sustained breach and sustained calm (a breach wins a tie), so no fold is needed.  Action: of the mode; null for a
    resume."""
    if mode not in ACTIONS:
        raise ValueError(f"paper or live, not {mode}")
    w, out = windows.over(keys, "time"), None
    for rule in rules:
        def lasted(condition: Column, n: int) -> Column:
            over = w.rowsBetween(-(n - 1), 0)
            return (F.count_if(F.coalesce(condition, F.lit(False))).over(over) == n)

        told = readings.withColumn("_d", F.when(lasted(rule.breach, rule.sustained), 1).when(lasted(rule.clear, rule.calm), 0))
        told = told.withColumn("_s", F.coalesce(windows.forward_filled(F.col("_d"), keys, "time"), F.lit(0)))
        moved = told.withColumn("_b", F.coalesce(F.lag("_s").over(w), F.lit(0))).where("_s <> _b")
        change = F.when(F.col("_s") == 1, "halt").otherwise("resume")
        part = moved.select(*keys, "time", F.lit(rule.priority).alias("priority"), change.alias("change"), F.when(F.col("_s") == 1, ACTIONS[mode][rule.priority]).alias("action"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class TargetPosition:
    """What a strategy wants to hold: the state, and the notional of each leg."""

    state: int
    notional: float


class Strategy(Protocol):
    """A strategy as the pipeline sees it: how many settled rates it looks back, and what it wants after the last of them."""

    length: int

    def compute_target_position(self, window: Sequence[float]) -> TargetPosition: ...


class RatchetStrategy:
    """The ratcheted carry behind that interface; its machine remembers state and hold between calls."""

    def __init__(self, p: RatchetParams, machine: Ratchet | None = None) -> None:
        self.p, self.machine, self.length = p, machine or Ratchet(), max(p.ma_lookback, p.compression_lookback)

    def compute_target_position(self, window: Sequence[float]) -> TargetPosition:
        means = [round(sum(window[-n:]) / n, 12) if len(window) >= n else None for n in (self.p.ma_lookback, self.p.compression_lookback)]
        state = self.machine.step(*means, self.p)
        return TargetPosition(state, self.p.capital_per_leg * state)

"""The paper-trading event log: an append-only folder of JSON lines, as a stream and as a table, and what is derived from it."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import windows

# The kinds of events, and the halt priorities.
KINDS = ("start", "stop", "settlement", "target", "order", "fill", "funding", "mark", "halt", "resume")
PRIORITIES = ("P0", "P1", "P2", "P3", "P4", "P5")
SCHEMA = "event_id string, kind string, time timestamp, version string, symbol string, payload string"


def line(event_id: str, kind: str, time: datetime, version: str, symbol: str, payload: dict) -> str:
    """One line of the log."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    return json.dumps({"event_id": event_id, "kind": kind, "time": time.isoformat(), "version": version, "symbol": symbol, "payload": json.dumps(payload, sort_keys=True)}, separators=(",", ":"))


def parsed(lines: DataFrame) -> DataFrame:
    """Events of a frame of text lines; lines that are no events (such as a last one cut short) are skipped."""
    e = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    return lines.select(e.alias("e")).select("e.*").where(F.col("event_id").isNotNull() & F.col("kind").isin(*KINDS) & F.col("time").isNotNull())


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 100, late: str = "1 day") -> DataFrame:
    """The log as a stream of events, each once: repeats within the watermark are dropped, so state stays bounded."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parsed(lines).withWatermark("time", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_reconcile(paper: DataFrame, backtest: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """day, a, b, tracking_error, correction_effect: daily returns of the log against the backtest's, over the size of the latter; with a
    backtest on corrected data also what the corrections change.  Each: time, ret."""

    def daily(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.date_trunc("day", "time").alias("day")).agg(windows.compounded(F.col("ret")).alias(name))

    x = daily(paper, "a").join(daily(backtest, "b"), "day", "left")
    x = x.join(daily(corrected, "c"), "day", "left") if corrected is not None else x.withColumn("c", F.lit(None).cast("double"))
    return x.select("day", "a", "b", F.when(F.abs("b") > 0, (F.col("a") - F.col("b")) / F.abs("b")).alias("tracking_error"), (F.col("c") - F.col("b")).alias("correction_effect"))


def halts(readings: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """time, priority: where a rule's condition has held for so many readings in a row, first at the one that completes the run.

    readings: symbol, time and what the conditions read; rules: priority -> (condition, readings)."""
    w = Window.partitionBy("symbol").orderBy("time")
    out = None
    for priority, (bad, least) in sorted(rules.items()):
        if priority not in PRIORITIES:
            raise ValueError(f"unknown priority: {priority}")
        n = F.sum(bad.cast("int")).over(w.rowsBetween(-(least - 1), 0))
        full = F.count(F.lit(1)).over(w.rowsBetween(-(least - 1), 0)) == least
        hit = readings.withColumn("_h", (n == least) & full)
        first = hit.withColumn("_b", F.coalesce(F.lag("_h").over(w), F.lit(False))).where(F.col("_h") & ~F.col("_b")).select("symbol", "time", F.lit(priority).alias("priority"))
        out = first if out is None else out.unionByName(first)
    return out

"""Command lines: `python -m quantloom.cli archive|sweep|compare ...`.  Exit codes: 0 clean, 10 with failures, 11 after a rate limit."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.operators import carry, quality, universe
from quantloom.plans import family, reports
from quantloom.session import session
from quantloom.sources import archive, exchange

MARKETS = ("perp_usdt", "spot", "perp_funding")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantloom", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("archive", help="fetch what the universe asks for, then check the archive")
    a.add_argument("--root", required=True)
    a.add_argument("--snapshot", required=True, help="month of the universe, YYYY-MM")
    a.add_argument("--end", help="ISO time; now by default")
    a.add_argument("--sample", help="only the last span, such as 30d or 24h")
    a.add_argument("--force-cold-start", action="store_true")
    a.add_argument("--max-tasks", type=int)
    a.add_argument("--task-types", help="comma list of " + ", ".join(MARKETS))
    a.add_argument("--skip-fetch", action="store_true")
    a.add_argument("--skip-qc", action="store_true")
    for name in ("sweep", "compare"):
        s = sub.add_parser(name, help="over an archive's symbols")
        s.add_argument("--root", required=True)
        s.add_argument("--symbols", required=True, help="comma list")
    return p


def sample_window(text: str) -> timedelta:
    """30d or 24h."""
    if not text[:-1].isdecimal() or text[-1:] not in "dh":
        raise ValueError(f"not a span: {text!r}")
    return timedelta(**{"d": {"days": int(text[:-1])}, "h": {"hours": int(text[:-1])}}[text[-1]])


def task_types(text: str | None) -> tuple[str, ...]:
    found = MARKETS if text is None else tuple(x.strip() for x in text.split(",") if x.strip())
    if bad := [x for x in found if x not in MARKETS]:
        raise ValueError(f"unknown task types: {bad}")
    return found


def run_archive(spark: SparkSession, args: argparse.Namespace, work: Callable[[exchange.Task, int], tuple[str, int]] | None, now: Callable[[], datetime] = lambda: datetime.now(UTC), say: Callable[[str], None] = print) -> int:
    """work: fetches and stores one task up to a time in ms, by an injected client; None with --skip-fetch."""
    root, end = args.root, archive.parse_time(args.end) if args.end else now()
    lock, breaker = archive.Lock(Path(root) / "state" / "run.lock"), archive.Breaker(Path(root) / "state" / "breaker.json")
    if not lock.acquire():
        return exchange.exit_code(False, 1)
    try:
        if breaker.tripped():
            return exchange.exit_code(True, 0)
        members = archive.read_snapshot(spark, f"{root}/universe", "perp_usdt", datetime.strptime(args.snapshot, "%Y-%m").date())
        outcomes, aborted = [], False
        roots = [f"{root}/klines", f"{root}/funding"]
        if not args.skip_fetch:
            kinds = task_types(args.task_types)
            plan = [exchange.Task(r["market"], r["symbol"]) for r in universe.tasks(members).where(F.col("market").isin(*kinds)).orderBy("rank", "seq").collect()]
            outcomes, aborted = exchange.run(plan[: args.max_tasks], lambda t: work(t, int(end.timestamp() * 1000)))
            if aborted:
                breaker.trip(f"rate limit at {outcomes[-1].task}")
                say(reports.archive_summary(outcomes, None, reports.archive_bytes(spark, roots)))
                return exchange.exit_code(True, 0)
        results, errors = None, 0
        if not args.skip_qc:
            bars, paid = archive.load(spark, roots[0], schemas.KLINES), archive.load(spark, roots[1], schemas.FUNDING)
            listings = universe.listing_effective(members.select("symbol", F.explode(F.array(*map(F.lit, MARKETS))).alias("market"), F.col("listing_date").cast("timestamp").alias("listing")), bars)
            results = quality.suite(bars, paid, members, listings).persist()
            archive.write_audit(results, now(), f"{root}/audit")
            errors = results.where("severity = 'ERROR'").count()
        say(reports.archive_summary(outcomes, results, reports.archive_bytes(spark, roots)))
        failed = sum(o.result == "failed" for o in outcomes) + errors
        if not failed:
            breaker.clear()
        return exchange.exit_code(False, failed)
    finally:
        lock.release()


def run_family(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None] = print) -> int:
    """The sweep of the symbols against the baseline, or the variants side by side."""
    names = [x.strip() for x in args.symbols.split(",") if x.strip()]
    k = archive.load(spark, f"{args.root}/klines", schemas.KLINES).where(F.col("symbol").isin(names))
    f = archive.load(spark, f"{args.root}/funding", schemas.FUNDING).where(F.col("symbol").isin(names))
    bars = carry.assemble(k, f)
    base = carry.hysteresis(bars, carry.CarryParams())
    if args.command == "sweep":
        found = family.swept(bars, family.tied_grid(bars), base).persist()
        say(reports.ascii_table(reports.rows_of(found, ["symbol", "place"]), ["symbol", "place", "compression_exit", "compression_lookback", *family.WINDOWS, "max_dd", "active_fraction", "dominance"], 6))
        say(reports.ascii_table(reports.rows_of(family.flatness(found), ["symbol", "compression_lookback"]), ["symbol", "compression_lookback", "gap", "verdict"]))
        for r in reports.rows_of(found.where("place = 1"), ["symbol"]):
            say(f"{r['symbol']}: {family.recommendation(r['dominance'])}")
        return 0 if names else 10
    one = family.tied_grid(bars, [carry.RatchetParams().compression_exit], [carry.RatchetParams().compression_lookback])
    rows = reports.rows_of(family.gated(family.compared({"v2": base, "v3": carry.ratchet(bars, one)})), ["symbol", "variant"])
    say(reports.ascii_table(rows, ["symbol", "variant", "n_obs", *family.WINDOWS, "max_dd", "active_fraction", "n_transitions", "final_equity", "clears"]))
    return 0 if rows else 10


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "archive" and not args.skip_fetch:
        raise SystemExit("no transport is built in: call run_archive with one, or pass --skip-fetch")
    spark = session()
    return run_archive(spark, args, None) if args.command == "archive" else run_family(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())

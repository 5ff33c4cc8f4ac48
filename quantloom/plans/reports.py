"""Small results as text: tables for consoles and documents, the summary of an archive run.  Frames are collected here and nowhere else, so they must be
reports: a few rows by series, variant or check."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import archive

#: Rows that a report may have.
ROWS = 1000


def cell(value: object, digits: int = 4) -> str:
    """A value as a report shows it: thousands apart in whole numbers, fixed digits, a dash for nothing."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:,.{digits}f}" if isinstance(value, float) else str(value)


def rows_of(df: DataFrame, order: list[str] | None = None) -> list[dict]:
    """The rows of a report; one of more than ROWS is refused."""
    found = [r.asDict() for r in (df.orderBy(*order) if order else df).limit(ROWS + 1).collect()]
    if len(found) > ROWS:
        raise ValueError(f"more than {ROWS} rows: not a report")
    return found


def ascii_table(rows: Iterable[dict], columns: list[str], digits: int = 4) -> str:
    """Columns in fixed width, numbers to the right, without characters that a plain console lacks."""
    body = [[cell(r[c], digits) for c in columns] for r in rows]
    width = [max([len(c), *(len(b[i]) for b in body)]) for i, c in enumerate(columns)]
    line = lambda cells, fill=" ": " | ".join(c.rjust(w, fill) for c, w in zip(cells, width, strict=True))
    rule = "=" * len(line(columns))
    return "\n".join([rule, line(columns), rule, *map(line, body), rule])


def markdown(title: str, tables: dict[str, tuple[list[dict], list[str]]], digits: int = 4) -> str:
    """A document of titled tables; an empty one says so."""
    out = [f"# {title}"]
    for name, (rows, columns) in tables.items():
        out.append(f"\n## {name}\n")
        if rows:
            out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c], digits).replace("|", "\\|") for c in columns) + " |" for r in rows)]
        else:
            out.append("No rows.")
    return "\n".join(out) + "\n"


def write_text(text: str, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def error_categories(results: DataFrame) -> DataFrame:
    """category, n: errors of quality results by the part of the check's name before the first bracket or underscore."""
    category = F.lower(F.regexp_extract("name", r"^([^\[_]*)", 1))
    return results.where("severity = 'ERROR'").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def archive_bytes(spark: SparkSession, roots: list[str]) -> int:
    """What the archives take on disk; 0 for one that is not there."""
    total = 0
    for root in roots:
        fs, path = archive._fs(spark, root)
        if fs.exists(path(root)):
            total += fs.getContentSummary(path(root)).getLength()
    return total


def archive_summary(outcomes: list, results: DataFrame | None, size: int) -> str:
    """What a run of the archive did: tasks by outcome, quality results by severity, errors by category, size."""
    count = lambda *kinds: sum(o.result.startswith(kinds) for o in outcomes)
    by = {r["severity"]: r["count"] for r in results.groupBy("severity").count().collect()} if results is not None else {}
    errors = ", ".join(f"{r['category']}={r['n']}" for r in sorted(error_categories(results).collect(), key=lambda r: r["category"])) if results is not None else ""
    series = results.where("severity = 'ERROR'").select("symbol", "market").distinct().where("symbol is not null").count() if results is not None else 0
    return "\n".join([
        "=== Archive run ===",
        f"tasks:          {len(outcomes)} ({count('done')} done, {count('nothing')} with nothing to fetch, {count('skipped')} skipped, {count('failed', 'rate_limited')} failed)",
        f"quality:        {by.get('ERROR', 0)} ERROR, {by.get('WARN', 0)} WARN, {by.get('INFO', 0)} INFO",
        f"errors by kind: {errors or 'none'}",
        f"series in error: {series}",
        f"on disk:        {size / 1e6:.1f} MB",
    ])

"""The archive on disk: decoding raw rows, scans, audited upserts by year, audit files and small ledgers.

Bars and funding lie under year=YYYY/version=ID.  An upsert writes new versions of the years that the new rows touch, then the corrections,
then a manifest that names the version of each year: making that file, which fails if another writer has made it, is the only step
that a reader can see.  No folder is moved; the versions before are deleted when the next upsert has followed, so that readers of the
manifest before still find their files."""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom import schemas
from quantloom.operators import windows

#: A number counts as corrected when it moves by more than this share of the larger of its size and 1.
RTOL = 1e-9
KLINE_KEYS, FUNDING_KEYS = ["symbol", "market", "open_time"], ["symbol", "funding_time"]
KLINE_FIELDS = ["open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]
FUNDING_FIELDS = ["funding_rate", "mark_price"]


# --- decoding -------------------------------------------------------------------------------------------------------------------------


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def parse_time(text: str) -> datetime:
    """An ISO date or time; without a zone it is UTC."""
    t = datetime.fromisoformat(text)
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


def decode_klines(raw: DataFrame, source: str, ingested_at: datetime) -> DataFrame:
    """KLINES from symbol, market and row, an array of the twelve positional fields as strings; bad numbers become null."""
    f = lambda i: F.try_element_at("row", F.lit(i + 1))
    number = lambda i: F.expr(f"try_cast(try_element_at(row, {i + 1}) as double)")
    out = raw.select(
        "symbol", "market", from_epoch_ms(f(0)).alias("open_time"), from_epoch_ms(f(6)).alias("close_time"),
        number(1).alias("open"), number(2).alias("high"), number(3).alias("low"), number(4).alias("close"), number(5).alias("volume"),
        number(7).alias("quote_volume"), F.expr("try_cast(try_element_at(row, 9) as bigint)").alias("trades"), number(9).alias("taker_buy_base"),
        number(10).alias("taker_buy_quote"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"), F.lit(source).alias("source"),
    )
    return schemas.conform(out, schemas.KLINES)


def decode_funding(raw: DataFrame, source: str, ingested_at: datetime) -> DataFrame:
    """FUNDING from symbol, fundingTime (ms), fundingRate, markPrice (strings): times lose what is under a second; rows without a
    readable rate are dropped, a missing price stays null."""
    out = raw.select(
        "symbol", F.date_trunc("second", from_epoch_ms(F.col("fundingTime"))).alias("funding_time"), F.expr("try_cast(fundingRate as double)").alias("funding_rate"),
        F.expr("try_cast(markPrice as double)").alias("mark_price"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"), F.lit(source).alias("source"),
    )
    return schemas.conform(out.where("funding_rate is not null"), schemas.FUNDING)


def closed_bars(bars: DataFrame) -> DataFrame:
    """Without bars that were still open when they were fetched; the last row of a key wins."""
    return windows.latest(bars.where("close_time < ingested_at"), KLINE_KEYS, [F.desc("ingested_at")])


# --- scans ----------------------------------------------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The number of the latest manifest and its years: year -> folder under root; 0 and the year folders themselves where there is none.  A
    manifest cut short, by a writer that died, is none."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/_manifests")
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")), reverse=True) if fs.exists(folder) else []
    for name in names:
        stream = fs.open(path(f"{root}/_manifests/{name}"))
        text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        stream.close()
        try:
            return int(names[0].split(".")[0]), json.loads(text)
        except ValueError:
            continue
    years = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("year=")] if fs.exists(path(root)) else []
    return int(names[0].split(".")[0]) if names else 0, {y.split("=")[1]: y for y in years}


def load(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All years of an archive; empty where there is none.  A filter on `year` prunes folders."""
    kinds = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    years = manifest(spark, root)[1]
    if not years:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", root).parquet(*[f"{root}/{v}" for v in sorted(years.values())]).select(*kinds.names)


def bounds(archive: DataFrame, keys: list[str], when: str) -> DataFrame:
    """keys, first_time, last_time of every series at once: where each resumes."""
    return archive.groupBy(*keys).agg(F.min(when).alias("first_time"), F.max(when).alias("last_time"))


# --- corrections and upserts ------------------------------------------------------------------------------------------------------------


def corrections(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], when: str) -> DataFrame:
    """A row for each field of each key that both sides have and that moved beyond the tolerance (integers: at all); nulls do not count."""
    kinds = dict(old.dtypes)
    pair = old.select(*keys, F.struct("ingested_at", *fields).alias("o")).join(new.select(*keys, F.struct("ingested_at", *fields).alias("n")), keys)

    def moved(f: str) -> Column:
        a, b = F.col(f"o.{f}"), F.col(f"n.{f}")
        return a != b if kinds[f] in ("bigint", "int", "smallint") else F.abs(b - a) > RTOL * F.greatest(F.abs(a), F.lit(1.0))

    each = F.array(*[F.when(moved(f), F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("double").alias("old_value"), F.col(f"n.{f}").cast("double").alias("new_value"))) for f in fields])
    out = pair.select(*keys, F.col("o.ingested_at").alias("old_ingested_at"), F.col("n.ingested_at").alias("new_ingested_at"), F.inline(F.filter(each, lambda x: x.isNotNull())))
    market = F.col("market") if "market" in keys else F.lit("perp_funding")
    return out.select("symbol", market.alias("market"), F.col(when).alias("time"), "field", "old_value", "new_value", "old_ingested_at", "new_ingested_at")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and new with one row for each key: the latest ingested, of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return windows.latest(both, keys, [F.desc("ingested_at"), F.desc("_new")]).drop("_new")


def upsert(spark: SparkSession, root: str, new: DataFrame, schema: T.StructType, keys: list[str], fields: list[str], when: str, audit: bool = True) -> int:
    """Merge new into the archive, year by year; corrections of existing rows go beside it, before the merged rows can be seen.  How many
    corrections there were.  Of two upserts at a time one raises FileExistsError and has changed nothing."""
    root = root.rstrip("/")
    new = schemas.conform(new, schema).withColumn("year", F.year(when))
    touched = sorted(r["year"] for r in new.select("year").distinct().collect())
    if not touched:
        return 0
    number, years = manifest(spark, root)
    old = load(spark, root, schema).where(F.col("year").isin(touched))
    n, version = 0, f"version={uuid.uuid4().hex[:12]}"
    if audit:
        found = corrections(old, new, keys, fields, when).persist()  # computed from versions that stay
        if n := found.count():
            stamp = found.agg(F.max(F.unix_micros("new_ingested_at"))).first()[0]
            found.coalesce(1).write.mode("overwrite").parquet(f"{root}/_corrections/correction_{stamp}.parquet")
        found.unpersist()
    # A range for each task: a year may be many tasks' work, each of which writes one sorted file.
    parts = merged(old, new, keys).repartitionByRange("year", *keys).sortWithinPartitions("year", *keys).persist()
    try:
        for y in touched:
            parts.where(F.col("year") == y).drop("year").write.option("compression", "zstd").parquet(f"{root}/year={y}/{version}")
    finally:
        parts.unpersist()
    _publish(spark, root, number + 1, years | {str(y): f"year={y}/{version}" for y in touched})
    _sweep(spark, root, number, years)
    return n


def _publish(spark: SparkSession, root: str, number: int, years: dict[str, str]) -> None:
    fs, path = _fs(spark, root)
    place = path(f"{root}/_manifests/{number:010d}.json")
    try:
        out = fs.create(place, False)
    except Exception as e:
        if "exist" not in str(e):
            raise
        raise FileExistsError(f"another upsert came first: {place}") from e
    out.write(bytearray(json.dumps(years, sort_keys=True).encode()))
    out.close()


def _sweep(spark: SparkSession, root: str, number: int, before: dict[str, str]) -> None:
    """Delete what neither the newest manifest nor the one before (`before`) names, of the versions that older manifests named."""
    fs, path = _fs(spark, root)
    keep = {*before.values(), *manifest(spark, root)[1].values()}
    for status in fs.listStatus(path(f"{root}/_manifests")):
        name = status.getPath().getName()
        if not name.endswith(".json") or int(name.split(".")[0]) >= number:
            continue
        stream = fs.open(status.getPath())
        text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        stream.close()
        try:
            for folder in json.loads(text).values():
                if folder not in keep and "version=" in folder:
                    fs.delete(path(f"{root}/{folder}"), True)
        except ValueError:
            pass
        fs.delete(status.getPath(), False)


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def upsert_klines(spark: SparkSession, root: str, new: DataFrame, audit: bool = True) -> int:
    return upsert(spark, root, new, schemas.KLINES, KLINE_KEYS, KLINE_FIELDS, "open_time", audit)


def upsert_funding(spark: SparkSession, root: str, new: DataFrame, audit: bool = True) -> int:
    return upsert(spark, root, new, schemas.FUNDING, FUNDING_KEYS, FUNDING_FIELDS, "funding_time", audit)


def replace_run(df: DataFrame, root: str, when: str = "time") -> None:
    """Append a run's rows under strategy_id / run_id / year; writing a run again replaces exactly its own folders."""
    out = df.withColumn("year", F.year(when)) if when in df.columns else df.withColumn("year", F.lit(0))
    out.withColumn("run", F.col("run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "run", "year").parquet(root)


# --- universe files -----------------------------------------------------------------------------------------------------------------------


def month(day: date) -> tuple[date, date]:
    """First and last day of a month."""
    start = day.replace(day=1)
    end = date(start.year + start.month // 12, start.month % 12 + 1, 1)
    return start, date.fromordinal(end.toordinal() - 1)


def write_snapshot(universe: DataFrame, rejected: DataFrame, root: str, market: str, period: date) -> None:
    """Both files of a month; an empty universe is refused, an empty list of rejections is not."""
    if not universe.limit(1).count():
        raise ValueError("empty universe")
    for name, df in (("snapshot", universe), ("rejected", rejected)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{market}/{name}_{period:%Y-%m}.parquet")


def read_snapshot(spark: SparkSession, root: str, market: str, period: date, name: str = "snapshot") -> DataFrame:
    if not _exists(spark, path := f"{root}/{market}/{name}_{period:%Y-%m}.parquet"):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def universe_as_of(spark: SparkSession, root: str, market: str, when: datetime) -> DataFrame:
    """The month's snapshot, if it was taken by `when`; no other month is tried."""
    df = read_snapshot(spark, root, market, month(when.date())[0])
    seen = df.agg(F.max("as_of").alias("t"), F.min("period_start").alias("a"), F.max("period_end").alias("b")).first()
    taken = seen["t"] if seen["t"].tzinfo else seen["t"].replace(tzinfo=UTC)
    if taken > when or not seen["a"] <= when.date() <= seen["b"]:
        raise ValueError("the snapshot is later than asked for, or of another period")
    return df


# --- small state on the driver ------------------------------------------------------------------------------------------------------------


def write_json(payload: object, path: str | Path) -> None:
    """Atomically: a reader sees the old file or the new."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.{uuid.uuid4().hex[:6]}")
    part.write_text(json.dumps(payload, sort_keys=True))
    os.replace(part, path)


def read_json(path: str | Path) -> object | None:
    """None for a missing or unreadable file."""
    try:
        return json.loads(Path(path).read_text())
    except (FileNotFoundError, ValueError):
        return None


class Lock:
    """A lock file made exclusively, so that two processes cannot both hold it; one older than `stale` seconds is broken."""

    def __init__(self, path: str | Path, stale: float = 3600, wait: float = 30, poll: float = 0.05) -> None:
        self.path, self.stale, self.wait, self.poll = Path(path), stale, wait, poll

    def acquire(self) -> bool:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            try:
                old = time.time() - self.path.stat().st_mtime > self.stale
            except FileNotFoundError:
                return self.acquire()
            if not old:
                return False
            aside = self.path.with_name(f"{self.path.name}.{uuid.uuid4().hex[:6]}")
            try:
                os.rename(self.path, aside)  # of several breakers, one succeeds
            except FileNotFoundError:
                return False
            aside.unlink()
            return self.acquire()

    def release(self) -> None:
        self.path.unlink(missing_ok=True)

    def __enter__(self) -> Lock:
        end = time.monotonic() + self.wait
        while not self.acquire():
            if time.monotonic() > end:
                raise TimeoutError(f"locked: {self.path}")
            time.sleep(self.poll)
        return self

    def __exit__(self, *exc: object) -> None:
        self.release()


class Breaker:
    """Stops fetching for a while after a rate limit."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def trip(self, reason: str, hours: float = 24, now: float | None = None) -> None:
        write_json({"reason": reason, "until": (time.time() if now is None else now) + hours * 3600}, self.path)

    def tripped(self, now: float | None = None) -> bool:
        state = read_json(self.path)
        return isinstance(state, dict) and (time.time() if now is None else now) < state.get("until", 0)

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)


LISTING_VERSION = 1


def save_listings(listings: dict[str, str], path: str | Path) -> None:
    write_json({"version": LISTING_VERSION, "listings": listings}, path)


def load_listings(path: str | Path) -> dict[str, str]:
    """Empty if there is none or it is of another version."""
    state = read_json(path)
    return dict(state["listings"]) if isinstance(state, dict) and state.get("version") == LISTING_VERSION else {}


def write_audit(results: DataFrame, run_ts: datetime, folder: str) -> str:
    """The suite's results as one immutable file named by the run's time."""
    path = f"{folder}/qc_run_{int(run_ts.timestamp() * 1e6)}.parquet"
    schemas.conform(results.withColumns({"run_ts": F.lit(run_ts).cast("timestamp"), "tier": F.lit(None).cast("string")}), schemas.QC_RUN).coalesce(1).write.parquet(path)
    return path


def state(spark: SparkSession, klines: DataFrame, klines_root: str, funding_root: str) -> dict:
    """data_version: the last bar's minute and a fingerprint of the names of the correction files; and that bar's time."""
    import hashlib

    fs, path = _fs(spark, klines_root)
    names = []
    for root in (klines_root, funding_root):
        folder = path(f"{root}/_corrections")
        if fs.exists(folder):
            names += sorted(f"{root.rstrip('/').rsplit('/', 1)[-1]}/{s.getPath().getName()}" for s in fs.listStatus(folder))
    mark = hashlib.sha256("\n".join(names).encode()).hexdigest()[:8]
    last = klines.agg(F.max("open_time").alias("t"), F.date_format(F.max("open_time"), "yyyy-MM-dd'T'HH:mm").alias("m")).first()
    return {"data_version": f"{last['m']}+{mark}" if last["m"] else f"empty+{mark}", "archive_max_kline_time": last["t"], "corrections": mark}

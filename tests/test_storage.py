"""Archive, exchange client, registry, runner and streams."""

import json
import threading
import time
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import schemas
from quantloom.operators import carry
from quantloom.plans import registry, runner
from quantloom.sources import archive, exchange
from quantloom.streaming import events, paper

T0 = datetime(2026, 1, 1, tzinfo=UTC)
HOUR = exchange.HOUR_MS


# --- decoding, upserts ----------------------------------------------------------------------------------------------------------------------


def raw_bar(ms, close="1.5", trades="7"):
    return [str(ms), "1", "2", "0.5", close, "10", str(ms + HOUR - 1), "15", trades, "3", "4", "0"]


def decoded(spark, rows, at=T0, symbol="A"):
    raw = spark.createDataFrame([(symbol, "spot", r) for r in rows], "symbol string, market string, row array<string>")
    return archive.decode_klines(raw, "test", at)


def test_decode(spark):
    r = decoded(spark, [raw_bar(1_700_000_000_000), raw_bar(1_700_003_600_000, close="oops")]).orderBy("open_time").collect()
    assert r[0]["close"] == 1.5 and r[0]["trades"] == 7 and r[1]["close"] is None
    f = spark.createDataFrame([("A", 1_700_000_000_013, "0.0001", ""), ("A", 1_700_028_800_001, "", "3")], "symbol string, fundingTime long, fundingRate string, markPrice string")
    out = archive.decode_funding(f, "test", T0).collect()
    assert len(out) == 1 and out[0]["mark_price"] is None and out[0]["funding_time"].microsecond == 0


def test_conform(spark):
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(spark.createDataFrame([(1,)], "a int"), schemas.FUNDING)
    assert sum(isinstance(v, type(schemas.KLINES)) for v in vars(schemas).values()) == 14


def test_upsert(spark, tmp_path):
    root = str(tmp_path / "klines")
    ms = int(datetime(2025, 12, 31, 22, tzinfo=UTC).timestamp() * 1000)
    assert archive.upsert_klines(spark, root, decoded(spark, [raw_bar(ms + i * HOUR) for i in range(4)])) == 0
    again = decoded(spark, [raw_bar(ms + HOUR), raw_bar(ms + 2 * HOUR, close="1.500000000001"), raw_bar(ms + 3 * HOUR, close="1.6", trades="8"), raw_bar(ms + 4 * HOUR)], T0 + timedelta(days=1))
    assert archive.upsert_klines(spark, root, again) == 2
    df = archive.load(spark, root, schemas.KLINES)
    assert df.count() == 5 and {r["year"] for r in df.select("year").distinct().collect()} == {2025, 2026}
    assert sorted(r["close"] for r in df.collect())[-1] == 1.6
    side = spark.read.parquet(*[str(p) for p in (tmp_path / "klines" / "_corrections").iterdir() if p.name.startswith("correction_")])
    assert {(r["field"], r["old_value"], r["new_value"]) for r in side.collect()} == {("close", 1.5, 1.6), ("trades", 7.0, 8.0)}
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    state = archive.state(spark, df, root, str(tmp_path / "none"))
    assert state["data_version"].startswith("2026-01-01T02:00+")
    assert archive.load(spark, str(tmp_path / "none"), schemas.KLINES).count() == 0


def test_upsert_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    root, ms = str(tmp_path / "klines"), int(datetime(2025, 12, 31, 22, tzinfo=UTC).timestamp() * 1000)
    archive.upsert_klines(spark, root, decoded(spark, [raw_bar(ms + i * HOUR) for i in range(4)]))
    before = sorted(map(tuple, archive.load(spark, root, schemas.KLINES).collect()))
    reader = archive.load(spark, root, schemas.KLINES)
    later = decoded(spark, [raw_bar(ms, close="9")], T0 + timedelta(days=1))
    with monkeypatch.context() as m:
        m.setattr(archive, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            archive.upsert_klines(spark, root, later)
    assert sorted(map(tuple, archive.load(spark, root, schemas.KLINES).collect())) == before
    number, years = archive.manifest(spark, root)
    archive.upsert_klines(spark, root, later)
    with pytest.raises(FileExistsError):
        archive._publish(spark, root, number + 1, years)
    assert sorted(map(tuple, reader.collect())) == before  # planned before, still whole
    assert max(r["close"] for r in archive.load(spark, root, schemas.KLINES).collect()) == 9.0
    archive.upsert_klines(spark, root, decoded(spark, [raw_bar(ms, close="8")], T0 + timedelta(days=2)))
    assert len(list((tmp_path / "klines" / "year=2025").iterdir())) <= 3 and archive.load(spark, root, schemas.KLINES).count() == 4
    (tmp_path / "klines" / "_manifests" / "0000000099.json").write_text('{"2025": "ye')
    assert archive.load(spark, root, schemas.KLINES).count() == 4


def test_folders_without_a_manifest_are_read(spark, tmp_path):
    bars = decoded(spark, [raw_bar(1_700_000_000_000)])
    bars.withColumn("year", F.lit(2023)).write.partitionBy("year").parquet(root := str(tmp_path / "k"))
    assert archive.load(spark, root, schemas.KLINES).count() == 1
    archive.upsert_klines(spark, root, decoded(spark, [raw_bar(1_700_003_600_000)]))
    assert archive.load(spark, root, schemas.KLINES).count() == 2


def test_closed_bars(spark):
    now = T0 + timedelta(hours=1, minutes=30)
    ms = int(T0.timestamp() * 1000)
    assert archive.closed_bars(decoded(spark, [raw_bar(ms), raw_bar(ms + HOUR), raw_bar(ms)], now)).count() == 1


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2026, 1, 2, tzinfo=UTC), date(2026, 1, 1), date(2026, 1, 31), 1)], "as_of timestamp, period_start date, period_end date, rank int")
    archive.write_snapshot(rows, rows.limit(0), str(tmp_path), "perp", date(2026, 1, 1))
    assert archive.universe_as_of(spark, str(tmp_path), "perp", datetime(2026, 1, 9, tzinfo=UTC)).count() == 1
    assert archive.read_snapshot(spark, str(tmp_path), "perp", date(2026, 1, 1), "rejected").count() == 0
    with pytest.raises(ValueError):
        archive.universe_as_of(spark, str(tmp_path), "perp", datetime(2026, 1, 1, tzinfo=UTC))
    with pytest.raises(FileNotFoundError):
        archive.universe_as_of(spark, str(tmp_path), "perp", datetime(2026, 2, 1, tzinfo=UTC))
    with pytest.raises(ValueError):
        archive.write_snapshot(rows.limit(0), rows, str(tmp_path), "perp", date(2026, 1, 1))
    assert archive.month(date(2024, 2, 9)) == (date(2024, 2, 1), date(2024, 2, 29)) and archive.month(date(2025, 12, 9))[1] == date(2025, 12, 31)
    assert archive.parse_time("2026-01-01") == T0


def test_locks_exclude(tmp_path):
    inside, most = 0, 0

    def work():
        nonlocal inside, most
        with archive.Lock(tmp_path / "x.lock", wait=20, poll=0.002):
            inside += 1
            most = max(most, inside)
            time.sleep(0.005)
            inside -= 1

    ts = [threading.Thread(target=work) for _ in range(12)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert most == 1 and not list(tmp_path.iterdir())
    held = archive.Lock(tmp_path / "y.lock", stale=0.05)
    assert held.acquire() and not archive.Lock(tmp_path / "y.lock").acquire()
    time.sleep(0.1)
    assert archive.Lock(tmp_path / "y.lock", stale=0.05).acquire()


def test_breaker_and_listings(tmp_path):
    b = archive.Breaker(tmp_path / "b.json")
    assert not b.tripped()
    b.trip("429", 24, now=0)
    assert b.tripped(now=3600) and not b.tripped(now=25 * 3600)
    b.clear()
    assert not b.tripped(now=1)
    archive.save_listings({"A": "2020-01-01"}, p := tmp_path / "l.json")
    assert archive.load_listings(p) == {"A": "2020-01-01"}
    p.write_text(json.dumps({"version": 99, "listings": {"A": "x"}}))
    assert archive.load_listings(p) == {}
    p.write_text("{")
    assert archive.load_listings(p) == {}


# --- exchange -------------------------------------------------------------------------------------------------------------------------------


def client(*answers):
    left, slept = list(answers), []
    return exchange.Client(lambda u, p: left.pop(0), slept.append), slept


@pytest.mark.parametrize("status", sorted(exchange.RETRYABLE))
def test_retries(status):
    c, slept = client((status, {}, None), (status, {"Retry-After": "7"}, None), (200, {}, "ok"))
    assert c.get("u", {}) == "ok" and slept == [1.0, 7.0]


@pytest.mark.parametrize("status", sorted(exchange.FATAL))
def test_fatal(status):
    c, slept = client((status, {}, None))
    with pytest.raises(exchange.RateLimitError if status == 418 else exchange.ApiError):
        c.get("u", {})
    assert slept == []


def test_exhausted():
    c, slept = client(*[(429, {}, None)] * 5)
    with pytest.raises(exchange.RateLimitError):
        c.get("u", {})
    assert slept == [1.0, 2.0, 4.0, 8.0]


def test_paging():
    bars = [raw_bar(i * HOUR) for i in range(2500)]
    bars = [[int(b[0]), *b[1:6], int(b[6]), *b[7:]] for b in bars]
    asked = []

    def transport(url, p):
        asked.append(p["startTime"])
        return 200, {}, [b for b in bars if p["startTime"] <= b[0] <= p["endTime"]][: p["limit"]]

    c = exchange.Client(transport, lambda s: None)
    got = exchange.fetch_klines(c, "spot", "A", 0, 9999 * HOUR, 2400 * HOUR)
    assert [b[0] for b in got] == [i * HOUR for i in range(2399)] and len(asked) == 3
    assert exchange.first_bar(exchange.Client(lambda u, p: (200, {}, bars[:1]), lambda s: None), "spot", "A") == 0
    with pytest.raises(ValueError):
        exchange.endpoint("moon")


def test_tasks_resume_and_abort():
    assert exchange.resume(10, None, 20, 1, False) == (11, "resume") and exchange.resume(19, None, 20, 1, False) == (None, "nothing")
    assert exchange.resume(None, 5, 20, 1, False)[1] == "skipped_cold_start" and exchange.resume(None, 5, 20, 1, True) == (5, "cold_start")

    def work(t):
        if t.symbol == "B":
            raise ValueError("bad")
        if t.symbol == "C":
            raise exchange.RateLimitError("429")
        return "done", 3

    out, aborted = exchange.run([exchange.Task("spot", s) for s in "ABCD"], work)
    assert [o.result for o in out] == ["done", "failed", "rate_limited"] and aborted and exchange.exit_code(aborted, 1) == 11


def test_snapshot_is_one_moment():
    times = iter([T0, T0 + timedelta(seconds=9)])
    with pytest.raises(exchange.ApiError):
        exchange.snapshot(lambda u: {}, {"a": "1", "b": "2"}, lambda: next(times))


# --- registry, runner -----------------------------------------------------------------------------------------------------------------------

STATE = {"data_version": "2026-01-01T00:00+abcd1234", "archive_max_kline_time": T0}


def test_canonical_parameters():
    assert registry.params_json({"b": 1, "a": [True, None, 2.5]}) == '{"a":[true,null,2.5],"b":1.0}'
    assert registry.params_hash({"a": 1}) == registry.params_hash({"a": 1.0})
    for bad in ({"a": float("nan")}, {"a": (1,)}, {1: 2}):
        with pytest.raises((TypeError, ValueError)):
            registry.params_json(bad)


def test_status_machine(tmp_path):
    r = registry.Registry(tmp_path)
    i = r.register("s", "v2", {"a": 1}, STATE)
    with pytest.raises(ValueError):
        r.transition(i, "running", "validated")
    r.transition(i, "running", "complete")
    with pytest.raises(registry.StaleStatusError):
        r.transition(i, "running", "failed")
    r.transition(i, "complete", "validated", verdict="pass", metrics={"dsr": 0.9, "pbo": None, "x": float("nan")})
    assert json.loads(r.get(i)["metrics_summary_json"]) == {"dsr": 0.9, "pbo": None, "x": None}
    with pytest.raises(KeyError):
        r.get("none")
    assert r.check_corrections(i, STATE["data_version"]) == "clean" and r.check_corrections(i, "2027+ffff") == "dirty"


def test_trials(tmp_path):
    r = registry.Registry(tmp_path)
    log = lambda p, s, **k: r.log_trial("s", p, data_version="d", split="full", realized_sharpe=s, n_obs=9, **k)
    assert [log({"a": 1}, 1.0), log({"a": 2}, 2.0), log({"a": 1}, 1.0 + 1e-12)] == [1, 2, 1]
    with pytest.raises(registry.TrialMismatchError):
        log({"a": 1}, 1.5)
    assert log({"a": 1}, 1.5, overwrite=True) == 1 and r.count_trials("s") == 2 and log({"a": 3}, 0.0) == 3
    assert r.count_trials("s", "other") == 0


def market(spark, n=336, rate=2e-4, seed=42):
    x = 50_000 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.001, n))
    bars = [("A", m, T0 + timedelta(hours=i), float(x[i])) for m in ("spot", "perp_usdt") for i in range(n)]
    paid = [("A", T0 + timedelta(hours=8 * i), rate) for i in range(n // 8)] or [("A", T0, rate)]
    bench = [(T0 + timedelta(hours=i), float(x[i] / x[i - 1] - 1)) for i in range(1, n)] or [(T0, 0.0)]
    return spark.createDataFrame(bars, "symbol string, market string, open_time timestamp, close double"), spark.createDataFrame(paid, "symbol string, funding_time timestamp, funding_rate double"), spark.createDataFrame(bench, "time timestamp, ret double")


@pytest.mark.parametrize("params", [carry.CarryParams(), carry.RatchetParams(ma_lookback=3, compression_lookback=3, min_hold=2)])
def test_run_end_to_end(spark, tmp_path, params):
    k, f, b = market(spark)
    adv = spark.createDataFrame([("A", 1e9)], "symbol string, adv double")
    out = runner.run(spark, "A", "v2", params, klines=k, funding=f, benchmark=b, root=str(tmp_path), archive_state=STATE, adv=adv, n_bootstrap=30)
    header = runner.read_run(spark, str(tmp_path), out.run_id, "result").collect()
    assert len(header) == 1 and header[0]["n_bars"] == runner.read_run(spark, str(tmp_path), out.run_id).count() > 0 and json.loads(header[0]["universe_json"]) == ["A"]
    assert runner.read_run(spark, str(tmp_path), "none").count() == 0 and runner.read_run(spark, str(tmp_path / "no"), out.run_id).count() == 0
    with pytest.raises(ValueError, match="ledgers"):
        runner.run(spark, "A", "v2", params, klines=k, funding=f, benchmark=b, root="hdfs://host/x", archive_state=STATE)
    row = registry.Registry(tmp_path / "state").get(out.run_id)
    assert row["status"] == "validated" and row["verdict"] == out.verdict and out.metrics["n_obs"] == 336
    assert "regime_absent:pre_etf" in out.warnings and out.metrics["periods_per_year"] == 8760 and out.metrics["capacity_estimate_usd"] > 0
    for name in ("leg", "contrib", "equity"):
        saved = spark.read.parquet(f"{tmp_path}/backtests/{name}")
        assert saved.where(F.col("run_id") == out.run_id).count() == {"leg": 672}.get(name, 336)
    assert registry.Registry(tmp_path / "state").count_trials("carry_v2_A") == 1


def test_one_bar_is_a_fail_and_no_trial(spark, tmp_path):
    k, f, b = market(spark, 1)
    out = runner.run(spark, "A", "v2", carry.CarryParams(), klines=k, funding=f, benchmark=b, root=str(tmp_path), archive_state=STATE)
    assert out.verdict == "fail" and out.blocking == ["insufficient_data"] and registry.Registry(tmp_path / "state").count_trials("carry_v2_A") == 0


def test_a_failure_is_recorded(spark, tmp_path):
    def broken(*a, **k):
        raise RuntimeError("no")

    k, f, b = market(spark, 8)
    with pytest.raises(RuntimeError):
        runner.run(spark, "A", "v2", carry.CarryParams(), klines=k, funding=f, benchmark=b, root=str(tmp_path), archive_state=STATE, plan=broken)
    assert registry.Registry(tmp_path / "state").runs()["status"].tolist() == ["failed"]


def test_gates():
    ok = {("trend", "bull"): 1.0, ("trend", "bear"): 0.0, ("etf", "pre_etf"): 1.0, ("etf", "post_etf"): 1.0}
    assert registry.verdict({"max_dd": -0.1}, ok, 0.9, 0.4) == ("pass", [], [])
    assert registry.verdict({"max_dd": -0.1}, {}, 0.9, None)[0] == "pass"
    for m, r, d, p in (({"max_dd": -0.4}, ok, 0.9, None), ({"max_dd": None}, ok, 0.9, None), ({"max_dd": 0.0}, ok, float("nan"), None), ({"max_dd": 0.0}, ok, 0.5, None), ({"max_dd": 0.0}, ok, 0.9, 0.6), ({"max_dd": 0.0}, ok | {("trend", "bear"): float("nan")}, 0.9, None)):
        assert registry.verdict(m, r, d, p)[0] == "fail"


def test_panel_refuses_mixed_periods(spark):
    rows = [("a", T0 + timedelta(hours=i), 0.1, True) for i in range(4)] + [("b", T0 + timedelta(hours=2 * i), 0.1, True) for i in range(4)]
    c = spark.createDataFrame(rows, "alpha_id string, time timestamp, ret double, active boolean")
    with pytest.raises(registry.FrequencyMismatchError):
        registry.checked_panel(c)
    assert registry.checked_panel(c.where("alpha_id = 'a'")).count() == 4


# --- streams --------------------------------------------------------------------------------------------------------------------------------


def test_event_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [events.line(str(i % 5), "settlement", T0 + timedelta(hours=8 * (i % 5)), "1", "A", {"rate": i}) for i in range(8)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*lines, '{"event_id": "9", "ki']))
    q = events.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.table("log").collect()) == ["0", "1", "2", "3", "4"]
    with pytest.raises(ValueError):
        events.line("1", "nonsense", T0, "1", "A", {})


def test_stream_is_the_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    p = carry.RatchetParams(ma_lookback=3, compression_lookback=4, min_hold=2)
    rows = [(s, T0 + timedelta(hours=8 * i), float(rng.normal(0, 3e-4))) for s in "AB" for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, funding_rate double")
    for k in range(3):  # three files, in time order
        df.where(F.col("time").between(T0 + timedelta(hours=160 * k), T0 + timedelta(hours=160 * k + 159))).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = paper.targets(stream, p).writeStream.format("memory").queryName("targets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["symbol"], r["time"]): r["regime_state"] for r in spark.table("targets").collect()}
    for s in "AB":
        machine, rates = carry.Ratchet(), []
        for sym, t, r in rows:
            if sym == s:
                rates.append(r)
                fast, slow = (round(sum(rates[-n:]) / n, 12) if len(rates) >= n else None for n in (3, 4))
                assert got[s, t.replace(tzinfo=None)] == machine.step(fast, slow, p)


def test_transport_errors_are_retried():
    waits, left = [], [TimeoutError("slow"), ConnectionResetError("gone")]

    def transport(url, params):
        if left:
            raise left.pop(0)
        return 200, {}, "body"

    assert exchange.Client(transport, waits.append).get("u", {}) == "body" and waits == [1.0, 2.0]
    left += [TimeoutError("slow")] * 9
    with pytest.raises(exchange.ApiError):
        exchange.Client(transport, waits.append, tries=3).get("u", {})


def test_late_settlements_are_told(spark, tmp_path):
    p = carry.RatchetParams(ma_lookback=2, compression_lookback=2, min_hold=1)
    kinds = "symbol string, time timestamp, funding_rate double"
    for k, hours in enumerate([[0, 16], [8, 24]]):
        spark.createDataFrame([("A", T0 + timedelta(hours=h), 1e-4) for h in hours], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = paper.targets(stream, p).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["time"].hour, r["time"].day, r["late"], r["regime_state"] is None) for r in spark.table("late").collect()} == {(0, 1, False, False), (16, 1, False, False), (8, 1, True, True), (0, 2, False, False)}


def test_upsert_stream(spark, tmp_path):
    ms = int(T0.timestamp() * 1000)
    decoded(spark, [raw_bar(ms), raw_bar(ms + HOUR)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.KLINES).parquet(str(tmp_path / "in"))
    paper.upsert_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert archive.load(spark, str(tmp_path / "out"), schemas.KLINES).count() == 2


def test_reconcile_and_halts(spark):
    a = spark.createDataFrame([(T0 + timedelta(hours=i), 0.01) for i in range(24)], "time timestamp, ret double")
    r = events.daily_reconcile(a, a.withColumn("ret", F.col("ret") * 2)).first()
    assert r["tracking_error"] < 0 and r["correction_effect"] is None
    x = spark.createDataFrame([("A", T0 + timedelta(hours=i), v) for i, v in enumerate([0, 1, 1, 1, 1, 0, 1, 1, 1])], "symbol string, time timestamp, bad int")
    out = events.halts(x, {"P1": (F.col("bad") > 0, 3)})
    assert sorted(h["time"].hour for h in out.collect()) == [3, 8]

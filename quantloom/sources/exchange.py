"""Fetching from an exchange's REST interface, on the driver and with an injected transport: paging, retries, tasks and their outcomes.

`transport(url, params) -> (status, headers, body)` and `sleep` are arguments, so nothing here needs a network to be tested."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

# Fixed values of the interface.
RETRYABLE = {408, 425, 429, 500, 502, 503, 504}
FATAL = {400, 401, 403, 404, 418, 451}
PAGE, HOUR_MS = 1000, 3_600_000
ENDPOINTS = {"spot": "https://api.binance.com/api/v3/klines", "perp_usdt": "https://fapi.binance.com/fapi/v1/klines", "perp_funding": "https://fapi.binance.com/fapi/v1/fundingRate"}
SOURCES = {"spot": "binance_spot", "perp_usdt": "binance_fapi", "perp_funding": "binance_fapi"}

Transport = Callable[[str, dict], tuple[int, dict, object]]


class ApiError(RuntimeError):
    """A request failed for good."""


class RateLimitError(ApiError):
    """The exchange asked to stop."""


class Client:
    """GET with retries: exponential waits up to a minute, or what Retry-After asks for.  A transport that times out or loses its connection
    (OSError, which TimeoutError and ConnectionError are) is tried again like a retryable status."""

    def __init__(self, transport: Transport, sleep: Callable[[float], None], tries: int = 5, base: float = 1.0, longest: float = 60.0) -> None:
        self.transport, self.sleep, self.tries, self.base, self.longest = transport, sleep, tries, base, longest

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *exc: object) -> None:
        """Closes the transport, if it can be closed."""
        if close := getattr(self.transport, "close", None):
            close()

    def get(self, url: str, params: dict) -> object:
        for attempt in range(self.tries):
            try:
                status, headers, body = self.transport(url, params)
            except OSError as e:
                if attempt + 1 == self.tries:
                    raise ApiError(f"{type(e).__name__} after {self.tries} tries: {e}") from e
                self.sleep(min(self.longest, self.base * 2**attempt))
                continue
            if 200 <= status < 300:
                return body
            if status == 418:
                raise RateLimitError(f"{status}: banned")
            if status not in RETRYABLE:
                raise ApiError(f"{status}: {body}")
            if attempt + 1 < self.tries:
                asked = headers.get("Retry-After")
                self.sleep(float(asked) if asked else min(self.longest, self.base * 2**attempt))
        raise (RateLimitError if status == 429 else ApiError)(f"{status} after {self.tries} tries")


class EarlierClient(Client):
    """The earlier study's client, which knows no rate limits: a ban is an error like any other."""

    def get(self, url: str, params: dict) -> object:
        try:
            return super().get(url, params)
        except RateLimitError as e:
            raise ApiError(str(e)) from e


def endpoint(market: str) -> str:
    if market not in ENDPOINTS:
        raise ValueError(f"unknown market: {market}")
    return ENDPOINTS[market]


def pages(client: Client, market: str, symbol: str, start_ms: int, end_ms: int, step: int, time_of: Callable[[object], int], pause: float = 0.2) -> Iterator[list]:
    """Pages of [start, end), each from the last row's time plus step; a short page is the last."""
    cursor = start_ms
    while cursor < end_ms:
        params = {"symbol": symbol, "startTime": cursor, "endTime": end_ms - 1, "limit": PAGE} | ({} if market == "perp_funding" else {"interval": "1h"})
        rows = client.get(endpoint(market), params)
        if not rows:
            return
        yield rows
        if len(rows) < PAGE:
            return
        cursor = time_of(rows[-1]) + step
        client.sleep(pause)


def fetch_klines(client: Client, market: str, symbol: str, start_ms: int, end_ms: int, now_ms: int) -> list[list]:
    """Raw bars, once each (the last wins), in order, without the hour that is still open."""
    end_ms = min(end_ms, now_ms - HOUR_MS)
    found = {r[0]: r for page in pages(client, market, symbol, start_ms, end_ms, HOUR_MS, lambda r: r[0]) for r in page if r[6] < now_ms}
    return [found[t] for t in sorted(found)]


def fetch_funding(client: Client, symbol: str, start_ms: int, end_ms: int) -> list[dict]:
    found = {r["fundingTime"]: r for page in pages(client, "perp_funding", symbol, start_ms, end_ms, 1, lambda r: r["fundingTime"]) for r in page}
    return [found[t] for t in sorted(found)]


def first_bar(client: Client, market: str, symbol: str) -> int | None:
    """The open time of the earliest bar there is."""
    rows = client.get(endpoint(market), {"symbol": symbol, "interval": "1h", "startTime": 0, "limit": 1})
    return rows[0][0] if rows else None


def snapshot(fetch_json: Callable[[str], object], urls: dict[str, str], now: Callable[[], datetime], most: timedelta = timedelta(seconds=5)) -> tuple[dict, dict]:
    """All endpoints' bodies and the times at which they came; refused if these lie too far apart to be one moment."""
    bodies, times = {}, {}
    for name, url in urls.items():
        bodies[name] = fetch_json(url)
        times[name] = now()
    if max(times.values()) - min(times.values()) > most:
        raise ApiError("the endpoints were not read at one moment")
    return bodies, times


@dataclass(frozen=True)
class Task:
    market: str
    symbol: str


@dataclass(frozen=True)
class Outcome:
    task: Task
    result: str
    rows: int = 0
    detail: str = ""


def resume(last_ms: int | None, listing_ms: int | None, end_ms: int, step: int, cold_start: bool) -> tuple[int | None, str]:
    """Where a task starts, or why it does not."""
    if last_ms is not None:
        return (last_ms + step, "resume") if last_ms + step < end_ms else (None, "nothing")
    if not cold_start:
        return None, "skipped_cold_start"
    return (listing_ms, "cold_start") if listing_ms is not None else (None, "skipped_no_listing")


def run(tasks: list[Task], work: Callable[[Task], tuple[str, int]]) -> tuple[list[Outcome], bool]:
    """Each task's outcome, and whether a rate limit ended the phase; other failures stay with their task."""
    out = []
    for t in tasks:
        try:
            result, rows = work(t)
            out.append(Outcome(t, result, rows))
        except RateLimitError as e:
            out.append(Outcome(t, "rate_limited", detail=str(e)))
            return out, True
        except Exception as e:  # noqa: BLE001  one symbol's failure must not stop the others
            out.append(Outcome(t, "failed", detail=f"{type(e).__name__}: {e}"))
    return out, False


def exit_code(aborted: bool, failed: int) -> int:
    """0 for a clean run, 10 with failures, 11 after a rate limit."""
    return 11 if aborted else 10 if failed else 0

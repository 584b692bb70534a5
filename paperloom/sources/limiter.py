"""Spacing and backing off of calls to a provider, inside the one task that reads it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class RateLimiter:
    """Calls at least `interval` seconds apart, whatever the number of threads. wait() gives the seconds waited."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self._clock, self._sleep = interval, clock, sleep
        self._lock = threading.Lock()
        self._next = float("-inf")

    def wait(self) -> float:
        with self._lock:
            pause = max(0.0, self._next - self._clock())
            if pause:
                self._sleep(pause)
            self._next = self._clock() + self.interval
            return pause

    def tighten(self, factor: float = 1.2, most: float = 8.0) -> None:
        """After a refusal: wider spacing, up to `most` seconds."""
        with self._lock:
            self.interval = min(most, self.interval * factor)


def retry_pause(attempt: int, retry_after: str | None, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the next attempt: what the provider asks for, but no less than the doubling pause."""
    try:
        asked = float(retry_after or 0)
    except ValueError:
        asked = 0.0
    return max(asked, min(most, base * 2**attempt))


def get(fetch: Callable[[], tuple[int, dict[str, str], str]], limiter: RateLimiter | None = None, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One call with retries: fetch() gives (status, headers, body). Result: status, body, error, waited_s, retries."""
    waited, status, body = 0.0, 0, ""
    for attempt in range(retries + 1):
        if limiter:
            waited += limiter.wait()
        try:
            status, headers, body = fetch()
        except OSError as e:
            status, headers, body = 0, {}, str(e)
        if status == 200:
            return {"status": 200, "body": body, "error": None, "waited_s": waited, "retries": attempt}
        if attempt == retries or status not in (0, 429, 500, 502, 503):
            break
        if status == 429 and limiter:
            limiter.tighten()
        pause = retry_pause(attempt, headers.get("Retry-After"))
        waited += pause
        sleep(pause)
    return {"status": status, "body": "", "error": f"http_{status}:{body[:120]}" if status else body, "waited_s": waited, "retries": attempt}

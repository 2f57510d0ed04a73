"""A circuit breaker for calls to services, and what counts as a fatal error."""

from __future__ import annotations

import re

# Messages of errors that will not go away by trying again.
FATAL = r"401|403|429|quota|额度|配额|rate.?limit|unauthorized|forbidden|api key"


def is_fatal(message: str) -> bool:
    return bool(re.search(FATAL, message, re.I))


class Breaker:
    """Opens after `threshold` failures in a row, or at once on a fatal one, and closes again when its pause is over. Time is given."""

    def __init__(self, threshold: int, pause_ms: int, fatal_pause_ms: int | None = None):
        self.threshold, self.pauses = threshold, (pause_ms, pause_ms if fatal_pause_ms is None else fatal_pause_ms)
        self.failures, self.until = 0, 0

    def is_open(self, now_ms: int) -> bool:
        if self.until and now_ms >= self.until:
            self.failures = self.until = 0
        return bool(self.until)

    def success(self) -> None:
        self.failures = self.until = 0

    def failure(self, now_ms: int, fatal: bool = False) -> None:
        self.failures = 0 if fatal else self.failures + 1
        if fatal or self.failures >= self.threshold:
            self.until = now_ms + self.pauses[fatal]

"""Retries of steps that fail for a while: listings, small reads and writes, the move of a table to a new version."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

R = TypeVar("R")

# HTTP status codes and reasons that services give when the same request may succeed later.
STATUS_CODES = (429, 500, 503)
UNAUTHORIZED = 401
REASONS = ("rateLimitExceeded", "userRateLimitExceeded", "backendError", "jobRateLimitExceeded")

# Java's errors of connections that broke or were not answered in time.
BROKEN = ("SocketTimeoutException", "ConnectException", "NoHttpResponseException", "SlowDown")

_STATUS = re.compile(r"\b(?:status(?: code)?|http|code)\W{0,3}(\d{3})\b", re.IGNORECASE)


def transient(error: Exception, include_unauthorized: bool = False) -> bool:
    """Whether the error's text names a status code or a reason that passes. A 401 may be either, so the caller chooses."""
    text = str(error)
    codes = {int(x) for x in _STATUS.findall(text)}
    wanted = {*STATUS_CODES, UNAUTHORIZED} if include_unauthorized else set(STATUS_CODES)
    return bool(codes & wanted) or any(x in text for x in (*REASONS, *BROKEN))


@dataclass(frozen=True)
class Retries:
    """Up to ``attempts`` calls; waits double from ``first_wait`` to ``longest_wait`` seconds."""

    attempts: int = 5
    first_wait: float = 0.5
    longest_wait: float = 30.0
    include_unauthorized: bool = False

    def call(self, action: Callable[[], R]) -> R:
        """The action's result. It may run several times, so it must be one that can; the last error is raised."""
        wait = self.first_wait
        for left in range(self.attempts - 1, -1, -1):
            try:
                return action()
            except Exception as e:
                if not left or not transient(e, self.include_unauthorized):
                    raise
            time.sleep(min(wait, self.longest_wait))
            wait *= 2
        raise ValueError("at least one attempt is needed")


DEFAULT = Retries()

"""How many bad records a partition may have before it fails."""

from __future__ import annotations


class TooManyErrors(RuntimeError):
    pass


class ErrorBudget:
    """Fails at `threshold` <= 0 on any error, else on `least` errors or more that are over threshold of the records.

    Judged when a partition has been read, or after each error with `early`.
    """

    def __init__(self, threshold: float = 0.0001, least: int = 2, early: bool = False):
        self.threshold, self.least, self.early = threshold, least, early
        self.records = self.errors = 0
        self.last: Exception | None = None

    def good(self) -> None:
        self.records += 1

    def bad(self, error: Exception) -> None:
        self.records += 1
        self.errors += 1
        self.last = error
        if self.threshold <= 0:
            raise TooManyErrors(f"bad record: {error}") from error
        if self.early:
            self.close()

    def close(self) -> None:
        if self.errors and (self.threshold <= 0 or self.errors >= self.least and self.errors / self.records > self.threshold):
            raise TooManyErrors(f"{self.errors} of {self.records} records are bad, last: {self.last}") from self.last

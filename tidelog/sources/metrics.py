"""Counters and histograms of a table's work, kept on the driver."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Histogram:
    """How often values fell between powers of two, with their sum and extremes."""

    count: int = 0
    total: float = 0.0
    least: float = float("inf")
    most: float = float("-inf")
    below: Counter[int] = field(default_factory=Counter)  # values less than 2 ** k and not less than 2 ** (k - 1)

    def add(self, value: float) -> None:
        self.count += 1
        self.total += value
        self.least, self.most = min(self.least, value), max(self.most, value)
        self.below[max(0, int(value)).bit_length()] += 1

    def quantile(self, share: float) -> float:
        """A power of two that at least this share of the values does not exceed, or the greatest value if that is less."""
        seen = 0
        for k in sorted(self.below):
            seen += self.below[k]
            if seen >= share * self.count:
                return min(float(1 << k), self.most)
        return 0.0


class Metrics(Counter[str]):
    """Counters by name; ``histograms`` has milliseconds and sizes by name.  All are handed to a recorder as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.histograms: dict[str, Histogram] = {}
        self.recorder: Callable[[str, int], None] | None = None

    def count(self, name: str, by: int = 1) -> None:
        self[name] += by
        if self.recorder is not None:
            self.recorder(name, by)

    def observe(self, name: str, value: float) -> None:
        self.histograms.setdefault(name, Histogram()).add(value)
        if self.recorder is not None:
            self.recorder(name, round(value))

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Observes how many milliseconds the block takes, however it ends."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.observe(name, 1000 * (time.monotonic() - began))

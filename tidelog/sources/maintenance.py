"""Merging and clearing in the background, for tables that are written all the time."""

from __future__ import annotations

import threading

from tidelog.errors import TableError
from tidelog.sources.table import KeyedTable


class Maintainer:
    """Every ``interval_s`` merges the table if ``log_files`` wait beyond its base, and clears unused files.

    Use it on a table object of its own: a commit that another writer wins is
    given up, and tried again at the next turn.
    """

    def __init__(self, table: KeyedTable, log_files: int = 20, interval_s: float = 1.0):
        self._table, self._log_files, self._interval = table, log_files, interval_s
        self._stop, self._thread = threading.Event(), None
        self.turns = self.merges = self.lost = 0

    def tick(self) -> bool:
        """One turn; whether it merged."""
        self.turns += 1
        try:
            self._table.refresh()
            m = self._table.snapshot()
            merged = self._table.compact() if len(m.pending) >= self._log_files else self._table.merge()
            self._table.vacuum()
        except TableError:
            self.lost += 1
            return False
        self.merges += merged
        return merged

    def start(self) -> None:
        def run() -> None:
            while not self._stop.wait(self._interval):
                self.tick()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()

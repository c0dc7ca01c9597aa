"""A reader's copy: a base snapshot and the tail of operations after it.

Reads are the tail over the base.  The tail is advanced from the table's feed
and never goes back: what is not newer than what it holds is dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import BelowRetentionError, TableError
from tidelog.operators import overlay, resolve
from tidelog.sources.table import KeyedTable


class TableLog:
    """Operations after a seq, up to what the table showed when it was opened or last refreshed."""

    def __init__(self, table: KeyedTable):
        self._table = table

    def latest_seq(self) -> int:
        return self._table.read_seq()

    def refresh(self) -> None:
        self._table.refresh()

    def since(self, seq: int) -> DataFrame:
        return self._table.operations(seq, self.latest_seq())


@dataclass
class _Held:
    base: KeyedTable
    base_seq: int
    visible: int


class Replica:
    def __init__(self, spark: SparkSession, path: str, log: TableLog | None = None):
        self._spark, self._path = spark, path
        self._log = log or TableLog(KeyedTable.open_read_only(spark, path))
        self._rebases, self._warmup_ms, self._applied = 0, 0.0, 0
        self._held = self._fresh()

    def _fresh(self) -> _Held:
        base = KeyedTable.open_read_only(self._spark, self._path)
        return _Held(base, base.read_seq(), base.read_seq())

    @property
    def visible_seq(self) -> int:
        return self._held.visible

    def advance(self) -> int:
        """Take in what the log has after the visible seq; how many operations."""
        self._log.refresh()
        latest, before = self._log.latest_seq(), self._held.visible
        if latest <= before:
            return 0
        self._log.since(before)  # raises if they are no longer kept
        self._held.visible = latest
        self._applied += latest - before
        return latest - before

    def tail(self) -> DataFrame:
        """The newest operation of each key after the base."""
        held = self._held
        ops = self._log.since(held.base_seq).where(F.col("seq") <= held.visible)
        return resolve.newest(ops, held.base.pk)

    def tail_length(self) -> int:
        """How many keys the tail holds."""
        return 0 if self._held.visible == self._held.base_seq else self.tail().count()

    def view(self) -> DataFrame:
        """All live rows: the tail over the base."""
        held = self._held
        base = held.base.state()
        if held.visible == held.base_seq:
            return base.select(*held.base.schema.names)
        return overlay.overlay(base, self.tail(), held.base.pk).select(*held.base.schema.names)

    def get(self, *key: Any) -> Row | None:
        """A hit in the tail wins, a deletion there hides the base, a miss falls through."""
        held = self._held
        if held.visible > held.base_seq:
            hit = self.tail().where(resolve.is_key(held.base.pk, key)).first()
            if hit is not None:
                return self._spark_row(hit) if hit["op"] == 1 else None
        return held.base.get(*key)

    def _spark_row(self, row: Row) -> Row:
        names = self._held.base.schema.names
        return Row(*names)(*[row[n] for n in names])

    def rebase(self) -> None:
        """Load the newest snapshot and drop the tail, then catch up."""
        self._held = self._fresh()
        self._rebases += 1
        self.advance()

    def rebase_hotswap(self, timeout_s: float = 60.0, warm: Callable[[KeyedTable], Any] | None = None) -> None:
        """Build base and tail aside while reads go on, then swap; an error, and no swap, once it takes too long.

        What is built too late is dropped when it is done.
        """
        began = time.time()

        def build() -> _Held:
            fresh = self._fresh()
            if warm is not None:
                warm(fresh.base)
            self._log.refresh()
            fresh.visible = max(fresh.visible, self._log.latest_seq())
            return fresh

        pool = ThreadPoolExecutor(1)
        try:
            fresh = pool.submit(inheritable_thread_target(self._spark)(build)).result(timeout_s)
        except TimeoutError as e:
            raise TableError(f"the new base took over {timeout_s:g} s") from e
        finally:
            pool.shutdown(wait=False)
        self._held, self._warmup_ms = fresh, (time.time() - began) * 1000
        self._rebases += 1

    def advance_or_recover(self, timeout_s: float = 60.0) -> str:
        """``advanced``, or ``recovered`` by a new base if the log no longer reaches back far enough."""
        try:
            self.advance()
            return "advanced"
        except BelowRetentionError:
            self.rebase_hotswap(timeout_s)
            return "recovered"

    def stats(self) -> dict[str, Any]:
        return {
            "visible_seq": self._held.visible, "base_seq": self._held.base_seq,
            "tail_length": self.tail_length(), "operations_applied": self._applied,
            "rebase_count": self._rebases, "last_warmup_ms": self._warmup_ms,
        }

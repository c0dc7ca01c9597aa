"""The table as plain Python: rows in and out as dictionaries.

For callers that keep one table and do not think in DataFrames.  Everything
here is a thin shape over :class:`tidelog.sources.table.KeyedTable`, which is
``Database.table``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from tidelog.errors import InvalidArgumentError, SchemaMismatchError
from tidelog.schema import ColumnSpec, TableSchema, column
from tidelog.sources.mirror import Mirror
from tidelog.sources.replica import Replica
from tidelog.sources.table import KeyedTable, Options


def _columns(columns: Sequence[Any], primary_key: Sequence[str]) -> tuple[ColumnSpec, ...]:
    """Columns given as (name, type), (name, type, nullable), dictionaries, or as they are."""
    found = []
    for c in columns:
        if isinstance(c, ColumnSpec):
            found.append(c)
            continue
        spec = dict(c) if isinstance(c, dict) else dict(zip(("name", "type", "nullable"), c, strict=False))
        if not {"name", "type"} <= set(spec):
            raise InvalidArgumentError(f"a column has a name and a type: {c!r}")
        spec.setdefault("nullable", spec["name"] not in primary_key)
        found.append(column(**spec))
    return tuple(found)


class Database:
    """One table at a path.  The primary key is the first column unless given.

    ``memtable_size_mb`` is taken for callers that pass it; a batch is written at
    once, so nothing grows in memory that it could bound.
    """

    def __init__(
        self,
        path: str,
        table_name: str,
        columns: Sequence[Any],
        primary_key: Sequence[str] | None = None,
        memtable_size_mb: int = 64,
        read_only: bool = False,
        spark: SparkSession | None = None,
        options: Options | None = None,
    ):
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if not columns:
            raise SchemaMismatchError("a table has at least one column")
        first = columns[0]
        name = first.name if isinstance(first, ColumnSpec) else first["name"] if isinstance(first, dict) else first[0]
        key = tuple(primary_key) if primary_key else (name,)
        schema = TableSchema(table_name, _columns(columns, key), key)
        if read_only:
            self.table = KeyedTable.open_read_only(spark, path)
            self.table.schema.check_reopen(schema)
        else:
            self.table = KeyedTable.open(spark, path, schema, options)
        self._spark, self._mirror = spark, None

    def put(self, row: dict[str, Any]) -> int:
        return self.table.put(row)

    def put_batch(self, rows: Sequence[dict[str, Any]]) -> int:
        return self.table.put_batch(rows)

    def get(self, *key: Any) -> dict[str, Any] | None:
        row = self.table.get(*key)
        return None if row is None else row.asDict()

    def delete(self, *key: Any) -> int:
        return self.table.delete(*key)

    def scan(self, start: Any = None, end: Any = None) -> list[dict[str, Any]]:
        """Live rows with ``start <= key < end`` in key order, all of them: for small tables and ranges."""
        return [r.asDict() for r in self.table.scan(start, end).collect()]

    def flush(self) -> None:
        self.table.flush()

    def compact(self) -> None:
        self.table.compact()

    def stats(self) -> dict[str, Any]:
        """The snapshot with its levels and files; parts that do not exist here are empty."""
        m, levels = self.table.snapshot(), []
        for level in sorted({f.level for f in m.files}):
            own = [f for f in m.files if f.level == level]
            levels.append(
                {
                    "level": level,
                    "file_count": len(own),
                    "total_bytes": sum(f.bytes for f in own),
                    "total_rows": sum(f.rows for f in own),
                    "live_rows": sum(f.live_rows for f in own),
                    "files": [
                        {
                            "path": f.path,
                            "file_size": f.bytes,
                            "num_rows": f.rows,
                            "seq_range": (f.seq_min, f.seq_max),
                            "has_dv": bool(m.deletions),
                        }
                        for f in own
                    ],
                }
            )
        return {
            "snapshot_id": m.snapshot_id,
            "current_seq": self.table.read_seq(),
            "base_seq": m.base_seq,
            "memtable": {"active_size_bytes": 0, "active_entry_count": 0, "immutable_count": 0},
            "levels": levels,
            "cache": {"capacity": 0, "size": 0, "hit_count": 0, "miss_count": 0},
            "metrics": dict(self.table.metrics),
        }

    def __repr__(self) -> str:
        s = self.stats()
        files = sum(x["file_count"] for x in s["levels"])
        return f"Database(table={self.table.schema.name!r}, seq={s['current_seq']}, files={files}, levels={len(s['levels'])})"

    def refresh(self) -> None:
        self.table.refresh()

    def close(self) -> None:
        self.table.close()

    def is_closed(self) -> bool:
        return self.table.is_closed()

    def catalog_path(self) -> str:
        return self.table.catalog_path()

    def read_seq(self) -> int:
        return self.table.read_seq()

    def add_column(self, new: Any) -> None:
        self.table.add_column(_columns([new], self.table.pk)[0])

    def changes(self, since: int = 0, max_rows: int = 1000) -> list[dict[str, Any]]:
        """A page of the change feed after ``since``."""
        return [r.asDict() for r in self.table.cursor(since).next_batch(max_rows)]

    def export(self, path: str) -> str:
        return self.table.export(path)

    def replica(self) -> Replica:
        return Replica(self._spark, self.table.catalog_path())

    # mirroring

    def mirror_to(self, path: str) -> None:
        """Name the mirror, and bring it up to date."""
        self._mirror = Mirror(self.table, path)
        self._mirror.run()

    def mirror_seq(self) -> int:
        return 0 if self._mirror is None else self._mirror.mirror_seq()

    def mirror_lag_secs(self) -> float | None:
        return None if self._mirror is None else self._mirror.lag_s()

    def await_mirror(self, seq: int, timeout_s: float = 60.0) -> bool:
        if self._mirror is None:
            raise InvalidArgumentError("no mirror is named")
        return self._mirror.await_seq(seq, timeout_s)

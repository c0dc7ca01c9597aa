"""What can go wrong, as exceptions."""

from __future__ import annotations


class TableError(Exception):
    """Base of all errors of a table."""


class CorruptionError(TableError):
    """Stored bytes do not have the form they must have."""


class SchemaMismatchError(TableError):
    """Rows or a declared schema do not fit the table's schema."""


class NotFoundError(TableError):
    """A table, snapshot or file is not there."""


class InvalidArgumentError(TableError):
    """An argument has no meaning here."""


class ReadOnlyError(TableError):
    """A write to a table that was opened for reading."""


class ClosedError(TableError):
    """A write to a closed table."""


class AlreadyExistsError(TableError):
    """Another writer committed the same snapshot first."""


class CompactionError(TableError):
    """A compaction's inputs changed before it could commit."""


class BelowRetentionError(TableError):
    """The change feed was asked for operations that are no longer kept."""

    def __init__(self, requested: int, low_water: int):
        super().__init__(f"changes after {requested} were asked for, but only those after {low_water} are kept")
        self.requested, self.low_water = requested, low_water

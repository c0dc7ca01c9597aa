"""Compaction, and the positions of superseded rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.resolve import DELETE, distinct_keys, in_range, is_key, newest, same_key


def compact(
    ops: DataFrame, pk: Sequence[str], oldest_snapshot: int | None = None, drop_deletions: bool = False
) -> DataFrame:
    """The operations that a merge keeps.

    The newest of each key stays; an older one stays only if a snapshot may
    still need it (``seq >= oldest_snapshot``).  A deletion that is the newest
    goes if ``drop_deletions`` (nothing older lies below the output) and no
    snapshot may need it.  Without ``oldest_snapshot`` no snapshot needs anything.

    Operations that a snapshot may need are never ranked, so that the rank limit
    holds for the others and a busy key's versions do not meet in one task.
    """
    old = ops if oldest_snapshot is None else ops.where(F.col("seq") < oldest_snapshot)
    kept = newest(old, pk)
    if drop_deletions:
        kept = kept.where(F.col("op") != DELETE)
    if oldest_snapshot is None:
        return kept
    recent = ops.where(F.col("seq") >= oldest_snapshot)
    keys = distinct_keys(recent, pk, "_r_{}")
    return recent.unionByName(kept.join(keys, same_key(kept, keys, pk, "_r_{}"), "left_anti"))


def drops_deletions(output_level: int, level_targets: int) -> bool:
    """Deletions may go only below every level that has a target size."""
    return output_level > level_targets


def with_positions(files: DataFrame) -> DataFrame:
    """Rows read from Parquet, with the file and the row's number in it."""
    return files.select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")
    )


def keys_in_range(rows: DataFrame, pk: Sequence[str], low: Sequence[Any], high: Sequence[Any]) -> DataFrame:
    """Keys and positions with ``low <= pk <= high``; no other column is read."""
    inside = in_range(pk, low, None) & (in_range(pk, None, high) | is_key(pk, high))
    return rows.where(inside).select(*pk, "file_path", "row_index")


def file_scan(
    rows: DataFrame, pk: Sequence[str], low: Sequence[Any] | None = None, high: Sequence[Any] | None = None,
    marked: DataFrame | None = None,
) -> DataFrame:
    """What each stored file has to say about the keys ``low <= pk < high``: the newest operation of each key in it.

    Deletions are kept, since they may hide rows of other files; marked rows are left out.
    """
    found = rows.where(in_range(pk, low, high))
    if marked is not None:
        found = without_positions(found, marked)
    return newest(found, ["file_path", *pk])


def superseded(
    rows: DataFrame, pk: Sequence[str], keys: DataFrame, marked: DataFrame | None = None
) -> DataFrame:
    """(file_path, row_index) of every stored version of ``keys``, but for those in ``marked``.

    Only key columns and positions are read.
    """
    keys = distinct_keys(keys, pk, "_{}")
    found = rows.join(keys, same_key(rows, keys, pk, "_{}"), "left_semi").select("file_path", "row_index")
    return found if marked is None else found.join(marked, ["file_path", "row_index"], "left_anti")


def replaced(rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    """(file_path, row_index) of every row that is not the newest of its key.

    The newest are found under a rank limit and taken from all, so that a busy
    key's versions never meet in one task.
    """
    last = newest(rows.select("seq", *pk, "file_path", "row_index"), pk).select("file_path", "row_index")
    return rows.select("file_path", "row_index").join(last, ["file_path", "row_index"], "left_anti")


def union_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positions of both; never fewer than before."""
    return old.select("file_path", "row_index").union(new.select("file_path", "row_index")).distinct()


def without_positions(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows whose position is not marked."""
    return rows.join(marked.select("file_path", "row_index"), ["file_path", "row_index"], "left_anti")


def lineage(rows: DataFrame, first_row_ids: DataFrame) -> DataFrame:
    """Adds ``row_id``: a file's first row id (file_path, first_row_id) plus the row's number in it."""
    return rows.join(first_row_ids, "file_path").withColumn("row_id", F.col("first_row_id") + F.col("row_index"))

"""A fresh tail of operations over an older base of live rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.resolve import PUT, newest, same_key


def apply_tail(tail: DataFrame, more: DataFrame, pk: Sequence[str]) -> DataFrame:
    """One operation per key, the newest; what is not newer than what is held goes."""
    return newest(tail.unionByName(more), pk)


def overlay(base: DataFrame, tail: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Live rows: those of the tail, and those of the base whose key the tail does not have.

    ``base`` has the columns of ``tail`` without ``op``.  A deletion in the tail
    hides the base's row.
    """
    held = newest(tail, pk)
    touched = held.select(*[F.col(k).alias(f"_t_{k}") for k in pk])
    below = base.join(touched, same_key(base, touched, pk, "_t_{}"), "left_anti")
    return below.unionByName(held.where(F.col("op") == PUT).drop("op"))

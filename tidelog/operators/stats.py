"""Statistics of files, levels and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_stats(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("file_path",)) -> DataFrame:
    """Per group: rows, and of each column its values, nulls, least and greatest, in one pass."""
    parts: list[Column] = [F.count("*").alias("n_rows")]
    for c in columns:
        parts += [
            F.count(c).alias(f"{c}_values"),
            F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return rows.groupBy(*by).agg(*parts)


def level_stats(files: DataFrame) -> DataFrame:
    """Per level of (level, bytes, rows, live_rows): files, bytes, physical and live rows."""
    return files.groupBy("level").agg(
        F.count("*").alias("n_files"),
        F.sum("bytes").alias("bytes"),
        F.sum("rows").alias("rows"),
        F.sum("live_rows").alias("live_rows"),
    )

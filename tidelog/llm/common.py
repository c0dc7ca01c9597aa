"""Shared pieces of the corpus operators: words, samples, and tables in the shared folder.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  ``bytes.split()`` without
arguments splits on exactly those six bytes, so words are cut on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.workspace import scratch

#: Rows of an Arrow batch that are worked on together, so that word lists stay small.
CHUNK_ROWS = 128
#: So many rows of each label are in a sample, or all that it has.
LEAST_OF_LABEL = 200


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors.  The table lives as long
    as the session, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(labelled: DataFrame, keys: list[str], bound: int, label: str) -> DataFrame:
    """About ``bound`` rows of ``labelled``, chosen by a hash of ``keys``; all rows if there are no more.

    Labels keep their proportions, but of each at least about
    :data:`LEAST_OF_LABEL` rows are taken, all if it has no more; so the sample
    has about ``bound + LEAST_OF_LABEL * labels`` rows at most.  A row is in or
    out by its own label and keys, so no task sees more than its share and
    reruns choose the same rows.
    """
    counts = dict(map(tuple, labelled.groupBy(label).count().collect()))  # a row for each label
    n = sum(counts.values())
    if n <= bound:
        return labelled
    scale = 1 << 30
    limit = F.lit(int(scale * bound / n))
    raised = {x: min(1, LEAST_OF_LABEL / m) for x, m in counts.items() if m * bound < LEAST_OF_LABEL * n}
    if raised:
        pairs = [F.lit(x) for label_share in raised.items() for x in (label_share[0], int(scale * label_share[1]))]
        limit = F.coalesce(F.create_map(*pairs)[F.col(label)], limit)
    return labelled.where(F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(scale)) < limit)


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[bytes | None]]]:
    """UTF-8 bytes of a text column, a chunk of rows at a time: (first row, texts)."""
    column = batch.column(name)
    for at in range(0, batch.num_rows, CHUNK_ROWS):
        yield at, column.slice(at, CHUNK_ROWS).cast(pa.binary()).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: unless the session has its own setting, hand Python 1,000 rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to columns, called a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)

"""Structured Streaming over the log: the tail as a sink, and labels with state.

Files of one micro-batch come in no particular order, so operations are ordered
by ``seq`` inside a batch, and one that is not newer than what its key holds is
dropped.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.feed import DELETE_LABEL, INSERT_LABEL, UPDATE_LABEL
from tidelog.operators.resolve import newest
from tidelog.schema import TableSchema
from tidelog.sources.storage import Storage


def read_log(
    spark: SparkSession, path: str, schema: TableSchema, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """Operations of a table as they are committed.  The limits on a micro-batch are its back-pressure."""
    source = spark.readStream.schema(schema.log_struct())
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        source = source.option("maxBytesPerTrigger", max_bytes)
    return source.parquet(f"{path.rstrip('/')}/log/*")


class TailSink:
    """For ``foreachBatch``: keeps the newest operation of each key as Parquet below the folder ``path``.

    A batch adds its own newest operations as a part; every ``merge_every``
    parts are merged with what was merged before.  Parts carry their epoch and
    count once they are whole, so a sink that is made anew goes on where the last
    one stopped, and a batch that is delivered again changes nothing.  What a
    merge has replaced goes at the merge after it, when no reader holds it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, merge_every: int = 10):
        self._spark, self._schema, self._every = spark, schema, merge_every
        self._store = Storage(spark, path)
        self._merged, self._parts, self._old, self.last_epoch = self._found()

    def _found(self) -> tuple[str | None, list[str], list[str], int]:
        """The newest merged copy, the parts after it, all that they replace, and the last epoch."""
        whole = []
        for folder in self._store.folders():
            m = re.fullmatch(r"(merged|part)-(\d+)-[0-9a-f]+", folder)
            if m and self._store.exists(f"{folder}/_SUCCESS"):
                whole.append((int(m[2]), m[1], folder))
        merged = max((x for x in whole if x[1] == "merged"), default=(-1, "", None))
        parts = {epoch: folder for epoch, kind, folder in sorted(whole) if kind == "part" and epoch > merged[0]}
        old = [folder for _, _, folder in whole if folder != merged[2] and folder not in parts.values()]
        return merged[2], [parts[k] for k in sorted(parts)], old, max([merged[0], *parts])

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> str:
        folder = f"{kind}-{epoch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(self._store.url(folder))
        return folder

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.last_epoch:
            return
        rows = newest(batch.select(*self._schema.log_struct().names), list(self._schema.primary_key))
        self._parts.append(self._write(rows, "part", epoch))
        self.last_epoch = epoch
        if len(self._parts) >= self._every:
            gone, old = [*self._parts, *([self._merged] if self._merged else [])], self._old
            self._merged, self._parts, self._old = self._write(self.tail(), "merged", epoch), [], gone
            for folder in old:
                self._store.delete(folder)

    def tail(self) -> DataFrame:
        """One operation per key, the newest of all batches so far."""
        struct = self._schema.log_struct()
        held = [self._store.url(f) for f in ([self._merged] if self._merged else []) + self._parts]
        if not held:
            return self._spark.createDataFrame([], struct)
        return newest(self._spark.read.schema(struct).parquet(*held), list(self._schema.primary_key))


def _as_text(c: Column, type: T.DataType) -> Column:
    """A value as text that :func:`_from_text` turns back into it exactly; null stays null."""
    return F.base64(c) if isinstance(type, T.BinaryType) else c.cast("string")


def _from_text(c: Column, type: T.DataType) -> Column:
    return F.unbase64(c) if isinstance(type, T.BinaryType) else c.cast(type)


def label_stream(operations: DataFrame, schema: TableSchema) -> DataFrame:
    """The labelled feed of a stream: ``seq``, ``op`` (a label) and the row, deletions with what they removed.

    State is one row for each key: the newest seq, whether the key is live, and
    its row.  Rows pass through Python as text, so that no value changes: pandas
    would make floats of whole numbers beside a null, and nulls of NaN.  A key's
    operations of a micro-batch are labelled together.
    """
    names, n = schema.names, len(schema.names)
    texts = [f"t{i}" for i in range(n)]
    fields = [T.StructField(t, T.StringType()) for t in texts]
    out = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *fields])
    state = T.StructType([T.StructField("seq", T.LongType()), T.StructField("live", T.BooleanType()), *fields])

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        seq, live, *row = held.get if held.exists else (0, False, *[None] * n)
        ops = pd.concat(list(parts))
        ops = ops[ops["seq"] > seq].drop_duplicates("seq").sort_values("seq")
        if not len(ops):
            return
        puts, rows = ops["op"].to_numpy() == 1, ops[texts].to_numpy(dtype=object)
        rows[~puts] = None
        # what was there before each operation: the row of the one before it
        lived, before = np.append([live], puts[:-1]), np.concatenate([np.array([row], dtype=object), rows[:-1]])
        labels = np.where(puts, np.where(lived, UPDATE_LABEL, INSERT_LABEL), DELETE_LABEL)
        shown = np.where(puts[:, None], rows, before)
        held.update((int(ops["seq"].iloc[-1]), bool(puts[-1]), *rows[-1]))
        found = pd.DataFrame(shown, columns=texts, dtype=object)
        found.insert(0, "op", labels)
        found.insert(0, "seq", ops["seq"].to_numpy())
        yield found

    chosen = operations.select("seq", "op", *[_as_text(F.col(c.name), c.spark_type).alias(t) for c, t in zip(schema.columns, texts, strict=True)])
    keys = [texts[names.index(k)] for k in schema.primary_key]  # as text, so that the zeros are two
    labelled = chosen.groupBy(*keys).applyInPandasWithState(run, out, state, "append", "NoTimeout")
    return labelled.select("seq", "op", *[_from_text(F.col(t), c.spark_type).alias(c.name) for c, t in zip(schema.columns, texts, strict=True)])


def counts_by_window(operations: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Operations of each kind in windows of event time; later ones than ``late`` are left out."""
    return (
        operations.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"), "op")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), "op", "n")
    )

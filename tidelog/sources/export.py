"""Export of the resolved snapshot as a table of a public open format (version 2 of its specification).

``data`` holds one row per live key in the user's columns alone, so a plain
Parquet reader needs no deduplication.  ``metadata`` holds what a reader of the
format needs: the table's JSON, a manifest list and a manifest, both Avro, with
each file's counts and bounds.  Field ids are the table's own and are in the
Parquet files too.  Columns of fixed width are exported as plain binary, which
is what the files hold.
"""

from __future__ import annotations

import json
import math
import struct
import time
import uuid
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from tidelog.schema import ColumnSpec, TableSchema
from tidelog.sources import avro
from tidelog.sources.manifest import Manifest
from tidelog.sources.storage import Storage

if TYPE_CHECKING:
    from tidelog.sources.table import KeyedTable


def type_name(c: ColumnSpec) -> str:
    return "binary" if c.fixed else c.type


def schema_json(schema: TableSchema) -> dict[str, Any]:
    """Columns with ids, and the key columns as identifier fields."""
    return {
        "type": "struct",
        "schema-id": schema.schema_id,
        "identifier-field-ids": [schema[k].field_id for k in schema.primary_key if schema[k].type not in ("float", "double")],
        "fields": [
            {"id": c.field_id, "name": c.name, "required": not c.nullable, "type": type_name(c)} for c in schema.columns
        ],
    }


def sort_order_json(schema: TableSchema) -> dict[str, Any]:
    """Ascending by key, as files are written."""
    return {
        "order-id": 1,
        "fields": [
            {"transform": "identity", "source-id": schema[k].field_id, "direction": "asc", "null-order": "nulls-first"}
            for k in schema.primary_key
        ],
    }


# Names, ids and types of the fields of manifests and manifest lists, from the format's specification.


def _field(name: str, id: int, type: Any, optional: bool = False) -> dict[str, Any]:
    return {"name": name, "type": ["null", type] if optional else type, "field-id": id} | ({"default": None} if optional else {})


def _map(key: int, value: int, type: str) -> dict[str, Any]:
    """A map with numbers for keys is an array of pairs."""
    pair = {"type": "record", "name": f"k{key}_v{value}", "fields": [_field("key", key, "int"), _field("value", value, type)]}
    return {"type": "array", "logicalType": "map", "items": pair}


_DATA_FILE = {
    "type": "record",
    "name": "r2",
    "fields": [
        _field("content", 134, "int"),
        _field("file_path", 100, "string"),
        _field("file_format", 101, "string"),
        _field("partition", 102, {"type": "record", "name": "r102", "fields": []}),
        _field("record_count", 103, "long"),
        _field("file_size_in_bytes", 104, "long"),
        _field("value_counts", 109, _map(119, 120, "long"), True),
        _field("null_value_counts", 110, _map(121, 122, "long"), True),
        _field("nan_value_counts", 137, _map(138, 139, "long"), True),
        _field("lower_bounds", 125, _map(126, 127, "bytes"), True),
        _field("upper_bounds", 128, _map(129, 130, "bytes"), True),
        _field("sort_order_id", 140, "int", True),
    ],
}
_ENTRY = {
    "type": "record",
    "name": "manifest_entry",
    "fields": [
        _field("status", 0, "int"),
        _field("snapshot_id", 1, "long", True),
        _field("sequence_number", 3, "long", True),
        _field("file_sequence_number", 4, "long", True),
        _field("data_file", 2, _DATA_FILE),
    ],
}
_MANIFEST_FILE = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        _field("manifest_path", 500, "string"),
        _field("manifest_length", 501, "long"),
        _field("partition_spec_id", 502, "int"),
        _field("content", 517, "int"),
        _field("sequence_number", 515, "long"),
        _field("min_sequence_number", 516, "long"),
        _field("added_snapshot_id", 503, "long"),
        _field("added_files_count", 504, "int"),
        _field("existing_files_count", 505, "int"),
        _field("deleted_files_count", 506, "int"),
        _field("added_rows_count", 512, "long"),
        _field("existing_rows_count", 513, "long"),
        _field("deleted_rows_count", 514, "long"),
    ],
}


def bound(c: ColumnSpec, value: Any, upper: bool) -> bytes | None:
    """A bound in the format's binary form of a single value; of zeros the lower bound is the negative one."""
    if value is None:
        return None
    if c.type == "boolean":
        return b"\x01" if value else b"\x00"
    if c.type in ("int", "long"):
        return value.to_bytes(4 if c.type == "int" else 8, "little", signed=True)
    if c.type in ("float", "double"):
        value = (0.0 if upper else -0.0) if value == 0 else value
        return None if math.isnan(value) else struct.pack("<f" if c.type == "float" else "<d", value)
    return value.encode() if c.type == "string" else bytes(value)


def _pairs(values: dict[int, Any]) -> list[dict[str, Any]]:
    return [{"key": k, "value": v} for k, v in values.items() if v is not None]


def data_files(table: KeyedTable, store: Storage, folder: str) -> list[dict[str, Any]]:
    """The exported files as entries of a manifest: counts and bounds by field id, from one pass over them."""
    columns, sizes = table.schema.columns, dict(store.list(folder))
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        value, real = F.col(c.name), c.type in ("float", "double")
        known = F.when(~F.isnan(value), value) if real else value
        parts += [F.count_if(value.isNull()).alias(f"null{i}"), F.min(known).alias(f"low{i}"), F.max(known).alias(f"high{i}")]
        parts += [F.count_if(F.isnan(value)).alias(f"nan{i}")] if real else []
    written = table._spark.read.schema(table.schema.struct(all_nullable=True)).parquet(store.url(folder))
    rows = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(*parts).collect()  # a row for each file
    found = []
    for r in sorted(rows, key=lambda r: r["file"]):
        ids = {i: c.field_id for i, c in enumerate(columns)}
        found.append(
            {
                "content": 0,
                "file_path": store.url(f"{folder}/{r['file']}"),
                "file_format": "PARQUET",
                "partition": {},
                "record_count": r["n"],
                "file_size_in_bytes": sizes[f"{folder}/{r['file']}"],
                "value_counts": _pairs({ids[i]: r["n"] for i in ids}),
                "null_value_counts": _pairs({ids[i]: r[f"null{i}"] for i in ids}),
                "nan_value_counts": _pairs({ids[i]: r[f"nan{i}"] for i, c in enumerate(columns) if c.type in ("float", "double")}),
                "lower_bounds": _pairs({ids[i]: bound(c, r[f"low{i}"], False) for i, c in enumerate(columns)}),
                "upper_bounds": _pairs({ids[i]: bound(c, r[f"high{i}"], True) for i, c in enumerate(columns)}),
                "sort_order_id": 1,
            }
        )
    return found


def table_metadata_json(manifest: Manifest, location: str, files: list[dict[str, Any]], manifest_list: str, now_ms: int | None = None) -> dict[str, Any]:
    """The whole table at one snapshot, unpartitioned; the summary counts the exported files."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    schema, n = manifest.schema, manifest.snapshot_id
    totals = {
        "data-files": len(files), "records": sum(f["record_count"] for f in files),
        "files-size": sum(f["file_size_in_bytes"] for f in files),
    }
    return {
        "format-version": 2,
        "table-uuid": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{location}#{schema.name}")),
        "location": location,
        "last-sequence-number": n,
        "last-updated-ms": now,
        "last-column-id": schema.last_column_id,
        "current-schema-id": schema.schema_id,
        "schemas": [schema_json(s) for s in sorted((*manifest.schemas, schema), key=lambda s: s.schema_id)],
        "partition-specs": [{"spec-id": 0, "fields": []}],
        "default-spec-id": 0,
        "last-partition-id": 999,
        "sort-orders": [sort_order_json(schema)],
        "default-sort-order-id": 1,
        "properties": {k: str(v) for k, v in manifest.properties.items()},
        "current-snapshot-id": n,
        "refs": {"main": {"snapshot-id": n, "type": "branch"}},
        "snapshots": [
            {
                "snapshot-id": n,
                "sequence-number": n,
                "timestamp-ms": now,
                "schema-id": schema.schema_id,
                "manifest-list": manifest_list,
                "summary": {"operation": "append"} | {f"total-{k}": str(v) for k, v in totals.items()},
            }
        ],
    }


def export_snapshot(table: KeyedTable, path: str) -> str:
    """Write live rows to ``path/data`` and the table's metadata to ``path/metadata``; the path of its JSON."""
    store, m, run = Storage(table._spark, path), table.snapshot(), uuid.uuid4().hex
    seq, n = table.read_seq(), m.snapshot_id
    folder = f"data/s{seq}-{run}"
    live = table.scan(ordered=False).select(
        *[F.col(c.name).alias(c.name, metadata={"parquet.field.id": c.field_id}) for c in m.schema.columns]
    )
    live.sortWithinPartitions(*table.pk).write.option("compression", "zstd").parquet(store.url(folder))
    files = data_files(table, store, folder)
    entries = [{"status": 1, "snapshot_id": n, "sequence_number": n, "file_sequence_number": n, "data_file": f} for f in files]
    own = avro.write(
        _ENTRY,
        entries,
        {
            "schema": json.dumps(schema_json(m.schema)), "schema-id": str(m.schema.schema_id), "partition-spec": "[]",
            "partition-spec-id": "0", "format-version": "2", "content": "data",
        },
    )
    store.put(f"metadata/{run}-m0.avro", own)
    listed = {
        "manifest_path": store.url(f"metadata/{run}-m0.avro"), "manifest_length": len(own), "partition_spec_id": 0, "content": 0,
        "sequence_number": n, "min_sequence_number": n, "added_snapshot_id": n, "added_files_count": len(files),
        "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": sum(f["record_count"] for f in files),
        "existing_rows_count": 0, "deleted_rows_count": 0,
    }
    listing = f"metadata/snap-{n}-{run}.avro"
    properties = {"snapshot-id": str(n), "parent-snapshot-id": "null", "sequence-number": str(n), "format-version": "2"}
    store.put(listing, avro.write(_MANIFEST_FILE, [listed], properties))
    described = table_metadata_json(m, path, files, store.url(listing))
    described["properties"]["read-seq"] = str(seq)
    version = 1 + max([int(x[10:-14]) for x, _ in store.list("metadata") if x.endswith(".metadata.json")], default=0)
    name = f"metadata/v{version}.metadata.json"
    store.put_if_absent(name, json.dumps(described, indent=1).encode())
    store.put("metadata/version-hint.text", str(version).encode())
    return store.url(name)


def exported_files(spark: Any, path: str) -> list[dict[str, Any]]:
    """The data files of the newest export at ``path``, found as any reader does: hint, JSON, manifest list, manifests."""
    store = Storage(spark, path)
    local = lambda url: url.removeprefix(f"{store.root}/")
    described = json.loads(store.get(f"metadata/v{store.get('metadata/version-hint.text').decode()}.metadata.json"))
    snapshot = next(s for s in described["snapshots"] if s["snapshot-id"] == described["current-snapshot-id"])
    listed, _ = avro.read(store.get(local(snapshot["manifest-list"])))
    return [e["data_file"] for m in listed for e in avro.read(store.get(local(m["manifest_path"])))[0] if e["status"] < 2]

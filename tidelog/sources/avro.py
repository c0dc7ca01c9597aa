"""Avro object container files, as far as table manifests need them: written and read whole, on the driver."""

from __future__ import annotations

import io
import json
import os
from typing import Any

_MAGIC = b"Obj\x01"
_META = {"type": "map", "values": "bytes"}


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(data: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = data.read(1)[0]
        n |= (b & 127) << shift
        if b < 128:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _kind(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema["type"] if isinstance(schema, dict) else schema


def encode(schema: Any, value: Any) -> bytes:
    """The binary form of a value; a union is of null and one other type."""
    kind = _kind(schema)
    if kind == "union":
        at = schema.index("null") if value is None else next(i for i, s in enumerate(schema) if s != "null")
        return _zigzag(at) + (b"" if value is None else encode(schema[at], value))
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    if kind in ("array", "map"):
        rows = value.items() if kind == "map" else value
        each = [encode("string", k) + encode(schema["values"], v) for k, v in rows] if kind == "map" else [encode(schema["items"], v) for v in rows]
        return (_zigzag(len(each)) + b"".join(each) if each else b"") + _zigzag(0)
    if kind in ("int", "long"):
        return _zigzag(value)
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    data = value.encode() if kind == "string" else bytes(value)
    return _zigzag(len(data)) + data


def decode(schema: Any, data: io.BytesIO) -> Any:
    kind = _kind(schema)
    if kind == "null":
        return None
    if kind == "union":
        return decode(schema[_number(data)], data)
    if kind == "record":
        return {f["name"]: decode(f["type"], data) for f in schema["fields"]}
    if kind in ("array", "map"):
        found: list = []
        while n := _number(data):
            if n < 0:  # a block with its size
                n, _ = -n, _number(data)
            found += [(decode("string", data), decode(schema["values"], data)) if kind == "map" else decode(schema["items"], data) for _ in range(n)]
        return dict(found) if kind == "map" else found
    if kind in ("int", "long"):
        return _number(data)
    if kind == "boolean":
        return data.read(1) == b"\x01"
    raw = data.read(_number(data))
    return raw.decode() if kind == "string" else raw


def write(schema: dict, rows: list[dict], properties: dict[str, str]) -> bytes:
    """A container file of one block, uncompressed."""
    sync = os.urandom(16)
    meta = {k: v.encode() for k, v in properties.items()} | {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"}
    block = b"".join(encode(schema, r) for r in rows)
    body = _zigzag(len(rows)) + _zigzag(len(block)) + block + sync if rows else b""
    return _MAGIC + encode(_META, meta) + sync + body


def read(data: bytes) -> tuple[list[dict], dict[str, str]]:
    """The rows and properties of an uncompressed container file."""
    if data[:4] != _MAGIC:
        raise ValueError("not an Avro file")
    source = io.BytesIO(data[4:])
    meta = decode(_META, source)
    schema, found = json.loads(meta["avro.schema"]), []
    source.read(16)
    while source.tell() < len(data) - 4:
        n, _ = _number(source), _number(source)
        found += [decode(schema, source) for _ in range(n)]
        source.read(16)
    return found, {k: v.decode() for k, v in meta.items()}

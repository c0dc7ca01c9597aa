"""Order-preserving bytes of primary keys, as column expressions.

Bytes compare as the keys do, column by column:

* booleans are 00 or 01; integers are big-endian with the sign bit flipped;
* floats are their IEEE bits, all flipped if negative, else the sign bit
  flipped, so -0.0 and +0.0 are different keys, in that order; NaN is no key;
* bytes and text write 00 as 00 FF and end with 00 00; fixed bytes are raw.

A version's key appends eight bytes, the inverted sequence number and the
operation, so newer versions of a key come first.
"""

from __future__ import annotations

import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import CorruptionError, InvalidArgumentError
from tidelog.schema import TableSchema

SEQ_MAX = (1 << 56) - 1


def _fixed_hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def _hex_of(value: Column, type: str) -> Column:
    if type == "boolean":
        return F.when(value, "01").otherwise("00")
    if type == "int":
        return _fixed_hex(value.cast("long") + (1 << 31), 8)
    if type == "long":
        return _fixed_hex(value.bitwiseXOR(F.lit(-(1 << 63))), 16)
    if type in ("float", "double"):
        wide = type == "double"
        bits = F.java_method(
            F.lit("java.lang.Double" if wide else "java.lang.Float"),
            F.lit("doubleToRawLongBits" if wide else "floatToRawIntBits"),
            value,
        ).cast("long")
        if not wide:
            flipped = F.when(bits < 0, F.bitwise_not(bits).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(bits + (1 << 31))
            return _fixed_hex(flipped, 8)
        return _fixed_hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63)))), 16)
    if type.startswith("fixed["):
        return F.hex(value)
    # pair by pair, so that a 00 across two bytes is not taken for one
    pairs = F.regexp_replace(F.hex(value.cast("binary")), "(..)", "$1 ")
    return F.concat(F.replace(F.replace(pairs, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit("")), F.lit("0000"))


def pk_bytes(schema: TableSchema, source: str | None = None) -> Column:
    """The encoded primary key; ``source`` is a struct column to take the key columns from."""
    at = lambda n: F.col(f"{source}.{n}" if source else n)
    return F.unhex(F.concat(*[_hex_of(at(k), schema[k].type) for k in schema.primary_key]))


def version_key(key: Column, seq: Column, op: Column) -> Column:
    """The encoded key with the tag that sorts newer versions first."""
    tag = F.shiftleft(F.lit(SEQ_MAX) - seq.cast("long"), 8) + op.cast("long")
    return F.concat(key, F.unhex(_fixed_hex(tag, 16)))


def seq_of(version: Column) -> Column:
    """The sequence number in a version's key."""
    return F.lit(SEQ_MAX) - F.conv(F.substring(F.hex(version), -16, 14), 16, 10).cast("long")


# the same rules for single keys, on the driver


def encode(schema: TableSchema, key: tuple) -> bytes:
    if len(key) != len(schema.primary_key):
        raise InvalidArgumentError(f"the key has {len(schema.primary_key)} columns, not {len(key)}")
    out = []
    for name, v in zip(schema.primary_key, key, strict=True):
        type = schema[name].type
        if v is None:
            raise InvalidArgumentError(f"the key column {name} is null")
        if type == "boolean":
            out.append(b"\x01" if v else b"\x00")
        elif type in ("int", "long"):
            width = 4 if type == "int" else 8
            out.append((v + (1 << (8 * width - 1))).to_bytes(width, "big"))
        elif type in ("float", "double"):
            if v != v:
                raise InvalidArgumentError(f"the key column {name} is NaN")
            raw = struct.pack(">f" if type == "float" else ">d", v)
            out.append(bytes(b ^ 255 for b in raw) if raw[0] & 128 else bytes([raw[0] ^ 128]) + raw[1:])
        else:
            data = v.encode() if isinstance(v, str) else bytes(v)
            fixed = schema[name].fixed
            if fixed and len(data) != fixed:
                raise InvalidArgumentError(f"{name} takes {fixed} bytes")
            out.append(data if fixed else data.replace(b"\x00", b"\x00\xff") + b"\x00\x00")
    return b"".join(out)


def decode(schema: TableSchema, data: bytes) -> tuple[Any, ...]:
    """The key of :func:`encode`; bytes that are none are an error."""
    found, at = [], 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise CorruptionError("the key is too short")
        at += n
        return data[at - n : at]

    for name in schema.primary_key:
        c = schema[name]
        if c.type == "boolean":
            b = take(1)
            if b not in (b"\x00", b"\x01"):
                raise CorruptionError("a boolean is 0 or 1")
            found.append(b == b"\x01")
        elif c.type in ("int", "long"):
            width = 4 if c.type == "int" else 8
            found.append(int.from_bytes(take(width), "big") - (1 << (8 * width - 1)))
        elif c.type in ("float", "double"):
            raw = take(4 if c.type == "float" else 8)
            raw = bytes([raw[0] ^ 128]) + raw[1:] if raw[0] & 128 else bytes(b ^ 255 for b in raw)
            found.append(struct.unpack(">f" if c.type == "float" else ">d", raw)[0])
        elif c.fixed:
            found.append(take(c.fixed))
        else:
            parts = bytearray()
            while True:
                b = take(1)
                if b != b"\x00":
                    parts += b
                    continue
                follow = take(1)
                if follow == b"\x00":
                    break
                if follow != b"\xff":
                    raise CorruptionError("a zero byte is escaped or ends the value")
                parts += b"\x00"
            found.append(parts.decode() if c.type == "string" else bytes(parts))
    if at != len(data):
        raise CorruptionError("bytes are left over")
    return tuple(found)


def decode_version(schema: TableSchema, data: bytes) -> tuple[tuple, int, int]:
    """(key, seq, op) of a version's key."""
    if len(data) < 8:
        raise CorruptionError("the key has no tag")
    tag = int.from_bytes(data[-8:], "big")
    op = tag & 255
    if op not in (0, 1):
        raise CorruptionError(f"no operation {op}")
    return decode(schema, data[:-8]), SEQ_MAX - (tag >> 8), op


def decoded(schema: TableSchema, key: Column) -> Column:
    """The key columns of encoded keys, as a struct; Arrow batches, for reading keys back from files."""
    out = T.StructType([T.StructField(k, schema[k].spark_type) for k in schema.primary_key])

    @F.pandas_udf(out)
    def run(keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(schema, bytes(k)) for k in keys], columns=list(schema.primary_key))

    return run(key)

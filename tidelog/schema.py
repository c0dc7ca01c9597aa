"""The schema of a keyed table: typed columns, a primary key, and additive evolution."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import InvalidArgumentError, SchemaMismatchError

# The names of column types, as callers may spell them.
SPELLINGS = {
    "bool": "boolean", "boolean": "boolean",
    "int32": "int", "i32": "int",
    "int64": "long", "i64": "long", "int": "long", "long": "long",
    "float": "float", "f32": "float", "float32": "float",
    "double": "double", "f64": "double", "float64": "double",
    "bytes": "binary", "bytearray": "binary", "binary": "binary",
    "string": "string", "str": "string",
}

_SPARK = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "binary": T.BinaryType(), "string": T.StringType(),
}


def parse_type(text: str) -> str:
    """The type's own name; ``fixed[n]`` is binary of n bytes."""
    name = text.strip().lower()
    if name.startswith("fixed[") and name.endswith("]"):
        if not name[6:-1].isdigit() or int(name[6:-1]) < 1:
            raise InvalidArgumentError(f"a fixed type has a length: {text}")
        return name
    if name not in SPELLINGS:
        raise InvalidArgumentError(f"unknown column type: {text}")
    return SPELLINGS[name]


@dataclass(frozen=True)
class ColumnSpec:
    """One column.  ``initial_default`` is what rows written before it was added read as; ``write_default``
    is what rows that leave it out are written with."""

    name: str
    type: str
    nullable: bool = True
    field_id: int | None = None
    initial_default: Any = None
    write_default: Any = None

    @property
    def spark_type(self) -> T.DataType:
        return T.BinaryType() if self.fixed else _SPARK[self.type]

    @property
    def fixed(self) -> int | None:
        return int(self.type[6:-1]) if self.type.startswith("fixed[") else None

    def default(self) -> Any:
        return self.write_default if self.write_default is not None else self.initial_default


def column(name: str, type: str, nullable: bool = True, **more: Any) -> ColumnSpec:
    return ColumnSpec(name, parse_type(type), nullable, **more)


@dataclass(frozen=True)
class TableSchema:
    """Ordered columns and the names of those that make up the primary key, in key order."""

    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...]
    schema_id: int = 0
    last_column_id: int = 0

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names:
            raise SchemaMismatchError("a table has at least one column")
        if len(set(names)) < len(names):
            raise SchemaMismatchError("column names are unique")
        if not self.primary_key:
            raise SchemaMismatchError("a table has at least one key column")
        if len(set(self.primary_key)) < len(self.primary_key):
            raise SchemaMismatchError("key columns are unique")
        for k in self.primary_key:
            if k not in names:
                raise SchemaMismatchError(f"the key column {k} is not a column")
            if self[k].nullable:
                raise SchemaMismatchError(f"the key column {k} is nullable")
        given = [c.field_id for c in self.columns if c.field_id is not None]
        if len(set(given)) < len(given):
            raise SchemaMismatchError("field ids are unique")
        if self.last_column_id and any(i > self.last_column_id for i in given):
            raise SchemaMismatchError("a field id is over the last column id")
        if len(given) < len(names):
            last, done = max([self.last_column_id, *given]), []
            for c in self.columns:
                if c.field_id is None:
                    last += 1
                    c = replace(c, field_id=last)
                done.append(c)
            object.__setattr__(self, "columns", tuple(done))
            object.__setattr__(self, "last_column_id", last)
        elif not self.last_column_id:
            object.__setattr__(self, "last_column_id", max(given))

    def __getitem__(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise InvalidArgumentError(f"no column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self, all_nullable: bool = False) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, all_nullable or c.nullable) for c in self.columns])

    def log_struct(self) -> T.StructType:
        """An operation: its number, what it does (0 deletes, 1 puts) and the row."""
        return T.StructType(
            [T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType()), *self.struct(all_nullable=True)]
        )

    # persistence
    def to_dict(self) -> dict:
        return {
            "name": self.name, "schema_id": self.schema_id, "last_column_id": self.last_column_id,
            "primary_key": list(self.primary_key),
            "columns": [
                {
                    "name": c.name, "type": c.type, "nullable": c.nullable, "field_id": c.field_id,
                    "initial_default": _out(c.initial_default), "write_default": _out(c.write_default),
                }
                for c in self.columns
            ],
        }

    @staticmethod
    def from_dict(d: dict) -> TableSchema:
        columns = tuple(
            ColumnSpec(
                c["name"], c["type"], c["nullable"], c["field_id"],
                _in(c["initial_default"], c["type"]), _in(c["write_default"], c["type"]),
            )
            for c in d["columns"]
        )
        return TableSchema(d["name"], columns, tuple(d["primary_key"]), d["schema_id"], d["last_column_id"])

    # evolution
    def check_reopen(self, declared: TableSchema) -> TableSchema:
        """The schema to go on with when a table of this schema is opened as ``declared``.

        Accepted are the same schema, or this one's columns as an exact beginning
        and then columns that are nullable or have a default.
        """
        if declared.name != self.name:
            raise SchemaMismatchError(f"the table is {self.name}, not {declared.name}")
        if declared.primary_key != self.primary_key:
            raise SchemaMismatchError("the primary key differs")
        if len(declared.columns) < len(self.columns):
            raise SchemaMismatchError("columns are missing")
        for old, new in zip(self.columns, declared.columns, strict=False):
            if (old.name, old.type, old.nullable) != (new.name, new.type, new.nullable):
                raise SchemaMismatchError(f"column {old.name} became {new.name} {new.type} nullable={new.nullable}")
        grown = self
        for new in declared.columns[len(self.columns) :]:
            grown = grown.add(replace(new, field_id=None))
        return grown

    def add(self, new: ColumnSpec) -> TableSchema:
        """This schema with one more column at its end."""
        if new.name in self.names:
            raise SchemaMismatchError(f"there is a column {new.name}")
        if not new.nullable and new.default() is None:
            raise SchemaMismatchError(f"the new column {new.name} is neither nullable nor has a default")
        check_value(new, new.initial_default)
        check_value(new, new.write_default)
        last = self.last_column_id + 1
        return TableSchema(
            self.name, (*self.columns, replace(new, field_id=last)), self.primary_key, self.schema_id + 1, last
        )


def _out(value: Any) -> Any:
    return {"hex": bytes(value).hex()} if isinstance(value, bytes | bytearray) else value


def _in(value: Any, type: str) -> Any:
    return bytes.fromhex(value["hex"]) if isinstance(value, dict) else value


_PYTHON = {"boolean": bool, "int": int, "long": int, "float": float, "double": float, "string": str}


def check_value(c: ColumnSpec, value: Any) -> Any:
    """``value`` as column ``c`` stores it; an error if it does not fit."""
    if value is None:
        return None
    if c.fixed or c.type == "binary":
        value = value.encode() if isinstance(value, str) else value
        if not isinstance(value, bytes | bytearray):
            raise SchemaMismatchError(f"{c.name} takes bytes, not {value!r}")
        if c.fixed and len(value) != c.fixed:
            raise SchemaMismatchError(f"{c.name} takes {c.fixed} bytes, not {len(value)}")
        return bytes(value)
    kind = _PYTHON[c.type]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise SchemaMismatchError(f"{c.name} takes {c.type}, not {value!r}")
    width = {"int": 31, "long": 63}.get(c.type)
    if width and not -(1 << width) <= value < 1 << width:
        raise SchemaMismatchError(f"{value} is out of range for {c.name}")
    return value


def check_row(schema: TableSchema, row: dict[str, Any]) -> tuple:
    """A row given by names, padded with defaults and checked, as a tuple in column order."""
    for name in row:
        if name not in schema.names:
            raise SchemaMismatchError(f"no column {name}")
    found = []
    for c in schema.columns:
        value = check_value(c, row[c.name] if c.name in row else c.default())
        if value is None and not c.nullable:
            raise SchemaMismatchError(f"{c.name} may not be null")
        if c.name in schema.primary_key and isinstance(value, float) and value != value:
            raise SchemaMismatchError(f"the key column {c.name} may not be NaN")
        found.append(value)
    return tuple(found)


def pad(df: DataFrame, schema: TableSchema, initial: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in the schema's column order, after ``keep``; columns it lacks get their defaults.

    ``initial`` pads what was written before a column existed: with the initial
    default, whatever rows written today would get.
    """
    found = []
    for c in schema.columns:
        if c.name in df.columns:
            found.append(F.col(c.name).cast(c.spark_type).alias(c.name))
        else:
            value = c.initial_default if initial else c.default()
            if value is None and not c.nullable and not initial:
                raise SchemaMismatchError(f"{c.name} may not be null")
            found.append(F.lit(value).cast(c.spark_type).alias(c.name))
    kept = [n for n in ("seq", "op", *keep) if n in df.columns and n not in schema.names]
    return df.select(*kept, *found)


def violation(schema: TableSchema, deletes: Column | None = None) -> Column:
    """The first reason against a row, null if there is none.  A deletion needs its key columns only."""
    reasons = []
    for c in schema.columns:
        key = c.name in schema.primary_key
        wrong: list[tuple[Column, str]] = []
        if not c.nullable:
            wrong.append((F.col(c.name).isNull(), f"{c.name} may not be null"))
        if c.fixed:
            wrong.append((F.octet_length(c.name) != c.fixed, f"{c.name} takes {c.fixed} bytes"))
        if key and c.type in ("float", "double"):
            wrong.append((F.isnan(c.name), f"the key column {c.name} may not be NaN"))
        for bad, why in wrong:
            if deletes is not None and not key:
                bad = bad & ~deletes
            reasons.append(F.when(bad, F.lit(why)))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def same_type(df: DataFrame, schema: TableSchema) -> None:
    """A frame's columns are the schema's or a part of them, with the schema's types."""
    for f in df.schema:
        if f.name in ("seq", "op") and f.name not in schema.names:
            continue
        if f.name not in schema.names:
            raise SchemaMismatchError(f"no column {f.name}")
        want = schema[f.name].spark_type
        text_as_bytes = isinstance(want, T.BinaryType) and isinstance(f.dataType, T.StringType)
        if f.dataType != want and not text_as_bytes and not isinstance(f.dataType, T.NullType):
            raise SchemaMismatchError(f"{f.name} takes {want.simpleString()}, not {f.dataType.simpleString()}")

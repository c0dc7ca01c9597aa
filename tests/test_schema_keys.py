import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.errors import CorruptionError, InvalidArgumentError, SchemaMismatchError
from tidelog.functions import keys
from tidelog.schema import TableSchema, check_row, column, parse_type

ID = column("id", "int64", nullable=False)


def schema(*more, pk=("id",)):
    return TableSchema("t", (ID, *more), pk)


def test_spellings():
    assert [parse_type(x) for x in ("i32", "int", "str", "bytes", "f32", "bool", "fixed[8]")] == [
        "int", "long", "string", "binary", "float", "boolean", "fixed[8]",
    ]
    for bad in ("decimal", "fixed[0]", "fixed[x]"):
        with pytest.raises(InvalidArgumentError):
            parse_type(bad)


def test_invariants():
    for columns, pk in [((), ("id",)), ((ID,), ()), ((ID,), ("x",)), ((ID,), ("id", "id")), ((column("id", "int"),), ("id",)), ((ID, ID), ("id",))]:
        with pytest.raises(SchemaMismatchError):
            TableSchema("t", columns, pk)
    s = schema(column("v", "int"))
    assert [c.field_id for c in s.columns] == [1, 2] and s.last_column_id == 2
    with pytest.raises(SchemaMismatchError):
        TableSchema("t", (column("id", "int", nullable=False, field_id=5),), ("id",), last_column_id=3)
    assert TableSchema.from_dict(s.to_dict()) == s


def test_reopen_matrix():
    old = schema(column("v", "int64"))
    same = old.check_reopen(old)
    assert same is old
    grown = old.check_reopen(schema(column("v", "int64"), column("w", "int64")))
    assert grown.names == ["id", "v", "w"] and grown.schema_id == 1 and grown["w"].field_id == 3
    assert old.check_reopen(schema(column("v", "int64"), column("w", "int64", nullable=False, initial_default=4)))
    refused = [
        schema(), schema(column("x", "int64")), schema(column("v", "int32")), schema(column("v", "int64", nullable=False)),
        schema(column("w", "int64"), column("v", "int64")), schema(column("v", "int64"), column("w", "int64", nullable=False)),
        TableSchema("other", (ID, column("v", "int64")), ("id",)),
        TableSchema("t", (ID, column("v", "int64", nullable=False)), ("id", "v")),
    ]
    for s in refused:
        with pytest.raises(SchemaMismatchError):
            old.check_reopen(s)


def test_rows():
    s = schema(column("n", "bytes", nullable=False, write_default=b"d"), column("f", "fixed[2]"), column("x", "double"))
    assert check_row(s, {"id": 1}) == (1, b"d", None, None)
    assert check_row(s, {"id": 1, "n": "text", "f": b"ab", "x": 3}) == (1, b"text", b"ab", 3.0)
    for bad in ({"id": None}, {"id": "1"}, {"id": True}, {"id": 1, "f": b"abc"}, {"id": 1, "zz": 1}, {"id": 1, "n": None}, {"id": 1 << 63}):
        with pytest.raises(SchemaMismatchError):
            check_row(s, bad)
    with pytest.raises(SchemaMismatchError):
        check_row(TableSchema("t", (column("k", "double", nullable=False),), ("k",)), {"k": float("nan")})


KEYS = {
    "boolean": st.booleans(),
    "int": st.integers(-(1 << 31), (1 << 31) - 1),
    "long": st.integers(-(1 << 63), (1 << 63) - 1),
    "float": st.floats(allow_nan=False, width=32),
    "double": st.floats(allow_nan=False),
    "binary": st.binary(max_size=6) | st.sampled_from([b"", b"\0", b"\0\0", b"\xff", b"\0\xff\0", b"\0\1", b"\1\0"]),
    "fixed[3]": st.binary(min_size=3, max_size=3),
}


def of(*types):
    return TableSchema("t", tuple(column(f"k{i}", t, nullable=False) for i, t in enumerate(types)), tuple(f"k{i}" for i in range(len(types))))


def order(v):
    """Python's order, with -0.0 before 0.0."""
    import math

    return (v, math.copysign(1, v)) if isinstance(v, float) else v


@pytest.mark.parametrize("types", [(t,) for t in KEYS] + [("long", "binary"), ("binary", "double", "int")])
def test_byte_order_is_key_order(types):
    s, one = of(*types), st.tuples(*[KEYS[t] for t in types])

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(one, one)
    def check(a, b):
        ea, eb = keys.encode(s, a), keys.encode(s, b)
        oa, ob = tuple(map(order, a)), tuple(map(order, b))
        assert (ea < eb) == (oa < ob) and (ea == eb) == (oa == ob)
        assert tuple(map(order, keys.decode(s, ea))) == oa

    check()


@pytest.mark.parametrize("type", list(KEYS))
def test_expression_equals_encode(spark, type):
    s = of(type)
    values = {
        "boolean": [True, False], "int": [0, -1, 1, 2**31 - 1, -(2**31)], "long": [0, -1, 1, 2**63 - 1, -(2**63)],
        "float": [0.0, -0.0, 1.5, -1.5, float("inf"), float("-inf")], "double": [0.0, -0.0, 1.1, -1e300, float("inf")],
        "binary": [b"", b"\0", b"\0\0", b"\xff", b"\0\xff\0", b"\0\1", b"\1\0", b"\x10\x01"], "fixed[3]": [b"abc", b"\0\0\0"],
    }[type]
    df = spark.createDataFrame([(v,) for v in values], s.struct())
    got = [bytes(r[0]) for r in df.select(keys.pk_bytes(s)).collect()]
    assert got == [keys.encode(s, (v,)) for v in values]


def test_version_keys(spark):
    s = of("long")
    df = spark.createDataFrame([(5, 1, 1), (5, 9, 0), (5, 2**56 - 1, 1)], "k0 long, seq long, op int")
    v = keys.version_key(keys.pk_bytes(s), F.col("seq"), F.col("op"))
    rows = df.select("seq", "op", v.alias("v"), keys.seq_of(v).alias("back")).collect()
    assert all(r.seq == r.back for r in rows)
    assert [keys.decode_version(s, bytes(r.v)) for r in rows] == [((5,), 1, 1), ((5,), 9, 0), ((5,), 2**56 - 1, 1)]
    assert sorted(bytes(r.v) for r in rows) == [bytes(r.v) for r in reversed(rows)]  # newest first


def test_bad_keys():
    s = of("long", "binary")
    good = keys.encode(s, (1, b"x"))
    for bad in (good[:-1], good + b"\0", good[:8] + b"\0\1\0\0", b""):
        with pytest.raises(CorruptionError):
            keys.decode(s, bad)
    with pytest.raises(CorruptionError):
        keys.decode_version(s, good + bytes(7) + b"\7")
    with pytest.raises(InvalidArgumentError):
        keys.encode(of("double"), (float("nan"),))
    with pytest.raises(InvalidArgumentError):
        keys.encode(s, (1,))


def test_decoded_column(spark):
    s = of("long", "binary", "double")
    rows = [(1, b"a\0b", -0.5), (-3, b"", 2.0)]
    df = spark.createDataFrame(rows, s.struct()).select(keys.decoded(s, keys.pk_bytes(s)).alias("k")).select("k.*")
    assert [(r.k0, bytes(r.k1), r.k2) for r in df.collect()] == rows

"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the child's name and the doc_id, and
the least draw wins, so children are chosen in proportion to their weights, and
a child's draw depends on nothing but itself.  Changing a weight therefore
moves documents only between the subtrees whose weights change, and a shard
that joins as a region of its own takes documents only into itself.

The law is ``key``: the doc_id and the tree alone decide.

Defined results: a null doc_id is a key like any other; a null text has no
bytes, so size 1; rows that repeat, or that share a doc_id, share a shard and have
a slot each; of equal draws the child whose name is least wins; an empty table
gives an empty one; :func:`layout` reads doc_id and text alone, and
:func:`assign` keeps all columns but replaces one of its result's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import materialize


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def balanced_tree(shards: int, base: int = 8, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """``base`` shards in regions of ``racks`` racks of ``per_rack`` shards; each further one is a region of its own."""
    if shards < 1:
        raise ValueError("a tree has at least one shard")
    found = []
    for i in range(shards):
        if i < base:
            region, rack = i // (racks * per_rack), i // per_rack % racks
            found.append(Shard(f"region{region}", f"region{region}/rack{rack}", i))
        else:
            found.append(Shard(f"joined{i}", f"joined{i}/rack0", i))
    return found


def _draw(child: Column, weight: Column, key: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(child, key), 11) + 1).cast("double") / float(1 << 53)
    return -F.log(u) / weight


def _choice(tree: dict[str, dict[str, float]], node: Column, key: Column) -> Column:
    """The child of ``node`` with the least draw; ``tree`` maps each node to its children's weights."""
    kids = F.create_map(
        *[
            x
            for name, children in tree.items()
            for x in (
                F.lit(name),
                F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in children.items()]),
            )
        ]
    )
    draws = F.transform(
        F.element_at(kids, node), lambda c: F.struct(_draw(c["name"], c["weight"], key).alias("d"), c["name"].alias("n"))
    )
    return F.array_min(draws)["n"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The number of the shard that ``key`` descends to.  Shards of weight 0 take nothing."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    leaves: dict[str, dict[str, float]] = {}
    for s in tree:
        if s.weight < 0:
            raise ValueError("weights are not negative")
        if s.weight:
            regions[s.region] = regions.get(s.region, 0) + s.weight
            inner = racks.setdefault(s.region, {})
            inner[s.rack] = inner.get(s.rack, 0) + s.weight
            leaves.setdefault(s.rack, {})[str(s.number)] = s.weight
    if not regions:
        raise ValueError("every shard has weight 0")
    region = _choice({"root": regions}, F.lit("root"), key)
    rack = _choice(racks, region, key)
    return _choice({r: {f"{r}/{n}": w for n, w in kids.items()} for r, kids in leaves.items()}, rack, key)


def _number(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).cast("int")


def assign(docs: DataFrame, tree: list[Shard], name: str = "shard") -> DataFrame:
    """``docs`` with its shard's number in a further column, which replaces one of that name."""
    return docs.withColumn(name, _number(shard_of(F.col("doc_id").cast("long"), tree)))


def layout(docs: DataFrame, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and the shard in the grown tree.

    Slots follow the files and rows of the written assignment: a task ranks the
    rows of one file and shard, whatever keys they have, and adds the rows of
    the files before.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    rows = materialize(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _number(shard_of(key, tree)).alias("shard"),
            _number(shard_of(key, grown)).alias("grown_shard"),
        ),
        "shards",
    )
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = placed.groupBy("shard", "file").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard",
        "file",
        (F.sum("n").over(W.partitionBy("shard").orderBy("file")) - F.col("n")).alias("before"),
    )
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "file").orderBy("row")) - 1)
    return ranked.join(before, ["shard", "file"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("rank") + F.col("before")).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, tree: list[Shard], path: str) -> None:
    """The documents as one folder of Parquet files for each shard."""
    assign(docs, tree).write.partitionBy("shard").parquet(path)

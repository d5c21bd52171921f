"""Sharding by a hierarchical weighted hash tree.

Shards hang under racks and racks under regions. At each level a row makes one
hash draw per child, ``-ln(u) / weight`` with ``u`` from the row's key and the
child's own name, and goes to the smallest draw; so a child wins in proportion
to its weight and a draw never depends on its siblings. When a weight grows or
a child appears, rows move only into that subtree; when it shrinks, only out of
it; other subtrees exchange nothing. A new shard that opens its own region
takes rows only into itself.

Only built-in expressions: three small arrays of draws per row, no shuffle for
the shard itself. The slot numbering deals every shard to several parts.

Defined results: a null key draws like any other value; a null text has no
bytes and no checksum; repeated rows go to the same shard and get slots of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import number_within

_SALT = 0x5EED


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack]`` lists the weights of that rack's shards, numbered in order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def filled(shards: int, racks: int = 3, per_rack: int = 4) -> Tree:
        """Shards of weight 1, filling racks and regions of fixed size one after another."""
        regions = []
        for s in range(shards):
            if s % (racks * per_rack) == 0:
                regions.append([])
            if s % per_rack == 0:
                regions[-1].append([])
            regions[-1][-1].append(1.0)
        return Tree(tuple(tuple(tuple(rack) for rack in region) for region in regions))


def _draw(key: Column, level: str, name: Column, weight: Column) -> Column:
    """An exponential draw of this child for this key: smaller wins."""
    bits = F.xxhash64(key, F.lit(level), name, F.lit(_SALT))
    u = (F.shiftrightunsigned(bits, 11) + F.lit(1)) * F.lit(2.0**-53)  # in (0, 1]
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _pick(key: Column, level: str, children: int, name, weight) -> Column:
    """The position of the child with the smallest draw; equal draws go to the first."""
    draws = [
        F.struct(_draw(key, level, name(i), weight(i)).alias("draw"), F.lit(i).alias("i")) for i in range(children)
    ]
    return F.array_min(F.array(*draws))["i"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. Names are positions: region, then rack in it, then shard in that."""
    shape = tree.weights
    racks = max(len(region) for region in shape)
    per_rack = max(len(rack) for region in shape for rack in region)
    flat = lambda values: F.array(*(F.lit(float(v)) for v in values))
    fill = lambda row, n: [*row, *[0.0] * (n - len(row))]
    rack_weights = flat(w for region in shape for w in fill([sum(r) for r in region], racks))
    shard_weights, numbers, number = [], [], 0
    for region in shape:
        for rack in [*region, *[()] * (racks - len(region))]:
            shard_weights += fill(list(rack), per_rack)
            numbers += [*range(number, number + len(rack)), *[-1] * (per_rack - len(rack))]
            number += len(rack)
    region = _pick(
        key, "region", len(shape), F.lit, lambda i: F.lit(float(sum(sum(r) for r in shape[i])))
    )

    def place(r: Column) -> Column:
        rack_at = lambda i: r * racks + F.lit(i)
        rack = _pick(key, "rack", racks, rack_at, lambda i: F.get(rack_weights, rack_at(i)))
        return F.element_at(F.transform(F.array(r * racks + rack), in_rack), 1)

    def in_rack(at: Column) -> Column:
        shard_at = lambda i: at * per_rack + F.lit(i)
        shard = _pick(key, "shard", per_rack, shard_at, lambda i: F.get(flat(shard_weights), shard_at(i)))
        return F.get(F.array(*map(F.lit, numbers)), shard_at(0) + shard)

    # One-element transforms bind each level's winner, so that it is drawn once.
    return F.element_at(F.transform(F.array(region), place), 1)


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None,
    grown: Tree | None = None,
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row.

    ``tree`` defaults to ``Tree.filled(shards)`` and ``grown`` to one shard
    more. ``slot`` counts from 0 inside a shard.
    """
    tree, grown = tree or Tree.filled(shards), grown or Tree.filled(shards + 1)
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(docs[id_col], tree).cast("int").alias("shard"),
        shard_of(docs[id_col], grown).cast("int").alias("grown_shard"),
    )
    chunks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = number_within(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", chunks)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

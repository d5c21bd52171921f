"""Connected components of a link table, by alternating star contraction.

Each round makes every node point at the smallest node it knows (first among
larger neighbours, then among smaller ones), so long chains shrink to stars in
a number of rounds that follows the logarithm of the table. Nothing but one
count and one checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut, released

TASK_LINKS = 50_000  # links of a task, or fewer; so few links make few tasks, and small files


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("mark"),
    ).first()
    return row["n"], row["mark"]


def _each(*pairs: tuple[str, str], names: tuple[str, str]):
    """Each row's pairs of columns as rows. Unlike a union, this leaves rows that are together where they are."""
    return F.inline(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(pair, names, strict=True))) for pair in pairs)))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: each linked node's smallest reachable node.

    Self-links, repeated links and rows with a null end add nothing. An empty
    table gives an empty result. Only linked nodes appear.
    """
    links = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = _state(links)
    for turn in range(max_rounds):
        if not state[0]:
            break
        links = links.coalesce(-(-state[0] // TASK_LINKS))
        both = links.select(_each(("hi", "lo"), ("lo", "hi"), names=("u", "v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours of u move to the smallest node around u ...
        large = (
            links.withColumnRenamed("lo", "u")
            .join(least, "u")
            .select("hi", F.col("m").alias("lo"))
            .distinct()
        )
        # ... and the smaller ones, with u itself, to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").select(_each(("lo", "m"), ("hi", "m"), names=("hi", "lo")))
        links = cut(moved.where("hi <> lo").distinct().coalesce(-(-state[0] // TASK_LINKS)))  # never more links than before
        before, state = state, _state(links)
        if state == before:
            break
        if turn % 3 == 2:
            released(links.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.groupBy("hi").agg(F.min("lo").alias("component"))
    roots = links.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return found.withColumnRenamed("hi", "node").union(roots)

"""Gapless numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def number_within(df: DataFrame, group: list[str], order: list[str], number: str, chunks: int) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, ... inside each group.

    A group is dealt to ``chunks`` parts by a hash of its first order column (an
    id; only that and the group are read to size the parts). Rows are numbered
    inside each part, and a part begins where the parts before it
    end; only the part sizes (at most groups times chunks rows) meet. Rows that
    agree in all order columns may swap numbers among themselves.
    """
    part = "__part"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(order[0]), F.lit(chunks)))
    sizes = dealt.groupBy(*group, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, part).orderBy(*order)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*group, part])
        .withColumn(number, (F.col("__rank") - 1 + F.col("__offset")).cast("long"))
        .drop(part, "__rank", "__offset", "__n")
    )


def order_within(df: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, ... inside each group in the given order; equal rows may swap numbers.

    Rows are dealt by ranges of group and order, so a group that holds most
    rows is many ranges; only the sizes of ranges (a row per range and group in
    it) meet.
    """
    part, rank = "__part", "__rank"
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(df.repartitionByRange(parts, group, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(group, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("__group"), F.col(part).alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    ranked = ranged.withColumn(rank, F.row_number().over(Window.partitionBy(group, part).orderBy(*order)))
    same = ranked[group].eqNullSafe(offsets["__group"]) & (ranked[part] == offsets["__at"])
    return (
        ranked.join(offsets, same).withColumn(number, (F.col(rank) - 1 + F.col("__offset")).cast("long"))
        .drop(part, rank, "__group", "__at", "__offset")
    )

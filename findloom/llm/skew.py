"""Joins of rows with a table that has one row per key, when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000  # so many keys are dealt out at most; any other has less than a thousandth of the rows
HOT_ROWS = 1000  # keys with fewer rows need not be
SALTS = 64


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; the rows of a hot key go to ``SALTS`` places by a hash of ``by``.

    The list of hot keys has ``HOT_KEYS`` rows at most, so it can be broadcast,
    and the table grows by as many times ``SALTS`` rows. Null keys match nothing
    and are dealt out too.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS)
    hot = F.broadcast(counts.orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("__hot")))
    nothing = F.lit(False)
    for key in keys:
        nothing = nothing | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot") | nothing, salt).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = table.join(hot, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")

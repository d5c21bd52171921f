"""Packing by optimal length buckets.

The global histogram of padded lengths goes through a dynamic program that
chooses at most ``buckets`` boundaries so that padding every document to its
bucket's boundary wastes the fewest tokens. Inside a bucket, batches hold as
many documents as fit a token budget.

Scale: one aggregation makes the histogram. It has a row per distinct padded
length, so at most ``sqrt(2 * tokens) / sqrt(align)`` rows however many
documents there are (distinct lengths must add up to no more than all tokens),
and only it reaches the driver. The numbering deals each bucket to several
parts, so a bucket that holds most rows is not one task.

Defined results: a null or blank text has length 0 and pads to ``align``;
a document longer than the budget is a batch of its own (nothing is dropped or
cut); ids may repeat or be null, and rows with equal id and length may swap
places; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import number_within
from ..sources.storage import cut

BUCKETS = 16
BUDGET = 16_384
ALIGN = 8


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (the last is the largest length) with the least total padding.

    ``lengths`` ascend. The cost of a bucket satisfies the quadrangle
    inequality, so the best last cut moves one way and each layer is solved by
    divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    total = np.concatenate(([0.0], np.cumsum(counts * lengths, dtype=np.float64)))
    best = lengths * rows[1:] - total[1:]  # one bucket for the first i + 1 lengths
    cuts = []
    for _ in range(1, min(buckets, n)):
        nxt, cut = np.empty(n), np.zeros(n, dtype=np.int64)
        todo = [(0, n - 1, -1, n - 2)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            j = np.arange(first, min(last, mid - 1) + 1)  # the earlier buckets end at length j
            cost = lengths[mid] * (rows[mid + 1] - rows[j + 1]) - (total[mid + 1] - total[j + 1])
            cost = cost + np.where(j >= 0, best[j], 0.0)
            at = int(cost.argmin())
            nxt[mid], cut[mid] = cost[at], j[at]
            todo += [(low, mid - 1, first, int(j[at])), (mid + 1, high, int(j[at]), last)]
        best = nxt
        cuts.append(cut)
    ends, at = [], n - 1
    for cut in reversed(cuts):
        ends.append(int(lengths[at]))
        at = int(cut[at])
        if at < 0:
            return sorted(ends)
    return sorted([*ends, int(lengths[at])])


def pack(
    docs: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    align: int = ALIGN,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, pad_to, batch, place, padding``.

    ``length`` is the document's length in tokens. ``batch`` counts from 0
    inside a bucket and ``place`` inside a batch.
    """
    spark = docs.sparkSession
    lengths = cut(docs.select(docs[id_col].alias("doc_id"), length.cast("long").alias("n_tokens")))  # texts are read once
    padded = F.greatest(F.ceil(F.col("n_tokens") / align), F.lit(1)).cast("long") * align
    histogram = lengths.groupBy(padded.alias("padded")).agg(F.count("*").alias("n")).toArrow().sort_by("padded")
    ends = best_boundaries(
        histogram.column("padded").to_numpy().astype(np.float64), histogram.column("n").to_numpy(), buckets
    )
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(ends))):
        bucket = F.when(padded <= ends[i], F.lit(i)).otherwise(bucket)
    edges = F.array(*map(F.lit, ends)) if ends else F.array(F.lit(align))
    placed = lengths.select("doc_id", "n_tokens", bucket.alias("bucket")).withColumn(
        "pad_to", F.get(edges, F.col("bucket")).cast("long")
    )
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = number_within(placed, ["bucket", "pad_to"], ["doc_id", "n_tokens"], "__slot", chunks)
    fits = F.greatest(F.floor(F.lit(budget) / F.col("pad_to")), F.lit(1)).cast("long")
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "pad_to",
        F.floor(F.col("__slot") / fits).cast("long").alias("batch"),
        F.pmod("__slot", fits).alias("place"),
        (F.col("pad_to") - F.col("n_tokens")).alias("padding"),
    )

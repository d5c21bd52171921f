"""Embedding near-dedup with a forest of random-projection trees.

Vectors are compared only inside their label. Each tree splits the space again
and again at the sample's median along a random direction; a vector within
``margin`` of a split goes to both sides (spill), so that near vectors share a
leaf of at least one tree with high probability. Inside a leaf all pairs are
checked by cosine in double precision, in blocks, and linked ones are joined.

Scale: equal vectors of a label are one row with a weight before anything is
compared. Trees are fitted on at most ``SAMPLE`` vectors, chosen by a hash of
their id, and every vector is routed through all of them. Leaves that are still
large are split on, round after round, along fresh random directions at the
median of all their vectors, as long as that makes them smaller, so leaves do
not grow with the data. What no split divides (a dense cluster of near copies)
is cut into blocks, and each pair of blocks is one bounded group, so nothing is
left out however large a leaf is. A pair counts in the first leaf that its two
vectors share. Groups return one row per vector (its links, and one link to the
smallest vector of its part), never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing and stay; others link
whatever their length, also where its square overflows; vectors of different
dimensions are not compared; a repeated id is one row per row, and equal vectors
with equal ids still count each other; a vector with a null id links and counts
like any other, but names no component: it is kept only where its component has
no id at all (``component_id`` is null then); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from ..sources.storage import cut, stored
from .skew import spread_join

SAMPLE = 20_000
LEAF = 32  # vectors of a label that a leaf may have before it is split
LEAST = 24  # sampled vectors that a split needs
BLOCK = 1024
TREES = 4
LARGE = 4 * BLOCK  # vectors of a leaf that is split on
ROUNDS = 24  # of splits, at most; each halves what it can
_NONE = np.iinfo(np.int64).min  # no leaf
_NAMELESS = 1 << 62  # nodes without an id come after all with one


class Forest:
    """Trees in flat arrays: node ``i`` sends low projections to ``2i + 1`` and high ones to ``2i + 2``."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, margin: float, seed: int = 7):
        dim = sample.shape[1] if len(sample) else 0
        self.margin, self.trees = margin, []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            size = 2**depth - 1
            way, at = np.zeros((size, dim)), np.full(size, np.nan)
            parts = {0: np.arange(len(sample))}
            for node in range(size):
                rows = parts.pop(node, None)
                if rows is None or len(rows) < LEAST:
                    continue
                w = rng.standard_normal(dim)
                way[node] = w / np.linalg.norm(w)
                along = sample[rows] @ way[node]
                at[node] = np.median(along)
                low = along <= at[node]
                parts[2 * node + 1], parts[2 * node + 2] = rows[low], rows[~low]
            self.trees.append((way, at))

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """For each unit vector the numbers of all leaves it falls into, ascending."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for t, (way, at) in enumerate(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            while len(row):
                inner = node < len(at)
                inner[inner] = ~np.isnan(at[node[inner]])
                for r, n in zip(row[~inner].tolist(), node[~inner].tolist(), strict=True):
                    out[r].append(t << 32 | n)
                row, node = row[inner], node[inner]
                gap = np.einsum("ij,ij->i", x[row], way[node]) - at[node]
                low, high = gap <= self.margin, gap > -self.margin
                row, node = (
                    np.concatenate([row[low], row[high]]),
                    np.concatenate([2 * node[low] + 1, 2 * node[high] + 2]),
                )
        return [sorted(x) for x in out]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(np.float64)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector):
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def _group_links(x, weight, node, leaves, sides, leaf, least):
    """(node, weighted links counted here, smallest node of its part) of one group of unit vectors."""
    n = len(x)
    part, links = np.arange(n), np.zeros(n, dtype=np.int64)
    # Leaves before this one: a pair that shares one of them has been counted there.
    row, column = np.nonzero((leaves != _NONE) & (leaves < leaf))
    names, which, held = np.unique(leaves[row, column], return_inverse=True, return_counts=True)
    row, which = row[held[which] > 1], which[held[which] > 1]  # what one row has, no pair shares
    names, which = np.unique(which, return_inverse=True)
    pairs = []
    for low in range(0, n, BLOCK):
        a, b = np.nonzero(x[low : low + BLOCK] @ x.T >= least)
        keep = a + low < b
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        met = np.zeros((min(BLOCK, n - low), n), dtype=bool)
        for first in range(0, len(names), BLOCK):
            now = (which >= first) & (which < first + BLOCK)
            has = np.zeros((n, min(BLOCK, len(names) - first)), dtype=np.float32)
            has[row[now], which[now] - first] = 1
            met |= has[low : low + BLOCK] @ has.T > 0
        # In two blocks, pairs inside one block count where it meets itself.
        once = ~met[a, b] & ((sides[a + low] != sides[b]) | (sides.min() == sides.max()))
        a = a + low
        np.add.at(links, a[once], weight[b[once]])
        np.add.at(links, b[once], weight[a[once]])
        pairs.append((a, b))
    while pairs:  # smallest position of each linked part
        before = part.copy()
        for a, b in pairs:
            low = np.minimum(part[a], part[b])
            np.minimum.at(part, a, low)
            np.minimum.at(part, b, low)
        part = part[part]
        if (part == before).all():
            break
    some = (links > 0) | (part != np.arange(n))
    return node[some], links[some], node[part][some]


def _compare(least: float):
    def groups(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if not table.num_rows:
                continue
            keys = np.stack([table.column(k).to_numpy() for k in ("label", "leaf", "block_a", "block_b", "dim")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edge = [0, *new.tolist(), table.num_rows]
            for a, b in zip(edge[:-2], edge[1:-1], strict=True):
                yield table.slice(a, b - a)
            held = table.slice(edge[-2])
        if held is not None:
            yield held

    def run(batches):
        for group in groups(batches):
            if group.num_rows < 2:
                continue
            group = group.sort_by("node").combine_chunks()
            x = _unit(_matrix(group.column("vector").chunk(0)))
            lists = group.column("leaves").to_pylist()
            leaves = np.full((len(lists), max(map(len, lists))), _NONE, dtype=np.int64)
            for i, row in enumerate(lists):
                leaves[i, : len(row)] = row
            found = _group_links(
                x, group.column("weight").to_numpy(), group.column("node").to_numpy(), leaves,
                group.column("own").to_numpy(), group.column("leaf")[0].as_py(), least,
            )
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["node", "links", "low"])

    return run


def _along(batches):
    """Rows (leaf, dim, vector, ...) with the projection of the unit vector on a random direction of the leaf's own."""
    ways: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        leaf, dim = batch.column("leaf").to_numpy(), batch.column("dim").to_numpy()
        out = np.zeros(batch.num_rows)
        pairs, which = np.unique(np.stack([leaf, dim]), axis=1, return_inverse=True)
        for i, (name, size) in enumerate(pairs.T.tolist()):
            if (name, size) not in ways:
                ways = ways if len(ways) < 10_000 else {}
                way = np.random.default_rng([name & 0xFFFFFFFF, name >> 32 & 0xFFFFFFFF, size]).standard_normal(size)
                ways[name, size] = way / np.linalg.norm(way)
            at = np.flatnonzero(which.ravel() == i)
            out[at] = _unit(_matrix(batch.column("vector").take(pa.array(at)))) @ ways[name, size]
        columns = [batch.column(n) for n in ("label", "leaf", "dim", "key", "vector")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], ["label", "leaf", "dim", "key", "vector", "along"])


def _split_on(routed: DataFrame, margin: float) -> DataFrame:
    """``routed`` with leaves over ``LARGE`` split until they are small or no split makes them smaller."""
    names = ["label", "leaf", "dim"]
    routed = stored(routed, "leaves")
    sizes = routed.select("label", F.explode("leaves").alias("leaf"), "dim").groupBy(*names).agg(F.count("*").alias("n"))
    big = stored(sizes.where(F.col("n") > LARGE), "leaves")
    if big.isEmpty():
        return routed
    every = routed.select("label", F.explode("leaves").alias("leaf"), "dim", "key", "vector")
    whole = spread_join(every, big, names, ["key"])
    small = whole.where("n is null").select("key", "leaf")
    rows = stored(whole.where("n is not null").select(*names, "key", "vector"), "leaves")
    for _ in range(ROUNDS):
        placed = stored(rows.mapInArrow(_along, "label long, leaf long, dim int, key long, vector array<double>, along double"), "leaves")
        middle = placed.groupBy(*names).agg(F.percentile_approx("along", 0.5, 1000).alias("middle"), F.count("*").alias("n"))
        sided = spread_join(placed, middle, names, ["key"])
        sides = F.array_compact(F.array(
            F.when(F.col("along") <= F.col("middle") + margin, F.lit(0)), F.when(F.col("along") > F.col("middle") - margin, F.lit(1))
        ))
        split = stored(sided.withColumn("side", F.explode(sides)).select(*names, "key", "vector", "n", "side"), "leaves")
        halves = split.groupBy(*names, "side", "n").agg(F.count("*").alias("half"))
        # A split that leaves nine tenths or more on one side is not made.
        made = halves.groupBy(*names).agg(
            (F.max("half") < 0.9 * F.max("n")).alias("made"), F.max(F.when(F.col("side") == 0, F.col("half"))).alias("low"),
            F.max(F.when(F.col("side") == 1, F.col("half"))).alias("high"),
        )
        told = spread_join(split, made, names, ["key"])
        old = told.where("not made").select("key", "leaf").distinct()
        size = F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high"))
        new = stored(
            told.where("made").select(
                "label", F.xxhash64("leaf", "side").alias("leaf"), "dim", "key", "vector", (size > LARGE).alias("large")
            ),
            "leaves",
        )
        small = small.unionByName(old).unionByName(new.where("not large").select("key", "leaf"))
        rows = new.where("large").drop("large")
        if rows.isEmpty():
            break
    else:
        small = small.unionByName(rows.select("key", "leaf"))
    lists = small.groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    return routed.drop("leaves").join(lists, "key")


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.98,
    trees: int = TREES,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"),
        vectors[vector_col].cast("array<double>").alias("vector"),
        vectors[label_col].cast("long").alias("label"),
    )
    usable = _usable(F.col("vector")) & F.col("label").isNotNull()
    nameless = F.lit(_NAMELESS) + F.shiftrightunsigned(F.xxhash64("label", "vector"), 2)
    nodes = cut(
        rows.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
        .withColumn("node", F.coalesce("node", nameless)).withColumn("dim", F.size("vector"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    total = sizes["n"] if sizes else 0
    most = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(most, 1) / LEAF)))
    depth = min(depth, max(0, math.floor(math.log2(SAMPLE / LEAST))))
    links = None
    # Trees serve the commonest length; vectors of other lengths share one leaf per label and length.
    dim = sizes["dim"] if sizes else 1
    every = max(1, total // SAMPLE)
    sample = (
        nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node"), F.lit(every)) == 0))
        .select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
    )
    unit = np.array(sample.column("vector").to_pylist(), dtype=np.float64).reshape(-1, dim)
    unit = _unit(unit) if len(unit) else unit
    margin = math.sqrt(max(0.0, 2 - 2 * min_cosine) / dim)
    forest = Forest(unit, trees, depth, margin)

    def route(batches):
        for batch in batches:
            same = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            lists = [[0]] * batch.num_rows
            if len(same):
                x = _unit(_matrix(batch.column("vector").take(pa.array(same))))
                for i, found in zip(same.tolist(), forest.leaves(x), strict=True):
                    lists[i] = found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"]
            )

    schema = "label long, vector array<double>, node long, weight long, dim int, key long, leaves array<long>"
    routed = _split_on(nodes.mapInArrow(route, schema), margin)
    spread = routed.withColumn("leaf", F.explode("leaves"))
    heavy = (
        spread.groupBy("label", "leaf", "dim").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select("label", "leaf", "dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = (
        spread.join(heavy, ["label", "leaf", "dim"], "left")
        .withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumn("block_a", F.least("own", "other"))
        .withColumn("block_b", F.greatest("own", "other"))
        .select("label", "leaf", "dim", "block_a", "block_b", "own", "node", "weight", "vector", "leaves")
    )
    keys = ["label", "leaf", "dim", "block_a", "block_b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links = cut(
        dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
        .mapInArrow(_compare(min_cosine), "node long, links long, low long")
    )
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("low").alias("b")))
    found = (
        nodes.select("label", "vector", "node", "weight").join(counts, "node", "left").join(groups, "node", "left")
        .select(
            "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    joined = rows.withColumn("label", F.when(usable, F.col("label"))).join(found, ["label", "vector"], "left")
    component = F.when(F.coalesce("component", F.lit(0)) >= _NAMELESS, None).otherwise(F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component.isNull() | F.coalesce(component == F.col("vec_id"), F.lit(False))).alias("kept"),
    )

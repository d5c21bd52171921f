"""Large groups of near copies most of which are not similar to each other."""

import random

import numpy as np
from pyspark.sql import functions as F

from findloom.llm import components, simhash


def test_pairs_of_a_group_are_few_and_no_link_is_lost(spark, monkeypatch):
    random.seed(7)
    base = [f"w{i}" for i in range(120)]
    texts = [base] + [[f"x{k}y{random.random()}" if random.random() < k / 3000 else w for w in base] for k in range(240)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    sets = [simhash.shingles(" ".join(t), 5) for t in texts]
    n = [len(s) for s in sets]
    shared = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    links = [(i, j) for i in range(len(n)) for j in range(i) if shared[i][j] >= 0.8 * (n[i] + n[j] - shared[i][j])]
    parent = list(range(len(n)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    made = []
    cross = simhash._cross

    def counted(least):
        run = cross(least)
        made.append(spark.sparkContext.accumulator(0))
        total = made[-1]

        def rows(batches):
            for out in run(batches):
                total.add(len(set(zip(*(c.to_pylist() for c in out.columns), strict=True))))
                yield out

        return rows

    monkeypatch.setattr(simhash, "_cross", counted)
    found = simhash.similar_components(docs, 5, 0.8)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {i: got.get(i, i) for i in range(len(n))} == {i: root(i) for i in range(len(n))}
    assert len({root(i) for i in range(len(n))}) > 20  # several texts stay apart from the group
    assert made[0].value < 4000  # 5431 when every pair under a shingle was made


def test_few_links_make_few_tasks(spark, monkeypatch):
    parts = []
    cut = components.cut

    def counted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "cut", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = components.connected_components(chain)
        assert {r["component"] for r in found.collect()} == {0} and found.count() == 201
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(parts[1:]) == {1}

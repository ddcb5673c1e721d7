"""Clustering against plain integers, and its edge cases."""

import hashlib
import math

import pytest

import __spark_entry__ as entry
from movelines.llm import clusters

SF = "/root/testdata/sf0.001"


def by_hand(rows, k, rounds, dims, seed=2):
    """(id, cluster, distance, cluster inertia, inertia, centroid) of each kept row."""
    kept = [(i, [max(-clusters.LIMIT, min(clusters.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, own)), j) for j, own in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in kept]
    total = [sum(d for d, j in last if j == i) for i in range(len(c))]
    return sorted(((i, j, d, total[j], sum(total), ",".join(map(str, c[j]))) for (i, _), (d, j) in zip(kept, last)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in by_hand(rows, 40, 5, 64)]
    assert got(entry.queries()["op13_clusters"](spark, SF)) == sorted(want, key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.5, -0.5]), (None, [9.0, 9.0]), (None, [0.1, 0.2]), (3, None), (4, []), (5, [1.0]), (6, [1.0, nan]), (7, [1.0, inf]), (8, [None, 1.0]), (9, [1e300, -1e300]), (10, [-0.0, 0.001])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")
    for k, rounds in ((3, 4), (1, 0), (50, 2)):
        assert got(clusters.cluster_vectors(d, k=k, rounds=rounds, dims=2)) == by_hand(rows, k, rounds, 2)
    assert clusters.cluster_vectors(d.limit(0), dims=2).collect() == []
    assert clusters.cluster_vectors(d, dims=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(ValueError):
        clusters.cluster_vectors(d, k=0)


def test_means_round_down_and_empty_clusters_stay(spark):
    rows = [(k, [x]) for k, x in enumerate([-0.01, -0.012, -0.013, 1.0, 1.0, 1.0, 5.0, -5.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(clusters.cluster_vectors(d, k=5, rounds=5, dims=1)) == by_hand(rows, 5, 5, 1)
    same = [(k, [2.0]) for k in range(6)]  # all centroids start alike; all but the first stay empty
    assert got(clusters.cluster_vectors(spark.createDataFrame(same, "vec_id long, embedding array<double>"), k=3, rounds=2, dims=1)) == by_hand(same, 3, 2, 1)


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, [1, 2])], "_id long, v array<bigint>")
    own = rows.select("v", clusters.nearest(rows.v, [[1, 2], [3, 4]])["cluster"].alias("cluster")).groupBy("cluster").agg(*clusters.column_sums(2))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "HashAggregate" in plan

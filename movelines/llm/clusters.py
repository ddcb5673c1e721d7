"""Centroid clustering of integer vectors with JVM expressions only.

Vectors become arrays of integers once, and are stored. Each round writes the centroids into the
plan as literal arrays: zip_with and aggregate give the squared distance to each (in integers,
without the vector's own square), array_min of (distance, number) structs the cluster, and one
aggregation with a sum for each component the next centroids. Sums are combined before the shuffle, so a cluster of any size sends one row a
task, and only the centroids (k rows) come to the driver, where they are divided exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Components beyond this count as it, so that no distance or sum can leave 64 bits: squared
#: distances stay below 2**58, and sums over 2**38 vectors below 2**62.
LIMIT = 1 << 24


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))


def complete(vector: Column, dims: int) -> Column:
    """Whether it has exactly dims components, none null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & F.coalesce(fine, F.lit(False))


def literal(centroids: list[list[int]]) -> Column:
    """The centroids as one constant array: of each twice its components, and its squared length.
    Numbers in texts, which the optimizer folds."""
    one = lambda c: f"named_struct('square', {sum(x * x for x in c)}L, 'twice', cast(split('{','.join(str(2 * x) for x in c)}', ',') as array<bigint>))"
    return F.expr("array(" + ", ".join(map(one, centroids)) + ")")


def square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0).cast("long"), lambda s, x: s + x * x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; ties by the smaller number. distance is the
    squared one less the vector's own square, which is the same for all centroids."""
    from_one = lambda c: F.aggregate(F.zip_with(vector, c["twice"], lambda a, b: a * b), c["square"], lambda s, x: s - x)
    return F.array_min(F.transform(literal(centroids), lambda c, k: F.struct(from_one(c).alias("distance"), k.alias("cluster"))))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose `seed:id` has the smallest SHA-256, in its order; ties by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.select("v", key.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def column_sums(dims: int) -> list[Column]:
    return [F.count("*").alias("n"), *map(F.expr, (f"sum(get(v, {j})) as s{j}" for j in range(dims)))]


def next_centroids(rows: DataFrame, centroids: list[list[int]], sums: list[Column]) -> list[list[int]]:
    """Each centroid's vectors' mean, rounded down component by component; an empty one stays."""
    own = rows.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(*sums)
    out = list(centroids)
    for r in own.collect():  # at most k rows
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(len(sums) - 1)]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """One row per complete vector: id, cluster, distance (squared), cluster_inertia (distances
    summed over the cluster), inertia (over all), centroid (its components, decimal, joined by
    commas).

    A vector that is null, of another length, or that holds a null or non-finite component is left
    out. Rows with a null id are clustered, but start no centroid while others are left; rows that
    share an id are separate rows, also as starts. With fewer than k vectors each starts one. An
    empty table gives none. Components beyond 65,536 in size count as that; an inertia beyond 64
    bits is null. Other columns are ignored.
    """
    if k < 1 or rounds < 0 or dims < 1:
        raise ValueError("k and dims must be positive, rounds not negative")
    spark, v = vectors.sparkSession, F.col(vector_col).cast("array<double>")
    rows = vectors.filter(complete(v, dims)).select(F.col(id_col).cast("long").alias("_id"), integers(v, scale).alias("v"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if vectors.rdd.getNumPartitions() < tasks:  # few bytes of vectors are much work
        rows = rows.repartition(tasks)
    rows = materialise(rows)
    centroids, columns = first_centroids(rows, k, seed), column_sums(dims)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(rows, centroids, columns)
    if not centroids:
        empty = "cast(null as int) as cluster", *(f"cast(null as long) as {c}" for c in ("distance", "cluster_inertia", "inertia")), "cast(null as string) as centroid"
        return rows.filter("false").select(F.col("_id").alias(id_col), *map(F.expr, empty))
    last = rows.select("_id", nearest(F.col("v"), centroids).alias("n"), square(F.col("v")).alias("square"))
    last = materialise(last.select("_id", "n.cluster", (F.col("n.distance") + F.col("square")).alias("distance")))
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # at most k rows
    known = None not in sums.values() and sum(sums.values()) < 1 << 63
    by_cluster = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    return last.select(
        F.col("_id").alias(id_col),
        "cluster",
        "distance",
        by_cluster([sums.get(j) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values()) if known else None).cast("long").alias("inertia"),
        by_cluster([",".join(map(str, c)) for c in centroids], "string").alias("centroid"),
    )

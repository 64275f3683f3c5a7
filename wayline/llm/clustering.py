"""Clustering around centroids in exact integers, with built-in expressions only.

Components become integers once and are written. A round is one scan: ``zip_with`` and ``aggregate`` work out every vector's
squared distance to each centroid (a literal array), ``array_min`` of (distance, number) structs takes the nearest one, and
sums of the components' columns, in generated code with partial sums in every task, give the next centroids. A row for each
cluster comes to the driver, so vectors are never shuffled or collected; the number of clusters and of components bounds the rest.

Defined cases: vectors with a null or non-finite component, or with another number of components than asked for, are left out;
fewer vectors than clusters make so many clusters; ties of distance go to the smaller number; first centroids with the same hash (ids that
repeat) come in order of their components, null ids after all others; equal first centroids stay apart, the later ones empty;
repeated rows give repeated rows; an empty table gives no rows. A component, distance or sum beyond 64 bits is an error.
Further columns pass through, of the names that this operator adds the input's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import free, others, written

CLUSTERS, ROUNDS, DIMS = 8, 10, 64
#: Integers for one of a component's unit, and what the ids' hashes begin with.
SCALE, SEED = 1024, 3
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~x.cast("double").isin(float("nan"), float("inf"), float("-inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, worked out in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def squared_distance(vector: Column, centroid: Sequence[int]) -> Column:
    parts = F.zip_with(vector, F.lit(np.array(centroid, np.int64)), lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + x)


def nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; of equal distances the smaller number."""
    return F.array_min(F.array(*(F.struct(squared_distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def first_centroids(vectors: DataFrame, vector: str, vec_id: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; Spark keeps k rows of each task."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    rows = vectors.orderBy(said.asc_nulls_last(), F.col(vector)).limit(k).select(vector).collect()
    return [list(r[0]) for r in rows]


def moved(vectors: DataFrame, vector: str, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of its vectors' means; those without vectors stay."""
    dims, out = range(len(centroids[0])), list(centroids)
    near = vectors.select(nearest(F.col(vector), centroids)["cluster"].alias("c"), F.col(vector).alias("x"))
    sums = near.groupBy("c").agg(F.count("*").alias("n"), *(F.expr(f"sum(x[{d}]) AS s{d}") for d in dims))
    for row in sums.collect():  # a row for each cluster
        out[row["c"]] = [row[f"s{d}"] // row["n"] for d in dims]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vectors (whole ones of ``dims`` components) with cluster (int), distance (squared), cluster_inertia, inertia and centroid (array of its integers)."""
    passed = others(vectors.columns, ADDED)
    (x,) = free([*vectors.columns, *ADDED], "x")
    kept = vectors.where(whole(F.col(vector)) & (F.size(vector) == dims))
    kept = written(kept.select(*dict.fromkeys([*passed, vec_id]), integers(F.col(vector), scale).alias(x)), "vectors")
    centroids = first_centroids(kept, x, vec_id, k, seed)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(kept, x, centroids)
        if centroids == before:  # all further rounds would leave them where they are
            break
    if not centroids:
        kinds = dict(zip(ADDED, ("int", "bigint", "bigint", "bigint", "array<bigint>"), strict=True))
        return kept.select(*passed, *(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
    (best,) = free([*passed, *ADDED], "best")
    near = kept.select(*passed, nearest(F.col(x), centroids).alias(best))
    near = written(near.select(*passed, F.col(best)["cluster"].alias("cluster"), F.col(best)["distance"].alias("distance")), "assigned")
    sums = {r["cluster"]: r["s"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = F.lit(np.array([sums.get(c, 0) for c in range(len(centroids))], np.int64))
    at = F.array(*(F.lit(np.array(c, np.int64)) for c in centroids))
    total = F.lit(sum(sums.values())).cast("long")
    return near.select(*passed, "cluster", "distance", F.get(of, F.col("cluster")).alias("cluster_inertia"), total.alias("inertia"), F.get(at, F.col("cluster")).alias("centroid"))


def digest(centroid: Column) -> Column:
    """Hash of a centroid's components, as decimal integers with commas between."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

"""Lloyd's algorithm over integer vectors, exact and the same on any cluster.

A component x counts as floor(256 * x), x as double. Each round the centroids (k rows) go
to all tasks, which compute squared differences in int64, one centroid after another, and
take the lowest number among the nearest; a task sends a sum for each cluster, and the
sums of the tasks meet in a groupBy. New centroids are floor(sum / count), exact.

Vectors that are null, of another length, or hold a null or non-finite component take no part. Components
beyond 2^26 in amount count as 2^26, so that nothing passes 64 bits. Rows with one vec_id are
vectors of their own; a null vec_id is kept and never a first centroid; other columns are
ignored. With fewer vectors than k there are as many centroids as vectors with an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

LIMIT = 1 << 26


def whole_vectors(frame: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """The rows whose vector has only finite components (``size`` of them, if given)."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = frame.where(F.col(vector).isNotNull() & inside)
    return rows if size is None else rows.where(F.size(vector) == size)


def integers(vector: str):
    """floor(256 * x) of each component, within LIMIT."""
    bounded = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), 256 * x.cast("double")))
    return F.transform(vector, lambda x: F.floor(bounded(x)).cast("int"))


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, size), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the lowest number on ties."""
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for number, c in enumerate(centroids):
        off = x - c
        distance = np.einsum("ij,ij->i", off, off)
        closer = distance < least
        best[closer], least[closer] = number, distance[closer]
    return best, least


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _matrix(batch["x"], centroids.shape[1])
            best, _ = nearest(x, centroids)
            order = np.argsort(best, kind="stable")
            met, at = np.unique(best[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(x[order], at, axis=0)
            counts += np.bincount(best, minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": counts[met], "sums": list(sums[met])})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, distance = nearest(_matrix(batch["x"], centroids.shape[1]), centroids)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; one without vectors stays."""
    parts = vectors.select("x").mapInPandas(_sums(centroids), "cluster int, n long, sums array<long>")
    merged = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place").agg(F.sum("value").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in merged.collect():  # a row for each centroid's component
        out[r.cluster, r.place] = r.total // r.n
    return out


def clusters(frame: DataFrame, k: int = 40, size: int = 64, rounds: int = 5, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    vectors = stored(whole_vectors(frame.select("vec_id", "embedding"), "embedding", size).select("vec_id", integers("embedding").alias("x")), "vectors")
    hashed = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy("h", "x").limit(k).select("x").collect()  # k rows
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), size)
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return frame.sparkSession.createDataFrame([], kinds)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = stored(vectors.mapInPandas(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, inertia[i], sum(inertia.values()), digest[i]) for i in sorted(inertia)]
    about = frame.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows

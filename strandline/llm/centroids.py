"""Centroid clustering in whole numbers: Lloyd's rounds whose assignments use partial-distance search.

Components become ``floor(scale * x)``, so every sum, distance and tie is exact and no order of tasks can change a
result. A task holds one Arrow batch of vectors at a time and goes through the centroids: squared differences are
added up over the dimensions of highest variance first, a few at a time; vectors whose partial sum is already
strictly above their current best leave, the survivors finish all dimensions. Each task returns at most one row a
centroid (count and sums), which Spark adds up; the driver sees the centroids alone (``k`` x ``dims`` numbers). Every
pass reads the stored whole-number vectors, so a lost executor costs only its own tasks.

Results in special cases: vectors that are null, of another length, or hold null or non-finite components take no
part; a null id is hashed as the empty string; repeated rows are rows of their own (equal hashes are ordered by
the vectors' components); fewer than ``k`` vectors give that many centroids, an empty table no rows; equally near
centroids: the smaller number; a centroid without vectors stays where it is. A component beyond +-2**27 after
scaling is an error, since distances would not fit into a long. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col, discard, prepare, stored

#: Dimensions that are added up between two looks at the current best.
STEP = 8
#: Largest scaled component: 64 squared differences of twice this fit into a long.
MOST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    v = F.col(value)
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    far = F.exists(v, lambda x: F.abs(x.cast("double")) * scale > MOST)
    checked = F.when(far, F.raise_error(F.lit(f"a component beyond {MOST} after scaling")).cast("array<int>")).otherwise(whole.cast("array<int>"))
    return vectors.where((F.size(v) == dims) & F.forall(v, fit)).select(F.col(key).alias("vec_id"), checked.alias("v"))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(col(batch, "v").flatten(), np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) of every row of ``x``; ties to the smaller number.

    ``order`` has the dimensions by falling variance. What all centroids have in their first ``STEP`` dimensions
    names the one that is finished first, so that the others are soon above it.
    """
    n, dims = x.shape
    x, c = x[:, order], centroids[:, order]
    head = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(axis=2)
    which = head.argmin(axis=1)
    best = head[np.arange(n), which] + ((x[:, STEP:] - c[which, STEP:]) ** 2).sum(axis=1)
    first = which.copy()
    for j in range(len(c)):
        rows = np.flatnonzero((head[:, j] <= best) & (first != j))
        part = head[rows, j]
        for at in range(STEP, dims, STEP):
            if not len(rows):
                break
            part = part + ((x[rows, at : at + STEP] - c[j, at : at + STEP]) ** 2).sum(axis=1)
            left = part <= best[rows]
            rows, part = rows[left], part[left]
        better = (part < best[rows]) | (j < which[rows])
        rows, part = rows[better], part[better]
        best[rows], which[rows] = part, j
    return which, best


def by_variance(vectors: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance over all vectors; only the order in which they are looked at depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            x = matrix(b, dims).astype(float)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        if n:
            yield pa.record_batch({"dim": np.arange(dims), "n": np.full(dims, n), "one": one, "two": two})

    rows = vectors.select("v").mapInArrow(run, "dim long, n long, one double, two double").groupBy("dim").agg(F.sum("n"), F.sum("one"), F.sum("two")).collect()
    spread = np.zeros(dims)
    for dim, n, one, two in rows:
        spread[dim] = two / n - (one / n) ** 2
    return np.argsort(-spread, kind="stable")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; one pass that keeps ``k`` rows a task."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of each cluster's mean."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = matrix(b, dims)
            which, _ = nearest(x, centroids, order)
            counts += np.bincount(which, minlength=k)
            for j in range(k):
                sums[j] += x[which == j].sum(axis=0)
        for j in np.flatnonzero(counts):
            yield pa.record_batch({"cluster": np.full(dims, j), "dim": np.arange(dims), "n": np.full(dims, counts[j]), "total": sums[j]})

    parts = vectors.select("v").mapInArrow(run, "cluster long, dim long, n long, total long")
    out = centroids.copy()
    for cluster, dim, n, total in parts.groupBy("cluster", "dim").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        out[cluster, dim] = int(total) // n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, best = nearest(matrix(b, dims), centroids, order)
            yield pa.record_batch({"vec_id": col(b, "vec_id"), "cluster": which.astype(np.int32), "distance": best})

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3, key: str = "vec_id", value: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids) of all vectors that take part."""
    spark = vectors.sparkSession
    prepare(spark)
    schema = f"vec_id {vectors.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    own = stored(whole_vectors(vectors, dims, scale, key, value), "vectors")
    centroids = first_centroids(own, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema), []
    order = by_variance(own, dims)
    for _ in range(rounds):
        centroids = moved(own, centroids, order)
    rows = stored(assigned(own, centroids, order), "clusters")
    discard(own)
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = sum(sums.values())
    about = spark.createDataFrame([(j, s, total, digest(centroids[j])) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(about), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), list(centroids)

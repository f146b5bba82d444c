"""Lloyd's clustering of integer vectors: exact sums and floors, so that results are the same at any partitioning.

Centroids go to every task; each batch's squared differences are taken per centroid in NumPy, and tasks send one row of integer
sums for each centroid that some vector of theirs is nearest to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
LARGEST = 1 << 80  # integers beyond are taken as this
SAFE = 1 << 27  # up to here, squared distances of 64 components fit into 64 bits
EXACT = {"precision": 38, "scale": 0}


@dataclass(frozen=True)
class Lloyd:
    """k centroids of dims components, got from floor(scale * x), over rounds rounds; seeds are the vectors whose id has the least hash after salt.

    k * dims numbers go to all tasks."""

    k: int = 16
    dims: int = 64
    scale: int = 64
    rounds: int = 3
    salt: str = "1:"
    rows: int = 8192


def as_integers(vectors: pa.Array, p: Lloyd) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integers): rows of exactly dims components, none null or non-finite. 64-bit integers, or Python's where larger."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == p.dims)
    flat = vectors.take(pa.array(at)).flatten()
    x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, p.dims)  # null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    at, x = at[fine], x[fine]
    with np.errstate(over="ignore"):
        y = np.floor(x * p.scale)
    if len(y) and np.abs(y).max() > SAFE:
        each = [max(-LARGEST, min(LARGEST, int(v) if np.isfinite(v) else int(np.sign(v)) * LARGEST)) for v in y.reshape(-1)]
        return at, np.array(each, object).reshape(y.shape)
    return at, y.astype(np.int64)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number on ties."""
    wide = x.dtype == object or any(abs(v) > SAFE for c in centroids for v in c)
    kind = object if wide else np.int64
    x, best, cluster = x.astype(kind, copy=False), None, np.zeros(len(x), np.int32)
    for j, c in enumerate(centroids):
        off = x - np.array(c, kind)
        d = (off * off).sum(axis=1) if wide else np.einsum("ij,ij->i", off, off)
        if best is None:
            best = d
        else:
            less = (d < best).astype(bool)
            best, cluster = np.where(less, d, best), np.where(less, j, cluster).astype(np.int32)
    return cluster, best


def whole(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(**EXACT))


def _sums(p: Lloyd, centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each centroid with vectors in this task: their number, summed distance and summed components."""
        n, far = [0] * len(centroids), [0] * len(centroids)
        totals = [[0] * p.dims for _ in centroids]
        for batch in batches:
            for i in range(0, batch.num_rows, p.rows):
                _, x = as_integers(batch.column("embedding").slice(i, p.rows), p)
                cluster, d = nearest(x, centroids)
                for j in np.unique(cluster).tolist():
                    own = cluster == j
                    n[j] += int(own.sum())
                    far[j] += sum(min(LONG, v) for v in d[own].tolist())
                    totals[j] = [a + int(b) for a, b in zip(totals[j], x[own].sum(axis=0))]
        some = [j for j in range(len(centroids)) if n[j]]
        flat = whole([v for j in some for v in totals[j]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()), pa.array([n[j] for j in some], pa.int64()), whole([far[j] for j in some]),
                pa.ListArray.from_arrays(pa.array(range(0, p.dims * len(some) + 1, p.dims), pa.int32()), flat),
            ],
            names=["cluster", "n", "far", "sums"],
        )

    return run


def _seeds(p: Lloyd):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = as_integers(batch.column("embedding"), p)
            ids = batch.column("vec_id").take(pa.array(at))
            flat = whole([int(v) for v in x.reshape(-1)])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(range(0, p.dims * len(at) + 1, p.dims), pa.int32()), flat)], names=["vec_id", "x"])

    return run


def seeds(vectors: DataFrame, p: Lloyd = Lloyd()) -> list[list[int]]:
    """The k kept vectors whose ids have the least sha256, in its order; of one id, those of smaller components first. k rows come to the driver."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    hashed = vectors.select("vec_id", "embedding").where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(p.salt), F.col("vec_id").cast("string")), 256))
    # only ids of the least hashes are read as integers; rows of other lengths or with null or non-finite components are sieved out before
    fine = (F.size("embedding") == p.dims) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    first = hashed.where(fine).orderBy("h", "embedding").limit(p.k)
    got = first.select("vec_id", "embedding").mapInArrow(_seeds(p), f"vec_id {kind}, x array<decimal(38,0)>").collect()
    return [x for _, x in sorted((hashlib.sha256(f"{p.salt}{r.vec_id}".encode()).hexdigest(), [int(v) for v in r.x]) for r in got)]


def totals(vectors: DataFrame, centroids: list[list[int]], p: Lloyd) -> dict[int, tuple[int, int, list[int]]]:
    """n, summed distance and summed components by cluster; k rows come to the driver."""
    parts = vectors.select("embedding").mapInArrow(_sums(p, centroids), "cluster int, n bigint, far decimal(38,0), sums array<decimal(38,0)>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(p.dims)]
    return {r.cluster: (r.n, int(r.far), [int(r[f"s{i}"]) for i in range(p.dims)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *sums).collect()}


def fit(vectors: DataFrame, p: Lloyd = Lloyd()) -> list[list[int]]:
    """Centroids after p.rounds rounds; a centroid without vectors stays as it is. One pass over the vectors a round."""
    centroids = seeds(vectors, p)
    for _ in range(p.rounds if centroids else 0):
        for j, (n, _, sums) in totals(vectors, centroids, p).items():
            centroids[j] = [v // n for v in sums]
    return centroids


def _assign(p: Lloyd, centroids: list[list[int]], inertia: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], pa.string())
        own = pa.array([min(LONG, v) for v in inertia], pa.int64())
        for batch in batches:
            for i in range(0, batch.num_rows, p.rows):
                part = batch.slice(i, p.rows)
                at, x = as_integers(part.column("embedding"), p)
                if not len(at) or not centroids:
                    continue
                cluster, d = nearest(x, centroids)
                number = pa.array(cluster)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)), number, pa.array([min(LONG, int(v)) for v in d], pa.int64()), own.take(number),
                        pa.array(np.full(len(at), min(LONG, sum(inertia)))), digests.take(number),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def assign(vectors: DataFrame, centroids: list[list[int]], p: Lloyd = Lloyd()) -> DataFrame:
    """One row per kept row of vectors (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Rows whose embedding is null, has another length, or holds null or non-finite components are left out. A null vec_id is no seed but is
    assigned; rows that share a vec_id are vectors of their own. With fewer vectors than k there are as many centroids as vectors, and no rows
    give no rows. Equal distances go to the smaller number. Numbers of floor(scale * x) beyond 2**80 are taken as that; distances and inertias above 2**63 - 1
    are given as that. Extra columns are ignored.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    last = totals(vectors, centroids, p) if centroids else {}
    inertia = [last[j][1] if j in last else 0 for j in range(len(centroids))]
    fields = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return vectors.select("vec_id", "embedding").mapInArrow(_assign(p, centroids, inertia), fields)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return assign(vectors, fit(vectors))

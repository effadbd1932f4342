"""Clustering of vectors around centroids, in whole numbers and without any rounding.

Components become integers by a power-of-two scale. A block of vectors meets all
centroids in one matrix product, |x|^2 - 2 x.c + |c|^2: every partial sum stays below
2**53 in magnitude where ``dims * (max|x| + max|c|)**2`` does, so float64 holds it
exactly. Vectors beyond that bound are compared in 64-bit integers, and beyond 2**63
in Python's own. Each partition gives a row of sums, which an RDD ``treeAggregate``
adds up, so the driver gets ``clusters * dims`` numbers a round and nothing per vector.

Cases: rows whose vector is null, of another length, or holds a null, an infinity or
NaN are left out. Repeated rows are vectors of their own; an id that several rows
share gives each the same start hash, and ties go to the smaller components. A null id
never starts a centroid while others are left, and stays null. With fewer vectors than
clusters there are as many centroids as vectors; an empty table gives no rows. A
distance or an inertia that no long holds is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that meet the centroids in one product.
BLOCK = 4096
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
_LONG = (1 << 63) - 1

Centroids = list[list[int]]
#: Of each centroid: how many vectors, the sums of their components, the sum of their distances.
Sums = tuple[list[int], list[list[int]], list[int]]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 where that is exact, else as Python integers; ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[math.floor(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in row] for row in vectors.tolist()], object)


def _nearest_exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance by differences, in the integers of the arrays' type; a centroid at a time."""
    best = ((x - c[0]) ** 2).sum(axis=1)
    at = np.zeros(len(x), np.int64)
    for k in range(1, len(c)):
        d = ((x - c[k]) ** 2).sum(axis=1)
        closer = (d < best).astype(bool)
        best[closer], at[closer] = d[closer], k
    return at, best


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """Nearest centroid of each row (the smaller number of equals) and its squared distance, exactly."""
    dims = x.shape[1]
    largest = max((abs(v) for c in centroids for v in c), default=0)
    at, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    reach = np.abs(x).max(axis=1) if dims and len(x) else np.zeros(len(x))
    # float64 rounds whole numbers beyond 2**53 only; those fail either test, rounded or not.
    with np.errstate(over="ignore"):
        bound = dims * (reach + largest) ** 2 if largest < EXACT else np.full(len(x), np.inf)
    near = np.array(bound < EXACT, bool)
    middle = ~near & np.array(bound < (1 << 62), bool)
    if near.any():
        a, c = x[near].astype(np.float64), np.array(centroids, np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(axis=1)
        at[near] = d.argmin(axis=1)
        distance[near] = d[np.arange(len(a)), at[near]].astype(np.int64)
    if middle.any():
        at[middle], distance[middle] = _nearest_exact(x[middle].astype(np.int64), np.array(centroids, np.int64))
    far = ~near & ~middle
    if far.any():
        at[far], distance[far] = _nearest_exact(np.array([[int(v) for v in row] for row in x[far].tolist()], object), np.array(centroids, object))
    return at, distance.tolist()


def _blocks(batches: Iterable[pa.RecordBatch], scale: int, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield part.column(0), whole(values, scale)


def _sums_of(centroids: Centroids, scale: int, dims: int):
    """A row for each cluster that a partition has vectors of; sums travel as decimal text, which bounds nothing."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.string()), ("distance", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, far = [0] * len(centroids), np.zeros((len(centroids), dims), object), [0] * len(centroids)
        for _, x in _blocks(batches, scale, dims):
            at, distance = nearest(x, centroids)
            member = at[:, None] == np.arange(len(centroids))
            if x.dtype != object and len(x) * np.abs(x).max(initial=0) < EXACT:
                added = (member.T.astype(np.float64) @ x).astype(np.int64)
            else:
                exact = np.array([[int(v) for v in row] for row in x.tolist()], object)
                added = np.array([exact[m].sum(axis=0) if m.any() else np.zeros(dims, object) for m in member.T], object)
            sums += added.astype(object)
            for k, d in zip(at.tolist(), distance, strict=True):
                n[k] += 1
                far[k] += d
        found = [k for k in range(len(centroids)) if n[k]]
        rows = [[k, n[k], ",".join(map(str, sums[k])), str(far[k])] for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _total(vectors: DataFrame, centroids: Centroids, scale: int, dims: int) -> Sums:
    """Sums over all partitions, added up along a tree on the executors."""
    rows = vectors.mapInArrow(_sums_of(centroids, scale, dims), "cluster int, n long, sums string, distance string").rdd
    k = len(centroids)

    def add(total: Sums, row) -> Sums:
        n, sums, far = total
        c = row["cluster"]
        n[c] += row["n"]
        sums[c] = [a + int(b) for a, b in zip(sums[c], row["sums"].split(","), strict=True)]
        far[c] += int(row["distance"])
        return total

    def both(a: Sums, b: Sums) -> Sums:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]

    return rows.treeAggregate(([0] * k, [[0] * dims for _ in range(k)], [0] * k), add, both, depth=3)


def _assign(centroids: Centroids, inertia: list[int], scale: int, dims: int):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda v: int(v) if v <= _LONG else None
    within, total = [long(v) for v in inertia], long(sum(inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, scale, dims):
            at, distance = nearest(x, centroids)
            clusters = pa.array(at, pa.int32())
            columns = [ids, clusters, pa.array([long(d) for d in distance], pa.int64())]
            columns += [pa.array(values, t).take(clusters) for values, t in ((within, pa.int64()), (digests, pa.string()))]
            columns.insert(4, pa.array([total] * len(at), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster_vectors(table: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``clusters`` vectors of the least sha256 of ``1:<id>``;
    ``rounds`` times every vector goes to its nearest centroid and every centroid that has
    vectors to the floor of their mean. The table is read once for the start, once a round,
    once for the inertia and once for the result; vectors are never shuffled.
    """
    vector = table[vector_col].cast("array<double>")
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vectors = table.where((F.size(vector) == dims) & ~odd).select(table[id_col].cast("long").alias("vec_id"), vector.alias("vector"))
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(start.alias("start"), "vector").orderBy(F.asc_nulls_last("start"), "vector").limit(clusters).collect()
    centroids = [[int(v) for v in whole(np.array([row.vector]), scale)[0]] for row in first]
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return table.sparkSession.createDataFrame([], out)
    for _ in range(rounds):
        n, sums, _ = _total(vectors, centroids, scale, dims)
        centroids = [[s // n[k] for s in sums[k]] if n[k] else centroids[k] for k in range(len(centroids))]
    inertia = _total(vectors, centroids, scale, dims)[2]
    return vectors.mapInArrow(_assign(centroids, inertia, scale, dims), out)

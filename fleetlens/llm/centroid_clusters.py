"""Centroid clustering with a vantage-point tree over the centroids.

Vectors become integers, floor(scale * x).  Each round builds a tree over the
current centroids on the driver (their number is a parameter), sends it with
the tasks, and assigns every vector to its nearest centroid.  A node of the
tree has a vantage centroid and splits the others at their median distance
from it into an inner and an outer part; with d the vector's distance from the
vantage, [low, high] the part's own distances from it, no centroid of the part
is nearer than max(d - high, low - d).  Every vector keeps its own queue of
open nodes and takes the one with the least such bound first; the queues of
one batch advance together.  A node is given up only if its bound, less the
rounding, is above the best distance: bounds equal to it are visited, so all
nearest centroids are seen and the smaller number wins.

Distances are sums of squared integer differences, exact in 64 bits while
components stay below 2**27 and in Python integers beyond that.  Tasks sum the
vectors of each centroid before the shuffle; sums travel as 40-bit limbs, so
one centroid may hold a third of all vectors, and of any size.  The driver
sees sums of k centroids, never vectors.

Defined results: a vector takes part if it has ``dim`` components, none null,
NaN or infinite.  Rows that repeat an id are vectors of their own; rows with a
null id are assigned but never start a centroid.  Of starts with one id the
smaller vector comes first.  With fewer vectors than ``k`` there are fewer
centroids; without any start the result is empty.  A centroid that loses all
its vectors stays where it is.  Distances and inertias beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import write_shared

LIMB = 40  #: bits of a limb of a sum
EXACT = 2**27  #: components below it have squared distances (64 components) below 2**63
BATCH = 2048  #: vectors whose queues advance together


def usable(vector: str, dim: int) -> Column:
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & (F.size(x) == dim) & finite


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python integers if any is large."""
    if not values.size or np.abs(values).max() * scale < EXACT:
        return np.floor(values * scale).astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows from one centre."""
    if points.dtype == object or centre.dtype == object:
        return ((points.astype(object) - centre.astype(object)) ** 2).sum(axis=1)
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


def root(distance: np.ndarray) -> np.ndarray:
    """Distances from squared ones; infinite beyond a double."""
    if distance.dtype != object:
        return np.sqrt(distance.astype(np.float64))
    return np.array([float(d) ** 0.5 if d < 2**1000 else np.inf for d in distance])


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root.  ``own`` are the centroids compared
    at a node (a leaf's all, else the vantage alone); ``parts`` are its
    (child, low, high)."""

    centroids: np.ndarray
    own: list[list[int]] = field(default_factory=list)
    parts: list[list[tuple[int, float, float]]] = field(default_factory=list)


def vantage_tree(centroids: np.ndarray, leaf: int = 2) -> Tree:
    """A vantage-point tree over the rows; equal rows may share a leaf or not."""
    tree = Tree(centroids)

    def grow(members: list[int]) -> int:
        node = len(tree.own)
        tree.own.append(members)
        tree.parts.append([])
        if len(members) <= leaf:
            return node
        far = squared(centroids[members], centroids[members[0]])
        vantage = members[int(np.argmax(root(far)))]
        rest = [m for m in members if m != vantage]
        away = root(squared(centroids[rest], centroids[vantage]))
        order = np.argsort(away, kind="stable")
        tree.own[node] = [vantage]
        for part in (order[: len(rest) // 2], order[len(rest) // 2 :]):
            if len(part):
                child = grow([rest[i] for i in part])
                tree.parts[node].append((child, float(away[part].min()), float(away[part].max())))
        return node

    if len(centroids):
        grow(list(range(len(centroids))))
    return tree


def nearest(points: np.ndarray, tree: Tree, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row (ties:
    smaller number).  ``visits`` gets the number of distances computed."""
    n = len(points)
    exact = object if points.dtype == object or tree.centroids.dtype == object else np.int64
    best = np.full(n, -1, np.int64)
    distance = np.zeros(n, exact)
    reach = np.full(n, np.inf)  # the best distance so far, with its rounding
    bound = np.full((n, len(tree.own)), np.inf)  # of open nodes
    bound[:, 0] = 0.0
    asked, done = 0, np.zeros(n, bool)
    while not done.all():
        live = np.flatnonzero(~done)
        node = np.argmin(bound[live], axis=1)  # each row's most promising node
        least = bound[live, node]
        over = (least > reach[live]) | np.isinf(least)
        done[live[over]] = True
        live, node = live[~over], node[~over]
        bound[live, node] = np.inf
        for at in np.unique(node):
            rows = live[node == at]
            asked += len(rows) * len(tree.own[at])
            for centroid in tree.own[at]:
                found = squared(points[rows], tree.centroids[centroid])
                nearer = (best[rows] < 0) | (found < distance[rows]) | ((found == distance[rows]) & (centroid < best[rows]))
                nearer = nearer.astype(bool)
                best[rows[nearer]], distance[rows[nearer]] = centroid, found[nearer]
            away = root(distance[rows])
            reach[rows] = away + 1e-9 * (away + 1)
            if tree.parts[at]:
                d = root(found)
                for child, low, high in tree.parts[at]:
                    with np.errstate(invalid="ignore"):
                        gap = np.maximum(d - high, low - d) - 1e-9 * (d + high + 1)
                    bound[rows, child] = np.maximum(np.nan_to_num(gap, nan=0.0), 0.0)
    if visits is not None:
        visits.append(asked)
    return best, distance


def _pieces(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            piece = batch.slice(at, BATCH)
            flat = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield piece.column(0), integers(flat.reshape(-1, dim), scale)


def limbs(total: int) -> list[int]:
    """``total`` as 40-bit limbs, lowest first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) <= total < (1 << LIMB):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _sums(rows: DataFrame, tree: Tree, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact component sums of every centroid that has any."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for _, points in _pieces(batches, dim, scale):
            number, _ = nearest(points, tree)
            for c in np.unique(number).tolist():
                mine = points[number == c]
                count[c] = count.get(c, 0) + len(mine)
                total[c] = total.get(c, 0) + mine.sum(axis=0).astype(object)  # of at most BATCH rows, so exact
        out = [(c, -1, 0, count[c]) for c in count]
        out += [(c, i, j, limb) for c in total for i, t in enumerate(total[c].tolist()) for j, limb in enumerate(limbs(int(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["c", "i", "j", "x"])

    sums = rows.mapInArrow(partial, "c long, i long, j long, x long").groupBy("c", "i", "j").agg(F.sum("x").alias("x"))
    # k * (dim * limbs + 1) numbers at most
    found: dict[int, tuple[int, list[int]]] = {}
    for c, i, j, x in sums.collect():
        n, total = found.get(c, (0, [0] * dim))
        if i < 0:
            n = x
        else:
            total[i] += x << (LIMB * j)
        found[c] = (n, total)
    return found


def _array(rows: list[list[int]], dim: int) -> np.ndarray:
    kind = np.int64 if all(abs(x) < EXACT for r in rows for x in r) else object
    out = np.empty((len(rows), dim), kind)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def starts(rows: DataFrame, k: int, dim: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in that order."""
    hashed = rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v")
    first = hashed.orderBy("h", "v").limit(k).collect()
    return [integers(np.array(r["v"], np.float64).reshape(1, dim), scale)[0].tolist() for r in first]


def cluster(
    data: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): per vector its id, ``cluster`` and squared ``distance``
    from the centroids after the last round, and those centroids."""
    kept = data.where(usable(vector_col, dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = write_shared(kept, "cluster-vectors")
    centroids = starts(rows, k, dim, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(rows, vantage_tree(_array(centroids, dim)), dim, scale).items():
            centroids[c] = [t // n for t in total]
    tree = vantage_tree(_array(centroids, dim))
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _pieces(batches, dim, scale):
            if not centroids:
                continue
            number, distance = nearest(points, tree)
            fits = [int(d) if d < 2**63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Assigned rows with the sums of distances of their cluster and of all,
    and the digest of their centroid (one small row per centroid is joined)."""
    spark = assigned.sparkSession
    rows = write_shared(assigned, "clusters")
    whole = "decimal(38,0)"
    known = F.count("distance") == F.count("*")  # a distance beyond a long is unknown, and so are its sums
    per = rows.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast(whole))).alias("s")).collect()
    sums = {r["cluster"]: r["s"] for r in per}
    total = None if None in sums.values() else sum(int(s) for s in sums.values())

    def long(x: int | None) -> int | None:
        return None if x is None or int(x) >= 2**63 else int(x)

    named = [(c, long(sums[c]), long(total), ",".join(map(str, centroids[c]))) for c in sums]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(facts), "cluster")

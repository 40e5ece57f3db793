"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x), so scores are exact.  In a cover tree
every node has a centre, one of its points, and a covering radius, the largest
distance to a point below it; its points are gathered around centres more than
half that radius apart, children lie within half of it, and points that no
other is near to are children of radius 0, held as rows of a matrix.  For a
query node Q and a data node P

    max <q, p>  <=  <cQ, cP> + rQ |cP| + rP |cQ| + rQ rP

so the pair is pruned if that bound is below the worst k-th score of Q's
queries; below a query node single queries are pruned by the same bound with a
radius of 0.

The corpus has the same shape one level up.  Up to ``cells`` data vectors out
of a bounded sample (the first by a hash; each time the one farthest from those
chosen before) are centres; every vector belongs to the nearest one, and a
cell's covering radius is the largest distance in it.  Queries first search the
cell whose centre has the best product with them.  The k-th scores found there
prune the other cells, query by query, before any vector is shuffled for them:
a query is sent to the cells that may still hold a better vector, and a cell's
vectors meet only the queries that were sent to it.  Cells and the queries of a
cell are cut into blocks of bounded size by a hash, a pair of blocks is a task;
in a task both blocks are trees.  Very common vectors fall into one cell and
are cut like any other.

On vectors without clusters in many dimensions radii are as large as products,
and few pairs can be pruned; README has the figures.

Equal vectors share a node of radius 0; ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components
take no part; only vectors of the same length are compared.  A query's own id
is never its result.  Repeated data rows count each; repeated queries give one
result.  With fewer candidates than k all are returned; an empty table or
query set gives none.  Products beyond the exact range of doubles are computed
in Python integers; ranks are right for scores below 2**123, and a score beyond
a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import write_shared

LEAF = 8  #: points that are not divided further
SAMPLED = 16  #: rows of the sample that centres are chosen from, per centre
HIGH = 62  #: bits of the lower half of a score


class Node:
    """Points ``index`` with a centre and covering radius: child nodes, and the
    places ``single`` of children of radius 0."""

    __slots__ = ("centre", "norm", "radius", "index", "children", "single", "worst")

    def __init__(self, centre: np.ndarray, radius: float, index: np.ndarray) -> None:
        self.centre, self.radius, self.index = centre, radius, np.sort(index)
        self.norm = float(np.linalg.norm(centre))
        self.children: list[Node] = []
        self.single = self.index[:0]
        self.worst = -np.inf


def cover_tree(points: np.ndarray) -> Node | None:
    """Cover tree of the rows; every row is a single of exactly one node."""
    if not len(points):
        return None

    def grow(index: np.ndarray, centre: int, distance: np.ndarray) -> Node:
        node = Node(points[centre], float(distance.max()), index)
        if len(index) <= LEAF or node.radius == 0:
            node.single = node.index
            return node
        scale = node.radius / 2
        left, left_distance, next_centre, single = index, distance, centre, []
        while len(left):  # a net of centres more than ``scale`` apart
            near = left_distance <= scale
            if near.sum() == 1:
                single.append(left[near])
            else:
                node.children.append(grow(left[near], next_centre, left_distance[near]))
            left, rest = left[~near], left_distance[~near]
            if len(left):  # next the point farthest from the centre just used
                next_centre = left[int(np.argmax(rest))]
                left_distance = np.linalg.norm(points[left] - points[next_centre], axis=1)
        if single:
            node.single = np.sort(np.concatenate(single))
        return node

    every = np.arange(len(points))
    return grow(every, 0, np.linalg.norm(points - points[0], axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows: doubles where they are exact, else objects."""
    if not len(a) or not len(b) or not a.shape[1] or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return a @ b.T
    whole = [np.array([[int(x) for x in r] for r in m.tolist()], object) for m in (a, b)]
    return whole[0] @ whole[1].T


def search(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray | None = None, seen: dict | None = None
) -> tuple[list[list[int]], list[list[int]]]:
    """Scores and ids of the k best rows of every query, best first.  Rows hold
    integers as doubles.  ``least`` are k-th scores known beforehand: rows below
    them may be left out.  ``seen`` counts pairs of rows that were multiplied,
    and node pairs pruned."""
    order = np.argsort(data_ids, kind="stable")  # so that a lower place is a smaller id
    data, data_ids = data[order], data_ids[order]
    best: list[list[tuple]] = [[] for _ in range(len(queries))]
    worst = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64).copy()
    length = np.linalg.norm(queries, axis=1) if len(queries) else np.zeros(0)
    seen = {} if seen is None else seen
    seen.update({n: seen.get(n, 0) for n in ("pairs", "pruned", "visited")})

    def slack(high):
        return high + 1e-9 * (np.abs(high) + 1)  # rounding of radii, norms and large products

    def compare(rows: np.ndarray, places: np.ndarray) -> None:
        seen["pairs"] += len(rows) * len(places)
        found = _products(queries[rows], data[places])
        high = found.max(axis=1).astype(np.float64)
        for i in np.flatnonzero(slack(high) >= worst[rows]):
            row = rows[i]
            good = np.flatnonzero((found[i].astype(np.float64) * 1.0 >= worst[row] - 1e-9 * (abs(worst[row]) + 1) if np.isfinite(worst[row]) else np.ones(len(places), bool)) & (data_ids[places] != query_ids[row]))
            if len(good) > 4 * k and found.dtype != object:  # all that reach the k-th best of them
                good = good[found[i][good] >= -np.partition(-found[i][good], k - 1)[k - 1]]
            mine = best[row] + [(-int(found[i][j]), int(places[j])) for j in good]
            best[row] = sorted(mine)[:k]
            if len(best[row]) == k:
                worst[row] = max(worst[row], float(-best[row][-1][0]))

    def bound(q: Node, p: Node) -> float:
        return float(slack(float(q.centre @ p.centre) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius))

    def visit_rows(rows: np.ndarray, p: Node) -> None:
        """Single queries, nodes of radius 0, against a data node."""
        rows = rows[slack(queries[rows] @ p.centre + p.radius * length[rows]) >= worst[rows]]
        if not len(rows):
            seen["pruned"] += 1
            return
        seen["visited"] += 1
        if len(p.single):
            compare(rows, p.single)
        if p.children:  # promising children first, so that k-th scores rise early
            near = queries[rows].mean(axis=0)
            for child in sorted(p.children, key=lambda c: -float(near @ c.centre) - c.radius * float(np.linalg.norm(near))):
                visit_rows(rows, child)

    def visit(q: Node, p: Node) -> None:
        q.worst = float(worst[q.index].min())
        if bound(q, p) < q.worst:
            seen["pruned"] += 1
            return
        seen["visited"] += 1
        if (q.radius > p.radius or not p.children) and q.children:
            for child in q.children:
                visit(child, p)
            if len(q.single):
                visit_rows(q.single, p)
        elif not q.children:
            visit_rows(q.index, p)
        else:
            if len(p.single):
                visit_rows(q.index, _Singles(p))
            for child in sorted(p.children, key=lambda c: -bound(q, c)):
                visit(q, child)

    class _Singles:
        """The singles of a node as a node of their own."""

        def __init__(self, p: Node) -> None:
            self.centre, self.radius, self.single, self.children = p.centre, p.radius, p.single, []

    a, b = cover_tree(queries), cover_tree(data)
    if a and b:
        visit(a, b)
    return [[-s for s, _ in r] for r in best], [[int(data_ids[p]) for _, p in r] for r in best]


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component as a double; null if the vector
    takes no part."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v.cast("double")) < 2.0**50, F.floor(v.cast("double") * scale).cast("double")).otherwise(v.cast("double") * scale))
    return F.when(usable, whole)


def _by_dim(centres: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {int(d): (g["cell"].to_numpy(), np.stack(g["v"].to_numpy()).astype(np.float64)) for d, g in centres.groupby("dim")} if len(centres) else {}


def spread_out(sample: pd.DataFrame, wanted: int) -> pd.DataFrame:
    """``wanted`` rows of the sample as centres, each time the one farthest from
    those before; vectors of one length after another, by their share."""
    out = []
    for dim, g in sample.groupby("dim"):
        x = np.stack(g["v"].to_numpy()).astype(np.float64)
        place, away = 0, np.full(len(x), np.inf)
        for _ in range(min(len(x), -(-wanted * len(x) // len(sample)))):
            out.append((x[place], dim))
            away = np.minimum(away, np.linalg.norm(x - x[place], axis=1)) if x.shape[1] else np.zeros(len(x))
            place = int(away.argmax())
            if away[place] == 0:
                break
    return pd.DataFrame({"v": [v for v, _ in out], "dim": [d for _, d in out], "cell": np.arange(len(out))})


def in_cells(rows: DataFrame, centres: pd.DataFrame, schema: str) -> DataFrame:
    """Data rows with the nearest centre's ``cell`` (-1: none of that length)
    and its ``distance``."""
    known = _by_dim(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(cell=np.int64(-1), distance=np.inf)
            for dim, part in f.groupby("dim"):
                if dim in known and dim:
                    cell, c = known[dim]
                    x = np.stack(part["v"].to_numpy())
                    away = np.stack([np.linalg.norm(x - one, axis=1) for one in c], axis=1)
                    f.loc[part.index, "cell"] = cell[away.argmin(axis=1)]
                    f.loc[part.index, "distance"] = away.min(axis=1)
            yield f

    return rows.mapInPandas(run, f"{schema}, cell long, distance double")


def _pairs(asked: DataFrame, stored: DataFrame, k: int, id_col: str) -> DataFrame:
    """k best rows of every query in every pair of blocks: asked (id, v, least,
    cell, dim, part) against stored (id, v, cell, dim, block)."""
    dealt = stored.join(asked.select("cell", "dim", F.col("part").alias("part")).distinct(), ["cell", "dim"])
    meets = asked.join(stored.select("cell", "dim", F.col("block").alias("block")).distinct(), ["cell", "dim"])
    keys = ["cell", "dim", "part", "block"]

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = left["id"].to_numpy()
            q, d = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (left, right))
            scores, found = search(q, ids, d, right["id"].to_numpy(), k, left["least"].to_numpy())
            for i, (s, f) in enumerate(zip(scores, found, strict=True)):
                out += [(ids[i], j, min(max(x >> HIGH, -(2**62)), 2**62), x & ((1 << HIGH) - 1)) for x, j in zip(s, f, strict=True)]
        return pd.DataFrame(out, columns=["query_id", id_col, "high", "low"]).astype("int64")

    return meets.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(block, f"query_id long, `{id_col}` long, high long, low long")


def _best(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("high").desc(), F.col("low").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    data: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    data_block: int = 2048,
    query_block: int = 2048,
    cells: int = 1024,
    shares: dict | None = None,
) -> DataFrame:
    """query_id, rank (from 1), the data id and score, k rows per query.
    ``shares`` gets the numbers of (query, vector) pairs and of those that were
    sent to a task."""

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), integers(vector_col, scale).alias("v")).where("v is not null and id is not null")
        return rows.withColumn("dim", F.size("v").cast("long"))

    schema = "id long, v array<double>, dim long"
    rows = write_shared(prepared(data), "vectors")
    count = rows.count()
    # at most SAMPLED times ``cells`` vectors reach the driver
    wanted = max(1, min(cells, max(count // data_block, min(64, count // 128))))
    first = rows.select("v", "dim").orderBy(F.xxhash64("id", "v"), "v").limit(SAMPLED * wanted).distinct()
    centres = spread_out(first.toPandas(), wanted)
    placed = write_shared(in_cells(rows, centres, schema), "cells")
    facts = placed.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    facts = write_shared(facts.withColumn("blocks", F.ceil(F.col("n") / data_block).cast("int")), "cell-facts")
    stored = placed.join(facts.select("cell", "dim", "blocks"), ["cell", "dim"])
    stored = write_shared(stored.select("id", "v", "cell", "dim", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block")), "blocks")
    # a row per cell, and per vector length without a centre
    radius = {(int(r["cell"]), int(r["dim"])): float(r["radius"]) for r in facts.collect()}
    known = _by_dim(centres)

    def where_to(frames: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        """Cells of every query: the home cell, or all others that may matter."""
        for f in frames:
            out = []
            for q in f.itertuples(index=False):
                places = [c for c, d in radius if d == q.dim and c < 0]
                best = -1
                if q.dim in known and q.dim:
                    cell, c = known[q.dim]
                    v = np.asarray(q.v, np.float64)
                    product = c @ v
                    best = int(cell[product.argmax()])
                    if not home:
                        reach = np.array([radius.get((int(x), int(q.dim)), -np.inf) for x in cell])
                        high = product + reach * np.linalg.norm(v)
                        places += [int(x) for x in cell[(high + 1e-9 * (np.abs(high) + 1) >= q.least) & (reach >= 0)]]
                places = [best] if home else [p for p in places if p != best]
                out += [(q.id, q.v, q.dim, q.least, p) for p in places]
            yield pd.DataFrame(out, columns=["id", "v", "dim", "least", "cell"])

    def sent(asked: DataFrame, home: bool, label: str) -> DataFrame:
        goes = asked.mapInPandas(lambda frames: where_to(frames, home), f"{schema}, least double, cell long")
        goes = write_shared(goes, f"{label}-routes")
        parts = goes.groupBy("cell", "dim").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
        return goes.join(parts, ["cell", "dim"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    asked = write_shared(prepared(queries).dropDuplicates(["id", "v"]).withColumn("least", F.lit(float("-inf"))), "queries")
    near = sent(asked, True, "near")
    found = write_shared(_best(_pairs(near, stored, k, id_col), k, id_col).drop("rank"), "found-near")
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.col("high").cast("double") * 2.0**HIGH + F.col("low")).alias("kth")).where(F.col("n") >= k)
    again = asked.drop("least").join(kth.select(F.col("query_id").alias("id"), "kth"), "id", "left")
    again = again.select("id", "v", "dim", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    far = sent(again, False, "far")
    if shares is not None:
        sizes = facts.select("cell", "dim", "n")
        shares["all"] = count * asked.count()
        shares["sent"] = sum(int(x.join(sizes, ["cell", "dim"]).agg(F.sum("n")).first()[0] or 0) for x in (near, far))
    every = found.unionByName(_pairs(far, stored, k, id_col))
    score = F.when(F.col("high").between(-2, 1), F.col("high") * (1 << HIGH) + F.col("low"))
    return _best(every, k, id_col).select("query_id", "rank", id_col, score.alias("score"))

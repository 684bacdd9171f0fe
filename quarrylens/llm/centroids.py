"""Exact Lloyd rounds over whole-number vectors: cover trees over the vectors meet a tree over the centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import lean, staged

#: Vectors of a cover tree, and of a leaf, at most.
BLOCK, LEAF = 2048, 16
#: Components stay below, so that squared distances of up to 256 components fit 64 bits.
REACH = 2**26
#: Distances of points and centroids that are computed at once.
PAIRS = 1 << 16


@dataclass
class Tree:
    """A cover tree. Nodes stand by level: node i has the points lo[i] to hi[i] of the tree's order, all within radius[i] of
    the point at[i], and its children are the nodes first[i] to first[i] + kids[i]; a node with kids 0 is a leaf."""

    at: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    kids: np.ndarray

    def packed(self) -> bytes:
        return np.stack([x.astype(np.float64) for x in (self.at, self.radius, self.lo, self.hi, self.first, self.kids)]).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        m = np.frombuffer(data, np.float64).reshape(6, -1)
        at, lo, hi, first, kids = (m[i].astype(np.int64) for i in (0, 2, 3, 4, 5))
        return Tree(at, m[1], lo, hi, first, kids)


def _far(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(1))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree over points (rows of whole numbers), and the order of them in which its nodes are stretches; at counts in
    that order.

    A node of radius up to 2^i has children that lie within 2^(i-1) of their own points, which are points of the node more
    than 2^(i-1) from each other, the node's own among them.
    """
    x = points.astype(np.float64)
    order = np.arange(len(x))
    centre, radius, lo, hi, first, kids = [], [], [], [], [], []

    def add(c: int, a: int, b: int, r: float) -> None:
        for store, v in ((centre, c), (radius, r), (lo, a), (hi, b), (first, 0), (kids, 0)):
            store.append(v)

    if len(x):
        add(0, 0, len(x), float(_far(x, x[0]).max()))
    node = 0
    while node < len(centre):
        a, b, r = lo[node], hi[node], radius[node]
        if b - a > leaf and r > 0:
            reach = 2.0 ** (np.ceil(np.log2(r)) - 1)
            left, c, groups = order[a:b], centre[node], []
            while len(left):
                far = _far(x[left], x[c])
                near = far <= reach
                groups.append((c, left[near], float(far[near].max())))
                left = left[~near]
                c = left[0] if len(left) else -1
            order[a:b] = np.concatenate([g for _, g, _ in groups])
            first[node], kids[node] = len(centre), len(groups)
            for c, g, far in groups:
                add(c, a, a + len(g), far)
                a += len(g)
        node += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    ints = lambda v: np.array(v, np.int64)
    return Tree(place[ints(centre)], np.array(radius, np.float64), ints(lo), ints(hi), ints(first), ints(kids)), order


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch from lo, n long, the number of the stretch and the place."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, ctree: Tree, corder: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
    """The nearest centroid of all points (in the tree's order), the smaller number of equal ones.

    Pairs of a node of the points and one of the centroids are bounded together: what can't hold the nearest centroid of
    any point of the node goes, a node that one centroid alone is left for is assigned as a whole, and what is left between
    leaves is compared point by point, in whole numbers. Given are the nodes assigned as a whole (lo, hi, centroid), the
    points compared, the centroid of each of those, and how many distances of points were computed.
    """
    x, c = points.astype(np.float64), centroids.astype(np.float64)
    whole: list[tuple[int, int, int]] = []
    singles, labels, computed = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    number = corder  # of the centroid at a place of the centroids' tree
    q = r = np.zeros(min(1, len(points)), np.int64)
    while len(q):
        far = np.concatenate([np.sqrt(((x[tree.at[q[i : i + PAIRS]]] - c[number[ctree.at[r[i : i + PAIRS]]]]) ** 2).sum(1)) for i in range(0, len(q), PAIRS)])
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        best = np.repeat(np.minimum.reduceat(far + tree.radius[q], starts), np.diff(np.r_[starts, len(q)]))
        keep = far - tree.radius[q] - ctree.radius[r] <= best * (1 + 1e-9) + 1e-6
        q, r = q[keep], r[keep]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        size = np.diff(np.r_[starts, len(q)])
        end, inner = tree.kids[q] == 0, ctree.kids[r] > 0
        split = np.repeat(np.logical_or.reduceat(inner & (end | (ctree.radius[r] >= tree.radius[q])), starts), size)  # the centroids' side goes down
        alone = np.repeat((size == 1) & (ctree.kids[r[starts]] == 0) & ((ctree.hi - ctree.lo)[r[starts]] == 1), size)
        whole += zip(tree.lo[q[alone]].tolist(), tree.hi[q[alone]].tolist(), number[ctree.lo[r[alone]]].tolist(), strict=True)
        exact = end & ~split & ~alone
        if exact.any():
            at, k, n = _compared(points, centroids, tree, ctree, number, q[exact], r[exact])
            singles.append(at)
            labels.append(k)
            computed += n
        stay, down = split & ~alone & ~inner, split & ~alone & inner
        own, kid = _ranges(ctree.first[r[down]], ctree.kids[r[down]])
        rest = ~split & ~alone & ~end
        mine, child = _ranges(tree.first[q[rest]], tree.kids[q[rest]])
        q, r = np.r_[q[stay], q[down][own], child], np.r_[r[stay], kid, r[rest][mine]]
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
    return whole, np.concatenate(singles), np.concatenate(labels), computed


def _compared(points, centroids, tree: Tree, ctree: Tree, number: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The points of leaves q and the nearest of the centroids in the leaves r that are left for each."""
    pair, place = _ranges(ctree.lo[r], (ctree.hi - ctree.lo)[r])
    q, k = q[pair], number[place]
    pair, at = _ranges(tree.lo[q], (tree.hi - tree.lo)[q])
    k = k[pair]
    far = np.concatenate([((points[at[i : i + PAIRS]] - centroids[k[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(at), PAIRS)])
    order = np.lexsort((k, far, at))
    at, k = at[order], k[order]
    one = np.r_[True, at[1:] != at[:-1]]
    return at[one], k[one], len(far)


def _plant(scale: float, dim: int, block: int):
    """Cover trees over the vectors of a partition, block of them at most in each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def out() -> pa.RecordBatch:
            i, m = np.concatenate(ids), np.concatenate(rows)
            tree, order = cover_tree(m)
            return pa.RecordBatch.from_arrays([pa.array([i[order]], pa.list_(pa.int64())), pa.array([m[order].astype(np.int32).tobytes()], pa.binary()), pa.array([tree.packed()], pa.binary())], ["ids", "m", "tree"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = np.floor(scale * flat)
                if (np.abs(x) >= REACH).any():
                    raise ValueError(f"a component times {scale} is beyond {REACH}")
                own = part.column(0).to_numpy(zero_copy_only=False)
                while len(own):
                    take = block - held
                    ids.append(own[:take])
                    rows.append(x[:take].astype(np.int64))
                    held += len(ids[-1])
                    own, x = own[take:], x[take:]
                    if held == block:
                        yield out()
                        ids, rows, held = [], [], 0
        if held:
            yield out()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            m = np.frombuffer(batch.column(1)[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
            yield batch.column(0)[i].values.to_numpy(), m, Tree.unpacked(batch.column(2)[i].as_py())


def _sums(centroids: np.ndarray):
    """cluster, n, total, computed: what a task's vectors add to each centroid. Nodes assigned as a whole add the difference of
    two running sums."""
    k, dim = centroids.shape

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, computed = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        ctree, corder = cover_tree(centroids, 1)
        for _, m, tree in _blocks(batches, dim):
            whole, at, own, some = nearest(m, tree, centroids, ctree, corder)
            running = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(m, 0)])
            lo, hi, c = np.array(whole, np.int64).reshape(-1, 3).T
            np.add.at(total, c, running[hi] - running[lo])
            np.add.at(n, c, hi - lo)
            np.add.at(total, own, m[at])
            np.add.at(n, own, 1)
            computed += some
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64())), pa.array([computed if i == 0 else 0 for i in range(len(some))], pa.int64())], ["cluster", "n", "total", "computed"])

    return run


def _labels(centroids: np.ndarray):
    """vec_id, cluster, distance of all vectors."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctree, corder = cover_tree(centroids, 1)
        for ids, m, tree in _blocks(batches, centroids.shape[1]):
            whole, at, own, _ = nearest(m, tree, centroids, ctree, corder)
            label = np.empty(len(m), np.int64)
            label[at] = own
            for lo, hi, c in whole:
                label[lo:hi] = c
            far = ((m - centroids[label]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dim: int = 64, seed: str = "3:", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of vectors (vec_id, embedding), and the final centroids by number.

    Vectors with exactly dim components, none null or non-finite, and a vec_id take part; component x counts as
    floor(scale * x), and one that leaves 26 bits is an error. The centroids start as the k vectors with the smallest
    sha256 of seed and vec_id, in this order (of rows with one vec_id the smaller vector first); fewer vectors make fewer
    centroids, and none make no rows. Each round assigns every vector to the nearest centroid by squared distance, the
    smaller number of equal ones, and moves each centroid to floor(sum / count) of its vectors, component by component; a
    centroid without vectors stays. Then vectors are assigned once more. Rows that share a vec_id are vectors each.

    The trees are built once, one for each block of vectors, and staged; a round reads them, and gathers k sums. The
    driver holds k centroids and nothing that grows with the vectors.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    own = own.where((F.size("embedding") == dim) & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))))
    start = own.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "embedding").limit(k).collect()  # k rows
    centroids = np.floor(scale * np.array([r["embedding"] for r in start]).reshape(len(start), dim)).astype(np.int64)
    trees = staged(own.mapInArrow(_plant(scale, dim, block), "ids array<long>, m binary, tree binary"), "cover-trees")
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>, computed long")
        each = sums.select("cluster", "n", F.posexplode("total").alias("place", "total")).groupBy("cluster", "place")
        moved = each.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * dim rows
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    out = trees.mapInArrow(_labels(centroids), "vec_id long, cluster int, distance long")
    return out, centroids.tolist()

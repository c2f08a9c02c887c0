"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded hash sample; then every vector descends to a leaf. A query visits leaves in
best-bin-first order: a priority queue holds the branches passed by, nearest centre first, and is read only as far as
the visits go. How many leaves a query visits is calibrated: a bounded sample of queries is compared with all
vectors, and visits widen until the recall over them reaches `RECALL`. A visit also widens until `k` candidates are met.

Sample vectors are candidates too: those that stand in the leaves a query visits are met again there. The
distance of the k-th nearest of them bounds that of the k-th nearest candidate, so leaves return only what is
not farther, a few rows for each query, and what is left out has k nearer candidates. Where a query's leaves
hold fewer than k sample vectors, nothing is left out. So each query has k rows, or all candidates if fewer.

A (leaf, part) pair is the unit of work: leaves with many vectors, such as thousands of equal ones, are split
into parts of about `PART` vectors, and each query goes to all parts of its leaves. A part returns its k
nearest, and these are merged by partial aggregation over queries. The leaves' number is bounded by the sample, so
that at a given SAMPLE a leaf's parts, not its size, grow with the table.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths have no distance: each length is searched by itself. Every row counts, also rows with equal ids or
vectors: only the query's own row is no candidate of it, and each row of a repeated id is a query of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chosen, stored

#: Bound of the fitting sample in vectors and of the calibration sample in queries; calibrated recall;
#: branches of a node; vectors in a usual leaf; vectors in a part.
SAMPLE, TRIALS, RECALL, BRANCH, LEAF, PART = 20000, 200, 0.97, 8, 800, 4096


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    return good.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres)[None] - 2 * x @ centres.T).argmin(axis=1)


class Tree:
    """Nodes hold centres of their children; a leaf is a negative number less one."""

    def __init__(self, x: np.ndarray, most: int):
        self.centres, self.children, self.leaves = [], [], 0
        self.draw = np.random.default_rng(1)
        self.root = self._grow(x, most)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, most: int) -> int:
        if len(x) <= most or len(distinct := np.unique(x, axis=0)) < 2:
            return self._leaf()
        c = distinct[self.draw.permutation(len(distinct))[:BRANCH]]
        for _ in range(12):
            near = nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        near = nearest(x, c)
        if np.bincount(near).max() == len(x):
            return self._leaf()
        at = len(self.centres)
        self.centres.append(c)
        self.children.append([])
        self.children[at] = [self._grow(x[near == i], most) for i in range(len(c))]
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = -node - 1
                continue
            near = nearest(x[rows], self.centres[node])
            stack += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray):
        """The leaves in a query's best-bin-first order, one after another."""
        heap = [(0.0, 0, self.root)]
        while heap:
            _, _, node = heapq.heappop(heap)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(heap, (float(d[i]), len(self.centres) + child, child))
                node = self.children[node][best]
            yield -node - 1


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size) if len(column) else np.empty((0, size))


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, not_row: np.ndarray, k: int, met: np.ndarray | None = None):
    """For each query the k nearest rows (position, distance): a matrix product picks, exact differences decide.

    own numbers the rows of x, not_row is each query's own. `met` tells for each query which rows count; all do if it is left out.
    """
    rough = np.einsum("ij,ij->i", x, x)[None] - 2 * q @ x.T
    rough[own[None] == not_row[:, None]] = np.inf
    if met is not None:
        rough[~met] = np.inf
    for i, row in enumerate(rough):
        size = min(k, int(np.isfinite(row).sum()))
        if not size:
            continue
        limit = np.partition(row, size - 1)[size - 1]
        near = np.flatnonzero(row <= limit + 1e-9 * (1 + abs(limit)))
        d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], d))[:k]
        yield i, near[order], d[order]


FOUND = "row long, query_id long, vec_id long, score double"


def _found(rows: list) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("row", "query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})


def _search(size: int, k: int):
    def run(left, right):
        q, x = left.combine_chunks(), right.combine_chunks()
        rows = []
        if q.num_rows and x.num_rows:
            qv, xv = (_matrix(t.column("v").combine_chunks(), size) for t in (q, x))
            qi, qr, bound, xi, xr = (t.column(c).to_numpy() for t, c in ((q, "query_id"), (q, "query_row"), (q, "bound"), (x, "vec_id"), (x, "row")))
            for a in range(0, len(qv), 256):
                for i, at, d in top(qv[a : a + 256], xv, xi, xr, qr[a : a + 256], k):
                    at, d = at[d <= bound[a + i]], d[d <= bound[a + i]]
                    rows += zip([int(qr[a + i])] * len(at), [int(qi[a + i])] * len(at), xi[at].tolist(), d.tolist(), strict=True)
        return _found(rows)

    return run


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a part sends k at most, so a query's list is k times its parts."""
    best = found.groupBy("row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("row", "query_id", F.posexplode("best").alias("at", "b")).select("row", "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def brute_force(base: DataFrame, queries: list, size: int, k: int) -> DataFrame:
    """Exact neighbours of a few given queries among all vectors, with the leaves that hold them."""
    qr, qi, qv = np.array([r.row for r in queries]), np.array([r.vec_id for r in queries]), np.array([r.v for r in queries])

    def run(batches):
        for b in batches:
            x, ids, own, leaf = _matrix(b.column("v"), size), *(b.column(c).to_numpy() for c in ("vec_id", "row", "leaf"))
            rows = [(int(qr[i]), int(qi[i]), int(leaf[j]), float(e)) for i, at, d in top(qv, x, ids, own, qr, k) for j, e in zip(at, d, strict=True)]
            if rows:
                yield from _found(rows).to_batches()

    # the place of vec_id holds the leaf: the calibration asks where neighbours are, not which
    return _merge(base.select("vec_id", "row", "v", "leaf").mapInArrow(run, FOUND), k).withColumnRenamed("vec_id", "leaf")


def search(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for queries whose id is divisible by `every`, against all other rows."""
    base = vectors(df, id_col, vec_col)
    out = None
    for r in base.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():
        found = _of_size(base.where(F.size("v") == r["size"]), r["size"], r["count"], every, k)
        out = found if out is None else out.union(found)
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _of_size(base: DataFrame, size: int, total: int, every: int, k: int) -> DataFrame:
    of_sample = chosen(F.col("vec_id"), SAMPLE / total)
    rows = base.where(of_sample).orderBy("vec_id", "v").limit(4 * SAMPLE).collect() or base.limit(1).collect()
    sample = np.array([r.v for r in rows])
    tree = Tree(sample, max(2, round(LEAF * len(sample) / total)))

    def leaf(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("row"), pa.array(tree.assign(_matrix(b.column("v"), size)))], ["vec_id", "v", "row", "leaf"])

    # rows get their numbers once, in the stored table
    placed = stored(base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(leaf, "vec_id long, v array<double>, row long, leaf long"))
    sizes = stored(placed.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    queries = placed.where(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    trials = queries.where(chosen(F.col("row"), TRIALS / max(1, n_queries))).limit(4 * TRIALS).select("row", "vec_id", "v").collect() if n_queries else []
    want = calibrated(tree, placed, trials, size, k)
    full = {r.leaf: r.n for r in sizes.select("leaf", "n").collect()}  # at most SAMPLE / 2 rows
    rows = placed.where(of_sample).orderBy("row").limit(4 * SAMPLE).select("row", "vec_id", "v", "leaf").collect()
    met_v, met_id, met_row, met_leaf = np.array([r.v for r in rows]).reshape(-1, size), *(np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "row", "leaf"))

    def visit(batches):
        for b in batches:
            ids, own, v = b.column("vec_id").to_numpy(), b.column("row").to_numpy(), _matrix(b.column("v"), size)
            for a in range(0, len(ids), 64):
                visited, seen = [], np.zeros((len(ids[a : a + 64]), tree.leaves), bool)
                for i, q in enumerate(v[a : a + 64]):
                    leaves, met = [], 0
                    for at in tree.visits(q):
                        leaves.append(at)
                        met += full.get(at, 0)
                        if len(leaves) >= want and met > k:  # one may be the query's own row
                            break
                    seen[i, leaves] = True
                    visited.append([x for x in leaves if x in full])
                bound = np.full(len(visited), np.inf)
                for i, _, d in top(v[a : a + 64], met_v, met_id, met_row, own[a : a + 64], k, seen[:, met_leaf]):
                    bound[i] = d[-1] * (1 + 1e-9) if len(d) == k else np.inf
                for i, row, q, most, leaves in zip(ids[a : a + 64].tolist(), own[a : a + 64].tolist(), v[a : a + 64], bound.tolist(), visited, strict=True):
                    n = len(leaves)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array([q.tolist()] * n, pa.list_(pa.float64())), pa.array([most] * n, pa.float64()), pa.array(leaves, pa.int64())], ["query_row", "query_id", "v", "bound", "leaf"])

    asked = queries.select("vec_id", "row", "v").mapInArrow(visit, "query_row long, query_id long, v array<double>, bound double, leaf long")
    parts = F.broadcast(sizes.select("leaf", "parts"))  # no more leaves than the sample has vectors
    asked = asked.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = placed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    found = asked.select("leaf", "part", "query_row", "query_id", "v", "bound").groupBy("leaf", "part").cogroup(held.select("leaf", "part", "row", "vec_id", "v").groupBy("leaf", "part")).applyInArrow(_search(size, k), FOUND)
    return _merge(found, k).drop("row")


def calibrated(tree: Tree, placed: DataFrame, trials: list, size: int, k: int) -> int:
    """Leaves to visit so that the trial queries find RECALL of their true neighbours."""
    if not trials or tree.leaves < 2:
        return tree.leaves
    where = brute_force(placed, trials, size, k).groupBy("row").agg(F.collect_list("leaf").alias("leaves")).collect()
    rank_of = {r.row: {leaf: i for i, leaf in enumerate(tree.visits(np.array(r.v)))} for r in trials}
    needed = np.sort([rank_of[r.row][leaf] + 1 for r in where for leaf in r.leaves])
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) if len(needed) else tree.leaves

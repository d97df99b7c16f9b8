"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

Vectors gain one component that makes their lengths equal, so the largest inner product is the least distance and k-means fits the
measure. The tree is fitted on a bounded sample; every row is then put into its leaf. A query walks the tree best bin first,
with a priority queue over nodes, and visits as many leaves as a calibration against exact results says. Leaves and the queries
that visit them meet in blocks of bounded size, so neither a hot leaf nor a much visited one is held by one task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickloom.llm.common import stored

TOP = 20
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class TreeParams:
    sample: int = 20_000  # bound of the rows that the tree is fitted on, by hash of vec_id
    branch: int = 8
    leaf: int = 512  # rows a leaf should hold
    least: int = 8  # rows of the sample that a leaf needs at least, which bounds the number of leaves
    rounds: int = 12  # of k-means
    calibration: int = 200  # queries of the calibration, by hash of vec_id
    recall: float = 0.97  # share of the exact neighbours that the calibration must find
    first: int = 2  # leaves whose best rows set the score that a query's other leaves must reach
    vectors: int = 2048  # rows of a block
    queries: int = 1024


@dataclass
class Tree:
    centers: np.ndarray = None
    children: list[list[int]] = field(default_factory=list)  # by node; empty for a leaf
    reach: float = 0.0  # the squared length that all extended vectors have

    def extend(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.reach - (x * x).sum(1), 0))[:, None]])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each (extended) row falls into."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                at[rows] = node
                continue
            kids = np.array(self.children[node])
            c = self.centers[kids]
            nearest = ((c * c).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(int(k), rows[nearest == i]) for i, k in enumerate(kids) if (nearest == i).any()]
        return at

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query, its leaves in best-bin-first order, ``most`` at most."""
        flat = np.hstack([q, np.zeros((len(q), 1))])
        gap = (self.centers * self.centers).sum(1)[None] - 2 * flat @ self.centers.T
        out = []
        for row in gap:
            queue, found = [(0.0, 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                if not self.children[node]:
                    found.append(node)
                for k in self.children[node]:
                    heapq.heappush(queue, (row[k], k))
            out.append(found)
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centers * centers).sum(1)[None] - 2 * x @ centers.T).argmin(1)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return own


def fit(x: np.ndarray, total: int, reach: float, p: TreeParams) -> Tree:
    """Split nodes of the sample until a leaf's share of ``total`` rows is small enough."""
    tree = Tree(reach=reach)
    x = tree.extend(x)
    rng = np.random.default_rng(1)
    centers = [x.mean(0)]
    tree.children.append([])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * total / len(x) <= p.leaf or len(rows) < p.branch * p.least:
            continue
        own = _kmeans(x[rows], p.branch, p.rounds, rng)
        groups = [rows[own == i] for i in range(p.branch) if (own == i).any()]
        if len(groups) < 2:
            continue  # equal rows: the leaf stays, its rows are spread over blocks
        for g in groups:
            tree.children[node].append(len(centers))
            todo.append((len(centers), g))
            centers.append(x[g].mean(0))
            tree.children.append([])
    tree.centers = np.array(centers)
    return tree


def usable(e: Column) -> Column:
    """Not null, not zero, and all components finite."""
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine, F.lit(False)) & F.exists(e, lambda v: v != 0)


def _matrix(column) -> np.ndarray:
    rows = column.to_numpy() if isinstance(column, pd.Series) else column.to_numpy(zero_copy_only=False)
    return np.stack(rows).astype(np.float64)


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, top: int = TOP, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's ``top`` rows of x, itself left out; ties to the smaller id.

    Rows whose score is below a query's ``floor`` are left out. Equal rows are taken together with their least ids, and scores are summed row by row, so equal vectors tie exactly.
    """
    order = np.argsort(vid, kind="stable")
    vid, x = vid[order], np.ascontiguousarray(x[order])
    keep = np.concatenate([[True], vid[1:] != vid[:-1]])  # a repeated row counts once
    vid, x = vid[keep], x[keep]
    _, first, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(same, kind="stable")
    count = np.bincount(same)
    begin = np.cumsum(count) - count
    count = np.minimum(count, top + 1)  # one of them may be the query itself
    u = x[first]
    s = q @ u.T
    k = min(top + 1, s.shape[1])
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    if floor is not None:
        edge = np.maximum(edge, floor)
    qi, ui = np.nonzero(s >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
    exact = (q[qi] * u[ui]).sum(1)
    n = count[ui]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = vid[members[np.repeat(begin[ui], n) + nth]]
    qi, exact = np.repeat(qi, n), np.repeat(exact, n)
    other = ids != qid[qi]
    qi, ids, exact = qi[other], ids[other], exact[other]
    order = np.lexsort((ids, -exact, qi))
    qi, ids, exact = qi[order], ids[order], exact[order]
    start = np.searchsorted(qi, np.arange(len(qid)))
    good = np.arange(len(qi)) - start[qi] < top
    return qid[qi[good]], ids[good], exact[good]


def _exact(rows: DataFrame, qid: np.ndarray, q: np.ndarray, top: int) -> DataFrame:
    """The exact neighbours of a few queries among all rows, with their leaf: the best of every batch, then of all batches."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            vid = b["vec_id"].to_numpy()
            got = best(qid, q, vid, _matrix(b["embedding"]), top)
            leaf = dict(zip(vid.tolist(), b["leaf"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[0]), pa.array(got[1]), pa.array(got[2]), pa.array([leaf[i] for i in got[1].tolist()], pa.int64())],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    return rows.mapInArrow(run, FOUND + ", leaf long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, p: TreeParams = TreeParams()) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``.

    Rows without vec_id, and vectors that are null, zero or not finite, take no part; so do vectors whose length differs from the
    most common one. A repeated vec_id counts once as a candidate and once as a query. Further columns are not used. Without
    usable rows the result is empty; with fewer candidates than ``top`` all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == width.n)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    reach = float(rows.agg(F.max(square)).first()[0]) * (1 + 1e-9)
    by_hash = lambda d, n: d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toPandas()  # noqa: E731  bounded samples
    tree = fit(_matrix(by_hash(rows, p.sample)["embedding"]), width["count"], reach, p)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for b in batches:
            if len(b):
                leaf = shared.value.leaves_of(shared.value.extend(_matrix(b["embedding"])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    index = stored(rows.mapInArrow(assign, "vec_id long, embedding array<float>, leaf long"))
    asked = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")

    # widen the walk until the calibration's exact neighbours are found
    trial = by_hash(asked.withColumnRenamed("query_id", "vec_id"), p.calibration)
    leaves = sum(not c for c in tree.children)
    most = leaves
    if len(trial):
        qid, q = trial["vec_id"].to_numpy(), _matrix(trial["embedding"])
        truth = _ranked(_exact(index, qid, q, top), top).select("query_id", "leaf").toPandas()  # calibration * top rows
        place = {(int(a), leaf): i for a, walk in zip(qid, tree.visits(q, leaves), strict=True) for i, leaf in enumerate(walk)}
        depth = np.array([place[a, b] for a, b in zip(truth["query_id"].tolist(), truth["leaf"].tolist(), strict=True)] or [0])
        most = 1
        while most < leaves and (depth < most).mean() < p.recall:
            most = min(leaves, most + max(1, most // 4))

    def walk(batches):
        for b in batches:
            if len(b):
                paths = shared.value.visits(_matrix(b["embedding"]), most)
                n = np.array([len(x) for x in paths])
                at = pa.array(np.repeat(np.arange(len(b)), n))
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [b["query_id"].take(at), b["embedding"].take(at), pa.array(np.concatenate(paths)), pa.array(nth)],
                    names=["query_id", "embedding", "leaf", "nth"],
                )

    visits = stored(asked.mapInArrow(walk, "query_id long, embedding array<float>, leaf long, nth long"))
    # the walk goes in three parts; what the earlier ones found is the floor of the later ones
    found, begin = None, 0
    for end in sorted({min(p.first, most), max(min(p.first, most), most // 8), most}):
        part = visits.filter((F.col("nth") >= begin) & (F.col("nth") < end))
        if found is None:
            part = part.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("floor"))
            part = part.join(floors, "query_id", "left")
        new = _meet(index, part, top, p)
        found = stored(_ranked((new if found is None else found.union(new)).distinct(), top).select("query_id", "vec_id", "score"))
        begin = end
    return _ranked(found, top).select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, visits: DataFrame, top: int, p: TreeParams) -> DataFrame:
    """The best rows of every visited leaf, block by block; rows below a query's floor are not given."""
    # leaves are bounded by the sample, so these counts are a small table
    held = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / p.vectors).cast("int").alias("chunks"))
    called = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / p.queries).cast("int").alias("calls"))
    sizes = stored(held.join(called, "leaf"))
    ones = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["leaf", "chunk", "call"]
    left = index.join(F.broadcast(sizes), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), ones("calls").alias("call"), "vec_id", "embedding")
    right = visits.join(F.broadcast(sizes), "leaf").select("leaf", ones("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), "calls").cast("int").alias("call"), "query_id", "embedding", "floor")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        b = b.drop_duplicates("query_id")
        floor = b["floor"].fillna(-np.inf).to_numpy(np.float64)
        got = best(b["query_id"].to_numpy(), _matrix(b["embedding"]), a["vec_id"].to_numpy(), _matrix(a["embedding"]), top, floor)
        return pd.DataFrame({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, FOUND)

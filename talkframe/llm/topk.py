"""Exact top-k search by inner product: cover trees of queries and data, walked together.

Both sides are dealt into cells by the nearest of some centres, drawn from the data. For a group
of queries around ``c`` with covering radius ``r_c`` and a group of data around ``d`` with
``r_d`` no inner product exceeds ``c·d + r_c |d| + r_d |c| + r_c r_d``; the pair is pruned if
that is below the worst kth score of the group's queries. Scores of a bounded sample of the
data, found first, give each query a floor. Pairs of cells are pruned before rows are exchanged,
so a far cell's vectors are never sent.

In a task a block of queries meets a block of data. Each forms a cover tree: the children of a
node of radius r have centres more than r/2 apart, and all its vectors lie within r/2 of one of
them. The trees are walked together; the bounds of all children of two nodes are one matrix
product, and where both have radius zero the bound is the score itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: A child with so few vectors has no children of its own.
LEAF = 16
#: Children, or vectors, of queries and data whose bounds or scores are worked out at once.
SCORED = (512, 2048)
#: Rows of a block of data and of queries, about; of the sample for the first floors; and cells at most.
DATA_BLOCK, QUERY_BLOCK, SAMPLE, CELLS = 16384, 4096, 2048, 1024
#: The sample is no more than one in so many rows.
SHARE = 16


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(squares, 0))


def _net(points: np.ndarray, apart: float, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Centres, more than ``apart`` from each other, within ``apart`` of all points; and each point's nearest."""
    centres, near, which = [], np.full(len(points), np.inf), np.zeros(len(points), int)
    while len(left := np.flatnonzero(near > apart)):
        some = left[:at_once]
        gaps = _distances(points[some], points[some])
        chosen: list[int] = []
        for i in range(len(some)):
            if not chosen or gaps[i, chosen].min() > apart:
                chosen.append(i)
        new = some[chosen]
        for at in range(0, len(points), SCORED[1] * 4):
            part = slice(at, at + SCORED[1] * 4)
            gap = _distances(points[part], points[new])
            first = gap.argmin(axis=1)
            least = gap[np.arange(len(gap)), first]
            closer = least < near[part]
            which[part] = np.where(closer, len(centres) + first, which[part])
            near[part] = np.minimum(near[part], least)
        near[new], which[new] = 0.0, len(centres) + np.arange(len(new))  # whatever was rounded
        centres += new.tolist()
    return np.array(centres, int), which


@dataclass
class Node:
    """The children of a node: centres, their lengths, covering radii, and the places of their vectors in the block."""

    centres: np.ndarray
    lengths: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    below: dict[int, Node] = field(default_factory=dict)  # of those children that have children

    def only(self, i: int) -> Node:
        """One child as if it were its own only child."""
        one = slice(i, i + 1)
        return Node(self.centres[one], self.lengths[one], self.radii[one], self.starts[one], self.ends[one])

    def levels(self) -> int:
        """This node's level and those below it."""
        return 1 + max((n.levels() for n in self.below.values()), default=1)

    def leaves(self) -> int:
        return len(self.radii) - len(self.below) + sum(n.leaves() for n in self.below.values())


class CoverTree:
    """``vectors`` and ``ids`` in the tree's order, and its root (None if empty)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.order = np.arange(len(vectors))
        self.raw = vectors
        self.root = None
        if len(vectors):
            middle = vectors.mean(axis=0)[None]
            centre = vectors[_distances(vectors, middle).argmin()][None]
            self.root = self._build(0, len(vectors), float(_distances(vectors, centre).max()))
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def _build(self, start: int, end: int, radius: float) -> Node:
        own = self.order[start:end]
        points = self.raw[own]
        centres, which = _net(points, radius / 2)
        sizes = np.bincount(which, minlength=len(centres))
        ends = start + np.cumsum(sizes)
        gap = np.sqrt(((points - points[centres[which]]) ** 2).sum(axis=1))
        radii = np.zeros(len(centres))
        np.maximum.at(radii, which, gap)
        self.order[start:end] = own[np.argsort(which, kind="stable")]
        at = points[centres]
        node = Node(at, np.sqrt((at**2).sum(axis=1)), radii, ends - sizes, ends)
        for i in np.flatnonzero((sizes > LEAF) & (radii > 0) & (radii < radius)):
            node.below[int(i)] = self._build(int(node.starts[i]), int(ends[i]), float(radii[i]))
        return node


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """In each row the k highest scores with the smaller ids first among equals."""
    if scores.shape[1] > 4 * k:
        # All that reach the kth highest score stay, ties included, so the order below is exact.
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
        width = int((scores >= floor).sum(axis=1).max())
        take = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        scores, ids = np.take_along_axis(scores, take, 1), np.take_along_axis(ids, take, 1)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Search:
    """Dual-tree walk; rows of ``scores`` and ``ids`` hold each query's best so far."""

    def __init__(self, queries: CoverTree, data: CoverTree, floors: np.ndarray, k: int) -> None:
        self.queries, self.data, self.k = queries, data, k
        self.floors = floors[queries.order]
        n = len(queries.ids)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.leaf_pairs = 0  # that were not pruned
        if queries.root and data.root:
            self._walk(queries.root, data.root)

    def _worst(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each range of queries the worst kth score; an equal one with a smaller id may still enter."""
        worst = np.maximum(self.scores[starts[0] : ends[-1], -1], self.floors[starts[0] : ends[-1]])
        return np.minimum.reduceat(worst, starts - starts[0])

    def _walk(self, q: Node, d: Node) -> None:
        """All pairs of children; those of one parent follow each other, as do their vectors."""
        for i in range(0, len(q.radii), SCORED[0]):
            rows = np.arange(i, min(len(q.radii), i + SCORED[0]))
            for j in range(0, len(d.radii), SCORED[1]):
                columns = np.arange(j, min(len(d.radii), j + SCORED[1]))
                most = bounds(q.centres[rows], q.lengths[rows], q.radii[rows], d.centres[columns], d.lengths[columns], d.radii[columns])
                near = most >= self._worst(q.starts[rows], q.ends[rows])[:, None]
                deep = near & (np.isin(rows, [*q.below])[:, None] | np.isin(columns, [*d.below])[None, :])
                self._leaves(q, d, rows, columns, near & ~deep)
                pairs = np.argwhere(deep)
                for x, y in pairs[np.argsort(-most[deep], kind="stable")].tolist():
                    if most[x, y] >= self._worst(q.starts[rows[x]][None], q.ends[rows[x]][None])[0]:
                        self._walk(q.below.get(i + x) or q.only(i + x), d.below.get(j + y) or d.only(j + y))

    def _leaves(self, q: Node, d: Node, rows: np.ndarray, columns: np.ndarray, near: np.ndarray) -> None:
        self.leaf_pairs += int(near.sum())
        rows, columns = rows[near.any(axis=1)], columns[near.any(axis=0)]
        own, other = _ranges(q.starts[rows], q.ends[rows]), _ranges(d.starts[columns], d.ends[columns])
        for i in range(0, len(own), SCORED[0]):
            mine = own[i : i + SCORED[0]]
            for j in range(0, len(other), SCORED[1]):
                theirs = other[j : j + SCORED[1]]
                ids = self.data.ids[theirs]
                scores = self.queries.vectors[mine] @ self.data.vectors[theirs].T
                scores[ids[None, :] == self.queries.ids[mine][:, None]] = -np.inf  # not the query's own row
                both = np.concatenate((self.scores[mine], scores), axis=1), np.concatenate((self.ids[mine], np.broadcast_to(ids, scores.shape)), axis=1)
                self.scores[mine], self.ids[mine] = _best(*both, self.k)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def bounds(qc: np.ndarray, q_length: np.ndarray, q_radius: np.ndarray, dc: np.ndarray, d_length: np.ndarray, d_radius: np.ndarray) -> np.ndarray:
    """What no inner product of a query group (a row) with a data group (a column) exceeds, rounding included."""
    far = (q_length + q_radius)[:, None] * (d_length + d_radius)[None, :]
    return qc @ dc.T + far - q_length[:, None] * d_length[None, :] + 1e-9 * far + 1e-6


def quantized(vector: Column) -> Column:
    """floor(256 x) of each component, as doubles; null if any component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, width))


def _in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with cell and gap: the nearest centre and the distance from it."""

    @F.pandas_udf("struct<cell:int,gap:double>")
    def nearest(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in vectors:
            cell, gap = [np.zeros(0, int)], [np.zeros(0)]
            for at in range(0, len(part), SCORED[1]):
                m = _matrix(part[at : at + SCORED[1]], centres.shape[1])
                cell.append(_distances(m, centres).argmin(axis=1))
                gap.append(np.sqrt(((m - centres[cell[-1]]) ** 2).sum(axis=1)))
            yield pd.DataFrame({"cell": np.concatenate(cell), "gap": np.concatenate(gap)})

    return rows.select("*", nearest("vector").alias("at")).select(*rows.columns, "at.cell", "at.gap")


def _near_cells(queries: DataFrame, data: DataFrame, q_centres: np.ndarray, d_centres: np.ndarray, q_block: int, d_block: int) -> list[tuple]:
    """Pairs of cells that may hold something: (qc, dc, and the number of blocks of each)."""
    q = {r["cell"]: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("floor")).collect()}
    d = {r["cell"]: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect()}
    qk, dk = sorted(q), sorted(d)
    length = lambda m: np.sqrt((m**2).sum(axis=1))
    qc, dc = q_centres[qk], d_centres[dk]
    most = bounds(qc, length(qc), np.array([q[k]["r"] for k in qk]), dc, length(dc), np.array([d[k]["r"] for k in dk]))
    near = most >= np.array([q[k]["floor"] for k in qk])[:, None]
    return [(qk[i], dk[j], -(-q[qk[i]]["n"] // q_block), -(-d[dk[j]]["n"] // d_block)) for i, j in np.argwhere(near).tolist()]


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products.

    Both sides have vec_id and vector, a non-null array of doubles with whole values, all of one
    length: rows of another length than that of the data's first vec_id take no part, on either
    side; products and sums stay exact below 2**53. A query does not meet the row of its own
    vec_id. Ties go to the smaller vec_id; fewer than k candidates give fewer rows; rows
    repeated under one vec_id are one candidate if their vectors are equal, else two; an empty
    side gives an empty result; other columns are ignored. Block sizes grow no task beyond one
    block of each side. Each block of queries meets the blocks of data in all cells that the
    bounds leave; what is not pruned there is scored as matrix products. A cell's rows are dealt
    into its blocks by a hash. Centres are at most ``CELLS`` vectors of the sample.
    """
    rows = lambda df: df.select("vec_id", "vector").distinct()
    data = checkpointed(rows(data))
    first = data.orderBy("vec_id").limit(1).select(F.size("vector").alias("n")).first()
    of_length = F.size("vector") == (first["n"] if first else 0)
    queries, data = checkpointed(rows(queries).where(of_length)), data.where(of_length)
    n_q, n_d = queries.count(), data.count()
    found = "query_id long, vec_id long, score long"
    if not n_q or not n_d:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def walk(key: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        width = len(d["vector"].iloc[0])
        search = Search(
            CoverTree(_matrix(q["q_vector"], width), q["q_id"].to_numpy()), CoverTree(_matrix(d["vector"], width), d["vec_id"].to_numpy()),
            q["floor"].fillna(-np.inf).to_numpy(float), k,
        )
        keep = np.isfinite(search.scores)
        return pd.DataFrame({"query_id": np.repeat(search.queries.ids, keep.sum(axis=1)), "vec_id": search.ids[keep], "score": search.scores[keep].astype(np.int64)})

    def met(q: DataFrame, d: DataFrame, pairs: list[tuple]) -> DataFrame:
        near = [F.broadcast(q.sparkSession.createDataFrame(pairs, "qc int, dc int, nq int, nd int")) for _ in range(2)]
        part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = q.join(near[0], F.col("cell") == F.col("qc")).select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"), "floor", "qc", part("nq").alias("qb"), "dc", every("nd").alias("db"))
        d = d.join(near[1], F.col("cell") == F.col("dc")).select("vec_id", "vector", "qc", every("nq").alias("qb"), "dc", part("nd").alias("db"))
        block = ("qc", "qb", "dc", "db")
        return q.groupBy(*block).cogroup(d.groupBy(*block)).applyInPandas(walk, found)

    # A true sample: the floors of a small table are not found by scoring all of it.
    sample = data.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n_d)) < min(SAMPLE, max(1, n_d // SHARE)))
    drawn = _matrix(sample.orderBy(F.xxhash64(F.lit(6), "vec_id"), "vec_id").limit(CELLS).toPandas()["vector"], 0)
    drawn = drawn if len(drawn) else _matrix(data.orderBy("vec_id").limit(1).toPandas()["vector"], 0)
    q_centres, d_centres = drawn[: -(-n_q // query_block)], drawn[: -(-n_d // data_block)]
    queries = checkpointed(_in_cells(queries, q_centres))
    none = queries.withColumn("floor", F.lit(None).cast("double"))
    all_cells = _near_cells(none, sample.withColumns({"cell": F.lit(0), "gap": F.lit(0.0)}), q_centres, d_centres, query_block, SAMPLE)
    floors = met(none, sample.withColumn("cell", F.lit(0)), all_cells).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    floored = checkpointed(queries.join(floors, F.col("query_id") == F.col("vec_id"), "left").drop("query_id"))
    data = checkpointed(_in_cells(data, d_centres))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = _near_cells(floored, data, q_centres, d_centres, query_block, data_block)
    ranked = met(floored, data, near).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("vector")).where("vector is not null")
    return top_k(vectors.where(F.pmod("vec_id", F.lit(50)) == 0), vectors)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

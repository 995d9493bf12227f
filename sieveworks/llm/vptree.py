"""Nearest neighbours by inner product: vantage-point trees per shard.

Vectors gain one component, sqrt(M^2 - |x|^2) with M the largest norm, queries a zero; then the
nearest in Euclidean distance are those of largest inner product, and the triangle inequality
holds.  Each shard (a hash of the id, about ``shard_rows`` vectors) keeps one tree as one row.
A block of queries walks down a tree together; a subtree is skipped when the triangle inequality,
relaxed by ``factor`` (distance to the ball's edge times factor against the k-th best distance),
excludes it: factor 1 is exact search, larger factors prune more and may miss neighbours.  A second
walk takes everything up to the k-th best distance and its rounding error, so that ties are decided
by exact scores alone.

Queries go to the shards in blocks; a query keeps k candidates per shard, then the k best of all.
Scores are inner products of the original vectors in double precision, summed component by
component in order; ties go to the smaller id.  Equal vectors of a shard are stored once with all
their ids, of which a query needs the k + 1 smallest, so that large groups of copies cost nothing.

Defined results: null, empty and zero vectors and vectors with null or non-finite components take
no part; vectors of different lengths are never compared; rows with equal ids are separate
candidates (none of them answers a query of that id); null ids take no part.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
#: Queries that walk down a tree together.
SEARCH_ROWS = 512


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the components' order whatever the batch."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


class Tree:
    """A vantage-point tree over lifted vectors, in arrays; children are laid out behind their parents."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.lexsort(tuple(vectors.T[::-1]))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            same[1:] = (vectors[order[1:]] == vectors[order[:-1]]).all(1)
        group = np.cumsum(~same) - 1
        by = np.lexsort((ids[order], group))
        self.ids, starts = ids[order][by], np.flatnonzero(~same)
        self.first = np.append(starts, len(order))  # ids of distinct vector g: first[g] to first[g + 1]
        self.vectors = vectors[order[starts]]
        self.largest = largest
        self._lift()
        self.nodes: list[tuple] = []
        if len(self.points):
            self._build(np.arange(len(self.points)))

    def _lift(self) -> None:
        self.points = np.column_stack([self.vectors, np.sqrt(np.maximum(0.0, self.largest**2 - (self.vectors**2).sum(1)))])
        self.norms = (self.points**2).sum(1)

    def __getstate__(self):
        # vectors travel once
        return {k: v for k, v in self.__dict__.items() if k not in ("points", "norms")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._lift()

    def _build(self, members: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[me] = (None, 0.0, members, None)
            return me
        vantage = self.points[members[len(members) // 2]]
        d = np.sqrt(((self.points[members] - vantage) ** 2).sum(1))
        edge = float(np.median(d))
        near = d <= edge
        if near.all():  # many at the median: cut just below the largest distance
            near = d < d.max()
            edge = float(d[near].max()) if near.any() else edge
        if not near.any() or near.all():
            self.nodes[me] = (None, 0.0, members, None)
            return me
        a = self._build(members[near])
        b = self._build(members[~near])
        self.nodes[me] = (vantage, edge, a, b)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, distinct vector) pairs: the k nearest of each query, and all that rounding or ties may have kept out."""
        q = np.column_stack([queries, np.zeros(len(queries))])
        if not self.nodes or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q2 = (q**2).sum(1)
        best = np.full((len(q), k), np.inf)
        # of a computed squared distance; points lie on the sphere of radius ``largest``
        error = 8 * np.finfo(float).eps * (self.points.shape[1] + 4) * (q2 + self.largest**2)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def walk(node: int, act: np.ndarray, reach, visit) -> None:
            vantage, edge, a, b = self.nodes[node]
            if vantage is None:
                visit(act, a, np.maximum(0.0, q2[act, None] + self.norms[a] - 2.0 * (q[act] @ self.points[a].T)))
                return
            d = np.sqrt(((q[act] - vantage) ** 2).sum(1))
            inside = d <= edge
            gap = np.abs(d - edge) * factor
            for group, first, second in ((inside, a, b), (~inside, b, a)):
                if group.any():
                    own, room = act[group], gap[group]
                    walk(first, own, reach, visit)
                    # a hair of slack covers rounding in the distances
                    left = own[room <= reach(own) * (1 + 1e-9) + 1e-9]
                    if len(left):
                        walk(second, left, reach, visit)

        def nearest(act, members, d):
            d = np.concatenate([best[act], d], axis=1)
            best[act] = np.partition(d, k - 1, axis=1)[:, :k]

        walk(0, np.arange(len(q)), lambda own: np.sqrt(best[own].max(1)), nearest)
        bound = best.max(1) + 2 * error

        def within(act, members, d):
            row, col = np.nonzero(d <= bound[act, None])
            pairs.append((act[row], members[col]))

        walk(0, np.arange(len(q)), lambda own: np.sqrt(bound[own]), within)
        row, who = (np.concatenate(x) for x in zip(*pairs))
        return row, who


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).alias("id"), v.alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of queries its k nearest rows of vectors with another id."""
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    asked = usable(queries, id_col, vector_col).withColumn("dim", F.size("v"))
    # per length: rows and largest norm, one row for each length that occurs
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = base.groupBy("dim").agg(F.count("*").alias("rows"), F.max(norm).alias("largest"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("int")
    placed = base.join(stats, "dim").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), shards))

    def grow(key, t):
        dim = key[0].as_py()
        flat = np.asarray(t.column("v").combine_chunks().flatten())
        tree = Tree(np.asarray(t.column("id")), flat.reshape(-1, dim), t.column("largest")[0].as_py())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = placed.select("id", "v", "dim", "shard", "largest").groupBy("dim", "shard").applyInArrow(grow, "dim int, shard long, tree binary")
    counted = asked.join(stats.select("dim", "rows"), "dim")
    per_dim = asked.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks"))
    sent = (
        counted.join(per_dim, "dim")
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")))
        .groupBy("dim", "block", "rows")
        .agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # block_rows queries or thereabouts
        .withColumn("shard", F.explode(F.expr(f"sequence(0L, CAST(greatest(1, ceil(rows / {shard_rows})) AS BIGINT) - 1)")))
    )
    pairs = sent.join(trees, ["dim", "shard"]).select("dim", "asked", "tree").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def find(batches):
        for b in batches:
            for dim, asked, blob in zip(*(c.to_pylist() for c in b.columns)):
                tree = pickle.loads(blob)
                ids = np.array([a["id"] for a in asked])
                q = np.array([a["v"] for a in asked]).reshape(-1, dim)
                for lo in range(0, len(ids), SEARCH_ROWS):
                    own = ids[lo : lo + SEARCH_ROWS]
                    row, g = tree.search(q[lo : lo + SEARCH_ROWS], k + 1, factor)  # one more: the query itself may be among them
                    exact = inner(q[lo + row], tree.vectors[g])
                    reps = np.minimum(tree.first[g + 1] - tree.first[g], k + 1)  # more of one vector's ids can't be among the k
                    step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    row, score = np.repeat(row, reps), np.repeat(exact, reps)
                    cand = tree.ids[np.repeat(tree.first[g], reps) + step]
                    keep = cand != own[row]
                    row, cand, score = row[keep], cand[keep], score[keep]
                    order = np.lexsort((cand, -score, row))
                    row, cand, score = row[order], cand[order], score[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    top = rank < k
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[top]]), pa.array(cand[top]), pa.array(score[top])], ["query_id", "id", "score"])

    found = pairs.mapInArrow(find, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

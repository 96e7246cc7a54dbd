"""Approximate nearest neighbours by a forest of random-projection trees and exact reranking.

Trees stand over vectors with one more coordinate, which gives all of them the
norm of the longest; on that sphere the largest inner product is the smallest distance.
They are fitted on a bounded sample of distinct vectors: a node projects its sample
vectors on the difference of two of them and splits at the median. Every
vector is then indexed, in one leaf of each tree. A query walks all trees through
one priority queue, ordered by how far it is from crossing the splits on the way,
and takes leaves until they hold enough vectors. Leaves are joined with the
queries that chose them, and inner products are taken in double precision, block by block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import materialize

TREES = 8
LEAF = 160
#: Distinct vectors that the trees are fitted on at most.
SAMPLE = 20_000
NEAREST = 20
#: A query takes leaves until they hold this share of all trees' entries, at every size of the table.
SHARE = 0.18
#: Vectors and queries of one leaf that a task holds at most; larger leaves are cut into blocks.
BLOCK = 20_000
#: Queries that one task walks through the trees.
WALKED = 2_000
EVERY = 20
SEED = 7


class Forest:
    """Splits of all trees as arrays over nodes. Children below 0 are leaves: leaf number -1 - child."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]
        dim = sample.shape[1]
        self.normals = np.array(self.normals).reshape(-1, dim)
        self.cuts = np.array(self.cuts)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, sample, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            normal = sample[a] - sample[b]
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                at = sample[rows] @ normal
                cut = float(np.median(at))
                right = at > cut
                if 0 < right.sum() < len(rows):
                    node = len(self.cuts)
                    self.normals.append(normal)
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    self.children[node] = [self._grow(sample, rows[~right], leaf, rng), self._grow(sample, rows[right], leaf, rng)]
                    return node
        self.leaves += 1
        return -self.leaves

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root)
            going = np.flatnonzero(node >= 0)
            while len(going):
                at = node[going]
                side = (np.einsum("ij,ij->i", vectors[going], self.normals[at]) > self.cuts[at]).astype(int)
                node[going] = self.children[at, side]
                going = going[node[going] >= 0]
            out[:, t] = -1 - node
        return out

    def probe(self, queries: np.ndarray, entries: np.ndarray, enough: float) -> list[list[int]]:
        """Leaves for each query, best first, until ``entries`` of them sum to ``enough``."""
        out = []
        for margins in queries @ self.normals.T - self.cuts if len(self.cuts) else np.zeros((len(queries), 0)):
            heap = [(-np.inf, root) for root in self.roots]
            heapq.heapify(heap)
            leaves, got = [], 0
            while heap and got < enough:
                bound, node = heapq.heappop(heap)
                if node < 0:
                    leaves.append(-1 - node)
                    got += entries[-1 - node]
                    continue
                m = margins[node]
                heapq.heappush(heap, (max(bound, m), self.children[node, 0]))
                heapq.heappush(heap, (max(bound, -m), self.children[node, 1]))
            out.append(leaves)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: each id and vector once, of the table's most frequent length."""
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad).where(F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (length[0] if length else 0)).dropDuplicates(["vec_id", "embedding"])


def on_sphere(vectors: np.ndarray, unit: float, radius: float) -> np.ndarray:
    """Vectors in multiples of ``unit``, with the coordinate that makes each as long as ``radius``."""
    scaled = vectors / unit
    rest = np.sqrt(np.maximum(radius * radius - (scaled * scaled).sum(axis=1), 0.0))
    return np.column_stack([scaled, rest])


def towards_sphere(queries: np.ndarray, radius: float) -> np.ndarray:
    """Queries stretched to ``radius``; their further coordinate is 0, so that inner products keep their order."""
    scaled = queries / np.abs(queries).max(axis=1, initial=0.0)[:, None]
    return np.column_stack([scaled * (radius / np.linalg.norm(scaled, axis=1))[:, None], np.zeros(len(queries))])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    every: int = EVERY,
    n: int = NEAREST,
    trees: int = TREES,
    sample_rows: int = SAMPLE,
    share: float = SHARE,
    least: int = 0,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``n`` vectors of largest inner product found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows
    of another vec_id. Ties go to the smaller vec_id. Vectors that are null, empty, zero or
    hold null or non-finite components, ids that are null, and vectors of another length
    than most take no part; repeated rows count once. Fewer candidates than ``n`` are all
    returned; no rows give no rows. Equal vectors are one entry with its n + 1 smallest
    ids, which can hold no others of the result. A query takes leaves of ``share`` of all
    entries, or of ``least`` entries if that is more.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    rows_kept = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= n + 1)
    entries = materialize(rows_kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    sample = entries.orderBy(F.xxhash64(F.lit(SEED), F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample_rows).select("embedding").toArrow()
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    component = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    unit = entries.agg(F.max(component)).first()[0]
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / unit) * (x.cast("double") / unit))
    radius = float(np.sqrt(entries.agg(F.max(squares)).first()[0]))
    forest = spark.sparkContext.broadcast(Forest(on_sphere(_matrix(sample.column(0).combine_chunks()), unit, radius), trees))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            leaf = forest.value.assign(on_sphere(x, unit, radius))
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            for t in range(leaf.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t]), batch.column("ids"), packed], ["leaf", "ids", "vector"])

    indexed = entries.select("ids", "embedding").mapInArrow(index, "leaf long, ids array<long>, vector binary")
    held = {r[0]: r[1] for r in indexed.groupBy("leaf").count().collect()}
    sizes = np.zeros(forest.value.leaves, np.int64)
    for k, v in held.items():
        sizes[k] = v
    enough = max(least, share * total * trees)
    sent = spark.sparkContext.broadcast(sizes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            probes = forest.value.probe(towards_sphere(x, radius), sent.value, enough)
            which = np.repeat(np.arange(len(x)), [len(p) for p in probes])
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(p, np.int64) for p in probes])) if len(x) else pa.array([], pa.int64()), batch.column("vec_id").take(pa.array(which)), packed.take(pa.array(which))],
                ["leaf", "query_id", "vector"],
            )

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    queries = asked.count()
    probes = asked.repartition(queries // WALKED + 1, "vec_id").mapInArrow(search, "leaf long, query_id long, vector binary")
    # A leaf's vectors are cut into blocks by its measured size and its queries by their number, as a query takes a leaf once.
    vector_blocks = np.maximum(1, -(-sizes // BLOCK))
    query_blocks = np.full(len(sizes), max(1, -(-queries // BLOCK)))
    plan = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes)), "vb": vector_blocks, "qb": query_blocks}))
    salted = lambda df, own, other, key: df.join(F.broadcast(plan), "leaf").withColumn("own", F.pmod(F.xxhash64(key), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = salted(indexed, "vb", "qb", "vector").select("leaf", F.col("own").alias("v"), F.col("other").alias("q"), "ids", "vector")
    right = salted(probes, "qb", "vb", "query_id").select("leaf", F.col("other").alias("v"), F.col("own").alias("q"), "query_id", "vector")

    def block(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(vectors) or not len(queries):
            return none
        v = np.frombuffer(b"".join(vectors["vector"]), kind).astype(np.float64).reshape(len(vectors), -1)
        smallest = np.array([i[0] for i in vectors["ids"]])
        order = np.argsort(smallest, kind="stable")
        v, ids = v[order], vectors["ids"].to_numpy()[order]
        out = []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start : start + 256]
            q = np.frombuffer(b"".join(part["vector"]), kind).astype(np.float64).reshape(len(part), -1)
            near = q @ v.T
            top = np.argsort(-near, axis=1, kind="stable")[:, : n + 1]
            which = np.repeat(np.arange(len(part)), top.shape[1])
            found = top.ravel()
            exact = (q[which] * v[found]).sum(axis=1)
            counts = np.array([len(ids[i]) for i in found])
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy()[which], counts), "vec_id": np.concatenate([ids[i] for i in found]), "score": np.repeat(exact, counts)}))
        return pd.concat(out) if out else none

    keys = ["leaf", "v", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    found = found.where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")

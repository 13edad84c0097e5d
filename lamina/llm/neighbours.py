"""Approximate nearest neighbours by a forest of random-projection trees.

Trees split a bounded sample (``SAMPLE`` vectors by the hash of vec_id) by
random hyperplanes at the median; every row is then routed to a leaf of every
tree.  A query orders the leaves of *all* trees in one shared priority queue,
by the least margin on the path to a leaf (how far the query would have to
move to fall there), and takes leaves until they hold a *share* of the rows.
Rows of those leaves are candidates and are ranked by the exact cosine in
double precision.

The share is found for the data at hand.  Some vectors of the sample
(``PROBES``) are asked for their exact nearest neighbours in the sample, and
the share is the least at which ``AIM`` of those neighbours lie in the leaves
searched.  Vectors without structure (the test tables: independent normals, 64
dimensions, fifth neighbour at cosine 0.42) need most rows for that, whatever
the index; clustered ones need a few leaves.  In a whole table neighbours are
nearer than in its sample, so recall is above the aim rather than below.
Vectors of each length have a forest of their own, as no cosine is defined
between lengths.

Scale.  Copies of a vector are one candidate with its smallest ids (only
``k + 1`` of them can be a result) and one query, so a vector that a third of
the rows share is one row.  A leaf is cut into blocks of ``ROWS`` rows and the
query set into blocks of ``QUERIES``; a task holds one of each.  What is
broadcast is the forest and its leaf sizes: at most ``TREES * 2**DEPTH`` cells.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of another length
are no candidates of a query; a repeated id counts once per distinct
vector; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.common import checkpoint, table

TREES = 4
#: Share of the probes' neighbours that the search must reach, and the number of probes.
AIM = 0.96
PROBES = 400
SAMPLE = 16_384
LEAF = 1024
DEPTH = 10
ROWS = 8192
QUERIES = 8192
NEIGHBOURS = 5
EVERY = 50


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (doubles as bytes) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    taken = rows.where(F.col(id_column).isNotNull() & sound & F.exists(x, lambda e: e != 0)).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 becomes 0.0
            ends = np.cumsum(np.asarray(column.value_lengths()))
            v = [flat[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["vec_id", "v"])

    return taken.mapInArrow(run, "vec_id long, v binary")


class Forest:
    """Complete binary trees of one depth, as arrays of hyperplanes."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.leaves = depth, 1 << depth
        nodes = self.leaves - 1
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.normal = rng.normal(size=(trees, nodes, sample.shape[1]))
        self.normal /= np.linalg.norm(self.normal, axis=2, keepdims=True)
        self.cut = np.zeros((trees, nodes))
        for t in range(trees):
            at = np.zeros(len(unit), np.int64)
            for k in range(nodes):
                here = np.flatnonzero(at == k)
                p = unit[here] @ self.normal[t, k]
                self.cut[t, k] = np.median(p) if len(p) else 0.0
                at[here] = 2 * k + 1 + (p > self.cut[t, k])

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, leaves of all trees numbered through."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = np.empty((len(self.cut), len(x)), np.int64)
        for t in range(len(self.cut)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", unit, self.normal[t, at]) > self.cut[t, at])
            out[t] = t * self.leaves + at - (self.leaves - 1)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Least margin on the path to each leaf of each tree: the shared queue's priorities."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for t in range(len(self.cut)):
            m = unit @ self.normal[t].T - self.cut[t]
            least = np.full((len(x), 1), np.inf)
            for d in range(self.depth):
                level = m[:, (1 << d) - 1 : (1 << (d + 1)) - 1]
                least = np.stack([np.minimum(least, -level), np.minimum(least, level)], 2).reshape(len(x), -1)
            out.append(least)
        return np.concatenate(out, 1)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosine of each row of x with q; a row's value depends on that row alone."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _rank(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a leaf block for each of a block of queries."""
    schema = pa.schema([("qid", pa.int64()), ("rid", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    x, rid = _matrix(index.column("v").to_pylist()), index.column("rid").to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    qv, qid = queries.column("v").to_pylist(), queries.column("qid").to_pylist()
    rows, scores = [], []
    for at in range(0, len(qv), 256):
        q = _matrix(qv[at : at + 256])
        near = unit @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
        for j in range(len(q)):
            c = near[:, j]
            best = np.flatnonzero(c >= np.partition(c, len(c) - k)[len(c) - k] - 1e-9) if len(c) > k else np.arange(len(c))
            exact = cosines(x[best], q[j])
            order = np.lexsort((rid[best], -exact))[:k]
            rows.append(rid[best][order])
            scores.append(exact[order])
    return pa.Table.from_arrays([pa.array(qid, pa.int64()), pa.array(rows, schema.field("rid").type), pa.array(scores, schema.field("score").type)], schema=schema)


def needed_share(forest: Forest, sample: np.ndarray, k: int) -> float:
    """The least share of rows, counted once a tree, in whose leaves AIM of the probes' k nearest lie."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    leaves = forest.route(sample)
    sizes = np.bincount(leaves.ravel(), minlength=len(forest.cut) * forest.leaves)
    need = []
    for at in range(0, min(PROBES, len(unit)), 64):
        probe = np.arange(at, min(at + 64, PROBES, len(unit)))
        near = unit[probe] @ unit.T
        near[np.arange(len(probe)), probe] = -np.inf
        best = np.argpartition(-near, min(k, len(unit) - 1) - 1, axis=1)[:, : min(k, len(unit) - 1)] if len(unit) > 1 else np.zeros((len(probe), 0), np.int64)
        order = np.argsort(-forest.margins(sample[probe]), axis=1, kind="stable")
        before = np.empty(order.shape)
        np.put_along_axis(before, order, np.cumsum(sizes[order], 1) - sizes[order], 1)
        # A row is met in the first leaf that holds it, of any tree.
        need.append(np.take_along_axis(before[:, None, :], leaves.T[best], 2).min(2).ravel())
    every = np.concatenate(need) / len(unit)
    return float(np.quantile(every, AIM, method="higher")) + 1e-9 if len(every) else 1.0


def fit_forest(vectors: DataFrame, n: int, trees: int, leaf: int, k: int) -> tuple[Forest, float]:
    """A forest over at most SAMPLE vectors, deep enough for leaves of about leaf rows, and the share of rows to search."""
    if n > SAMPLE:
        vectors = vectors.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    rows = vectors.select("v", F.xxhash64("rid").alias("h")).toArrow().sort_by([("h", "ascending"), ("v", "ascending")]).slice(0, SAMPLE).column("v").to_pylist()
    depth = min(DEPTH, max(1, math.ceil(math.log2(max(2, n / leaf)))))
    sample = _matrix(rows)
    forest = Forest(sample, trees, depth)
    return forest, needed_share(forest, sample, k)


def search(vectors: DataFrame, wanted: F.Column, k: int = NEIGHBOURS, trees: int = TREES, share: float | None = None, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every wanted row of (vec_id, v); share None finds the share of rows to search."""
    rows = checkpoint(vectors.dropDuplicates(["vec_id", "v"]))
    lengths = [r[0] for r in rows.select(F.octet_length("v")).distinct().collect()]  # one row a length of vectors
    found = [_search(rows.where(F.octet_length("v") == x), wanted, k, trees, share, leaf) for x in sorted(lengths)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, wanted: F.Column, k: int, trees: int, share: float | None, leaf: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    copies = checkpoint(few.groupBy("v").agg(F.min("vec_id").alias("rid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = copies.count()
    asked = rows.where(wanted)
    queries = checkpoint(asked.groupBy("v").agg(F.min("vec_id").alias("qid")))
    forest, enough = fit_forest(copies, n, trees, leaf, k)
    share = enough if share is None else share
    sent = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = sent.value.route(_matrix(b.column(1).to_pylist()))
                for x in leaves:
                    yield pa.RecordBatch.from_arrays([pa.array(x), b.column(0), b.column(1)], ["bucket", "rid", "v"])

    indexed = checkpoint(copies.select("rid", "v").mapInArrow(index, "bucket long, rid long, v binary"))
    sizes = np.zeros(trees * forest.leaves, np.int64)
    for bucket, count in indexed.groupBy("bucket").count().collect():  # one row a leaf: bounded by the forest
        sizes[bucket] = count
    blocks = -(-sizes // ROWS)
    n_queries = queries.count()
    parts = max(1, math.ceil(n_queries / QUERIES))
    plan = spark.sparkContext.broadcast((sizes, blocks, share * n))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cut, budget = plan.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                v = b.column(1).slice(at, 256)
                order = np.argsort(-sent.value.margins(_matrix(v.to_pylist())), axis=1, kind="stable")
                before = np.cumsum(size[order], 1) - size[order]
                i, j = np.nonzero((before <= budget) & (size[order] > 0))
                bucket = order[i, j]
                times = cut[bucket]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = pa.array(np.repeat(i, times))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, times)), pa.array(block), b.column(0).slice(at, 256).take(row), v.take(row)], ["bucket", "block", "qid", "v"])

    cut = F.element_at(F.lit(blocks.tolist()).cast("array<long>"), (F.col("bucket") + 1).cast("int")) if blocks.max() > 1 else F.lit(1)
    left = indexed.select("bucket", F.pmod(F.xxhash64("rid"), cut).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rid", "v")
    right = queries.select("qid", "v").mapInArrow(visit, "bucket long, block long, qid long, v binary")
    right = right.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    keys = ("bucket", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _rank(a, b, k + 1), "qid long, rid array<long>, score array<double>")
    pairs = found.select("qid", F.explode(F.arrays_zip("rid", "score")).alias("p")).select("qid", "p.rid", "p.score").distinct()
    top = pairs.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "rid"))).where(F.col("n") <= k + 1)
    near = top.join(copies.select("rid", "ids"), "rid").select("qid", "score", F.explode("ids").alias("vec_id"))
    own = asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "qid")
    hits = own.join(near, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(valid_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)

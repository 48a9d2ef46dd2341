"""Nearest neighbours through learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small network learns which part a
vector belongs to and places every row; a query goes to the parts that the network finds most probable,
and the rows there are ranked by their original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors

NEIGHBOURS = 5
FIT_ROWS = 8_192
#: Rows of the table for each part, the fewest parts, and the fewest rows of the sample for each.
ROWS_PER_PART, MIN_PARTS, FIT_ROWS_PER_PART = 1_000, 4, 16
#: Share of the sample's true neighbours that the probed parts must hold.
WANTED_RECALL = 0.93
GRAPH_DEGREE, HIDDEN, FIT_STEPS = 10, 64, 300
#: Rows and queries that meet in one task, and queries that are compared at a time there.
CHUNK_ROWS, CHUNK_QUERIES, AT_ONCE = 8_192, 16_384, 512
QUERY_STEP = 50


@dataclass(frozen=True)
class Router:
    layers: list[np.ndarray]  # weights and biases of a network with one hidden layer
    probes: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """(rows, degree): the nearest other rows by cosine, nearest first."""
    near = np.empty((len(x), degree), dtype=np.int64)
    for at in range(0, len(x), 1024):
        close = x[at : at + 1024] @ x.T
        close[np.arange(len(close)), np.arange(at, at + len(close))] = -np.inf
        own = np.argpartition(-close, degree - 1, axis=1)[:, :degree]
        order = np.argsort(-np.take_along_axis(close, own, axis=1), axis=1, kind="stable")
        near[at : at + 1024] = np.take_along_axis(own, order, axis=1)
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them.

    Starts from halvings along the widest direction; then rows move to the part of most of their
    neighbours, best gains first, as long as that part has room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    groups = [(np.arange(len(x)), parts)]
    nth = 0
    while groups:
        rows, k = groups.pop()
        if k == 1:
            part[rows] = nth
            nth += 1
            continue
        y = x[rows] - x[rows].mean(axis=0)
        _, v = np.linalg.eigh(y.T @ y)
        order = rows[np.argsort(y @ v[:, -1], kind="stable")]
        cut = len(order) * (k // 2) // k
        groups += [(order[:cut], k // 2), (order[cut:], k - k // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        votes = np.zeros((len(x), parts))
        for k in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), part[near[:, k]]), 1)
            np.add.at(votes, (near[:, k], part), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=parts)
        movers = np.flatnonzero((gain > 0) & (rng.random(len(x)) < 0.6))
        moved = 0
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            if sizes[best[i]] < room and sizes[part[i]] > 1:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, k: int = NEIGHBOURS, seed: int = 11) -> Router:
    """Cut the sample's graph, learn the parts with Adam, and find how many probes reach the wanted recall."""
    near = neighbour_graph(x, min(GRAPH_DEGREE, len(x) - 1))
    part = balanced_parts(x, near, parts)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]) * 4, np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, FIT_STEPS + 1):
        rows = rng.integers(0, len(x), min(len(x), 1024))
        own, truth = x[rows], part[rows]
        hidden = np.maximum(own @ layers[0] + layers[1], 0)
        odds = hidden @ layers[2] + layers[3]
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), truth] -= 1
        p /= len(rows)
        back = (p @ layers[2].T) * (hidden > 0)
        grads = [own.T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(layers, parts)
    odds = router.odds(x)
    placed = odds.argmax(axis=1)
    order = np.argsort(-odds, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    deep = np.stack([rank[np.arange(len(x)), placed[near[:, j]]] for j in range(min(k, near.shape[1]))])
    for probes in range(1, parts + 1):
        if (deep < probes).mean() >= WANTED_RECALL:
            break
    return Router(layers, probes)


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query, by cosine; and what the
    query took: parts_probed of parts, rows_compared.

    ``rows`` and ``queries`` are (vec_id, embedding); a row does not answer a query of its own vec_id.
    Vectors that are null, empty, zero or not finite, of another length than most, or without a vec_id
    take no part, neither as rows nor as queries; equal scores go to the smaller vec_id; a query gets
    all candidates if there are fewer than ``k``; a repeated query_id is searched once; an empty table gives no rows.
    """
    spark = rows.sparkSession
    common.short_batches(spark)
    able = vectors.usable() & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(able)
    queries = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(able)
    top = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, count = (top["dim"], top["count"]) if top else (1, 0)
    rows, queries = rows.filter(F.size("embedding") == dim), queries.filter(F.size("embedding") == dim).dropDuplicates(["vec_id"])
    x = vectors.sample(rows, FIT_ROWS, count)
    parts = max(1, min(max(MIN_PARTS, count // ROWS_PER_PART), len(x) // FIT_ROWS_PER_PART))
    router = fit_router(x, parts, k) if parts > 1 else Router([np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    layers = spark.sparkContext.broadcast(router.layers)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Router(layers.value, 0)
        for b in batches:
            if b.num_rows:
                part = own.odds(vectors.unit(vectors.matrix(b.column(1)))).argmax(axis=1).astype(np.int32)
                yield pa.record_batch([*b.columns, pa.array(part)], names=["vec_id", "embedding", "part"])

    held = common.stored(rows.mapInArrow(placed, "vec_id long, embedding array<double>, part int"), "placed")
    sizes = np.zeros(parts, dtype=np.int64)
    for r in held.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK_ROWS))
    probes = router.probes

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Router(layers.value, 0)
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-own.odds(vectors.unit(vectors.matrix(b.column(1)))), axis=1, kind="stable")
            reached = np.cumsum(sizes[order], axis=1)
            n = np.maximum(probes, (reached < k + 1).sum(axis=1) + 1)  # enough parts to hold k others, too
            at = np.minimum(n, parts)
            flat = np.concatenate([o[:j] for o, j in zip(order, at, strict=True)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)), pa.array(flat))
            compared = np.array([sizes[o[:j]].sum() for o, j in zip(order, at, strict=True)])
            yield pa.record_batch([*b.columns, lists, pa.array(compared)], names=["vec_id", "embedding", "parts", "compared"])

    asked = common.stored(queries.mapInArrow(routed, "vec_id long, embedding array<double>, parts array<int>, compared long"), "routed")
    effort = ["parts_probed", "parts", "rows_compared"]
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.size("parts").alias("parts_probed"), F.col("compared").alias("rows_compared"), F.explode("parts").alias("part"))
    asked = asked.withColumn("parts", F.lit(parts))
    load = np.ones(parts, dtype=np.int64)
    for r in asked.groupBy("part").count().collect():
        load[r["part"]] = max(1, -(-r["count"] // CHUNK_QUERIES))
    of_rows, of_queries = (F.array(*(F.lit(int(n)) for n in a))[F.col("part")] for a in (chunks, load))
    left = asked.select("query_id", "query", *effort, F.col("part").alias("q_part"), F.pmod(F.xxhash64("query_id"), of_queries).cast("int").alias("q_block"), F.explode(F.sequence(F.lit(0), of_rows - 1)).alias("q_chunk"))
    right = held.select("vec_id", "embedding", "part", F.pmod(F.xxhash64("vec_id"), of_rows).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), of_queries - 1)).alias("block"))

    def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
        """The nearest rows of a cell for each query there; queries are compared a block at a time."""
        rows: list[np.ndarray] = [np.zeros(0, np.int64)]
        ids: list[np.ndarray] = [np.zeros(0, np.int64)]
        scores: list[np.ndarray] = [np.zeros(0)]
        if q.num_rows and c.num_rows:
            a, b = vectors.matrix(q.column("query")), vectors.matrix(c.column("embedding"))
            unit, own, known = vectors.unit(b), q.column("query_id").to_numpy(), c.column("vec_id").to_numpy()
            some = min(k, len(b))
            for at in range(0, len(a), AT_ONCE):
                close = vectors.unit(a[at : at + AT_ONCE]) @ unit.T
                close[own[at : at + AT_ONCE, None] == known[None, :]] = -np.inf
                kth = np.partition(close, -some, axis=1)[:, -some]
                for i in range(len(close)):
                    j = np.flatnonzero((close[i] >= kth[i] - 1e-9) & (close[i] > -np.inf))
                    score = vectors.cosine(np.broadcast_to(a[at + i], (len(j), a.shape[1])), b[j])
                    best = np.lexsort((known[j], -score))[:k]
                    rows.append(np.full(len(best), at + i))
                    ids.append(known[j][best])
                    scores.append(score[best])
        taken = np.concatenate(rows)
        return pa.table({**{c: q.column(c).take(taken) for c in ("query_id", *effort)}, "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    kind = "query_id long, parts_probed int, parts int, rows_compared long, vec_id long, score double"
    met = left.groupBy("q_part", "q_chunk", "q_block").cogroup(right.groupBy("part", "chunk", "block")).applyInArrow(nearest, kind)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *effort)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % QUERY_STEP == 0))

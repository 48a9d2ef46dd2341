"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample makes balanced binary codes; the code's substrings are the keys
of several tables; vectors that meet in a table are compared by their original vectors. Only vectors
with equal labels meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

THRESHOLD = 0.93
FIT_ROWS, FIT_ROUNDS = 10_000, 30
CODE_BITS = 64
#: Least chance that a pair at the threshold shares a bucket, the largest radius that is probed, and what a comparison costs against a probe.
WANTED_RECALL, MAX_RADIUS, COMPARE_COST = 0.98, 2, 0.02
#: A bucket with more rows is split into blocks of about this size, and every two blocks meet in a cell.
BLOCK_ROWS = 1_000


def fit_rotation(x: np.ndarray, bits: int = CODE_BITS, rounds: int = FIT_ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection) for unit vectors: principal directions, then the rotation with the least quantisation error."""
    centre = x.mean(axis=0)
    y = x - centre
    bits = min(bits, x.shape[1])
    _, vectors_ = np.linalg.eigh(y.T @ y / max(len(y), 1))
    basis = vectors_[:, ::-1][:, :bits]
    v = y @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return centre, basis @ rotation


def meeting_chance(width: int, tables: int, radius: int, threshold: float = THRESHOLD) -> float:
    """Chance that two vectors at the threshold share a bucket: a bit of a random projection differs with chance angle / pi."""
    p = math.acos(threshold) / math.pi
    one = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(radius + 1))
    return 1 - (1 - one) ** tables


def table_shape(largest: int, bits: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(tables, bits of each, probed radius) for the largest number of vectors that share a label.

    The cheapest shape in probes and comparisons among those that keep the wanted chance for a pair at the
    threshold to meet, whatever the label's size. If none does, all rows of a label share one bucket.
    """
    found = (1, 0, 0)
    least = float(largest)
    for width in range(1, min(16, bits) + 1):
        tables = bits // width
        for radius in range(min(MAX_RADIUS, width - 1) + 1):
            if meeting_chance(width, tables, radius, threshold) >= WANTED_RECALL:
                probes = tables * sum(math.comb(width, k) for k in range(radius + 1))
                cost = probes * (1 + COMPARE_COST * largest / 2**width)
                if cost < least:
                    least, found = cost, (tables, width, radius)
                break
    return found


def _settle(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the pairs (u, v)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[u], low[v])
        after = low.copy()
        np.minimum.at(after, u, m)
        np.minimum.at(after, v, m)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _cell_links(x: np.ndarray, cid: np.ndarray, side: np.ndarray, across: bool, home: np.ndarray, substrings: np.ndarray, table: int, radius: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows that no earlier table has found.

    side: the block a row is in; across: whether the cell is of two blocks, whose rows then meet only
    each other; home: whether the row's own substring leads here, or a flipped one.
    """
    unit = vectors.unit(x)
    a, b = np.flatnonzero(home), np.arange(len(x))
    found_a, found_b = [], []
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        close = unit[rows] @ unit.T
        i, j = np.nonzero(close >= threshold - 1e-9)
        i, j = rows[i], b[j]
        keep = (cid[i] != cid[j]) & np.where(home[j], cid[i] < cid[j], cid[j] < cid[i])
        if across:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        edge = np.abs((unit[i] * unit[j]).sum(axis=1) - threshold) < 1e-9
        sure = np.ones(len(i), dtype=bool)
        sure[edge] = vectors.cosine(x[i[edge]], x[j[edge]]) >= threshold
        i, j = i[sure], j[sure]
        for t in range(table):
            if not len(i):
                break
            met = np.bitwise_count(substrings[i, t] ^ substrings[j, t]) <= radius
            i, j = i[~met], j[~met]
        found_a.append(i)
        found_b.append(j)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (a[:0], a[:0])


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, linked, root): per cell and class, the number of rows it links to and the smallest class it is connected to there.

    ``classes`` has cid, label, embedding (usable) and n, the rows that share the vector.
    """
    spark = classes.sparkSession
    common.short_batches(spark)
    sized = classes.withColumn("dim", F.size("embedding"))
    kinds = sized.groupBy("dim", "label").count()
    top = kinds.groupBy("dim").agg(F.sum("count").alias("rows"), F.max("count").alias("largest")).orderBy(F.desc("rows"), "dim").first()
    dim, rows, largest = (top["dim"], top["rows"], top["largest"]) if top else (1, 0, 0)
    x = vectors.sample(sized.filter(F.col("dim") == dim), FIT_ROWS, rows)
    centre, projection = fit_rotation(x) if len(x) > 1 else (np.zeros(dim), np.eye(dim)[:, :CODE_BITS])
    # centring brings a pair's difference closer to its length: the threshold as the centred vectors see it
    reach = float(np.quantile(((x - centre) ** 2).sum(axis=1), 0.1)) if len(x) > 1 else 0.0
    tables, width, radius = table_shape(largest, projection.shape[1], max(-1.0, 1 - (1 - threshold) / reach) if reach > 0 else -1.0)
    weights = (1 << np.arange(width)).astype(np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            own = b.column("dim").to_numpy() == dim
            keys = np.zeros((b.num_rows, tables), dtype=np.int64)  # vectors of other lengths all meet, by length
            if width and own.any():
                bits = (vectors.unit(vectors.matrix(lists.filter(pa.array(own)))) - centre) @ projection >= 0
                keys[own] = bits[:, : tables * width].reshape(-1, tables, width).astype(np.int64) @ weights
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.record_batch([*b.columns, flat], names=[*b.schema.names, "substrings"])

    kind = f"cid long, label {classes.schema['label'].dataType.simpleString()}, embedding {classes.schema['embedding'].dataType.simpleString()}, n long, dim int, substrings array<long>"
    codes = common.stored(sized.select("cid", "label", "embedding", "n", "dim").mapInArrow(coded, kind), "codes")
    flips = [sum(1 << k for k in own) for r in range(radius + 1) for own in combinations(range(width), r)]
    probes = F.array(*(F.struct(F.lit(t).alias("t"), F.col("substrings")[t].bitwiseXOR(m).alias("key"), F.lit(m == 0).alias("home")) for t in range(tables) for m in flips))
    slim = codes.select("cid", "label", "dim", F.explode(probes).alias("p")).select("cid", "label", "dim", "p.*")
    bucket = ["label", "dim", "t", "key"]
    sizes = slim.groupBy(bucket).agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).filter("size > 1 and homes > 0").drop("homes")
    placed = slim.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")).drop("size")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    cells = placed.select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "cid")
    full = cells.join(codes.select("cid", "embedding", "n", "substrings"), "cid")
    order = [*bucket, "i", "j"]
    full = full.repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(part: pa.Table) -> pa.RecordBatch:
            x = vectors.matrix(part.column("embedding"))
            cid, n, home, side = (part.column(c).to_numpy() for c in ("cid", "n", "home", "block"))
            subs = vectors.matrix(part.column("substrings")).astype(np.int64)
            across = part.column("i")[0] != part.column("j")[0]
            a, b = _cell_links(x, cid, side, across, home, subs, int(part.column("t")[0].as_py()), radius, threshold)
            linked = (np.bincount(a, n[b], len(cid)) + np.bincount(b, n[a], len(cid))).astype(np.int64)
            order_ = np.argsort(cid, kind="stable")
            place = np.empty(len(cid), dtype=np.int64)
            place[order_] = np.arange(len(cid))
            root = cid[order_][_settle(len(cid), place[a], place[b])][place]
            hit = linked > 0
            return pa.record_batch([pa.array(cid[hit]), pa.array(linked[hit]), pa.array(root[hit])], names=["cid", "linked", "root"])

        for part in _groups(batches, order):
            if part.num_rows > 1:
                yield cell(part)

    return full.mapInArrow(run, "cid long, linked long, root long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]  # no key is null
        new = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = first != last
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(b)
        else:
            if starts[0] > 0:
                held.append(b.slice(0, int(starts[0])))
            if held:
                yield pa.Table.from_batches(held)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield pa.Table.from_batches([b.slice(int(s), int(e - s))])
            held = [b.slice(int(starts[-1]))]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, label, embedding).

    Null, empty, zero and non-finite vectors and rows with a null label link with nothing; labels may be
    of any plain type; vectors of different lengths do not link; equal vectors are one class and link with each other, so a group of
    copies costs one comparison; a null vec_id takes part, but never names a component; an empty table
    gives no rows; other columns are not read.
    """
    keyed = rows.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    linking = vectors.usable() & F.col("label").isNotNull()
    able = keyed.filter(linking)
    grouped = able.groupBy("label", "h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = common.stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = common.stored(links(classes, threshold), "links")
    roots = common.connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    placed = classes.select("label", "h1", "h2", "cid", "first_id", "n").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    placed = common.stored(placed.select("label", "h1", "h2", "first_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("label", "h1", "h2", "n_links", "component_id")
    linkable = able.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter(~linking).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "embeddings"))

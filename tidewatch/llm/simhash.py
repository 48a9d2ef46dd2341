"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits that vary together share a partition; a dynamic programme over estimated candidate
counts gives every partition its own Hamming threshold; probes that meet in a partition are verified
on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64
SHINGLE_WORDS = 3
MAX_DIFFERENT_BITS = 2
PARTITIONS = 3
#: Buckets with more members than this are linked through one-bit variants instead of pairs.
BUCKET_PAIRS = 64
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 50_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def simhash(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text's UTF-8 bytes, as a signed long."""
    words = data.lower().split()  # for bytes: A-Z, and splits at x20 and x09-x0D alone
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    n = len(words) - size + 1
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        counts += _byte_counts(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), dtype=np.uint8))
    return _majority(counts, n)


def _byte_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each byte value stands at each of the eight places of big-endian hashes."""
    return np.bincount((hashes.reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)


def _majority(counts: np.ndarray, n: int) -> int:
    ones = (counts @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit shingle hashes, as a signed long; of none it is 0."""
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += _byte_counts(hashes[at : at + CHUNK].astype(">u8").view(np.uint8))
    return _majority(counts, len(hashes))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty and has fingerprint 0."""
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        for b in batches:
            found = [simhash(x or b"", size) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(common.comparable_id(docs), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _bit_statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, and the number of fingerprints: 4,096 sums, gathered per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False).astype(">i8"))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        k = np.arange(BITS * BITS + 1)
        yield pa.record_batch([pa.array(k), pa.array([*both.ravel().astype(np.int64), n])], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for r in rows:
        sums[r["k"]] = r["n"]
    return sums[:-1].reshape(BITS, BITS), int(sums[-1])


def group_bits(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Partitions of nearly equal width, each around the most correlated bits that are left."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, found = list(range(BITS)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        own = [max(left, key=lambda i: (tie[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda i: (tie[i, own].sum(), -i)))
            left.remove(own[-1])
        found.append(sorted(own))
    return found


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds with the given sum and the least summed cost, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picked) in best.items():
            for t, x in cost.items():
                if s + t not in after or c + x < after[s + t][0]:
                    after[s + t] = (c + x, [*picked, t])
        best = after
    return best[total][1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def plan(fps: DataFrame, groups: int = PARTITIONS, radius: int = MAX_DIFFERENT_BITS) -> list[tuple[list[int], int]]:
    """[(bits of a partition, its threshold)]: thresholds sum to radius - groups + 1, so any pair within
    ``radius`` is within the threshold in one partition at least. -1 leaves a partition out."""
    both, n = _bit_statistics(fps)
    parts = group_bits(both, n, groups)
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_signed(sum(1 << b for b in bits))).alias("key")) for i, bits in enumerate(parts)))
    sizes = fps.select(F.explode(keys).alias("x")).groupBy("x.part", "x.key").agg(F.count("*").alias("n"))
    cost = F.when(F.col("n") > BUCKET_PAIRS, F.col("n") * (BITS + 1)).otherwise(F.col("n") * F.col("n"))
    met = {r["part"]: float(r["c"]) for r in sizes.groupBy("part").agg(F.sum(cost.cast("double")).alias("c")).collect()}
    p = np.clip(np.diag(both) / max(n, 1), 0.01, 0.99)
    same = p * p + (1 - p) * (1 - p)
    costs = []
    for i, bits in enumerate(parts):
        odds = ((1 - same) / same)[bits]
        one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
        w = len(bits)
        costs.append({-1: 0.0, 0: n + met.get(i, 0), 1: n * (1 + w) + met.get(i, 0) * (1 + one), 2: n * (1 + w + w * (w - 1) / 2) + met.get(i, 0) * (1 + one + two)})
    return list(zip(parts, allocate(costs, radius - groups + 1), strict=True))


def _variants(bits: list[int], radius: int) -> list[int]:
    """Masks of up to ``radius`` of these bits."""
    masks = [0]
    if radius >= 1:
        masks += [1 << b for b in bits]
    if radius >= 2:
        masks += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    return [_signed(m) for m in masks]


def links(fps: DataFrame, groups: int = PARTITIONS, radius: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """(u, v): edges that connect all distinct fingerprints within ``radius`` bits, directly or through others.

    ``fps`` holds distinct values. A bucket of more than BUCKET_PAIRS fingerprints is not paired:
    its members and probes all send out their 65 variants of at most one flipped bit. Two
    fingerprints share a variant exactly if they are within two bits, and no variant has more than
    65 senders, so such a bucket costs rows in proportion to its size and loses no link.
    """
    if radius != 2:
        raise ValueError("the one-bit variants of large buckets are exact for a radius of 2")
    _, probed, hot, pairs = _met(fps, groups, radius)
    if hot.isEmpty():
        return pairs
    near_hot = probed.join(hot, ["part", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct()
    flips = F.array(*(F.lit(_signed(m)) for m in [0, *(1 << b for b in range(BITS))]))
    sent = common.stored(near_hot.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant")), "variants")
    first = sent.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("variant", "low")
    return pairs.unionByName(sent.join(first, "variant").filter("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct())


def candidates(fps: DataFrame, groups: int = PARTITIONS, radius: int = MAX_DIFFERENT_BITS) -> DataFrame:
    """(u, v): the pairs of distinct fingerprints within ``radius`` bits, for radii of up to 3 * groups - 1.

    In a bucket of more than BUCKET_PAIRS fingerprints each probe meets the bucket's smallest one alone,
    so a caller that wants all links has to find those of such buckets in another exact way.
    """
    index, probed, hot, pairs = _met(fps, groups, radius)
    if hot.isEmpty():
        return pairs
    heads = index.join(hot, ["part", "key"], "left_semi").groupBy("part", "key").agg(F.min("fp").alias("fp"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe")))
    crowded = probed.join(heads, ["part", "key"]).filter((F.col("probe") != F.col("fp")) & (apart <= radius))
    return pairs.unionByName(crowded.select(F.col("probe").alias("u"), F.col("fp").alias("v")))


def _met(fps: DataFrame, groups: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, probes, large buckets, verified pairs of all other buckets) under the plan for this radius."""
    probes, index = [], []
    for i, (bits, threshold) in enumerate(plan(fps, groups, radius)):
        key = F.col("fp").bitwiseAND(_signed(sum(1 << b for b in bits)))
        if threshold >= 0:
            index.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
            probes += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(m).alias("key")) for m in _variants(bits, threshold)]
    index = common.stored(fps.select("fp", F.explode(F.array(*index)).alias("x")).select("fp", "x.part", "x.key"), "index")
    probed = fps.select(F.col("fp").alias("probe"), F.explode(F.array(*probes)).alias("x")).select("probe", "x.part", "x.key")
    hot = common.stored(index.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_PAIRS).select("part", "key"), "hot")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe")))
    pairs = (
        probed.join(hot, ["part", "key"], "left_anti").alias("p")
        .join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & (F.col("probe") != F.col("fp")) & (apart <= radius))
        .select(F.col("probe").alias("u"), F.col("fp").alias("v"))
    )
    return index, probed, hot, pairs


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints at two or fewer differing bits.
    Null or empty texts have fingerprint 0 and link like any other; rows with a null doc_id take part
    but never name a component (theirs is null if no other row is reachable); repeated rows and ties
    share a component; an empty table gives no rows; other columns are not read.
    """
    rows = common.stored(fingerprints(docs, size), "fingerprints")
    classes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = common.connected_components(links(classes.select("fp")))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = common.stored(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents with one of each group that ``find`` tells by component_id: the one with the smallest doc_id.

    Rows are told apart by doc_id and a checksum of the text, so a text that is nobody's copy stays even if
    other rows share its doc_id; of a group's rows with the smallest doc_id the one with the smallest checksum
    stays, and of rows equal in both one stays. Rows with a null doc_id stay, for nothing could name the
    ones to go. Other columns pass through, whatever their names.
    """
    copy = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("check"))
    rows = docs.select(common.whole_row(docs), F.when(F.col("doc_id").isNotNull(), copy).alias("copy"))
    found = common.stored(find(docs.filter("doc_id is not null").select(copy.alias("doc_id"), "text")), "near")
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    left = rows.join(kept, F.col("copy") == F.col("kept"), "left_semi")
    if not found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["copy"])
    left = left.unionByName(rows.filter("copy is null"))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

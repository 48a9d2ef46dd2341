"""Near copies by word shingles: SimHash probes and MinHash bands propose pairs, the shingle sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
#: Two sets at Jaccard similarity 0.8 share a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99995.
BANDS, ROWS = 25, 5
#: Bits in which the fingerprints of two sets may differ for SimHash to propose the pair; each of three partitions takes one flip.
RADIUS = 5
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 4096

_RANDOM = np.random.default_rng(5)
_MASKS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, an empty one none."""
    words = data.lower().split()
    if len(words) < size:
        words, size = [b" ".join(words)] if words else [], 1
    rows = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, rows, repeat(42))), dtype=">u8").astype(np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One hash for each band of the set's least values under BANDS * ROWS orders."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(low, ((found[at : at + CHUNK] ^ _MASKS) * _FACTORS).min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), seed=k) for k, x in enumerate(low.reshape(BANDS, ROWS))] if len(found) else []
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _set_id(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes())], dtype=np.uint64).view(np.int64)[0])


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))


def signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, set_id, n, fp, keys) for every row: its shingle set's hash, size, SimHash fingerprint and bands."""
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        for b in batches:
            ids, n, fps, keys = [], [], [], []
            for x in b.column(1).cast(pa.binary()):
                found = shingles(x.as_py() or b"", size)
                ids.append(_set_id(found))
                n.append(len(found))
                fps.append(simhash.of_hashes(found))
                keys.append(band_keys(found))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), _lists(keys)], names=["doc_id", "set_id", "n", "fp", "keys"])

    rows = docs.select(common.comparable_id(docs), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, set_id long, n long, fp long, keys array<long>")


def shingle_sets(texts: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(set_id, found) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x.as_py() or b"", size) for x in b.column(0).cast(pa.binary())]
            yield pa.record_batch([pa.array(map(_set_id, found), pa.int64()), _lists([x.view(np.int64) for x in found])], names=["set_id", "found"])

    return texts.select("text").mapInArrow(run, "set_id long, found array<long>")


def _may_meet(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= least


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of ``least`` or more."""
    held = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("found").alias("a")), "u")
    held = held.join(sets.select(F.col("set_id").alias("v"), F.col("found").alias("b")), "v")
    # J = both / (sum - both), so J >= t means both >= sum * t / (1 + t)
    needed = F.ceil((F.size("a") + F.size("b")) * (least / (1 + least)) - 1e-6)
    return held.filter(F.size(F.array_intersect("a", "b")) >= needed).select("u", "v")


def _prefix_pairs(sets: DataFrame, left: DataFrame, least: float) -> DataFrame:
    """(u, v): the pairs of ``left`` (set_id, n, root) with different roots that may reach the similarity.

    Prefix filtering: with every set's shingles in one order, rarest first, two sets as similar as that
    share a shingle within the first few of both, and must have enough left after it. So sets that differ
    in rare shingles never meet, whatever bands they share, and no pair that counts is passed over.
    """
    tokens = left.join(sets, "set_id").select("set_id", "root", "n", F.explode("found").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    in_order = Window.partitionBy("set_id").orderBy("often", "token")
    ranked = tokens.join(often, "token").withColumn("at", F.row_number().over(in_order) - 1).filter("often > 1")
    room = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9)
    probes = common.stored(ranked.filter(F.col("at") <= room(least)).drop("often"), "prefixes")
    index = probes.filter(F.col("at") <= room(2 * least / (1 + least)))
    other = index.select("token", F.col("set_id").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("m"), F.col("at").alias("at_y"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("y") < F.col("set_id")))
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at_y")) >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-6
    near = (probes["token"] == other["token"]) & smaller & (F.col("m") >= F.col("n") * least - 1e-9) & (F.col("root") != F.col("root_y")) & enough
    return probes.join(other, near).select(F.col("set_id").alias("x"), "y")


def fingerprint_pairs(classes: DataFrame, radius: int, least: float) -> DataFrame:
    """(x, y): sets whose fingerprints differ in ``radius`` bits at most and whose sizes may reach the similarity.

    Of the sets with one fingerprint each meets the first of them, which alone meets those of other fingerprints.
    """
    firsts = classes.groupBy("fp").agg(F.min(F.struct("set_id", "n")).alias("first")).select("fp", F.col("first.set_id").alias("y"), F.col("first.n").alias("m"))
    firsts = common.stored(firsts, "firsts")
    same = classes.join(firsts, "fp").filter("set_id <> y").select(F.col("set_id").alias("x"), "n", "y", "m")
    near = simhash.candidates(firsts.select("fp"), radius=radius)
    near = near.join(firsts.select(F.col("fp").alias("u"), F.col("y").alias("x"), F.col("m").alias("n")), "u")
    near = near.join(firsts.withColumnRenamed("fp", "v"), "v").select("x", "n", "y", "m")
    return same.unionByName(near).filter(_may_meet(F.col("n"), F.col("m"), least)).select("x", "y")


def links(docs: DataFrame, classes: DataFrame, size: int, least: float) -> DataFrame:
    """(u, v): verified edges that connect all sets whose fingerprints or bands meet, directly or through others.

    ``classes`` holds one row a set. SimHash proposes the sets within ``RADIUS`` bits. A similarity of 0.8
    is about ten bits, so the rest is left to MinHash: each bucket's members are compared to one of them,
    another in each bucket; then the members that are not connected yet are joined by their rarest shingles.
    So a large group of near copies costs rows in proportion to its size, and no pair is passed over.
    """
    members = classes.select("set_id", "n", F.explode("keys").alias("key")).withColumn("turn", F.xxhash64("set_id", "key"))
    buckets = members.groupBy("key").agg(F.min("turn").alias("first"), F.count("*").alias("held")).filter("held > 1")
    shared = common.stored(members.join(buckets.select("key", "first"), "key"), "shared")
    probed = common.stored(fingerprint_pairs(classes, RADIUS, least), "probed")
    taking_part = shared.select("set_id").unionByName(probed.select(F.explode(F.array("x", "y")).alias("set_id")))
    wanted = common.stored(taking_part.distinct(), "wanted")
    ids = classes.join(wanted, "set_id", "left_semi").select("first_id").distinct()
    texts = docs.select(common.comparable_id(docs), "text")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["first_id"]), "left_semi")
    sets = shingle_sets(texts, size).join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])
    sets = common.stored(sets, "sets")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()

    heads = shared.filter("turn = first").select("key", F.col("set_id").alias("y"), F.col("n").alias("m"))
    star = shared.filter("turn <> first").join(heads, "key").filter(_may_meet(F.col("n"), F.col("m"), least))
    star = common.stored(ordered(star.select(F.col("set_id").alias("x"), "y").unionByName(probed)), "star")
    found = common.stored(similar(star, sets, least), "near")
    roots = common.connected_components(found)
    placed = shared.join(roots, shared["set_id"] == roots["node"], "left").select("key", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
    placed = common.stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    left = common.stored(placed.join(mixed, "key", "left_semi").select("set_id", "n", "root").distinct(), "left")
    apart = ordered(_prefix_pairs(sets, left, least)).join(star, ["u", "v"], "left_anti")
    return found.unionByName(similar(common.stored(apart, "apart"), sets, least))


def near_copies(docs: DataFrame, size: int = SHINGLE_WORDS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over texts whose sets of word shingles have a
    Jaccard similarity of ``least`` or more. Null and empty texts have the empty set and are copies
    of each other; rows with a null doc_id take part but never name a component.
    """
    rows = common.stored(signatures(docs, size), "signatures")
    classes = common.stored(rows.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
    roots = common.connected_components(links(docs, classes, size, least))
    placed = classes.join(roots, classes["set_id"] == roots["node"], "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    placed = common.stored(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("set_id", "component_id")
    return rows.join(named, "set_id").select("doc_id", "component_id")

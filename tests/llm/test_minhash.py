"""The pipeline's near-duplicate stage against brute force on 5-word shingles."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tidewatch.llm import common, minhash, simhash


def words_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, root = list(map(grams, texts)), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_edited_copies_go(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        first = words_of(rng, 200)
        texts.append(" ".join(first))
        for edits in (0, 1, 2, 3, 4, 8):
            words = list(first)
            for at in rng.sample(range(200), edits):
                words[at] = "edited"
            texts.append(" ".join(words))
    # one large group of near copies, each differing from the others
    common = words_of(rng, 120)
    texts += [" ".join([*common, *words_of(rng, 12)]) for _ in range(150)] + ["", "", "short text", "Short  text"]
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs).collect()}
    assert [found[k] for k in range(len(texts))] == want
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == set(want) and len(left) < len(texts)


def test_large_group_of_edited_copies(spark):
    """Copies of one text, edited more and more: all that are similar enough meet, and few pairs are looked at."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(80, 1 + i % 6, replace=False):
            words[at] = f"e{rng.integers(0, 12)}x{at}"
        texts.append(" ".join(words))
    sets = [frozenset(minhash.shingles(t.encode()).tolist()) for t in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        after = [min([low[j] for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]) for i in range(len(texts))]
        if after == low:
            break
        low = after
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs).collect()} == dict(enumerate(low))


def test_fingerprint_candidates_match_all_pairs(spark):
    """Every pair within five bits is found; in a bucket with too many members each meets one of them."""
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 120)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)) for f in fps for _ in range(2)]
    frame = lambda found: spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in found], "fp long")
    pairs = lambda found: {frozenset(x & (1 << 64) - 1 for x in r) for r in simhash.candidates(frame(found), radius=5).collect()}
    fps = sorted(set(fps))
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 5}
    assert want and pairs(fps) == want
    crowd = sorted({fps[0] ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(400)})
    found = pairs(crowd)
    assert set().union(*found) == set(crowd) and all(sum((x ^ y).bit_count() for x, y in [p]) <= 5 for p in found)


def test_fingerprints_propose_near_copies(spark):
    """Without any band the near copies that SimHash tells are linked, and texts below the similarity are not."""
    rng = random.Random(9)
    texts = []
    for _ in range(15):
        first = words_of(rng, 400)
        texts += [" ".join(first), " ".join([*first[:-1], "edited"]), " ".join([*first, *words_of(rng, 3)]), " ".join(first[:300])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    bare = minhash.signatures(docs).withColumn("keys", F.expr("cast(array() as array<long>)"))
    classes = common.stored(bare.withColumnRenamed("doc_id", "first_id"), "bare")
    of_set = {r["set_id"]: r["first_id"] for r in classes.collect()}
    roots = common.connected_components(minhash.links(docs, classes, 5, 0.8)).collect()
    linked = {}
    for r in roots:
        linked.setdefault(r["root"], set()).add(of_set[r["node"]])
    assert sorted(map(sorted, linked.values())) == [[k, k + 1, k + 2] for k in range(0, 60, 4)]

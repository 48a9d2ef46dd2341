"""Spelling variants against all pairs, and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tidewatch.llm import variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    words = sorted(counts)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], len(near[w]), counts.get(form[w])


def corpus(seed=3, docs=120):
    rng = random.Random(seed)
    stems = ["anden", "reling", "straße", "éléments", "naïves", "abcabc", "bcabca", "ÀÉÎõü", "mmmmm", "theronin", "roninthe", "Schätze"]
    stems += ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    for i in range(docs):
        words = []
        for _ in range(120):
            w = rng.choice(stems[: rng.choice([5, 20, len(stems)])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.title() if w.isascii() else w]))
        yield i, rng.choice([" ", "-", "\n", "1", "€"]).join(words)
    yield from [(900, None), (901, ""), (902, "12 345"), (903, "anden" * 20_000), (904, "anden anden Αθήνα"), (904, "anden anden Αθήνα"), (None, "anden reling " * 4), (905, "wordİs " * 5)]


def test_query_matches_all_pairs(spark, tmp_path):
    rows = list(corpus())
    spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, word string, n string, signature string").write.parquet(str(tmp_path / "documents.parquet"))
    found = variants.query(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = list(plain_groups(plain_counts(rows)))
    assert len(wanted) > 400 and sum(r[1] is not None for r in wanted) > 100 and any(r[1] not in (None, r[2]) for r in wanted)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_counts_without_lost_letters(spark):
    docs = spark.createDataFrame([(1, "Reling reling RELING ÉTÉES étées étées nahen"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in variants.word_counts(docs).collect()} == {("reling", 3)}
    assert {tuple(r) for r in variants.word_counts(docs, min_count=1).collect()} == {("reling", 3), ("étées", 2), ("ÉtÉes", 1), ("nahen", 1)}


def test_neighbours_share_a_signature():
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("abcdefgé") for _ in range(rng.randint(5, 12)))
        k = rng.randrange(len(w) + 1)
        v = rng.choice([w[:k] + rng.choice("abxé") + w[k:], w[:k] + rng.choice("abxé") + w[k + 1 :]])
        if one_apart(w, v) and len(v) >= 5:
            a, b = variants.signatures([w, v])
            assert np.intersect1d(a, b).size, (w, v)


def test_forms_lead_to_a_root(spark):
    words = spark.createDataFrame([("aaaaa", 1), ("aaaab", 2), ("aaabb", 4), ("aabbb", 8), ("abbbb", 16), ("zzzzz", 5)], "word string, n long")
    found = {r["word"]: r for r in variants.group_variants(words).collect()}
    assert {w: r["root"] for w, r in found.items()} == {**dict.fromkeys(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"], "abbbb"), "zzzzz": "zzzzz"}
    assert found["aaaaa"]["form"] == "aaaab" and found["abbbb"]["form"] is None and found["zzzzz"]["n_near"] == 0
    assert variants.group_variants(words.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variants.group_variants(words, ratio=1)

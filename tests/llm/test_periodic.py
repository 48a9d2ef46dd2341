"""Runs of words against a definition that tries every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewatch.llm import periodic


def plain_runs(words, min_words=24, min_periods=3):
    n, spans = len(words), {}
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_words, min_periods * p):
                spans.setdefault((i, j + p), p)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in spans.items())


def plain_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for s, length, p in found:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def numbered(words):
    return periodic.word_numbers([str(w).encode() for w in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(4, 12), st.integers(2, 4))
def test_runs_of_few_words(words, min_words, min_periods):
    assert periodic.runs(numbered(words), min_words, min_periods) == plain_runs(words, min_words, min_periods)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repeated_pieces(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 400:
        piece = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 25))]
        words += piece * rng.choice([1, 1, 2, 3, 5, 9]) + piece[: rng.randrange(len(piece) + 1)]
    assert periodic.runs(numbered(words)) == plain_runs(words)


def test_long_texts_cost_little():
    assert periodic.runs(numbered(["a"] * 300_000)) == [(0, 300_000, 1)]
    assert periodic.runs(numbered(["a", "b", "c"] * 70_000)) == [(0, 210_000, 3)]
    fibonacci = ["a"], ["a", "b"]
    for _ in range(20):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert len(periodic.runs(numbered(fibonacci[1]))) > 1000
    assert periodic.runs(numbered(range(200_000))) == []


def test_bounds():
    with pytest.raises(ValueError):
        periodic.runs(numbered("abc"), min_periods=1)
    assert periodic.runs(numbered("ab" * 11 + "a")) == []
    assert periodic.runs(numbered("ab" * 12)) == [(0, 24, 2)]
    assert np.array_equal(np.flatnonzero(periodic.kept_words(30, [(2, 24, 2), (20, 6, 2)])), [0, 1, 2, 3, 26, 27, 28, 29])


def texts():
    rng = random.Random(5)
    for i in range(300):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 5, 60, 200]))]
        if i % 3 == 0:
            piece = [f"x{rng.randrange(5)}" for _ in range(rng.randint(1, 9))]
            words += piece * rng.randint(2, 12) + words[:5]
        yield i, rng.choice([" ", "\n", " \t "]).join(words)
    yield from [(900, None), (901, ""), (902, " \n"), (903, "é\x00 \x85a b " * 30), (904, "same " * 30), (904, "same " * 30), (None, "no id " * 20)]


def test_query_matches_definition(spark, tmp_path):
    rows = list(texts())
    spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, runs string, best string").write.parquet(str(tmp_path / "documents.parquet"))
    found = periodic.query(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((plain_row(i, t) for i, t in rows), key=key)


def test_find_runs_collapses(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end"), (2, None), (None, "x")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(1, 30, 3)] and found[1]["collapsed"] == "start a b c end" and found[1]["n_words"] == 32
    assert (found[2]["runs"], found[2]["collapsed"], found[2]["n_words"]) == ([], "", 0) and found[None]["collapsed"] == "x"
    assert periodic.find_runs(docs.limit(0)).collect() == []

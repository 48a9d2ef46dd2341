"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a document's word sequence are united by decreasing length of their common prefixes, with
union-find over ordered sets of positions. Two positions that become neighbours in a united set, at a
distance within the common prefix's length, seed a run with that distance as period. Documents are worked
on one by one in their own tasks: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has at least so many words, and at least so many of its periods.
MIN_WORDS, MIN_PERIODS = 24, 3

Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The same number for the same word."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _ranks(numbers: np.ndarray, shared: int) -> list[np.ndarray] | None:
    """Ranks of the suffixes by their first 1, 2, 4, ... words until all differ; None as soon as no two suffixes share ``shared`` words."""
    n = len(numbers)
    ranks, width = [np.unique(numbers, return_inverse=True)[1].astype(np.int32)], 1
    while True:
        last = ranks[-1]
        distinct = int(last.max()) + 1
        if distinct == n:
            return ranks if width > shared else None
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = last[width:]
        ranks.append(np.unique(last.astype(np.int64) * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int32))
        width *= 2


def common_prefixes(numbers: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, words in common) for suffixes that follow each other in order and share at least ``shared`` words."""
    ranks = _ranks(numbers, shared)
    if ranks is None:
        return (np.empty(0, np.int64),) * 3
    n, order = len(numbers), np.argsort(ranks[-1])
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 2, -1, -1):  # suffixes of one rank share 2 ** level words
        rank = ranks[level]
        a, b = left + lcp, right + lcp
        inside = (a < n) & (b < n)
        inside[inside] = rank[a[inside]] == rank[b[inside]]
        lcp[inside] += 1 << level
    enough = lcp >= shared
    return left[enough], right[enough], lcp[enough]


def runs(numbers: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[Run]:
    """(start, length, period) of every run, by start, then period.

    The two first periods of a run begin at positions whose suffixes share the run but for one period, so
    only common prefixes of at least (periods - 1) x period words count. Among positions that share so
    much no other lies between these two, for it would make a shorter period; so they are neighbours as
    soon as they are in one set.
    """
    if min_periods < 2:
        raise ValueError("a run has at least two periods")
    if len(numbers) < min_words:
        return []
    # length - period is at least both min_words - period and (periods - 1) x period
    shared = -(-min_words * (min_periods - 1) // min_periods)
    left, right, lcp = common_prefixes(numbers, shared)
    if not len(lcp):
        return []
    up: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    shortest: dict[tuple[int, int], int] = {}

    def seed(i: int, j: int, length: int) -> None:
        period = j - i
        if (min_periods - 1) * period <= length and period + length >= min_words and (i == 0 or numbers[i - 1] != numbers[j - 1]):
            key = (i, j + length)
            shortest[key] = min(shortest.get(key, period), period)

    by_length = np.argsort(-lcp, kind="stable")
    for a, b, length in zip(left[by_length].tolist(), right[by_length].tolist(), lcp[by_length].tolist(), strict=True):
        for x in (a, b):
            if x not in up:
                up[x], members[x] = x, [x]
        a, b = find(a), find(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        up[b], large, last = a, members[a], -1
        for x in members.pop(b):
            at = bisect_left(large, x)
            if at and large[at - 1] != last:  # its neighbour from the same set was one before
                seed(large[at - 1], x, length)
            if at < len(large):
                seed(x, large[at], length)
            large.insert(at, x)
            last = x
    return sorted((s, e - s, p) for (s, e), p in shortest.items())


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # of bytes: at \x20 and \x09-\x0D


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document's words, by checksum, with a periodic tail; a null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())]
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _described(docs: DataFrame, rewrite: bool, min_words: int, min_periods: int, hashed: bool) -> DataFrame:
    common.short_batches(docs.sparkSession)

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = _words(text)
        if rewrite:
            words = rewritten(words, doc_id)
        found = runs(word_numbers(words), min_words, min_periods) if len(words) >= min_words else []
        kept = words if not found else [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
        text_left = b" ".join(kept)
        out = hashlib.sha256(text_left).hexdigest().encode() if hashed else text_left
        return doc_id, len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        for b in batches:
            rows = [row(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
            yield pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], names=[name for name, _ in _FIELDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed (the text with each run cut to its first period, words joined by one space).

    Words are what lies between blanks, tabs and line ends. A null or empty text has no words and no run;
    a very long one takes memory in proportion to its words times the logarithm of their number; repeated
    rows get equal results; runs may overlap and all are listed; an empty table gives no rows; a null
    doc_id stays null; other columns are not read.
    """
    found = _described(docs, False, min_words, min_periods, False)
    return found.select("doc_id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which (by checksum of the id) get a periodic tail first."""
    found = _described(common.read_table(spark, sf_dir, "documents"), True, MIN_WORDS, MIN_PERIODS, True)
    line = lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))
    # the first in order wins unless a later one has a greater length / period, compared as whole numbers
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    first = F.element_at("runs", F.when(F.size("runs") > 0, 1))
    best = F.aggregate("runs", first, lambda acc, x: F.when(greater(x, acc), x).otherwise(acc))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").cast("string").alias("collapsed_sha256"),
    )

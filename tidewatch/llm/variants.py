"""Spelling variants by PartEnum signatures.

A word's letters form a set of (letter, occurrence) pairs, a binary vector. One inserted, deleted or replaced
letter changes at most two of its places. The places are dealt to PARTS parts; two vectors that differ in at
most two places agree on all but two parts, so a signature for each choice of parts left out, over all the
others, is shared by every such pair. As one changed letter also leaves either the two first or the two last
letters of both words alone, each signature is made twice, with the one and with the other. Words of one
signature meet by an equi-join and their edit distance decides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Latin-1 characters to themselves where they are letters of words, A-Z to a-z, all others to blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Distinct words after which a task hands its counts over.
TASK_WORDS = 200_000
#: Words have at least so many letters and occur so often.
MIN_LETTERS, MIN_COUNT = 5, 3
#: Parts of the places; two of them are left out in each signature.
PARTS = 5
DIFFERENT = 2
#: Letters at a word's ends that a signature holds as they stand.
ENDS = 2
#: A word's form occurs at least so many times as often as the word.
FORM_RATIO = 2


def _runs(text: str) -> list[bytes]:
    """The runs of letters, in Latin-1, which has all of them; other characters end a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _shortened(runs: list[bytes], doc_id: int | None, modulus: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(run, what is left of it, times in this document) where ``modulus`` divides the checksum of id and run."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    own = list(set(runs))
    coded = [run if run.isascii() else run.decode("latin-1").encode() for run in own]
    sums = np.fromiter(map(zlib.crc32, coded, repeat(prefix)), np.int64, len(own))
    hit = {own[i]: int(sums[i]) for i in np.flatnonzero(sums % modulus == 0)}
    if hit:
        for run, n in Counter(run for run in runs if run in hit).items():
            k = hit[run] % len(run)
            yield run, run[:k] + run[k + 1 :], n


def word_counts(docs: DataFrame, swap_modulus: int | None = None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased. Counts are added up in each task before they are shuffled.

    With ``swap_modulus`` a run whose checksum with its document's id it divides loses one letter first;
    a null id counts as an empty one.
    """
    common.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w, n in counts.items() if len(w) >= min_letters and n]
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    runs = _runs(text)
                    counts.update(runs)
                    for whole, left, n in _shortened(runs, doc_id, swap_modulus) if swap_modulus else ():
                        counts[whole] -= n
                        counts[left] += n
            if len(counts) > TASK_WORDS:
                yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


@cache
def _place(letter: str, occurrence: int) -> int:
    """64 bits for one place of the vector; their remainder tells its part."""
    return xxhash.xxh64_intdigest(f"{occurrence}{letter}")


@cache
def _end(side: str, letters: str) -> int:
    return xxhash.xxh64_intdigest(side + letters)


def signatures(words: list[str], parts: int = PARTS) -> np.ndarray:
    """A row of 64-bit signatures for each word: two words at edit distance one have one in common at least."""
    sums = np.zeros((len(words), parts), np.uint64)
    ends = np.zeros((len(words), 2), np.uint64)
    for row, word in enumerate(words):
        own, seen = [0] * parts, {}
        for letter in word:
            seen[letter] = occurrence = seen.get(letter, 0) + 1
            place = _place(letter, occurrence) if occurrence < 16 else xxhash.xxh64_intdigest(f"{occurrence}{letter}")
            own[place % parts] ^= place
        sums[row] = own
        ends[row] = _end("<", word[:ENDS]), _end(">", word[-ENDS:])
    whole = np.bitwise_xor.reduce(sums, axis=1)
    columns = []
    for i, gone in enumerate(combinations(range(parts), DIFFERENT)):
        kept = whole.copy()
        for k in gone:
            kept ^= sums[:, k]
        for side in range(2):
            columns.append((kept * np.uint64(0x9E3779B97F4A7C15) ^ ends[:, side]) + np.uint64(i * 2 + side))
    return np.stack(columns, axis=1).view(np.int64)


def _signed(words: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = signatures(b.column(0).to_pylist(), parts)
            times = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
            yield pa.record_batch([b.column(0).take(times), b.column(1).take(times), pa.array(found.ravel())], names=["word", "n", "signature"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, signature long")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, near, near_n: both directions of every pair at edit distance one. ``words`` has word (distinct) and n."""
    common.short_batches(words.sparkSession)
    signed = common.stored(_signed(words, parts), "signed")
    a, b = signed.alias("a"), signed.alias("b")
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    pairs = met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    ways = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of ``forms`` (word, form; no cycles): the last word on the way from form to form.

    Each round doubles the length of the ways; a form is FORM_RATIO times as frequent as its word, so a way has no
    more steps than the greatest count has binary digits.
    """
    ways = common.stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.alias("a").join(ways.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        ways = common.stored(further.select(F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, parts: int = PARTS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n; words distinct).

    A word's form is its most frequent word at edit distance one, the first in code-point order among
    equals, if that occurs ``ratio`` times as often (at least 2); root is where forms lead to, the word
    itself without a form. A word of any length may come in; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms could lead in circles")
    words = common.stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, parts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    both = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = both.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    formed = common.stored(formed, "formed")
    return formed.join(roots(formed.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, swap_modulus: int | None = None) -> DataFrame:
    """:func:`group_variants` of the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; very long texts and words are taken whole; repeated rows count
    as often as they stand; ties go by code points; an empty table gives no rows; other columns are not read.
    """
    return group_variants(word_counts(docs, swap_modulus))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words, some of which lose a letter first, by checksum."""
    found = spelling_variants(common.read_table(spark, sf_dir, "documents"), 97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")

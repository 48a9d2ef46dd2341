"""Language identification with a linear-chain conditional random field over words.

Every word gets affix, character n-gram and lexicon features; learned transitions link neighbouring
words; forward-backward gives each word's language posteriors, so code-switched text is labelled word
by word. A document's language is the one with the largest mean posterior over its words.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
HASH_BITS = 15
#: Bounds of the labelled sample that the model is fitted on: documents of a language and of all, characters of
#: a document (a window of a longer one, at a place that follows from its id) and of all.
SAMPLE_DOCS_PER_LANG, SAMPLE_DOCS = 200, 20_000
SAMPLE_MAX_CHARS, SAMPLE_CHARS = 20_000, 20_000_000
#: Languages that the model can tell apart; of more, the most frequent are learned, with a warning.
MAX_LANGS = 250
#: Words whose scores a worker keeps, and these times labels; the table starts afresh when full.
CACHE_WORDS, CACHE_CELLS = 250_000, 4_000_000
#: Words that go through forward-backward at a time, and these times labels; a longer document goes alone, in windows.
BLOCK_WORDS, BLOCK_CELLS = 200_000, 1_000_000


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # (2 ** HASH_BITS, labels)
    transitions: np.ndarray  # (labels, labels), from row to column
    lexicon: dict[str, int]  # word: label in whose sample it is typical


def words_of(text: str | None) -> list[str]:
    """Lower-case words that hold a letter (the pattern also matches numerals such as a superscript two)."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a lower-case word."""
    mask, crc = (1 << HASH_BITS) - 1, zlib.crc32
    b = word.encode("utf-8", "replace")
    own = [crc(b, 1) & mask]
    own += [crc(word[:k].encode("utf-8", "replace"), 2) & mask for k in (1, 2, 3)]
    own += [crc(word[-k:].encode("utf-8", "replace"), 3) & mask for k in (1, 2, 3)]
    framed = b"^" + b + b"$"
    own += [crc(framed[i : i + 3], 4) & mask for i in range(len(framed) - 2)]
    if word in lexicon:
        own.append(crc(b"%d" % lexicon[word], 5) & mask)
    return own


def emissions(words: list[str], model: Model) -> np.ndarray:
    """(words, labels): summed feature weights, divided by the root of the number of features."""
    lists = [features(w, model.lexicon) for w in words]
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum()))
    sums = np.add.reduceat(model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    return sums / np.sqrt(sizes)[:, None]


def posteriors(scores: np.ndarray, transitions: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a block of sequences.

    scores: (steps, sequences, labels) with the longest sequence first; active: sequences that reach
    each step. Returns (marginals of the same shape, expected transition counts).
    """
    steps, _, k = scores.shape
    step_max = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - step_max)
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    now = e[0] / e[0].sum(axis=1, keepdims=True)
    alpha[0] = now
    for t in range(1, steps):
        n = active[t]
        now = (now[:n] @ move) * e[t, :n]
        now /= now.sum(axis=1, keepdims=True)
        alpha[t, :n] = now
    back = np.full((0, k), 1.0 / k)
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if t + 1 < steps and len(back):
            ahead = e[t + 1, : len(back)] * back
            joint = alpha[t, : len(back)].T @ (ahead / np.einsum("ni,ij,nj->n", alpha[t, : len(back)], move, ahead)[:, None])
            pairs += joint * move
            back = ahead @ move.T
            back /= back.sum(axis=1, keepdims=True)
        if len(back) < n:
            back = np.concatenate([back, np.full((n - len(back), k), 1.0 / k)])
        beta[t, :n] = back
    both = alpha * beta
    total = both.sum(axis=2, keepdims=True)
    return both / np.where(total > 0, total, 1), pairs


def fit(samples: list[tuple[str, str]], epochs: int = 4, seed: int = 7, steps: int = 64, width: int = 48) -> Model:
    """Fit on (lang, text) pairs, a bounded list, with AdaGrad on the conditional likelihood.

    Chunks of one to some forty words of different documents are strung together, so that the
    transitions see switches of language.
    """
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in samples})
    place = {x: i for i, x in enumerate(labels)}
    docs = [(place[lang], w) for lang, text in samples if (w := words_of(text))]
    counts = [Counter() for _ in labels]
    for y, words in docs:
        counts[y].update(words)
    lexicon = {}
    for y, c in enumerate(counts):
        for w, n in c.items():
            if n >= 3 and n > 3 * max([0, *(o[w] for k, o in enumerate(counts) if k != y)]):
                lexicon[w] = y
    model = Model(labels, np.zeros((1 << HASH_BITS, len(labels))), np.zeros((len(labels), len(labels))), lexicon)
    if len(labels) < 2 or not docs:
        return model
    seen: dict[str, int] = {}
    ids = [(y, np.array([seen.setdefault(w, len(seen)) for w in words])) for y, words in docs]
    lists = [np.array(features(w, lexicon)) for w in seen]
    g2, t2 = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    active = np.full(steps, width)
    for epoch in range(epochs):
        chunks = []
        for y, x in ids:
            at = 0
            while at < len(x):
                n = int(rng.integers(1, 40))
                chunks.append((y, x[at : at + n]))
                at += n
        order = rng.permutation(len(chunks))
        stream = np.concatenate([chunks[i][1] for i in order])
        truth = np.concatenate([np.full(len(chunks[i][1]), chunks[i][0]) for i in order])
        size = steps * width
        for at in range(0, max(len(stream) - size, 0) + 1, size):
            s, y = np.resize(stream[at : at + size], size), np.resize(truth[at : at + size], size)
            own, back = np.unique(s, return_inverse=True)
            sizes = np.array([len(lists[i]) for i in own])
            flat = np.concatenate([lists[i] for i in own])
            scale = 1 / np.sqrt(sizes)
            scores = np.add.reduceat(model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) * scale[:, None]
            grid = scores[back].reshape(width, steps, -1).transpose(1, 0, 2)
            marginal, pairs = posteriors(grid, model.transitions, active)
            grad = -marginal.transpose(1, 0, 2).reshape(size, -1)
            grad[np.arange(size), y] += 1
            word_grad = np.stack([np.bincount(back.ravel(), grad[:, k], len(own)) for k in range(len(labels))], axis=1) * scale[:, None]
            spread = np.repeat(word_grad, sizes, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, k], len(touched)) for k in range(len(labels))], axis=1)
            g -= 0.01 * model.weights[touched]
            g2[touched] += g * g
            model.weights[touched] += 0.3 * g / np.sqrt(g2[touched])
            yy = y.reshape(width, steps)
            told = np.zeros_like(pairs)
            np.add.at(told, (yy[:, :-1].ravel(), yy[:, 1:].ravel()), 1)
            t = (told - pairs) - 0.01 * model.transitions
            t2 += t * t
            model.transitions[:] += 0.3 * t / np.sqrt(t2)
    return model


class Labeller:
    """Labels documents with a model; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, np.zeros((0, len(model.labels)))
        self.known: dict[str, int] = {}
        k = max(1, len(model.labels))
        self.block, self.kept = max(1, min(BLOCK_WORDS, BLOCK_CELLS // k)), max(1, min(CACHE_WORDS, CACHE_CELLS // k))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        docs = [(i, words) for i, x in enumerate(texts) if (words := words_of(x))]
        docs.sort(key=lambda d: -len(d[1]))
        at = 0
        while at < len(docs):
            longest, end = len(docs[at][1]), at + 1
            while end < len(docs) and (end - at + 1) * longest <= self.block:
                end += 1
            for (i, _), share in zip(docs[at:end], self.shares([w for _, w in docs[at:end]]), strict=True):
                best = int(np.argmax(share))
                names[i], scores[i] = self.model.labels[best], float(min(1.0, max(0.0, share[best])))
            at = end
        return names, scores

    def _learn(self, words: Iterable[str]) -> None:
        """Scores of the words into the table."""
        if len(self.known) > self.kept:
            self.known, self.table = {}, np.zeros((0, len(self.model.labels)))
        fresh = list({w for w in words if w not in self.known})
        if fresh:
            self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
            step = max(1, self.block // 8)  # a word has some twenty features, each with a weight a label
            self.table = np.concatenate([self.table, *(emissions(fresh[i : i + step], self.model) for i in range(0, len(fresh), step))])

    def word_posteriors(self, docs: list[list[str]]) -> np.ndarray:
        """(steps, documents, labels) for documents in falling order of length."""
        self._learn(w for d in docs for w in d)
        sizes = np.array([len(d) for d in docs])
        grid = np.zeros((sizes[0], len(docs), len(self.model.labels)))
        get = self.known.__getitem__
        for j, d in enumerate(docs):
            grid[: len(d), j] = self.table[np.fromiter(map(get, d), dtype=np.int64, count=len(d))]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        return posteriors(grid, self.model.transitions, active)[0]

    def _odds(self, words: list[str]) -> np.ndarray:
        self._learn(words)
        scores = self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]
        return np.exp(scores - scores.max(axis=1, keepdims=True))

    def long_share(self, words: list[str]) -> np.ndarray:
        """The mean posterior of one document's words, whatever its length.

        Forward messages are kept where windows begin only, and each window's are made again on the way back, so
        memory holds one window; the result is that of forward-backward over the whole.
        """
        move = np.exp(self.model.transitions - self.model.transitions.max())
        starts = range(0, len(words), self.block)

        def forward(odds: np.ndarray, before: np.ndarray | None) -> np.ndarray:
            alpha = np.empty_like(odds)
            for t in range(len(odds)):
                now = odds[t] if before is None else (before @ move) * odds[t]
                alpha[t] = before = now / now.sum()
            return alpha

        entering: list[np.ndarray | None] = [None]
        for at in starts[:-1]:
            entering.append(forward(self._odds(words[at : at + self.block]), entering[-1])[-1])
        k = len(move)
        total, back = np.zeros(k), np.full(k, 1.0 / k)
        for at, before in zip(reversed(starts), reversed(entering), strict=True):
            odds = self._odds(words[at : at + self.block])
            alpha = forward(odds, before)
            for t in range(len(odds) - 1, -1, -1):
                both = alpha[t] * back
                total += both / both.sum()
                back = (odds[t] * back) @ move.T
                back /= back.sum()
        return total / len(words)

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        if len(docs[0]) > self.block:  # such a document comes alone
            return self.long_share(docs[0])[None, :]
        return self.word_posteriors(docs).sum(axis=0) / np.array([len(d) for d in docs])[:, None]


def training_rows(docs: DataFrame) -> Column:
    return (common.id_remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS_PER_LANG) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_lang`` training documents of each language, picked by a hash of the id.

    All languages are learned, up to MAX_LANGS; with many of them each gets fewer documents and shorter
    windows, so that the driver holds about SAMPLE_CHARS characters at most.
    """
    rows = docs.filter(training_rows(docs)).filter(F.length("text") > 0)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return []
    if len(sizes) > MAX_LANGS:
        warnings.warn(f"more than {MAX_LANGS} languages; only the most frequent are learned", stacklevel=2)
        sizes = dict(list(sizes.items())[:MAX_LANGS])
    per_lang = min(per_lang, SAMPLE_DOCS // len(sizes))
    window = min(SAMPLE_MAX_CHARS, SAMPLE_CHARS // (2 * per_lang * len(sizes)))
    mark = F.xxhash64(F.col("doc_id").cast("string"))
    draw = mark.bitwiseAND(0x7FFFFFFF) / F.lit(float(1 << 31))
    odds = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * per_lang / n))))
    spare = F.greatest(F.length("text") - window, F.lit(0)) + 1
    part = F.col("text").substr((F.pmod(F.shiftright(mark, 31), spare) + 1).cast("int"), F.lit(window))
    picked = rows.select("lang", part.alias("text"), draw.alias("draw")).filter(F.col("draw") < odds[F.col("lang")]).collect()
    by: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["draw"], r["text"])):
        by.setdefault(r["lang"], []).append((r["lang"], r["text"]))
    return [x for v in by.values() for x in v[:per_lang]]


def identify(docs: DataFrame, model: Model, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language of ``text`` and its mean word posterior.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the label that sorts
    first; repeated rows get equal results; a very long text is labelled alone, whole, in bounded memory; a model without
    labels calls everything ``und``; an empty table gives no rows; other columns pass through, and a
    clashing name gets an underscore.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    prediction, score = common.free_name(docs.columns, prediction), common.free_name(docs.columns, score)
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.transitions, model.lexicon))
    names = [*docs.columns, prediction, score]
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        model = Model(*shared.value)
        label = Labeller(model)
        for b in batches:
            texts = b.column(place).to_pylist()
            found, scores = label(texts) if model.labels else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.record_batch([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)
        del label
        common.give_back()

    schema = StructType([*docs.schema.fields, StructField(prediction, StringType()), StructField(score, DoubleType())])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)  # names there must not hold dots


def train(docs: DataFrame, per_lang: int = SAMPLE_DOCS_PER_LANG) -> Model:
    """Fit on a bounded sample of the rows that are not held out (crc32 of the id modulo 4 is not 2)."""
    return fit(labelled_sample(docs, per_lang))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told; null texts and texts without a letter go.

    Where no row is labelled there is nothing to tell, and every text with a letter stays.
    """
    model = train(docs)
    if not model.labels:
        return docs.filter(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    tagged = identify(docs, model)
    return tagged.filter(F.col(tagged.columns[-2]) != UNKNOWN).select(*common.plain(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (common.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def accuracy(found: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Share of right predictions among held-out documents, by language."""
    both = found.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy")).toPandas()

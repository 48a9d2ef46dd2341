"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a tree of contexts (the bytes before it), a
Krichevsky-Trofimov estimate in each node, and weights that mix the estimates of all depths. A text is
coded as one string: its words in lower case (A-Z), each with a blank after it, then one end; contexts
reach back over blanks into the words before.

What a text needs of the tree are its windows, a byte and the context before it. A block of documents
lists its distinct windows once, in buckets; equal windows of all blocks are summed, built into the tree
and scored once, and the lists get the scores back. Every context that stands before LEAST training bytes
is a node, so the tree grows with the corpus. It is dealt over tasks by the ROOT latest bytes of the
contexts; a task builds its subtrees from the leaves up, and the driver holds the nodes above them alone,
at most 257 contexts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEPTH, ROOT, LEAST = 6, 2, 2
#: Windows that a task's part of the tree is built from, about; windows scored at a time.
PART_ROWS, AT_ONCE = 150_000, 100_000
#: Bytes laid out at a time, so that a very long text needs little memory.
SLICE = 1 << 20
#: Bytes of text whose distinct words and windows are listed together (one longer document makes a block of its own).
BLOCK_BYTES = 48_000_000
#: Windows that a block gathers before it sums equal ones.
LISTED = 1_500_000
#: Windows are dealt by a hash of their first bytes, words by theirs, into so many buckets.
BUCKETS = 512
END = b"\n"
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
LOG_PI = float(np.log(np.pi))


# --- the model -----------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series at x + 7."""
    y = x + 7.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + k) for k in range(7))


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, 256) symbol counts to counts of 0 and 1 at each binary node (1 is the root; 0 is unused)."""
    zero, one = np.zeros_like(symbols), np.zeros_like(symbols)
    for b in range(8):
        halves = symbols.reshape(len(symbols), 1 << b, 2, 1 << (7 - b)).sum(axis=3)
        zero[:, 1 << b : 2 << b], one[:, 1 << b : 2 << b] = halves[:, :, 0], halves[:, :, 1]
    return zero, one


def log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log probability that the Krichevsky-Trofimov estimator gives to any sequence with these counts."""
    return lgamma(zero + 0.5) + lgamma(one + 0.5) - lgamma(zero + one + 1.0) - LOG_PI


BITS = np.arange(8)
BYTE = np.arange(256)
#: For each byte and each of its eight decisions: the binary node, and the bit that is coded there.
NODES = (1 << BITS)[None, :] | (BYTE[:, None] >> (8 - BITS)[None, :])
CODED = BYTE[:, None] >> (7 - BITS)[None, :] & 1


def chance(coded: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov estimate of a bit that was coded so often among ``total``."""
    return (coded + 0.5) / (total + 1.0)


@dataclass(frozen=True)
class Level:
    """The nodes of one depth: sorted codes (context and binary node), counts of both bits, those that no deeper node has, weights."""

    contexts: np.ndarray
    codes: np.ndarray
    counts: np.ndarray  # (2, codes)
    rest: np.ndarray  # (2, codes)
    weight: np.ndarray
    below: np.ndarray  # log of the weighted probability of what was coded here

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes


def _weighed(counts: np.ndarray, rest: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the node's own estimate, log weighted probability) where deeper nodes exist."""
    alone, split = log_kt(*counts), log_kt(*rest) + children
    both = np.logaddexp(alone, split) - np.log(2)
    return np.exp(alone - np.log(2) - both), both


def grow(keys: np.ndarray, n: np.ndarray, depth: int, least: int, root: int = ROOT) -> dict[int, Level]:
    """The subtrees below the contexts of ``root`` bytes, from distinct (context, symbol) keys with training counts."""
    seen = n > 0
    context, symbol, n = keys[seen] >> 8, keys[seen] & 255, n[seen].astype(float)
    code = (context[:, None] << 8 | NODES[symbol]).ravel()
    flat, where = np.unique(code, return_inverse=True)
    one = CODED[symbol].ravel() == 1
    times = np.repeat(n, 8)
    both = np.stack([np.bincount(where, times * ~one, len(flat)), np.bincount(where, times * one, len(flat))])
    own, node = flat >> 8, flat & 255
    levels: dict[int, Level] = {}
    deeper: Level | None = None
    for d in range(depth, root - 1, -1):
        mask = (1 << 8 * d) - 1
        long = own > mask >> 8  # contexts of d bytes or more
        held, where = np.unique(context[context > mask >> 8] & mask, return_inverse=True)
        total = np.bincount(where, n[context > mask >> 8], len(held))
        nodes = held[total >= least]
        at = np.minimum(np.searchsorted(nodes, own & mask), max(len(nodes) - 1, 0))
        long &= (nodes[at] == own & mask) if len(nodes) else False
        codes, where = np.unique((own[long] & mask) << 8 | node[long], return_inverse=True)
        counts = np.stack([np.bincount(where, both[k, long], len(codes)) for k in (0, 1)])
        rest, children = counts.copy(), np.zeros(len(codes))
        if deeper is not None and len(deeper.codes):
            up = np.searchsorted(codes, (deeper.codes >> 8 & mask) << 8 | deeper.codes & 255)
            rest -= np.stack([np.bincount(up, deeper.counts[k], len(codes)) for k in (0, 1)])
            children = np.bincount(up, deeper.below, len(codes))
        weight, below = _weighed(counts, rest, children) if d < depth else (np.ones(len(codes)), log_kt(*counts))
        deeper = levels[d] = Level(nodes, codes, counts, rest, weight, below)
    return levels


def roots_summed(levels: dict[int, Level], root: int = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """(code of the latest byte and binary node, sums of both counts and of the logs) over the contexts of ``root`` bytes."""
    top = levels[root]
    codes, where = np.unique((top.codes >> 8 & 255) << 8 | top.codes & 255, return_inverse=True)
    return codes, np.stack([np.bincount(where, x, len(codes)) for x in (*top.counts, top.below)])


@dataclass(frozen=True)
class Top:
    """The nodes of no context and of one byte, with (2, 256, 256) tables by coded bit, byte and binary node."""

    base: np.ndarray  # what the top adds to a chance from below
    scale: np.ndarray  # and the factor of that chance
    rest: np.ndarray  # the chance where the context has no node of ROOT bytes


def build_top(symbols: np.ndarray, sums: np.ndarray) -> Top:
    """From (byte, symbol) training counts and the roots' sums (3, byte, binary node): zeros, ones, logs."""
    counts = np.stack(bit_counts(symbols))
    rest = counts - sums[:2]
    known = symbols.sum(axis=1) > 0
    weight, below = _weighed(counts, rest, sums[2])
    whole = counts.sum(axis=1)
    first, _ = _weighed(whole, np.zeros_like(whole), below[known].sum(axis=0))
    own = np.where(known[None, :, None], chance(counts, counts.sum(axis=0)), 0.5)
    weight = np.where(known[:, None], weight, 1.0)
    start = first * chance(whole, whole.sum(axis=0))
    return Top(start[:, None, :] + (1 - first) * weight * own, np.broadcast_to((1 - first) * (1 - weight), own.shape), chance(rest, rest.sum(axis=0)))


def key_logs(keys: np.ndarray, levels: dict[int, Level], top: Top, depth: int, root: int = ROOT) -> np.ndarray:
    """log10 probability of each key's symbol after its context."""
    context, symbol = np.repeat(keys >> 8, 8), keys & 255
    node, bit = NODES[symbol].ravel(), CODED[symbol].ravel()
    latest = context & 255
    p = top.rest[bit, latest, node]
    started = np.zeros(len(context), dtype=bool)
    for d in range(depth, root - 1, -1):
        level, mask = levels[d], (1 << 8 * d) - 1
        if not len(level.contexts):
            continue
        cut = context & mask
        at = np.minimum(np.searchsorted(level.contexts, cut), len(level.contexts) - 1)
        inside = np.flatnonzero((level.contexts[at] == cut) & (context > mask >> 8))
        at, hit = level.find(cut[inside] << 8 | node[inside])
        b = bit[inside]
        own = np.where(hit, chance(level.counts[b, at], level.counts[:, at].sum(axis=0)), 0.5)
        if d == depth:
            p[inside] = own
        else:
            rest = np.where(hit, chance(level.rest[b, at], level.rest[:, at].sum(axis=0)), 0.5)
            w = np.where(hit, level.weight[at], 0.5)
            p[inside] = w * own + (1 - w) * np.where(started[inside], p[inside], rest)
        started[inside] = True
    p = top.base[bit, latest, node] + top.scale[bit, latest, node] * p
    return np.log10(p).reshape(-1, 8).sum(axis=1)


def windows(pieces: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context << 8 | byte, number of the piece) for the bytes of all pieces in a row, but each one's first, which is context alone.

    A zero byte counts as byte 1, for 0 means that a context reaches no further back.
    """
    sizes = np.array([len(x) for x in pieces]) + depth - 1
    data = b"".join([bytes(depth - 1) + x.replace(b"\0", b"\1") for x in pieces]) + bytes(8)
    every = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))  # the eight bytes from each place on
    coded = np.ones(len(data) - 8, dtype=bool)
    coded[(np.cumsum(sizes) - sizes)[:, None] + np.arange(depth)] = False
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    for at in range(0, len(coded), SLICE):
        place = np.flatnonzero(coded[at : at + SLICE]) + at
        yield (every[place - depth].astype(np.uint64) >> np.uint64(8 * (7 - depth))).astype(np.int64), piece[place]


def laid_out(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the coded bytes of all words, each as a text of its own: the byte, its context key, and each word's first place.

    A word is coded with the blank after it; the end of a text has none.
    """
    pieces = [b" " + w if w == END else b" " + w + b" " for w in words]
    key = np.concatenate([x for x, _ in windows(pieces, depth)])
    sizes = np.array([len(x) - 1 for x in pieces])
    return key & 255, key >> 8, np.cumsum(sizes) - sizes


def _piece(text: bytes) -> bytes:
    """What is coded of a text whose words are joined by blanks: after a blank, each word with its blank, and the end."""
    return b" " + text + b" " + END if text else b" " + END


# --- lists of windows ----------------------------------------------------------------------------


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of ``n`` for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n[order], first)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers with their bytes of equal weight side by side, which the shuffle's codec then shrinks."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 24).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % BUCKETS


# --- the tables ----------------------------------------------------------------------------------


def blocks(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds for each block of documents: some of its documents, with their texts as coded; and buckets of
    its distinct windows and words in order, with their training counts."""
    common.short_batches(docs.sparkSession)
    doc_type = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_())])
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(doc_type)), ("texts", pa.binary()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "n", "words", "train"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        part, nth, size = TaskContext.get().partitionId(), 0, 0
        counts: dict[bytes, int] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

        def rows(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": part << 32 | nth} | x for x in some], schema=schema)

        def listed() -> Iterator[pa.RecordBatch]:
            keys, n = merged()
            bucket = bucket_of(keys)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            dealt: list[list[bytes]] = [[] for _ in range(BUCKETS)]
            for w in sorted(counts):
                dealt[zlib.crc32(w) % BUCKETS].append(w)
            some = []
            for k, words in enumerate(dealt):
                own = order[ends[k] : ends[k + 1]]
                row = {"bucket": k}
                if len(own):
                    row |= {"keys": packed(np.diff(keys[own], prepend=0)), "n": packed(n[own])}
                if words:
                    row |= {"words": b" ".join(words), "train": packed(np.array([counts[w] for w in words]))}
                if len(row) > 1:
                    some.append(row)
            for at in range(0, len(some), 32):
                yield rows(some[at : at + 32])

        def taken(some: list[dict]) -> Iterator[pa.RecordBatch]:
            held = np.array([x["held_out"] for x in some])
            texts = [x.pop("text") for x in some]
            for key, owner in windows([_piece(x) for x in texts], depth):
                out = held[owner]
                found.append(np.unique(key[~out], return_counts=True))
                alone = np.unique(key[out])
                found.append((alone, np.zeros(len(alone), dtype=np.int64)))
            if sum(len(x) for x, _ in found[1:]) > LISTED:
                found[:] = [merged()]
            yield rows([{"docs": some, "texts": zstandard.compress(END.join(texts))}])

        for b in batches:
            some, some_bytes = [], 0
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = (data.as_py() or b"").lower().split()  # for bytes: A-Z, and splits at x20 and x09-x0D alone
                held = zlib.crc32(b"" if doc is None else str(doc).encode()) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER
                some.append({"doc_id": doc, "held_out": held, "text": b" ".join(words)})
                for w in (*words, END):
                    counts[w] = counts.get(w, 0) + (not held)
                size, some_bytes = size + len(some[-1]["text"]), some_bytes + len(some[-1]["text"])
                if size >= block_bytes or some_bytes >= SLICE:
                    yield from taken(some)
                    some, some_bytes = [], 0
                if size >= block_bytes:
                    yield from listed()
                    counts, found, size, nth = {}, [], 0, nth + 1
            if some:
                yield from taken(some)
        if found:
            yield from listed()

    kind = "block long, docs array<struct<doc_id: long, held_out: boolean>>, texts binary, bucket int, keys binary, n binary, words binary, train binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a task's part in order, and their training counts."""
    parts = [[b.column(k).to_numpy() for k in ("key", "n")] for b in batches if b.num_rows]
    key, n = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(2))
    order = np.argsort(key)
    return key[order], n[order]


def window_logs(counts: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(bucket, key, log) for distinct windows (key, n): log10 probability of the byte after its context, under the tree of all training counts n.

    The tree is built twice, once for what the top needs of it and once to score, rather than kept.
    Contexts shorter than ROOT belong to the top and may go anywhere.
    """
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // PART_ROWS))
    context = F.shiftright("key", 8)
    root = F.when(context >= 1 << 8 * (ROOT - 1), context.bitwiseAND((1 << 8 * ROOT) - 1)).otherwise(-1 - F.col("key").bitwiseAND(1023))
    rooted = counts.select(root.alias("root"), "key", "n")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if not len(keys):
            return
        codes, sums = roots_summed(grow(keys, n, depth, least))
        latest, where = np.unique((keys >> 8 & 255) << 8 | keys & 255, return_inverse=True)
        kind = np.repeat(["roots", "symbols"], [len(codes), len(latest)])
        zeros = np.zeros(len(latest))
        columns = (np.concatenate([codes, latest]), *(np.concatenate([a, b]) for a, b in zip(sums, (np.bincount(where, n, len(latest)), zeros, zeros), strict=True)))
        yield pa.record_batch([pa.array(kind.tolist(), pa.string()), *map(pa.array, columns)], names=["kind", "code", "a", "b", "c"])

    seen = rooted.filter("n > 0").repartition(parts, "root")
    top_rows = seen.mapInArrow(roots, "kind string, code long, a double, b double, c double").groupBy("kind", "code").agg(*(F.sum(x).alias(x) for x in "abc")).collect()
    symbols, sums = np.zeros((256, 256)), np.zeros((3, 256, 256))
    for r in top_rows:
        if r["kind"] == "roots":
            sums[:, r["code"] >> 8, r["code"] & 255] = r["a"], r["b"], r["c"]
        else:
            symbols[r["code"] >> 8, r["code"] & 255] = r["a"]
    shared = spark.sparkContext.broadcast(build_top(symbols, sums))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if not len(keys):
            return
        levels = grow(keys, n, depth, least)
        for at in range(0, len(keys), AT_ONCE):
            some = keys[at : at + AT_ONCE]
            yield pa.record_batch([pa.array(bucket_of(some).astype(np.int32)), pa.array(some), pa.array(key_logs(some, levels, shared.value, depth).astype(np.float32))], names=["bucket", "key", "log"])

    return rooted.repartition(parts, "root").mapInArrow(scored, "bucket int, key long, log float")


def word_logs(vocabulary: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(wid, log) for (word, wid, c): log10 probability of each word as a text of its own, under the tree of all words' training counts c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                symbol, context, firsts = laid_out(b.column(0).to_pylist(), depth)
                sizes = np.diff(np.append(firsts, len(symbol)))
                yield pa.record_batch([pa.array(context << 8 | symbol), *(pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (1, 2))], names=["key", "wid", "n"])

    spots = vocabulary.select("word", "wid", "c").mapInArrow(run, "key long, wid long, n long")
    logs = window_logs(spots.groupBy("key").agg(F.sum("n").alias("n")), depth, least)
    return spots.join(logs, "key").groupBy("wid").agg(F.sum("log").alias("log"))


def _all_counts(lists: pa.Table) -> pa.Table:
    keys = np.concatenate([np.cumsum(unpacked(x.as_py())) for x in lists.column("keys")])
    keys, n = summed(keys, np.concatenate([unpacked(x.as_py()) for x in lists.column("n")]))
    return pa.table({"key": keys, "n": n})


def _word_counts(lists: pa.Table) -> pa.Table:
    """Each list of a bucket's words with their counts in all blocks, and once the training tokens and distinct words of the bucket."""
    own, count = [x.as_py().split(b" ") for x in lists.column("words")], dict[bytes, int]()
    for words, train in zip(own, lists.column("train"), strict=True):
        for w, k in zip(words, unpacked(train.as_py()).tolist(), strict=True):
            count[w] = count.get(w, 0) + k
    c = [packed(np.array([count[w] for w in words])) for words in own]
    seen = [k for k in count.values() if k]
    once = lambda x: pa.array([x] + [0] * (len(own) - 1), pa.int64())
    return pa.table({"block": lists.column("block"), "words": lists.column("words"), "c": pa.array(c, pa.binary()), "tokens": once(sum(seen)), "distinct": once(len(seen))})


def _answered(lists: pa.Table, logs: pa.Table) -> pa.Table:
    """Each list of a bucket with the scores of its windows."""
    keys, log = logs.column("key").to_numpy(), logs.column("log").to_numpy()
    order = np.argsort(keys)
    keys, log = keys[order], log[order]
    found = [log[np.searchsorted(keys, np.cumsum(unpacked(x.as_py())))].tobytes() for x in lists.column("keys")]
    return pa.table({"block": lists.column("block"), "keys": lists.column("keys"), "logs": pa.array(found, pa.binary())})


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    base_score is the add-one word model's, score the context-tree model's log10 probability of the
    text, coded as one string, bits_per_byte that as code length. Both models learn from the rows that are not held
    out (crc32 of the id modulo 7 is not 2; a null id counts as the empty text). Null and empty texts
    hold the end alone; repeated rows count each time; a very long text is a block of its own; with no
    training rows the models are uniform; an empty table gives no rows; other columns are not read.
    """
    made = common.stored(blocks(docs, depth, block_bytes), "blocks")
    of_words = made.filter("words is not null").select("block", "bucket", "words", "train")
    known = common.stored(of_words.groupBy("bucket").applyInArrow(_word_counts, "block long, words binary, c binary, tokens long, distinct long"), "known")
    tokens, distinct = known.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "distinct"))).first()
    floor = float(np.log10(tokens + distinct + 1))
    lists = made.filter("keys is not null").select("block", "bucket", "keys", "n")
    counts = common.stored(lists.groupBy("bucket").applyInArrow(_all_counts, "key long, n long"), "windows")
    logs = window_logs(counts, depth, least)
    answers = lists.drop("n").groupBy("bucket").cogroup(logs.groupBy("bucket")).applyInArrow(_answered, "block long, keys binary, logs binary")
    looked_up = known.select(F.col("block").alias("of_block"), "words", "c").unionByName(answers.withColumnRenamed("block", "of_block"), allowMissingColumns=True)
    texts = made.filter("docs is not null").select("block", "docs", "texts")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        count: dict[bytes, int] = {}
        of_words = right.filter(right.column("words").is_valid())
        for words, c in zip(of_words.column("words"), of_words.column("c"), strict=True):
            count.update(zip(words.as_py().split(b" "), unpacked(c.as_py()).tolist(), strict=True))
        lists = right.filter(right.column("keys").is_valid())
        keys = np.concatenate([np.cumsum(unpacked(x.as_py())) for x in lists.column("keys")])
        log = np.concatenate([np.frombuffer(x.as_py(), dtype=np.float32) for x in lists.column("logs")])
        order = np.argsort(keys)
        keys, log = keys[order], log[order]
        out: list[tuple] = []
        for docs, texts in zip(left.column("docs"), left.column("texts"), strict=True):
            pieces = [_piece(x) for x in zstandard.decompress(texts.as_py()).split(END)]
            sums = np.zeros(len(pieces))
            for key, owner in windows(pieces, depth):
                own, where = np.unique(key, return_inverse=True)
                sums += np.bincount(owner, log[np.searchsorted(keys, own)][where], len(pieces))
            for doc, x, found in zip(docs.as_py(), pieces, sums.tolist(), strict=True):
                c = np.array([count[w] for w in (*x.split(), END)])
                base = float(np.log10(c + 1.0).sum()) - len(c) * floor
                out.append((doc["doc_id"], doc["held_out"], len(c), int((c > 0).sum()), tokens, base, found, -found / float(np.log10(2)) / (len(x) - 1)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return texts.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(total, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents"))

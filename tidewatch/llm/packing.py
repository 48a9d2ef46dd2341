"""Packing tokenised documents into sequences by a configuration linear program.

The programme has a variable for every way to fill a sequence with piece lengths and a demand for
every length. Multiplicative weights price the lengths, a knapsack dynamic programme finds the best
configurations at those prices, and the fractional solution is rounded; what rounding leaves over is
placed best fit. The programme's size depends on the sequence length alone, not on the corpus.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: A worker keeps the ids of up to twice as many words, and twice those that it looks up at a time.
CACHE_WORDS, SLICE_WORDS = 400_000, 10_000
#: Rounds of solving and rounding, and price updates in each.
ROUNDS, UPDATES = 6, 40

#: Unicode white space, without x1C-x1F, at which str.split() also splits.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WIDE = re.compile("[^\x00-ɏ]")
#: The tokenizer's own split (:func:`splits_at_blanks`) of words without such wide characters: \\d has only decimal digits, so other numbers are listed.
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|[\\W_]+")


class _Table(dict[str, bytes]):
    """Makes what it does not hold."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.make(word)
        return found


class WordTokenizer:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    Where the tokenizer splits at white space (:func:`splits_at_blanks`), each word is encoded once and
    looked up from then on, and the ids are those of encoding the whole text. When the table of words is
    full, it becomes the older one of two; words that are met again move on, the others go with it. Any
    other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.code = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.byte_signs = byte_signs()
        self.known: dict[str, bytes] = _Table(self._learn)
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [b"".join([code[k] for k in e.ids]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, word: str) -> bytes:
        """The ids of a word that the table has not."""
        if (found := self.older.get(word)) is not None:
            return found
        if not _plain(word):
            return self._encode([word])[0]
        runs = [word] if word.isalpha() else _RUNS.findall(word)
        return b"".join([self.known[x] for x in runs]) if len(runs) > 1 else self._run(word)

    def _run(self, run: str) -> bytes:
        """The ids of what is one run in the tokenizer's own split."""
        code = self.code
        signs, _ = charmap_decode(run.encode(), "strict", self.byte_signs)
        return b"".join([code[t.id] for t in self.model.tokenize(signs)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._encode([x or "" for x in texts])
        return [self._look_up(x or "") for x in texts]

    def _look_up(self, text: str) -> bytes:
        # for these characters Python and the tokenizer lower alike; it lowers the others itself, and finds special tokens before
        lowered = "<|" not in text and _narrow(text)
        if lowered:
            text = text.lower()
        words = [w for w in _WHITE.split(text) if w] if any(c in text for c in _SEPARATORS) else text.split()
        found = []
        for at in range(0, len(words), SLICE_WORDS):
            if len(self.known) > CACHE_WORDS:
                self.known, self.older = _Table(self._learn), self.known
            part = words[at : at + SLICE_WORDS]
            if not lowered:  # most words here are the tokenizer's, which gets them together
                fresh = [w for w in set(part) if w not in self.known and w not in self.older and not _plain(w)]
                self.known.update(zip(fresh, self._encode(fresh), strict=True))
            found.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(found)


def _narrow(text: str) -> bool:
    """Whether no character is wide; texts within Latin-1 are told apart without a search."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _WIDE.search(text)
    return True


def _plain(word: str) -> bool:
    """Whether a word is normal as it stands, so that the runs in it can go to the model directly."""
    return (word.isascii() or not _WIDE.search(word)) and word == word.lower() and "<|" not in word


def byte_signs() -> str:
    """By byte, the character that byte-level models have for it: the byte's own in Latin-1 if it shows there, or one of the next."""
    shown, others = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}, count(0x100)
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


def splits_at_blanks(shape: dict) -> bool:
    """Whether no token of this tokenizer crosses white space, and none depends on the words around."""
    split = shape.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    words = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    first = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": words} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
    normal = shape.get("normalizer") or {}
    kinds = [x.get("type") for x in normal.get("normalizers", [normal])]
    added = all(not any(t[k] for k in ("lstrip", "rstrip", "normalized")) and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in shape.get("added_tokens", []))
    return first and rest and kinds == ["NFC", "Replace", "Lowercase"] and added and shape.get("post_processor") is None


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process; a bare file name is looked up among the public tokenizers."""

    def load() -> WordTokenizer:
        where = path
        if not Path(path).is_absolute():
            import public_tokenizers

            where = str(public_tokenizers.path(path))
        return WordTokenizer(where)

    return common.worker_cache(f"tokenizer {path}", load)


def pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, path: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and where it was made (part, nth of its length there)."""
    common.short_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        tokens = tokenizer(path)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    for column, x in zip(out, (doc, k, at // 4, n, zlib.crc32(own), int(seen[n])), strict=True):
                        column.append(x)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            arrays.insert(5, pa.array(np.full(len(out[0]), part, dtype=np.int64)))
            yield pa.record_batch(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest sum of prices of lengths that add up to c at most; pick[c]: a length of it, 0: leave one free."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = price[1 : c + 1] + best[c - 1 :: -1]
        k = int(sums.argmax())
        if sums[k] > best[c - 1]:
            best[c], pick[c] = sums[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, pick


def _configurations(lengths: np.ndarray, pick: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each length, the item lengths of the best configuration that holds it: one array per step, 0 where it is full."""
    steps, room = [lengths], capacity - lengths
    while True:
        step = pick[room]
        while ((step == 0) & (room > 0)).any():  # skip what is left free
            free = (step == 0) & (room > 0)
            room = np.where(free, room - 1, room)
            step = pick[room]
        if not step.any():
            return steps
        steps.append(step)
        room = room - step


def solve(demand: np.ndarray, capacity: int, updates: int = UPDATES) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution {configuration: times} for the demands by length, and a lower bound on the sequences needed."""
    lengths = np.flatnonzero(demand)
    need = demand[lengths].astype(float)
    price = np.zeros(capacity + 1)
    price[lengths] = lengths / capacity
    used: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for k in range(updates):
        best, pick = knapsack(price, capacity)
        bound = max(bound, float((demand * price).sum() / best[capacity]))
        price /= best[capacity]
        worth = price[lengths] + best[capacity - lengths] / best[capacity]
        amount = need * np.exp(-60 * (1 - worth / worth.max()))
        steps = _configurations(lengths, pick, capacity)
        filled = sum(steps)
        amount *= (lengths * need).sum() / (amount * filled).sum()
        covered = np.zeros(capacity + 1)
        for s in steps:
            np.add.at(covered, s, amount)
        rows = np.sort(np.stack(steps, axis=1), axis=1)[:, ::-1]
        for row, x in zip(rows.tolist(), amount / updates, strict=True):
            if x > 1e-3:
                key = tuple(v for v in row if v)
                used[key] = used.get(key, 0.0) + x
        price[lengths] *= np.exp(0.5 / (1 + k / 10) * np.clip(1 - covered[lengths] / need, -1, 1))
    return used, bound


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: equal sequences are kept as one group with a count."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        while left:
            room = min((c for c in rooms if c >= length), default=capacity)
            group, count = rooms[room].pop() if room in rooms else ((), left)
            if room in rooms and not rooms[room]:
                del rooms[room]
            each = min(room // length, left)
            full = min(count, left // each)
            left -= full * each
            rooms.setdefault(room - each * length, []).append(((*group, *[length] * each), full))
            if group and count > full:
                rooms.setdefault(room, []).append((group, count - full))
    return [x for groups in rooms.values() for x in groups]


def pack_histogram(demand: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """[(piece lengths of a sequence, how many such sequences)] that use every piece once, and a lower bound on their number."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    whole = sum(n for _, n in plan)
    bound = whole + -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
    for k in range(ROUNDS):
        if not left.any():
            break
        used, fewest = solve(left, capacity)
        if k == 0:
            bound = max(bound, whole + int(np.ceil(fewest - 1e-6)))
        before = int(left.sum())
        waste = capacity // 200 if k < ROUNDS - 1 else capacity // 50
        for config, x in sorted(used.items(), key=lambda c: (-c[0][0], -c[1], c[0])):  # long pieces first: they are hard to place
            if not left[config[0]] or capacity - sum(config) > waste:
                continue
            items = {v: config.count(v) for v in config}
            times = min(int(np.ceil(x)), *(int(left[v]) // n for v, n in items.items()), int(1e15))
            if times > 0:
                plan.append((config, times))
                for v, n in items.items():
                    left[v] -= n * times
        if before - int(left.sum()) < before // 50:
            break
    return plan + best_fit(left, capacity), bound


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, path: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    Null and empty texts are the single id 0; very long texts are cut into pieces of ``size`` tokens;
    repeated rows, also of one doc_id, are packed once each; a null doc_id stays null; an empty table
    gives no rows; other columns are not read. Pieces of one length are interchangeable, so a piece's
    place follows from its rank among them: counts by task and length give each task's offset.
    """
    made = common.stored(pieces(docs, size, path), "pieces")
    counts = common.stored(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    demand = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[r["length"]] = r["n"]
    plan, _ = pack_histogram(demand, size)
    runs, base = [], 0
    rank = np.zeros(size + 1, dtype=np.int64)
    for config, times in plan:
        at = 0
        for v in sorted(set(config), reverse=True):
            n = config.count(v)
            runs.append((v, int(rank[v]), n, base, at))
            rank[v] += n * times
            at += n * v
        base += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, r = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            own = t[np.searchsorted(key, length << 48 | r, side="right") - 1]
            nth = r - own[:, 1]
            sequence, offset = own[:, 3] + nth // own[:, 2], own[:, 4] + nth % own[:, 2] * length
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))

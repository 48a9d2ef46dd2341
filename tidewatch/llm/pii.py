"""Personal data by bootstrapped contextual extraction.

Fixed forms (e-mail and IP addresses, card and phone numbers) give the base spans, which are the seeds. The
words around seeds are lexical patterns: two words before, one on either side, two after. Patterns and what
stands in their place are the two sides of a graph. Spark scores it in rounds: a pattern by the share of its
fillers that are known to be of a kind, an identifier by the patterns it stands in; identifiers that score high count
as known in the next round. What stands in a pattern is counted over all texts, ordinary words included, so
that a pattern that words fill too is worth little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans are listed; those found by context follow as context_<kind>.
KINDS = ("email", "ip", "card", "phone")
FOUND = "context_"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Distinct known identifiers that a pattern needs, its least confidence, and the least score of an identifier that is reported.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 3, 0.75, 0.8
#: What an identifier of no known kind counts in a pattern, against 1 for an ordinary word.
UNKNOWN_WEIGHT = 0.25
#: Scoring rounds at most; they end as soon as nothing new is found.
ROUNDS = 10
#: Characters on either side in which a pattern's words are looked for.
REACH = 120
#: Bits of the filter that tells which contexts of ordinary words are counted. It only saves work: an exact join follows.
FILTER_BITS = 1 << 23
_STRIPPED = "\"'()[]{}<>.,;:!?*&%$#|=~`^/\\_-"
# a token with a digit or @, and the groups of digits that follow it
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9()][0-9().-]*+(?!\S))*+")
_MIXED = re.compile("[0-9@]")
_M1, _M2, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
        done = m.end() if m else at + 1  # no address reaches over an @ that begins no domain
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed forms' spans by kind, then start: leftmost, not overlapping within a kind; offsets in code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def _is_identifier(core: str) -> bool:
    """An address with one @, or a number: 5 to 20 digits and no more letters than digits."""
    if not 0 < len(core) <= 64:
        return False
    if "@" in core:
        left, _, right = core.partition("@")
        return "@" not in right and left[-1:].isalnum() and right[:1].isalnum()
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    return 5 <= digits <= 20 and letters <= digits


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Tokens that may be identifiers and touch no span that is already found, without punctuation around them and labels before ``:`` or ``=``."""
    spans = sorted((s, e) for s, e, _ in taken)
    found, i, reached = [], 0, 0
    for m in _TOKEN.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reached = max(reached, spans[i][1])
            i += 1
        if reached > m.start():
            continue
        token = m.group()
        start = max(token.rfind(":", 0, -1), token.rfind("=", 0, -1)) + 1
        core = token[start:]
        kept = core.lstrip(_STRIPPED if ")" not in core else _STRIPPED.replace("(", ""))
        start += m.start() + len(core) - len(kept)
        kept = kept.rstrip(_STRIPPED)
        if _is_identifier(kept):
            found.append((start, start + len(kept)))
    return found


def _plain_words(text: str) -> list[str]:
    return [w for w in (t.strip(_STRIPPED) for t in text.lower().split()) if w]


def _word_hash(word: str) -> int:
    """64 bits for a word; the last tells whether it has a digit or an @. 0 is for no word."""
    return xxhash.xxh64_intdigest(word, 42) & ~1 | bool(_MIXED.search(word)) or 2


def _pair_key(form: int, a, b):
    """The key of a pattern: words as numbers or as arrays of numbers."""
    return ((a * _M1 + b) * _M2 + form) & _MASK


def patterns(text: str, start: int, end: int) -> list[tuple[int, str]]:
    """(key, text) of the patterns that text[start:end] stands in."""
    left, right = _plain_words(text[max(0, start - REACH) : start])[-2:], _plain_words(text[end : end + REACH])[:2]
    words = [*[""] * (2 - len(left)), *left, *right, *[""] * (2 - len(right))]
    h = [_word_hash(w) if w else 0 for w in words]
    forms = ((0, 1, f"{words[0]} {words[1]} _"), (1, 2, f"{words[1]} _ {words[2]}"), (2, 3, f"_ {words[2]} {words[3]}"))
    keys = [(_pair_key(form, h[a], h[b]), name) for form, (a, b, name) in enumerate(forms) if h[a] or h[b]]
    return [(key - (key >> 63 << 64), name) for key, name in keys]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = _word_hash(word)
        return h


def word_contexts(text: str, known: np.ndarray, hashes: _Hashes) -> np.ndarray:
    """Keys of the contexts of ordinary words that the filter ``known`` (64 bits a place) lets through, repeats included."""
    words = _plain_words(text)
    h = np.zeros(len(words) + 4, np.uint64)
    h[2:-2] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    inner = h[2:-2] & np.uint64(1) == 0
    found = []
    for form, (a, b) in enumerate(((h[:-4], h[1:-3]), (h[1:-3], h[3:-1]), (h[3:-1], h[4:]))):
        some = inner & ((a | b) != 0)
        key = (a[some] * np.uint64(_M1) + b[some]) * np.uint64(_M2) + np.uint64(form)
        place = key & np.uint64(FILTER_BITS - 1)
        hit = known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
        found.append(key[hit == 1])
    return np.concatenate(found).view(np.int64)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
_LINK = pa.struct([("text", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("pattern", pa.string())])
_SPAN_TYPE = "array<struct<kind: string, start: long, end: long, text: string>>"
_SLOTS = f"row long, doc_id long, spans {_SPAN_TYPE}, candidates {_SPAN_TYPE}, links array<struct<text: string, kind: string, key: long, pattern: string>>"


def _slots(docs: DataFrame) -> DataFrame:
    """Base spans, candidates, and what links either to patterns, for each row of (doc_id, text); ``row`` names the row in the stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.drop_worker_cache()
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            spans, others, links = [], [], []
            for text in (t or "" for t in b.column(1).to_pylist()):
                base = base_spans(text) if _MIXED.search(text) else []
                free = candidates(text, base) if _MIXED.search(text) else []
                spans.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k in base])
                others.append([{"kind": None, "start": s, "end": e, "text": text[s:e].lower()} for s, e in free])
                known = [*base, *((s, e, None) for s, e in free)]
                links.append([{"text": text[s:e].lower(), "kind": k, "key": key, "pattern": p} for s, e, k in known for key, p in patterns(text, s, e)])
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.record_batch([rows, b.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(others, pa.list_(_SPAN)), pa.array(links, pa.list_(_LINK))], names=["row", "doc_id", "spans", "candidates", "links"])

    return docs.mapInArrow(run, _SLOTS)


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each key's last digits: FILTER_BITS / 64 rows at most come to the driver, however many keys there are."""
    place = F.col("key").bitwiseAND(FILTER_BITS - 1)
    bit = F.expr(f"shiftleft(1L, cast(key & {63} as int))")
    found = keys.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    known = np.zeros(FILTER_BITS // 64, np.int64)
    known[found["at"].to_numpy()] = found["bits"].to_numpy()
    return known.view(np.uint64)


def _words_in(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n_words: how often an ordinary word stands in each context of ``keys``, over all texts."""
    known = _filter_bits(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            found = [word_contexts(t, known, hashes) for t in b.column(1).to_pylist() if t]
            key, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n_words"])

    counted = docs.mapInArrow(run, "key long, n_words long").groupBy("key").agg(F.sum("n_words").alias("n_words"))
    return counted.join(keys, "key", "left_semi")


def score_graph(links: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns: key, kind, confidence, support; identifiers: text, kind, score) from the pattern graph.

    ``links`` has text, kind (null where unknown) and key, distinct; ``words`` has key and n_words. A pattern's
    confidence for a kind is the summed score of its identifiers of that kind over all it holds; an
    identifier's score is the chance that one of its patterns is right, and 1 for a seed.
    """
    seeds = links.filter("kind is not null").select("text", "kind", F.lit(1.0).alias("score")).distinct()
    edges = common.stored(links.select("text", "key").distinct(), "edges")
    held = common.stored(edges.groupBy("key").agg(F.count("*").alias("n_texts")).join(words, "key", "left").na.fill(0, ["n_words"]), "held")
    known, before = common.stored(seeds, "known"), None
    for _ in range(rounds):
        scored = edges.join(known, "text").groupBy("key", "kind").agg(F.sum("score").alias("own"), F.count_if(F.col("score") >= MIN_SCORE).alias("support"))
        scored = common.stored(scored, "scored")
        every = edges.join(known.select("text").distinct(), "text", "left_semi").groupBy("key").agg(F.count("*").alias("n_known"))
        sums = scored.groupBy("key").agg(F.sum("own").alias("every")).join(every, "key")
        parts = scored.filter(F.col("support") >= MIN_SUPPORT).join(sums, "key").join(held, "key")
        confidence = F.col("own") / (F.col("every") + F.col("n_words") + UNKNOWN_WEIGHT * (F.col("n_texts") - F.col("n_known")))
        trusted = common.stored(parts.select("key", "kind", confidence.alias("confidence"), "support").filter(F.col("confidence") >= MIN_CONFIDENCE), "trusted")
        missed = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        found = edges.join(trusted, "key").groupBy("text", "kind").agg((1 - F.exp(missed)).alias("score")).filter(F.col("score") >= MIN_SCORE)
        found = found.join(seeds.select("text").distinct(), "text", "left_anti").unionByName(seeds)
        known = common.stored(found, "known")
        now = known.agg(F.count("*"), F.sum(F.xxhash64("text", "kind").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return trusted, known


def bootstrap(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their base spans and candidates, trusted patterns, identifiers found by context with kind and score)."""
    common.short_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slots = common.stored(_slots(docs), "slots")
    links = slots.select(F.inline("links")).groupBy("text", "kind", "key").agg(F.min("pattern").alias("pattern"))
    links = common.stored(links, "links")
    wide = links.select("key", "text").distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SUPPORT).select("key")
    # a pattern that holds too few identifiers, or no seed's kind, can never be trusted
    wide = common.stored(wide, "wide")
    links = common.stored(links.join(wide, "key", "left_semi"), "links")
    words = common.stored(_words_in(docs, wide), "words") if not wide.isEmpty() else wide.withColumn("n_words", F.lit(0).cast("long"))
    trusted, known = score_graph(links, words, rounds)
    named = links.groupBy("key").agg(F.min("pattern").alias("pattern"))
    best = known.groupBy("text").agg(F.max(F.struct("score", "kind")).alias("best")).select("text", "best.kind", "best.score")
    return slots, trusted.join(named, "key").select("pattern", "kind", "confidence", "support"), best


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and spans (kind, start, end, text; by kind, then start) for every row of ``docs`` (doc_id, text).

    A null text is empty and has no spans; base spans of different kinds may overlap and all stay, and an
    identifier found by context overlaps none; ties of two kinds' scores go to the later name; a very long
    text costs in proportion to its length; repeated rows get equal results; an empty table gives no rows;
    a null doc_id stays null; other columns are not read.
    """
    slots, _, best = bootstrap(docs, rounds)
    placed = slots.select("row", F.explode("candidates").alias("c")).join(best, F.col("c.text") == F.col("text"))
    found = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.text").alias("text")))).alias("found"))
    of = lambda kind: F.transform(F.filter("found", lambda x: x["kind"] == kind), lambda x: F.struct(F.lit(FOUND + kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    rows = slots.select("row", "doc_id", "spans").join(found, "row", "left")
    return rows.select("doc_id", F.when(F.col("found").isNull(), F.col("spans")).otherwise(F.concat("spans", *map(of, KINDS))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.read_table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )

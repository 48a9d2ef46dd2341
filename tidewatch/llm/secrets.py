"""Secret scans with dictionary-primed zstandard novelty.

Fixed patterns give the base spans. Further candidates are tokens on either side of a sensitive word that
are not made like words; each is measured by the bytes that it adds to a compressed frame of its surroundings, with a dictionary of
identifiers from the corpus. Text that repeats its surroundings or known identifiers adds little; a key
adds about as many bytes as it has.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds of spans in the order in which they are listed where starts are equal.
KINDS = ("assign", "access", "hex", "novel")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api")).removesuffix(_either_case("api"))
_ASSIGN = re.compile(f"({_NAMES}{_either_case('api')}_?{_either_case('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # runs are taken whole, so shorter ones can be left out at once
_MIN_ASSIGNED, _MIN_ACCESS = 6, 20

#: Words near which a token is a candidate (lower case), and how far it may begin before or after one.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "private key", "credential", "authorization", "bearer", "access key", "signature")
REACH = 64
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_CASES, _CAPITALS = re.compile("[a-z][A-Z]"), re.compile("[A-Z]{2}")
#: Names in code: words, humps and short numbers, joined by _ or - or by capitals; a hump has two letters at least.
_HUMPS = "(?:[a-z]{2,}|[A-Z][a-z]+)(?:[A-Z][a-z]+)*[0-9]{0,2}"
_NAME = re.compile(f"(?:{_HUMPS}|[A-Z]{{2,}}[0-9]{{0,2}}|[a-z][0-9]{{1,2}}|[0-9]{{1,4}})(?:[_-](?:{_HUMPS}|[A-Z]{{2,}}[0-9]{{0,2}}|[a-z][0-9]{{1,2}}|[0-9]{{1,4}}))*+")
#: The fewest characters of a candidate, and those from which a mixture of two kinds of characters is enough.
SHORT, LONG = 8, 16
#: Parts of identifiers: runs of letters, which no candidate is made of alone.
_PART = re.compile(r"[^\W\d_]{3,31}")
#: Characters of surroundings on each side, least share of a candidate's length that must be new bytes, dictionary size.
AROUND, NOVEL_SHARE, DICTIONARY_WORDS = 96, 0.85, 2_000
_LEVEL = 3

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: leftmost, not overlapping within a kind; offsets in code points, end exclusive."""
    low = text.lower()
    found: list[Span] = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def sensitive_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENSITIVE.finditer(text)]


def unlike_words(token: str) -> bool:
    """Whether a token mixes digits and letters, or switches case as no name does; long ones may mix any two kinds. Names in code are like words."""
    if len(token) < SHORT or _NAME.fullmatch(token):
        return False
    digit, lower, upper = any(map(str.isdigit, token)), any(map(str.islower, token)), any(map(str.isupper, token[1:]))
    switches = len(_CASES.findall(token))
    return digit and (lower or upper) or switches >= 3 or switches == 2 and bool(_CAPITALS.search(token)) or len(token) >= LONG and lower and upper


def candidates(text: str, places: list[tuple[int, int]], taken: list[Span]) -> list[tuple[int, int]]:
    """Tokens that begin within REACH of a sensitive word and touch no span that is already found.

    Reaches that overlap are one, and each token is looked at once, so a text costs in proportion to its
    length however often the words repeat.
    """
    reaches: list[list[int]] = []
    for s, e in places:
        lo, hi = max(0, s - REACH), min(len(text), e + REACH)
        if reaches and lo <= reaches[-1][1]:
            reaches[-1][1] = hi
        else:
            reaches.append([lo, hi])
    spans = sorted((s, e) for s, e, _ in taken)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    found, done = [], 0
    for lo, hi in reaches:
        lo = max(lo, done)
        if lo > done and lo < len(text) and _TOKEN.match(text, lo) and _TOKEN.match(text, lo - 1):
            inside = _TOKEN.match(text, lo)  # this token began before the reach
            lo = inside.end()
        for m in _TOKEN.finditer(text, lo, hi):
            s, e = m.span()
            if e == hi:
                e = _TOKEN.match(text, s).end()
            done = e
            i = bisect_left(starts, e) - 1
            if (i < 0 or ends[i] <= s) and unlike_words(text[s:e]):
                found.append((s, e))
    return found


class Novelty:
    """Marginal compressed bytes of a candidate, given its surroundings and the words of the dictionary."""

    def __init__(self, identifiers: list[str]) -> None:
        self.known = "\n".join(reversed(identifiers)).encode() + b"\n"  # a frame reaches the end of a dictionary cheapest
        self.empty = self._size(b"", b" " * 8)

    def _size(self, own: bytes, before: bytes) -> int:
        primed = zstandard.ZstdCompressionDict(self.known + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=_LEVEL, dict_data=primed, write_content_size=False, write_checksum=False).compress(own))

    def share(self, text: str, start: int, end: int) -> float:
        around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
        own = text[start:end].encode("utf-8", "replace")
        return (self._size(own, around.encode("utf-8", "replace") + b" " * 8) - self.empty) / len(own)


def all_spans(text: str, novelty: Novelty, min_share: float = NOVEL_SHARE) -> list[Span]:
    """Base spans and novel ones by start, then kind."""
    found = base_spans(text)
    places = sensitive_places(text)
    if places:
        found += [(s, e, "novel") for s, e in candidates(text, places, found) if novelty.share(text, s, e) >= min_share]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The words and parts of identifiers that stand near sensitive words most often, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    for _, at in sensitive_places(text):
                        counts.update(_PART.findall(text[max(0, at - AROUND) : at + AROUND]))
            if len(counts) > 100_000:
                yield flush()
        yield flush()

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in rows.filter("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()]


def scan(docs: DataFrame, min_share: float = NOVEL_SHARE) -> DataFrame:
    """doc_id and spans (a list of kind, start, end, text) for every row of ``docs``.

    A null text is empty and has no spans; spans of different base kinds may overlap and all stay; a very
    long text costs in proportion to its length; repeated rows get equal results; an empty table gives no
    rows; a null doc_id stays null; other columns are not read.
    """
    common.short_batches(docs.sparkSession)
    identifiers = identifier_dictionary(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "text": x[s:e]} for s, e, k in all_spans(x, novelty, min_share)] for x in (t or "" for t in b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    kind = 'doc_id long, spans array<struct<kind: string, start: long, end: long, text: string>>'
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def digest(spans: list[Span]) -> str:
    """sha256 of the joined base spans."""
    return hashlib.sha256(joined([s for s in spans if s[2] != "novel"]).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )

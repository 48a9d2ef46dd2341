"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import forget, scratch, shared_dir, ship_package, stored

__all__ = ["comparable_id", "connected_components", "forget", "free_name", "give_back", "id_remainder", "plain", "read_table", "scratch", "shared_dir", "short_batches", "stored", "whole_row", "worker_cache"]
T = TypeVar("T")
#: What the two bounds are where a session sets none.
_BATCH_DEFAULTS = ("10000", "67108864b")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that one Arrow batch may hold: whole texts can be long, so batches are short.
BATCH_ROWS = 1000
#: Bytes after which a batch is sent however few its rows are.
BATCH_BYTES = 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Send the package to the workers, and bound the session's Arrow batches by rows and bytes, so that
    very long texts do not pile up. A bound that the session has set itself stays."""
    ship_package(spark)
    for name, wanted in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) in _BATCH_DEFAULTS:
            spark.conf.set(key, str(wanted))


_kept: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made by ``make`` at first. A worker keeps one such thing
    at a time, so that the next operator's tasks do not add to the memory of the last one's."""
    if name not in _kept:
        drop_worker_cache()
        _kept[name] = make()
    return _kept[name]  # type: ignore[return-value]


def drop_worker_cache() -> None:
    """Called in tasks that keep nothing."""
    if _kept:
        _kept.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Memory that a worker has freed goes back to the system; else Arrow and the C library hold it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other alphabets)."""
    return F.translate(text, UPPER, UPPER.lower())


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def comparable_id(docs: DataFrame) -> Column:
    """doc_id as a long, or as it stands where it is a struct that names more than an id."""
    found = F.col("doc_id")
    return (found if isinstance(docs.schema["doc_id"].dataType, StructType) else found.cast("long")).alias("doc_id")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column of the input has that name."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def plain(columns: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col(f"`{c}`") for c in columns]


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The given columns (all by default) as one struct, ``row``: inside it no name can clash with a helper column."""
    names = df.columns if columns is None else columns
    return F.struct(*(x.alias(c) for x, c in zip(plain(names), names, strict=True))).alias("row")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has columns u and v (long). Alternating large-star and small-star rounds turn each
    component into a star around its smallest node; each round's edges are stored in the shared
    folder. Minima are pre-aggregated per task, and hub nodes only ever appear on the streamed side
    of a join that adaptive execution can split.
    """
    edges = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

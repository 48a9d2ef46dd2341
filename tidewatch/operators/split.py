"""Positional splits into reference and current rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import REFERENCE_FRACTION, TOTAL_ORDER
from ..session import stored

#: A row is looked for in ranges of the order, RANGES at a time, until its range holds so few distinct rows.
LOOKED_AT, RANGES = 10_000, 64
#: Copies of a row that one array numbers.
_CHUNK = 100_000
#: Name of the checksum of the columns that are not monitored.
REST = "_rest"


def cut(n: int, fraction: float, kind: str) -> int:
    """Rows in the reference: ``drift`` takes at least 10, ``baseline`` at least 1 and never all."""
    part = int(n * fraction)
    if kind == "drift":
        return max(part, 10)
    if kind == "baseline":
        return max(min(part, n - 1), 1)
    raise ValueError("kind is drift or baseline")


@dataclass(frozen=True)
class Boundary:
    """Where the reference ends: the last row's values in order (as text), and how many of several equal rows still belong to it."""

    last: dict[str, str | None] | None  # None: every row belongs to the reference
    equal: int = 0
    taken: int = 0


def _order(df: DataFrame) -> dict[str, Column]:
    """The monitored columns in order, then a checksum of the others, so that only rows that are equal in all columns are tied."""
    monitored = {c: F.col(c) for c in TOTAL_ORDER if c in df.columns}
    others = [F.col(f"`{c}`") for c in df.columns if c not in monitored]
    return monitored | ({REST: F.xxhash64(*others)} if others else {})


def _kth(groups: DataFrame, order: list[str], k: int) -> tuple[Row, int]:
    """The group (distinct in ``order``, of _rows rows) that holds the k-th row, and how many of its rows reach up to that.

    Groups are dealt to ranges of the order and counted; then only the range of the k-th row is dealt
    again. No task orders more than LOOKED_AT groups.
    """
    rising = [F.col(c).asc_nulls_first() for c in order]
    size = groups.count()
    while size > LOOKED_AT:
        ranged = stored(groups.repartitionByRange(RANGES, *rising).withColumn("_range", F.spark_partition_id()), "ranges")
        for r in ranged.groupBy("_range").agg(F.sum("_rows").alias("rows"), F.count("*").alias("size")).orderBy("_range").collect():
            if k <= r["rows"]:
                break
            k -= r["rows"]
        if r["size"] == size:
            raise RuntimeError("the order does not tell these rows apart")
        groups, size = ranged.filter(F.col("_range") == r["_range"]).drop("_range"), r["size"]
    for row in groups.orderBy(*rising).collect():
        if k <= row["_rows"]:
            return row, k
        k -= row["_rows"]
    raise ValueError("there are fewer rows than that")


def _day() -> Column:
    return F.to_date("study_date")


def _days(counted: DataFrame) -> list[tuple[date | None, int]]:
    """(day, rows) in order, null first, from ``counted`` (_day, _rows)."""
    rows = counted.groupBy("_day").agg(F.sum("_rows").alias("n")).collect()
    return sorted(((r["_day"], r["n"]) for r in rows), key=lambda d: d[0] or date.min)


def _day_of(days: list[tuple[date | None, int]], left: int) -> tuple[int | None, int]:
    """(place of the day that holds the row with this number, its number in the day)."""
    for i, (_, n) in enumerate(days):
        if left <= n:
            return i, left
        left -= n
    return None, left


def _within(df: DataFrame, day: date | None) -> Column:
    """Rows of a day, as a range of study_date that a scan can skip by."""
    if day is None:
        return F.col("study_date").isNull()
    own = F.lit(day).cast(df.schema["study_date"].dataType)
    return (F.col("study_date") >= own) & (F.col("study_date") < own + F.expr("interval 1 day"))


def boundaries(df: DataFrame, cuts: list[tuple[float, str]], days: list[tuple[date | None, int]] | None = None) -> list[Boundary]:
    """The boundary of each (fraction, kind). Rows are counted by day, if that is not known; then a boundary's own day is searched, in its monitored columns."""
    days = _days(df.groupBy(_day().alias("_day")).agg(F.count("*").alias("_rows"))) if days is None else days
    total, order = sum(n for _, n in days), _order(df)
    found: list[Boundary] = []
    known: dict[int, Boundary] = {}
    for fraction, kind in cuts:
        wanted = cut(total, fraction, kind)
        at, left = _day_of(days, wanted)
        if at is None:
            found.append(Boundary(None))
            continue
        if wanted not in known:
            groups = df.filter(_within(df, days[at][0])).groupBy(*(x.alias(c) for c, x in order.items())).agg(F.count("*").alias("_rows"))
            last, taken = _kth(groups.select(*(F.col(c) for c in order), *(F.col(c).cast("string").alias(f"_text_{c}") for c in order), "_rows"), list(order), left)
            known[wanted] = Boundary({c: last[f"_text_{c}"] for c in order}, last["_rows"], taken)
        found.append(known[wanted])
    return found


def _compared(df: DataFrame, last: dict[str, str | None]) -> tuple[Column, Column]:
    """Whether a row comes before the boundary's last row, and whether it equals it, in the order with nulls first."""
    order = _order(df)

    def value(c: str) -> Column:
        return F.lit(last[c]).cast("long" if c == REST else df.schema[c].dataType)

    def below(c: str) -> Column:
        return F.lit(False) if last[c] is None else order[c].isNull() | (order[c] < value(c))

    same = [order[c].eqNullSafe(value(c)) for c in last]
    before = reduce(lambda rest, c: below(c) | (order[c].eqNullSafe(value(c)) & rest), reversed(last), F.lit(False))
    return before, reduce(Column.__and__, same)


def _numbered(equal: DataFrame) -> DataFrame:
    """Rows that are all equal to others, each with _nth, its number among its copies from 1: they are counted and written out
    again, so no task orders them and a retry gives the same."""
    counted = equal.groupBy(*(F.col(f"`{c}`") for c in equal.columns)).agg(F.count("*").alias("_copies"))
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"), F.lit(_CHUNK).cast("long"))))
    upto = F.least(F.col("_from") + _CHUNK - 1, F.col("_copies"))
    return chunks.withColumn("_nth", F.explode(F.sequence(F.col("_from"), upto))).drop("_copies", "_from")


def phase_counts(df: DataFrame, phases: dict[str, tuple[float, str]], by: dict[str, Column], measures: dict[str, Column], strata: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(phases, by, measures summed; the measures by ``strata``), in one scan of ``df`` and one of the boundaries' days.

    The scan counts by day and ``by``, and by ``strata`` with grouping sets; measures are sums. Days on either side of a
    boundary belong to one phase as a whole, and only the rows of a boundary's day are told apart one by one.
    """
    keyed = df.select(_day().alias("_day"), *(x.alias(c) for c, x in by.items()), *(F.col(c).alias(f"_s_{c}") for c in strata or []), *(x.alias(c) for c, x in measures.items()))
    own, parts = ["_day", *by], [f"_s_{c}" for c in strata or []]
    sums = [*(F.sum(c).alias(c) for c in measures), F.count("*").alias("_rows")]
    if strata:
        sets = keyed.groupingSets([[F.col(c) for c in own], [F.col(c) for c in parts]], *(F.col(c) for c in [*own, *parts]))
        both = stored(sets.agg(F.grouping("_day").alias("_set"), *sums), "daily")
        daily, by_strata = both.filter("_set = 0"), both.filter("_set = 1").select(*(F.col(p).alias(c) for p, c in zip(parts, strata, strict=True)), *measures)
    else:
        daily, by_strata = stored(keyed.groupBy(*own).agg(*sums), "daily"), None
    days = _days(daily)
    total = sum(n for _, n in days)
    ends = {name: _day_of(days, cut(total, *kind))[0] for name, kind in phases.items()}
    edges = sorted({i for i in ends.values() if i is not None})
    inner = daily.filter(~reduce(Column.__or__, [F.col("_day").eqNullSafe(F.lit(days[i][0])) for i in edges])) if edges else daily

    def phase(end: int | None) -> Column:
        """By day, with null first."""
        if end is None:
            return F.lit("reference")
        day = days[end][0]
        return F.when(F.lit(False) if day is None else F.col("_day").isNull() | (F.col("_day") < day), "reference").otherwise("current")

    parts_of = inner.select(*(phase(end).alias(name) for name, end in ends.items()), *by, *measures)
    if edges:
        near = stored(df.filter(reduce(Column.__or__, [_within(df, days[i][0]) for i in edges])), "edges")
        told = with_phases(near, phases, boundaries(near, list(phases.values()), days))
        parts_of = parts_of.unionByName(told.select(*phases, *(x.alias(c) for c, x in by.items()), *(x.alias(c) for c, x in measures.items())))
    return parts_of.groupBy(*phases, *by).agg(*(F.sum(c).alias(c) for c in measures)), by_strata


def with_phases(df: DataFrame, phases: dict[str, tuple[float, str]], found: list[Boundary] | None = None) -> DataFrame:
    """``df`` with a column of ``reference`` and ``current`` for each name: (fraction, kind).

    The boundaries are found first, in a few jobs over ``df``, so a phase is a comparison with constants: no
    shuffle, no sort. Rows that are equal in all columns and lie on a boundary are alike; as many of
    them as belong there are in the reference. Columns must be groupable for that.
    """
    told = dict(zip(phases, boundaries(df, list(phases.values())) if found is None else found, strict=True))
    compared = {name: _compared(df, b.last) for name, b in told.items() if b.last is not None}
    split = {name: b for name, b in told.items() if b.taken < b.equal}

    def phase(name: str, numbered: bool) -> Column:
        b = told[name]
        if b.last is None:
            return F.lit("reference")
        before, equal = compared[name]
        among = before | (equal & (F.col("_nth") <= b.taken)) if numbered and name in split else before | equal if name not in split else before
        return F.when(F.coalesce(among, F.lit(False)), "reference").otherwise("current")

    own = {name: phase(name, False) for name in phases}
    if not split:
        return df.withColumns(own)
    tied = F.coalesce(reduce(Column.__or__, [compared[name][1] for name in split]), F.lit(False))
    ties = _numbered(df.filter(tied)).withColumns({name: phase(name, True) for name in phases}).drop("_nth")
    return df.filter(~tied).withColumns(own).unionByName(ties)


def with_phase(df: DataFrame, fraction: float = REFERENCE_FRACTION, kind: str = "drift") -> DataFrame:
    """``df`` with phase: ``reference`` for the first rows in time, ``current`` for the others; rows of one
    time are ordered by all monitored columns, with nulls first, then by a checksum of the others."""
    return with_phases(df, {"phase": (fraction, kind)})

"""Cumulative sums over scores without one task that sees them all.

Scores are cut into slices that hold about equally many rows each, wherever the scores crowd: the cuts are
quantiles from a mergeable sketch. Each slice is summed in its own task, and the slices' totals give the offsets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows (distinct scores and keys) that a slice holds, unless MOST_SLICES would be passed.
SLICE_ROWS = 50_000
MOST_SLICES = 4096
#: The sketch is off by so small a share of all rows; a slice is a 4,096th of them at least.
_ACCURACY = 5 * MOST_SLICES


def score_cuts(groups: DataFrame, score: str = "score", slice_rows: int = SLICE_ROWS) -> list[float]:
    """Rising cuts between slices of about ``slice_rows`` rows each: MOST_SLICES numbers at most, from one aggregate.

    As no slice is larger over all keys than its share, none is for one key. ``groups`` should be a stored table.
    """
    wanted = min(MOST_SLICES, -(-groups.count() // slice_rows))
    if wanted < 2:
        return []
    shares = ", ".join(f"{i / MOST_SLICES!r}d" for i in range(1, MOST_SLICES))
    at = groups.agg(F.expr(f"percentile_approx(`{score}`, array({shares}), {_ACCURACY})")).first()[0] or []
    picked = {at[round(i * MOST_SLICES / wanted) - 1] for i in range(1, wanted)}
    return sorted(c for c in picked if c == c)


def with_slices(groups: DataFrame, cuts: list[float], score: str = "score") -> DataFrame:
    """``groups`` with _slice, which rises with the score; a score that equals a cut is the first of its slice."""
    if not cuts:
        return groups.withColumn("_slice", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=score, outputCol="_slice", handleInvalid="keep").transform(groups)
    return placed.withColumn("_slice", F.col("_slice").cast("int"))


def cumulated(groups: DataFrame, sums: list[str], keys: list[str] | None = None, score: str = "score", descending: bool = False, cuts: list[float] | None = None) -> DataFrame:
    """``groups``, one row for each score (and key), with before_<sum>: the sum over lower scores (higher ones if descending).

    Without ``cuts`` the groups are stored and cut first; with them ``groups`` should be a stored table.
    """
    keys = keys or []
    if cuts is None:
        groups = stored(groups, "scores")
        cuts = score_cuts(groups, score)
    direction = F.desc if descending else F.asc
    sliced = with_slices(groups, cuts, score)
    inner = Window.partitionBy(*keys, "_slice").orderBy(direction(score)).rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"before_{c}") for c in sums))
    if not cuts:
        return own.drop("_slice")
    totals = sliced.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    outer = Window.partitionBy(*keys).orderBy(direction("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_slice").alias("_at"), *(F.coalesce(F.sum(f"_{c}").over(outer), F.lit(0)).alias(f"_before_{c}") for c in sums))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    both = own.join(offsets, [F.col("_slice") == F.col("_at"), *same])
    return both.select(*groups.columns, *((F.col(f"_before_{c}") + F.col(f"before_{c}")).alias(f"before_{c}") for c in sums))

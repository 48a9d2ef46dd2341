"""Confusion counts and the rates that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE, STRATIFIERS, SUBGROUP_MIN_N
from ..functions import stats

#: The rates that have an interval: name, successes, trials.
PROPORTIONS = {
    "sensitivity": ("tp", "positives"),
    "specificity": ("tn", "negatives"),
    "ppv": ("tp", "predicted_positive"),
    "npv": ("tn", "predicted_negative"),
    "accuracy": ("correct", "n"),
}


def counts(label: str = "y_true", prediction: str = "y_pred_binary") -> list[Column]:
    """Aggregates n, tp, fp, tn, fn."""
    y, p = F.col(label), F.col(prediction)
    return [
        F.count("*").alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    ]


def _part(name: str) -> Column:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "tp": tp, "tn": tn, "correct": tp + tn, "n": tp + fp + tn + fn, "positives": tp + fn, "negatives": tn + fp,
        "predicted_positive": tp + fp, "predicted_negative": tn + fn,
    }[name]


def rates() -> dict[str, Column]:
    """Rates from the count columns; NULL where the denominator is 0."""
    found = {name: stats.ratio(_part(k), _part(n)) for name, (k, n) in PROPORTIONS.items()}
    found["f1"] = stats.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    found["prevalence"] = stats.ratio(_part("positives"), _part("n"))
    return found


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, tp, fp, tn, fn of all rows, or by the given columns."""
    return df.groupBy(*(by or [])).agg(*counts())


def binary_metrics(df: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """metric, estimate, ci_lower, ci_upper for each rate: one aggregate and one row a metric."""
    one = confusion(df)
    rows = []
    for name, value in rates().items():
        low = high = F.lit(None).cast("double")
        if name in PROPORTIONS:
            k, n = PROPORTIONS[name]
            low, high = stats.wilson_bounds(_part(k), _part(n), confidence)
        rows.append(F.struct(F.lit(name).alias("metric"), value.alias("estimate"), low.alias("ci_lower"), high.alias("ci_upper")))
    return one.select(F.inline(F.array(*rows)))


def stratified(df: DataFrame, stratifiers: list[str] | tuple[str, ...] = STRATIFIERS, min_n: int = SUBGROUP_MIN_N) -> DataFrame:
    """stratifier, level, n, rates, status and counts for every level of every stratifier, in one scan.

    Null levels are left out. A level with fewer than ``min_n`` rows keeps its n, but its counts are 0
    and its rates NULL.
    """
    present = [c for c in stratifiers if c in df.columns]
    return stratified_counts(df.filter("y_true is not null and y_pred_binary is not null").groupBy(*present).agg(*counts()), present, min_n)


def stratified_counts(slim: DataFrame, present: list[str], min_n: int = SUBGROUP_MIN_N) -> DataFrame:
    """The same from counts (n, tp, fp, tn, fn) by all stratifiers."""
    pairs = F.array(*(F.struct(F.lit(c).alias("stratifier"), F.col(c).cast("string").alias("level")) for c in present))
    cells = ("n", "tp", "fp", "tn", "fn")
    found = slim.select(*cells, F.inline(pairs)).filter("level is not null").groupBy("stratifier", "level").agg(*(F.sum(c).alias(c) for c in cells)).filter("n > 0")
    enough = F.col("n") >= min_n
    found = found.withColumns({c: F.when(enough, F.col(c)).otherwise(0) for c in ("tp", "fp", "tn", "fn")})
    r = rates()
    columns = [r[c].alias(c) for c in ("sensitivity", "specificity", "ppv", "npv", "accuracy", "prevalence")]
    status = F.when(r["sensitivity"].isNull(), "insufficient_data").otherwise("ok").alias("status")
    return found.select("stratifier", "level", "n", *columns, status, "tp", "fp", "tn", "fn")


def subgroup_gap(strata: DataFrame, metric: str = "sensitivity") -> DataFrame:
    """stratifier, levels, gap: largest minus smallest value among levels that have one; 0 with fewer than two."""
    own = strata.groupBy("stratifier").agg(F.count(metric).alias("levels"), (F.max(metric) - F.min(metric)).alias("gap"))
    return own.select("stratifier", "levels", F.when(F.col("levels") >= 2, F.col("gap")).otherwise(0.0).alias("gap"))


def largest_gap(strata: DataFrame, metric: str = "sensitivity") -> DataFrame:
    return subgroup_gap(strata, metric).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))


def version_summary(df: DataFrame, min_n: int = 10) -> DataFrame:
    """Counts and rates by model version; versions with fewer than ``min_n`` rows are left out."""
    found = confusion(df, ["model_version"]).filter(F.col("n") >= min_n)
    return found.select("*", *(v.alias(k) for k, v in rates().items()))


def top_subgroups(strata: DataFrame, metric: str = "sensitivity", k: int = 24) -> DataFrame:
    """The k levels with the highest value of a metric, labelled ``stratifier: level``."""
    label = F.concat_ws(": ", "stratifier", "level").alias("label")
    return strata.filter(F.col(metric).isNotNull()).select(label, F.col(metric).alias("value")).orderBy(F.desc("value"), "label").limit(k)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

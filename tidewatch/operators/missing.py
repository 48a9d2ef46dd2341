"""Missing data and subgroup availability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REQUIRED, STRATIFIERS

#: Upper 5 % point of chi-square with one degree of freedom, to double precision.
CHI2_CRITICAL = 3.841458820694124


def profiled_columns(df: DataFrame) -> list[str]:
    """The stratifiers that are there, then every other text column that is not required."""
    extra = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in REQUIRED and f.name not in STRATIFIERS]
    return [*(c for c in STRATIFIERS if c in df.columns), *extra]


def missing_profile(df: DataFrame) -> DataFrame:
    """column, n_missing, n_total, pct_missing, is_metadata, chi2, mar_indicator, in one scan.

    chi2 is Yates's corrected statistic of missing against outcome; NULL unless both values of both occur.
    """
    columns = profiled_columns(df)
    y = F.col("y_true")
    counts = [F.count("*").alias("n"), F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0")]
    for i, c in enumerate(columns):
        gone = F.col(f"`{c}`").isNull()
        counts += [F.count_if(gone).alias(f"m{i}"), F.count_if(gone & (y == 1)).alias(f"a{i}"), F.count_if(gone & (y == 0)).alias(f"b{i}")]
    one = df.agg(*counts)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.col("n").alias("n_total"), F.lit(c in STRATIFIERS).alias("is_metadata"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), "n1", "n0")
        for i, c in enumerate(columns)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, n_missing long, n_total long, pct_missing double, is_metadata boolean, chi2 double, mar_indicator boolean")
    long = one.select(F.inline(F.array(*rows)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = F.col("n1") - a, F.col("n0") - b
    n = F.col("n1").cast("double") + F.col("n0")
    cross = F.abs(a * d - b * c)
    # the correction never takes more than the whole difference
    less = F.greatest(F.lit(0.0), cross - n / 2)
    told = (a + b > 0) & (c + d > 0) & (F.col("n1") > 0) & (F.col("n0") > 0)
    long = long.withColumn("chi2", F.when(told, F.try_divide(n * less * less, (a + b) * (c + d) * F.col("n1") * F.col("n0"))))
    share = F.coalesce(F.try_divide(F.col("n_missing").cast("double"), F.col("n_total")), F.lit(0.0))
    return long.select("column", "n_missing", "n_total", share.alias("pct_missing"), "is_metadata", "chi2", F.coalesce(F.col("chi2") > CHI2_CRITICAL, F.lit(False)).alias("mar_indicator"))


def availability(df: DataFrame) -> DataFrame:
    """stratifier, level, n, n_available, pct_available: rows of each level, and rows with any level."""
    present = [c for c in STRATIFIERS if c in df.columns]
    pairs = F.array(*(F.struct(F.lit(c).alias("stratifier"), F.col(c).cast("string").alias("level")) for c in present))
    slim = df.groupBy(*present).agg(F.count("*").alias("w"))
    levels = slim.select("w", F.inline(pairs)).groupBy("stratifier", "level").agg(F.sum("w").alias("n"))
    totals = levels.groupBy("stratifier").agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("n_available"))
    both = levels.filter("level is not null").join(totals, "stratifier")
    return both.select("stratifier", "level", "n", "n_available", (F.col("n_available") / F.col("_all")).alias("pct_available"))

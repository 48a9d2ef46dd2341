"""A synthetic monitoring table with planted drift, missing metadata and a paired version holdout."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clip

#: Levels and their shares.
SITES = {"North Hospital": 0.42, "South Hospital": 0.36, "Community Imaging": 0.22}
SCANNERS = {"GE": 0.34, "Siemens": 0.30, "Philips": 0.24, "Canon": 0.12}
MODALITIES = {"DX": 0.65, "CR": 0.25, "CT": 0.10}
AGES = {"0-17": 0.10, "18-39": 0.25, "40-64": 0.38, "65+": 0.27}
SEXES = {"F": 0.5, "M": 0.5}
RACES = {"Asian": 0.12, "Black": 0.17, "Hispanic": 0.15, "White": 0.49, "Other": 0.07}
AGE_EFFECTS = {"0-17": -0.45, "18-39": -0.25, "40-64": 0.05, "65+": 0.55}
ROWS_PER_DAY = 8
HOLDOUT_PATIENTS = 180


def _drawn(levels: dict[str, float], seed: int) -> Column:
    """One of the levels with the given shares: where a uniform draw falls among their running totals."""
    u, names = F.rand(seed), list(levels)
    tops = list(accumulate(levels.values()))[:-1]
    index = sum(((u >= t).cast("int") for t in tops), F.lit(0))
    return F.element_at(F.array(*map(F.lit, names)), index + 1)


def monitoring_table(spark: SparkSession, n: int = 1200, seed: int = 42, threshold: float = 0.5, start_date: str = "2025-10-01", holdout: bool = True) -> DataFrame:
    """``n`` rows, eight a day, and the paired holdout. Seeded draws: the same for the same partitioning."""
    seeds = iter(range(seed * 1000, seed * 1000 + 100))
    rows = spark.range(n).select(
        "id", *(_drawn(v, next(seeds)).alias(k) for k, v in (("site", SITES), ("_scanner", SCANNERS), ("modality", MODALITIES), ("age_group", AGES), ("sex", SEXES), ("_race", RACES))),
        *(F.rand(next(seeds)).alias(c) for c in ("_u_label", "_u_race_a", "_u_race_b", "_u_scanner")), F.randn(next(seeds)).alias("_z"),
    )
    south, philips = F.col("site") == "South Hospital", F.col("_scanner") == "Philips"
    age_effect = F.create_map(*(F.lit(x) for kv in AGE_EFFECTS.items() for x in kv))[F.col("age_group")]
    logit = -1.45 + age_effect + F.when(F.col("modality") == "CT", 0.45).otherwise(0.0) + F.when(south, 0.25).otherwise(0.0)
    phase = F.col("id") / float(max(n - 1, 1))
    drifted = phase >= 0.60
    separation = 2.35 - F.when(drifted, 0.65).otherwise(0.0) - F.when(philips & south, 0.35).otherwise(0.0) - F.when(F.col("age_group") == "65+", 0.15).otherwise(0.0)
    rows = rows.withColumn("y_true", (F.col("_u_label") < 1 / (1 + F.exp(-logit))).cast("int"))
    raw = -0.6 + separation * F.col("y_true") + 0.85 * F.col("_z") + F.when(drifted & philips, 0.35).otherwise(0.0)
    day = F.least(F.floor(F.col("id") / ROWS_PER_DAY), F.lit(max(n // ROWS_PER_DAY, 1) - 1)).cast("int")
    rows = rows.withColumn("y_pred_proba", clip(1 / (1 + F.exp(-raw)), 0.001, 0.999))
    race_gone = ((F.col("site") == "Community Imaging") & (F.col("_u_race_a") < 0.38)) | (F.col("_u_race_b") < 0.08)
    main = rows.select(
        F.format_string("demo_%05d", "id").alias("patient_id"), F.date_add(F.lit(start_date).cast("date"), day).cast("timestamp_ntz").alias("study_date"),
        F.when(phase < 0.48, "v1.0").otherwise("v2.0").alias("model_version"), "y_true", "y_pred_proba", (F.col("y_pred_proba") >= threshold).cast("int").alias("y_pred_binary"),
        "site", F.when(F.col("_u_scanner") > 0.035, F.col("_scanner")).alias("scanner_manufacturer"), "modality", "age_group", "sex", F.when(~race_gone, F.col("_race")).alias("race_ethnicity"),
    )
    return main.unionByName(_holdout(spark, seeds, threshold, start_date)) if holdout else main


def _holdout(spark: SparkSession, seeds, threshold: float, start_date: str) -> DataFrame:
    """Patients that both versions scored; the second version separates worse. A patient's metadata is one draw."""
    patients = spark.range(HOLDOUT_PATIENTS).select(
        "id", (F.rand(next(seeds)) < 0.30).cast("int").alias("y_true"), *(_drawn(v, next(seeds)).alias(k) for k, v in (("age_group", AGES), ("sex", SEXES), ("race_ethnicity", RACES))),
        F.randn(next(seeds)).alias("_z1"), F.randn(next(seeds)).alias("_z2"),
    )
    y = F.col("y_true")
    scores = F.array(
        F.struct(F.lit("v1.0").alias("model_version"), clip(0.20 + 0.58 * y + 0.12 * F.col("_z1"), 0.001, 0.999).alias("y_pred_proba")),
        F.struct(F.lit("v2.0").alias("model_version"), clip(0.25 + 0.45 * y + 0.22 * F.col("_z2"), 0.001, 0.999).alias("y_pred_proba")),
    )
    both = patients.select("*", F.inline(scores))
    return both.select(
        F.format_string("paired_%04d", "id").alias("patient_id"), F.date_add(F.lit(start_date).cast("date"), (10 + F.floor(F.col("id") / 6)).cast("int")).cast("timestamp_ntz").alias("study_date"),
        "model_version", "y_true", "y_pred_proba", (F.col("y_pred_proba") >= threshold).cast("int").alias("y_pred_binary"), F.lit("North Hospital").alias("site"), F.lit("GE").alias("scanner_manufacturer"),
        F.lit("DX").alias("modality"), "age_group", "sex", "race_ethnicity",
    )

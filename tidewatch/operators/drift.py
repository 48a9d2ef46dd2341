"""Drift of the score distribution and of performance over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CUSUM_THRESHOLD, HISTOGRAM_BINS, REFERENCE_FRACTION, ROLLING_MIN_SAMPLES, ROLLING_WINDOW_DAYS, AlertThresholds
from ..functions import stats
from ..functions.ordered import cumulated, score_cuts
from ..session import stored
from .ranking import grouped_auroc
from .split import phase_counts

PSI_FLOOR = 1e-6
KL_FLOOR = 1e-10


def histogram(phased: DataFrame, bins: int = HISTOGRAM_BINS, weight: str | None = None) -> DataFrame:
    """bin, reference, current: counts in left-closed bins of equal width, for every bin; ``weight`` names a column that counts rows. A column ``bin`` of ``phased`` stands."""
    p, w = F.col("phase"), F.col(weight) if weight else F.lit(1)
    place = F.col("bin") if "bin" in phased.columns else stats.left_closed_bin(F.col("y_pred_proba"), bins)
    own = phased.groupBy(place.alias("bin")).agg(
        *(F.sum(F.when(p == x, w).otherwise(0)).alias(x) for x in ("reference", "current"))
    )
    spine = phased.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(own, "bin", "left").na.fill(0, ["reference", "current"])


def score_drift(phased: DataFrame, bins: int = HISTOGRAM_BINS, minor: float | None = None, major: float | None = None, weight: str | None = None) -> DataFrame:
    """reference_n, current_n, psi, psi_level, kl_divergence in one row."""
    limits = AlertThresholds()
    minor, major = (limits.psi_minor if minor is None else minor), (limits.psi_major if major is None else major)
    h = histogram(phased, bins, weight)
    totals = h.agg(F.sum("reference").alias("rn"), F.sum("current").alias("cn"))
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(n)), F.lit(0.0))
    both = h.crossJoin(F.broadcast(totals)).select("rn", "cn", share("reference", "rn").alias("r"), share("current", "cn").alias("c"))
    pr, pc = F.greatest(F.col("r"), F.lit(PSI_FLOOR)), F.greatest(F.col("c"), F.lit(PSI_FLOOR))
    norm = 1 + bins * KL_FLOOR
    qr, qc = (F.col("r") + KL_FLOOR), (F.col("c") + KL_FLOOR)
    # an empty side has only the floor in each bin, so its shares add up to less than one
    nr, nc = (F.when(F.col(n) > 0, F.lit(norm)).otherwise(bins * KL_FLOOR) for n in ("rn", "cn"))
    found = both.agg(
        F.max("rn").alias("reference_n"), F.max("cn").alias("current_n"), F.sum((pc - pr) * F.log(pc / pr)).alias("psi"), F.sum(qr / nr * F.log((qr / nr) / (qc / nc))).alias("kl_divergence")
    )
    level = F.when(F.col("psi") >= major, "major").when(F.col("psi") >= minor, "minor").otherwise("none")
    return found.select("reference_n", "current_n", "psi", level.alias("psi_level"), "kl_divergence")


def distances(phased: DataFrame, weight: str | None = None) -> DataFrame:
    """wasserstein, ks_statistic, reference_n, current_n from the two distribution functions; NULL if a side is empty. ``weight`` names a column that counts rows."""
    p, w = F.col("phase"), F.col(weight) if weight else F.lit(1)
    side = lambda x: F.sum(F.when(p == x, w).otherwise(0))
    groups = phased.filter("y_pred_proba is not null").groupBy(F.col("y_pred_proba").alias("score")).agg(side("reference").alias("r"), side("current").alias("c"))
    groups = stored(groups, "scores")
    totals = groups.agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    up = cumulated(groups, ["r", "c"], cuts=score_cuts(groups)).crossJoin(F.broadcast(totals))
    gap = F.try_divide((F.col("before_r") + F.col("r")).cast("double"), F.col("rn")) - F.try_divide((F.col("before_c") + F.col("c")).cast("double"), F.col("cn"))
    # the gap holds from a score to the next one; its area follows from summing score differences by parts:
    # the integral is the sum of |gap| x (next - score), and the gap before a score is known at that score
    before = F.try_divide(F.col("before_r").cast("double"), F.col("rn")) - F.try_divide(F.col("before_c").cast("double"), F.col("cn"))
    area = F.sum(F.col("score") * (F.abs(before) - F.abs(gap)))
    return up.agg(area.alias("wasserstein"), F.max(F.abs(gap)).alias("ks_statistic"), F.max("rn").alias("reference_n"), F.max("cn").alias("current_n"))


def drift_report(df: DataFrame, fraction: float = REFERENCE_FRACTION, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """One row: sizes, PSI and its level, KL divergence, Wasserstein distance, KS statistic."""
    counted = score_counts(df, fraction)
    return score_drift(counted, bins, weight="n").crossJoin(F.broadcast(distances(counted, "n").select("wasserstein", "ks_statistic")))


def score_counts(df: DataFrame, fraction: float = REFERENCE_FRACTION, bins: int | None = None) -> DataFrame:
    """phase, y_pred_proba (or bin, if ``bins`` is given), n rows: in one scan, and one of the boundary's day."""
    by = {"bin": stats.left_closed_bin(F.col("y_pred_proba"), bins)} if bins else {"y_pred_proba": F.col("y_pred_proba")}
    return phase_counts(df, {"phase": (fraction, "drift")}, by, {"n": F.lit(1)})[0]


def rolling_auroc(df: DataFrame, window_days: int = ROLLING_WINDOW_DAYS, min_samples: int = ROLLING_MIN_SAMPLES) -> DataFrame:
    """window, center, n, auroc for every window; NULL with fewer than ``min_samples`` rows or one class.

    Window i begins i * window_days // 2 days after the first study. Rows are counted by day and score
    first, and these counts are copied into the two or three windows that hold them.
    """
    step = window_days // 2
    if step < 1:
        raise ValueError("window_days must be 2 at least")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    per_day = 86_400_000_000
    days = F.floor((micros("last") - micros("first")) / per_day)
    span = df.agg(F.min("study_date").alias("first"), F.max("study_date").alias("last"))
    span = span.select("first", micros("first").alias("micros"), F.greatest(F.lit(1), F.floor(days / step) + 1).alias("windows")).first()
    spark = df.sparkSession
    count = int(span["windows"] or 1) if span["micros"] is not None else 1
    starts = lambda i: F.floor(i * window_days / 2)
    age = F.floor((micros("study_date") - F.lit(span["micros"]).cast("long")) / per_day)
    scored = df.filter("y_pred_proba is not null and y_true is not null and study_date is not null")
    y = F.col("y_true")
    groups = scored.groupBy(age.alias("_age"), F.col("y_pred_proba").alias("score")).agg(F.count_if(y == 1).alias("np"), F.count_if(y == 0).alias("nn"))
    low = F.greatest(F.lit(0), F.floor((F.col("_age") - window_days) * 2 / window_days).cast("long"))
    high = F.least(F.lit(count - 1).cast("long"), F.ceil(F.col("_age") * 2 / window_days).cast("long"))
    copies = groups.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))))
    copies = copies.filter((F.col("_age") >= starts(F.col("window"))) & (F.col("_age") < starts(F.col("window")) + window_days))
    counts = stored(copies.groupBy("window", "score").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn")), "windows")
    own = grouped_auroc(counts, ["window"], score_cuts(counts)).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    spine = spark.range(count).withColumnRenamed("id", "window")
    center = F.lit(span["first"]).cast(df.schema["study_date"].dataType) + F.make_dt_interval((starts(F.col("window")) + step).cast("int"))
    joined = spine.join(own, "window", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("window", center.alias("center"), "n", F.when(F.col("n") >= min_samples, F.col("auroc")).alias("auroc"))


def cusum(series: DataFrame, threshold: float = CUSUM_THRESHOLD, order: str = "window", value: str = "auroc") -> DataFrame:
    """order, hi, lo, detected: two-sided cumulative sums around the mean of the non-null values.

    A sum that is held at 0 from below equals the running sum minus its running minimum, and the first
    value starts it, so window functions do without a loop. The series is one row a time window.
    """
    rows = series.filter(F.col(value).isNotNull())
    mean = rows.agg(F.avg(value).alias("_mean"))
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.orderBy(order)) == 1
    centred = rows.crossJoin(F.broadcast(mean)).withColumn("_d", F.when(first, 0.0).otherwise(F.col(value) - F.col("_mean")))
    summed = centred.withColumn("_c", F.sum("_d").over(upto))
    hi, lo = F.col("_c") - F.min("_c").over(upto), F.col("_c") - F.max("_c").over(upto)
    return summed.select(order, hi.alias("hi"), lo.alias("lo")).withColumn("detected", F.abs("hi") > threshold)


def score_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """model_version, bin, n, density of the scores."""
    own = df.groupBy("model_version", stats.left_closed_bin(F.col("y_pred_proba"), bins).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model_version"))
    return own.select("model_version", "bin", "n", (F.col("n") * float(bins) / total).alias("density"))

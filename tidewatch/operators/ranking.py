"""Ranking statistics: everything comes from counts by distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cumulated, score_cuts, with_slices
from ..session import stored


def score_groups(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, score, np, nn: positives and negatives at each distinct score. Rows without score or label are left out."""
    y = F.col("y_true")
    rows = df.filter("y_pred_proba is not null and y_true is not null")
    return rows.groupBy(*(keys or []), F.col("y_pred_proba").alias("score")).agg(F.count_if(y == 1).alias("np"), F.count_if(y == 0).alias("nn"))


def auroc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auroc: ties count half; NULL with a single class."""
    return grouped_auroc(score_groups(df, keys), keys)


def grouped_auroc(groups: DataFrame, keys: list[str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """The same from counts (keys, score, np, nn); with the ``cuts`` of a stored table these are not stored again."""
    keys = keys or []
    ranked = cumulated(groups, ["nn"], keys, cuts=cuts)
    won = F.sum(F.col("np") * (F.col("before_nn") + F.col("nn") / 2.0))
    found = ranked.groupBy(*keys).agg(F.coalesce(F.sum("np"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("nn"), F.lit(0)).alias("n_neg"), won.alias("won"))
    return found.select(*keys, "n_pos", "n_neg", F.try_divide("won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def auprc(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, auprc: average precision over distinct thresholds, from the highest score down."""
    keys = keys or []
    down = cumulated(score_groups(df, keys), ["np", "nn"], keys, descending=True)
    tp, fp = F.col("before_np") + F.col("np"), F.col("before_nn") + F.col("nn")
    found = down.groupBy(*keys).agg(F.sum(F.col("np") * tp / (tp + fp)).alias("s"), F.sum("np").alias("n_pos"))
    return found.select(*keys, F.try_divide("s", "n_pos").alias("auprc"))


def _totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.sum("np").alias("pos"), F.sum("nn").alias("neg"))


def roc_points(df: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """threshold, fpr, tpr from (NULL threshold, 0, 0) on. Inner points of a straight stretch are left out."""
    groups = stored(score_groups(df), "scores")
    cuts = score_cuts(groups)
    down = cumulated(groups, ["np", "nn"], descending=True, cuts=cuts).select("score", (F.col("before_np") + F.col("np")).alias("tp"), (F.col("before_nn") + F.col("nn")).alias("fp"), "np", "nn")
    if drop_collinear:  # a corner is where the step to the next point differs from the step to this one
        sliced = with_slices(down, cuts)
        # the next point of a slice's last row is the first of the next slice
        inner = Window.partitionBy("_slice").orderBy(F.desc("score"))
        firsts = sliced.withColumn("_row", F.row_number().over(inner)).filter("_row = 1").select("_slice", F.col("np").alias("f_np"), F.col("nn").alias("f_nn"))
        nexts = firsts.select("_slice", F.lead("f_np").over(Window.orderBy(F.desc("_slice"))).alias("n_np"), F.lead("f_nn").over(Window.orderBy(F.desc("_slice"))).alias("n_nn"))
        both = sliced.withColumns({"l_np": F.lead("np").over(inner), "l_nn": F.lead("nn").over(inner)}).join(nexts, "_slice")
        np2, nn2 = F.coalesce("l_np", "n_np"), F.coalesce("l_nn", "n_nn")
        down = both.filter(np2.isNull() | (np2 != F.col("np")) | (nn2 != F.col("nn")))
    ends = F.broadcast(_totals(groups))
    points = down.crossJoin(ends).select(F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("neg")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("pos")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def pr_points(df: DataFrame) -> DataFrame:
    """threshold, precision, recall for each distinct score, and the end point (NULL, 1, 0)."""
    groups = stored(score_groups(df), "scores")
    down = cumulated(groups, ["np", "nn"], descending=True, cuts=score_cuts(groups))
    tp, fp = F.col("before_np") + F.col("np"), F.col("before_nn") + F.col("nn")
    points = down.crossJoin(F.broadcast(_totals(groups))).select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.try_divide(tp.cast("double"), F.col("pos")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def brier(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    y, p = F.col("y_true").cast("double"), F.col("y_pred_proba")
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"))

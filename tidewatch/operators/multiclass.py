"""Multi-class metrics: all of them follow from the label-by-label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio


def _clean(name: str) -> F.Column:
    return F.regexp_replace(F.col(name), "^\\s+|\\s+$", "")


def pair_counts(df: DataFrame) -> DataFrame:
    """y_true, y_pred_label, n for the pairs that occur, labels without outer white space."""
    return df.groupBy(_clean("y_true").alias("y_true"), _clean("y_pred_label").alias("y_pred_label")).agg(F.count("*").alias("n"))


def labels(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("y_true", "y_pred_label")).alias("label")).distinct()


def confusion_matrix(df: DataFrame) -> DataFrame:
    """y_true, y_pred_label, n for every pair of labels: as many rows as labels squared."""
    pairs = pair_counts(df)
    own = labels(pairs)
    grid = own.select(F.col("label").alias("y_true")).crossJoin(F.broadcast(own.select(F.col("label").alias("y_pred_label"))))
    return grid.join(pairs, ["y_true", "y_pred_label"], "left").na.fill(0, ["n"])


def per_class(df: DataFrame) -> DataFrame:
    """label, support, predicted, tp, fp, fn, tn, sensitivity, specificity, ppv, npv, f1.

    Without support or predictions, sensitivity, ppv and f1 are 0; specificity and npv are NULL where
    their denominator is 0.
    """
    pairs = pair_counts(df)
    hit = F.when(F.col("y_true") == F.col("y_pred_label"), F.col("n")).otherwise(0)
    rows = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.alias("tp")),
        F.struct(F.col("y_pred_label").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )
    own = pairs.select(F.inline(rows)).groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    total = pairs.agg(F.sum("n").alias("total"))
    own = own.crossJoin(F.broadcast(total)).withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    own = own.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.select(
        "label", "support", "predicted", "tp", "fp", "fn", "tn",
        zero(ratio(F.col("tp"), F.col("support"))).alias("sensitivity"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        zero(ratio(F.col("tp"), F.col("predicted"))).alias("ppv"),
        ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"),
        zero(ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"),
    )


def summary(df: DataFrame) -> DataFrame:
    """metric, value: n, n_classes, accuracy, balanced accuracy, macro and weighted averages, Cohen's kappa."""
    own = per_class(df)
    s, n = F.col("support"), F.sum("support")
    weighted = lambda c: F.sum(s * F.col(c)) / n
    chance = F.sum(s.cast("double") * F.col("predicted")) / (n.cast("double") * n)
    accuracy = F.sum("tp") / n
    one = own.agg(
        n.cast("double").alias("n"), F.count("*").cast("double").alias("n_classes"), accuracy.alias("accuracy"), F.avg(F.when(s > 0, F.col("sensitivity"))).alias("balanced_accuracy"),
        F.avg("ppv").alias("macro_precision"), F.avg("sensitivity").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        weighted("ppv").alias("weighted_precision"), weighted("sensitivity").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.try_divide(accuracy - chance, 1 - chance).alias("cohen_kappa"),
    )
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns))))

"""Paired comparison of model versions, with a DeLong test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIDENCE, PAIRED_MIN_N
from ..functions import stats
from ..functions.ordered import cumulated, score_cuts
from ..session import stored


KEYS = ("version_a", "version_b")
#: Pairs at one score that one task may order.
TIED = 100_000
#: Rows of a DeLong test that one task sorts or sums by patient, about: the number of partitions follows from the table's size.
TASK_ROWS = 100_000


def _sides(found: DataFrame, columns: list[str]) -> DataFrame:
    """A row with both sides' columns for each patient and each two versions (a < b), from one row for each patient and version."""
    side = lambda s: found.select("patient_id", F.col("version").alias(f"version_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return side("a").join(side("b"), "patient_id").filter("version_a < version_b")


def _counted(df: DataFrame) -> DataFrame:
    """patient_id, version, n rows, least and greatest label."""
    rows = df.filter("patient_id is not null").groupBy(F.col("patient_id").cast("string").alias("patient_id"), F.col("model_version").alias("version"))
    return rows.agg(F.count("*").alias("n"), F.min("y_true").alias("low"), F.max("y_true").alias("high"))


def pair_summary(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """version_a, version_b, n_pairs, n_patients, labels_agree, comparable: enough pairs of rows that share a patient, whose labels all agree.

    The pairs are counted, not made: a patient with many rows has one row of counts for each version.
    """
    both = _sides(_counted(df) if counted is None else counted, ["n", "low", "high"])
    agree = (F.col("low_a") == F.col("high_b")) & (F.col("high_a") == F.col("low_b"))
    own = both.groupBy(*KEYS).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"), F.count("*").alias("n_patients"), F.bool_and(agree & (F.col("low_a") == F.col("high_a"))).alias("labels_agree"))
    return own.withColumn("comparable", (F.col("n_pairs") >= PAIRED_MIN_N) & (F.col("n_patients") >= PAIRED_MIN_N) & F.col("labels_agree"))


def delong(df: DataFrame, method: str = "placement") -> DataFrame:
    """One row per comparable version pair: AUROCs, their difference, its variance parts and z.

    ``placement`` weighs each positive by its place in the ranking, with variance over the positives
    divided by the negatives; ``delong1988`` has the textbook variance with both classes. The sample is all
    pairs of rows that share a patient, ties in score are ordered by patient, then by the other score; rows
    without label or score take no part. A pair's value splits into one part for each of its rows, so all sums over pairs come from
    sums over each patient's rows, and no pair is made.
    """
    if method not in ("placement", "delong1988"):
        raise ValueError("method is placement or delong1988")
    full = df.filter("y_true is not null and y_pred_proba is not null and patient_id is not null").select("patient_id", "model_version", "y_true", "y_pred_proba")
    full = stored(full, "paired")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-full.count() // TASK_ROWS))
    dealt = full.withColumn("patient_id", F.col("patient_id").cast("string")).repartition(parts, "patient_id")
    counted = stored(_counted(dealt), "counted")
    summary = pair_summary(full, counted.repartition(parts, "patient_id"))
    wanted = F.broadcast(summary.filter("comparable").select(*KEYS))  # as many rows as there are pairs of versions
    rows = dealt.select("patient_id", F.col("model_version").alias("version"), F.col("y_true").alias("y"), F.col("y_pred_proba").alias("score"))
    of, at = Window.partitionBy("version", "patient_id"), Window.partitionBy("version", "patient_id", "score")
    rows = rows.withColumns({"n": F.count("*").over(of), "first": F.row_number().over(of.orderBy("score")) - 1}).withColumns({"m": F.count("*").over(at), "r": F.col("first") - F.min("first").over(at) + 1})
    others = counted.select("patient_id", F.col("version").alias("other"), F.col("n").alias("times"))
    met = rows.join(others, "patient_id").filter("version <> other")
    keyed = met.withColumns({"side": F.when(F.col("version") < F.col("other"), "a").otherwise("b"), "version_a": F.least("version", "other"), "version_b": F.greatest("version", "other")})
    keyed = stored(keyed.join(wanted, list(KEYS)).select(*KEYS, "side", "patient_id", "y", "score", "first", "m", "r", "times"), "sides")
    y, keys = F.col("y"), list(KEYS)
    groups = stored(keyed.groupBy(*keys, "side", "score").agg(F.sum(F.when(y == 1, F.col("times")).otherwise(0)).alias("np"), F.sum(F.when(y == 0, F.col("times")).otherwise(0)).alias("nn")), "groups")
    totals = F.broadcast(groups.filter("side = 'a'").groupBy(*keys).agg(F.sum("np").alias("n_pos"), F.sum("nn").alias("n_neg")))
    placed = stored(cumulated(groups, ["np", "nn"], [*keys, "side"], cuts=score_cuts(groups)), "placed").join(totals, keys)
    return _finished((_placement if method == "placement" else _delong1988)(keyed, placed, parts), keys)


def _tie_offsets(cells: DataFrame, keys: list[str], most: int, parts: int) -> DataFrame:
    """``cells`` (keys, score, patient_id, pairs) with before: the pairs of earlier patients at the same score.

    Where a score has more than TIED pairs, cells are dealt by range and summed within their part, and the parts'
    totals give the offsets, so a score that half of the rows have is summed in many tasks. The parts are
    stored, for a second reading must see the same ranges.
    """
    score = [*keys, "score"]
    if most <= TIED:
        upto = Window.partitionBy(*score).orderBy("patient_id").rowsBetween(Window.unboundedPreceding, -1)
        return cells.repartition(parts, *score).select(*score, "patient_id", F.coalesce(F.sum("pairs").over(upto), F.lit(0)).alias("before"))
    dealt = stored(cells.repartitionByRange(parts, *score, "patient_id").withColumn("_part", F.spark_partition_id()), "ties")
    earlier = lambda w: F.coalesce(F.sum("pairs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = dealt.repartition(parts, "_part", *score).withColumn("_own", earlier(Window.partitionBy("_part", *score).orderBy("patient_id")))
    totals = dealt.groupBy("_part", *score).agg(F.sum("pairs").alias("pairs"))
    totals = totals.select("_part", *score, earlier(Window.partitionBy(*score).orderBy("_part")).alias("_others"))
    return own.join(totals, ["_part", *score]).select(*score, "patient_id", (F.col("_own") + F.col("_others")).alias("before"))


def _both_sides(sums: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row for each patient with the sums of both sides, from one row a side."""
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    return sums.groupBy(*by).agg(*(pick(s, c) for s in "ab" for c in columns))


def _placement(keyed: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """A pair's value on side a is x + y * k for its row on side a and the number k of earlier rows of the patient on side b, and the other way round."""
    keys, cell = list(KEYS), [*KEYS, "side", "score"]
    positives = keyed.filter("y = 1")
    cells = positives.repartition(parts, "patient_id").groupBy(*cell, "patient_id").agg((F.max("m") * F.max("times")).alias("pairs"))
    ties = _tie_offsets(cells, [*KEYS, "side"], placed.agg(F.max("np")).first()[0] or 0, parts)
    above, reached = F.col("n_pos") - F.col("before_np") - F.col("np"), F.col("n_neg") - F.col("before_nn")
    at = [*cell, "patient_id"]
    rows = positives.join(placed, cell).repartition(parts, *at).join(ties.repartition(parts, *at), at)
    x, y, k = F.col("x"), F.col("y"), F.col("first").cast("double")
    rows = rows.withColumns({"x": (above + F.col("before") + F.col("r")) / F.col("n_pos") - reached / F.col("n_neg"), "y": F.col("m") / F.col("n_pos"), "lost": (reached - F.col("nn") / 2.0) / F.col("n_neg")})
    terms = {"rows": F.lit(1), "x": x, "xx": x * x, "y": y, "yy": y * y, "xy": x * y, "k": k, "kk": k * k, "xk": x * k, "yk": y * k, "lost": F.col("lost")}
    sums = rows.repartition(parts, "patient_id").groupBy(*keys, "patient_id", "side").agg(*(F.sum(v).alias(c) for c, v in terms.items()), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    both = _both_sides(sums, [*keys, "patient_id"], [*terms, "p", "n"])
    c = F.col
    values = {}
    for s, o in ("ab", "ba"):
        values[f"sum_{s}"] = c(f"rows_{o}") * c(f"x_{s}") + c(f"y_{s}") * c(f"k_{o}")
        values[f"square_{s}"] = c(f"rows_{o}") * c(f"xx_{s}") + 2 * c(f"xy_{s}") * c(f"k_{o}") + c(f"yy_{s}") * c(f"kk_{o}")
        values[f"lost_{s}"] = c(f"rows_{o}") * c(f"lost_{s}")
    values["product"] = c("x_a") * c("x_b") + c("xk_a") * c("y_b") + c("y_a") * c("xk_b") + c("yk_a") * c("yk_b")
    one = both.groupBy(*keys).agg(F.max("p_a").alias("n_pos"), F.max("n_a").alias("n_neg"), *(F.sum(v).alias(name) for name, v in values.items()))
    p, n = c("n_pos"), c("n_neg")
    spread = lambda s: F.when(p > 1, (c(f"square_{s}") - c(f"sum_{s}") * c(f"sum_{s}") / p) / (p - 1)) / n
    return one.select(
        *keys, "n_pos", "n_neg", (1 - c("lost_a") / p).alias("auroc_a"), (1 - c("lost_b") / p).alias("auroc_b"),
        spread("a").alias("var_a"), spread("b").alias("var_b"), ((c("product") - c("sum_a") * c("sum_b") / p) / p / n).alias("cov_ab"),
    )


def _delong1988(keyed: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    keys, c = list(KEYS), F.col
    rows = keyed.filter("y in (0, 1)").join(placed, [*keys, "side", "score"])
    won = (c("before_nn") + c("nn") / 2.0) / c("n_neg")
    lost = 1 - (c("before_np") + c("np") / 2.0) / c("n_pos")
    rows = rows.withColumn("v", F.when(c("y") == 1, won).otherwise(lost))
    rows = rows.select(*keys, "side", "patient_id", "y", "v", "n_pos", "n_neg").repartition(parts, "patient_id")
    sums = rows.groupBy(*keys, "patient_id", "y", "side").agg(F.count("*").alias("rows"), F.sum("v").alias("v"), F.sum(c("v") * c("v")).alias("vv"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    both = _both_sides(sums, [*keys, "patient_id", "y"], ["rows", "v", "vv", "p", "n"])
    one = both.groupBy(*keys, "y").agg(
        F.max("p_a").alias("n_pos"), F.max("n_a").alias("n_neg"), F.sum(c("rows_a") * c("rows_b")).alias("size"), F.sum(c("v_a") * c("v_b")).alias("product"),
        *(F.sum(c(f"rows_{o}") * c(f"{v}_{s}")).alias(f"{v}_{s}") for v in ("v", "vv") for s, o in ("ab", "ba")),
    )
    size = c("size")
    over = lambda whole, a, b: F.when(size > 1, (whole - a * b / size) / (size - 1)) / size
    one = one.select(*keys, "y", "n_pos", "n_neg", *((c(f"v_{s}") / size).alias(f"mean_{s}") for s in "ab"), *(over(c(f"vv_{s}"), c(f"v_{s}"), c(f"v_{s}")).alias(f"var_{s}") for s in "ab"), over(c("product"), c("v_a"), c("v_b")).alias("cov_ab"))
    mean = lambda s: F.max(F.when(c("y") == 1, c(f"mean_{s}"))).alias(f"auroc_{s}")
    return one.groupBy(*keys).agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), mean("a"), mean("b"), *(F.when(F.count(x) == 2, F.sum(x)).alias(x) for x in ("var_a", "var_b", "cov_ab")))


def _finished(found: DataFrame, keys: list[str]) -> DataFrame:
    variance = F.greatest(F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab"), F.lit(1e-15))
    found = found.withColumn("auc_diff", F.col("auroc_a") - F.col("auroc_b")).withColumn("se_diff", F.sqrt(variance))
    return found.select(*keys, "n_pos", "n_neg", "auroc_a", "auroc_b", "auc_diff", "var_a", "var_b", "cov_ab", "se_diff", (F.col("auc_diff") / F.col("se_diff")).alias("z"))


def delong_tests(df: DataFrame, confidence: float = CONFIDENCE, method: str = "placement") -> list[dict]:
    """The comparisons as records with p-values and intervals: as many as there are pairs of versions."""
    z = stats.z_score(confidence)
    records = []
    for r in delong(df, method).orderBy("version_a", "version_b").collect():
        d = r.asDict()
        d["p_value"] = stats.two_sided_p_value(d["z"]) if math.isfinite(d["z"]) else None
        d["ci_lower"], d["ci_upper"] = d["auc_diff"] - z * d["se_diff"], d["auc_diff"] + z * d["se_diff"]
        records.append(d)
    return records

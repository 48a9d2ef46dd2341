"""BCa bootstrap intervals for AUROC, AUPRC and the Brier score.

Rows with equal score and label are interchangeable, so a replicate draws counts for these groups: first how many
rows fall to each slice of scores and each label, which every task draws alike from the replicate's seed, then
the groups' counts inside a slice, in the slice's own task. The first draw gives the sums over lower slices
too, so each task adds its whole part of a statistic. The jackknife is in closed form from cumulative sums.
Neither brings the scores to the driver or to one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOOTSTRAP_RESAMPLES, CONFIDENCE, SEED
from ..functions.ordered import cumulated, score_cuts, with_slices
from ..session import stored
from . import ranking

STATISTICS = ("auroc", "auprc", "brier")
#: Tasks that replicates are spread over where there are few slices.
TASKS = 64


@dataclass(frozen=True)
class _Placed:
    """Counts by distinct score with their cumulative sums, stored, and what is known of the whole."""

    groups: DataFrame
    cuts: list[float]
    n_pos: int
    n_neg: int
    points: dict[str, float | None]


def _placed(df: DataFrame) -> _Placed:
    groups = stored(ranking.score_groups(df), "scores")
    cuts = score_cuts(groups)
    placed = stored(cumulated(groups, ["np", "nn"], cuts=cuts), "placed")
    one = placed.agg(F.coalesce(F.sum("np"), F.lit(0)).alias("p"), F.coalesce(F.sum("nn"), F.lit(0)).alias("n")).first()
    p, n = one["p"], one["n"]
    np_, nn, s = F.col("np"), F.col("nn"), F.col("score")
    sums = placed.agg(
        F.sum(np_ * (F.col("before_nn") + nn / 2.0)).alias("auroc"), F.sum(_share(np_ * _tp(p), _tp(p) + _fp(n))).alias("auprc"), F.sum(np_ * (1 - s) * (1 - s) + nn * s * s).alias("brier")
    ).first()
    over = {"auroc": float(p) * n, "auprc": p, "brier": p + n}
    return _Placed(placed, cuts, p, n, {m: sums[m] / over[m] if over[m] else None for m in STATISTICS})


def _tp(n_pos: int) -> Column:
    """Positives at a score or above."""
    return n_pos - F.col("before_np")


def _fp(n_neg: int) -> Column:
    return n_neg - F.col("before_nn")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _left_out(at: _Placed, metric: str) -> DataFrame | None:
    """n, d: for each score and label, its rows and by how much the statistic changes without one of them. None where that is undefined."""
    p, n, whole, total = at.n_pos, at.n_neg, at.points[metric], at.n_pos + at.n_neg
    groups, np_, nn, s = at.groups, F.col("np"), F.col("nn"), F.col("score")
    if whole is None or total < 2 or metric != "brier" and (p < 2 or metric == "auroc" and n < 2):
        return None
    if metric == "brier":
        pos, neg = (whole - (1 - s) * (1 - s)) / (total - 1), (whole - s * s) / (total - 1)
    elif metric == "auroc":
        pos = (whole - (F.col("before_nn") + nn / 2.0) / n) / (p - 1)
        neg = (whole - (p - F.col("before_np") - np_ / 2.0) / p) / (n - 1)
    else:
        tp, fp = _tp(p), _fp(n)
        parts = groups.select("np", "nn", "score", "before_np", "before_nn", _share(np_ * tp, tp + fp).alias("a"), _share(np_ * tp, tp + fp - 1).alias("b"), _share(np_ * (tp - 1), tp - 1 + fp).alias("c"))
        groups = cumulated(stored(parts, "parts"), ["a", "b", "c"], cuts=at.cuts)
        a, b, c = F.col("a"), F.col("b"), F.col("c")
        above = whole * p - F.col("before_a") - a  # from the higher scores
        neg = (above + F.col("before_b") + b) / p - whole
        pos = (above + _share((np_ - 1) * (tp - 1), tp - 1 + fp) + F.col("before_c")) / (p - 1) - whole
    both = F.array(F.struct(np_.alias("n"), pos.alias("d")), F.struct(nn.alias("n"), neg.alias("d")))
    return groups.select(F.inline(both)).filter("n > 0")


def _moments(at: _Placed, metric: str) -> tuple[float, float, float] | None:
    """(mean, sum of squares, sum of cubes) of the statistic with one row left out, the sums around the mean."""
    rows = _left_out(at, metric)
    if rows is None:
        return None
    d, n = F.col("d"), F.col("n")
    one = rows.agg(F.sum(n * d).alias("m1"), F.sum(n * d * d).alias("m2"), F.sum(n * d * d * d).alias("m3")).first()
    w = at.n_pos + at.n_neg
    mean = one["m1"] / w
    return at.points[metric] + mean, one["m2"] - w * mean**2, one["m3"] - 3 * mean * one["m2"] + 2 * w * mean**3


def jackknife_moments(df: DataFrame, names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """metric, n, estimate, mean, spread, skew of the values with one row left out: mean, n x sum of squares, n^2 x sum of
    cubes around it. A metric that is undefined without some row has no row."""
    at = _placed(df)
    w = at.n_pos + at.n_neg
    found = {m: x for m in names if (x := _moments(at, m)) is not None}
    rows = [(m, w, at.points[m], mean, w * square, w * w * cube) for m, (mean, square, cube) in found.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, n long, estimate double, mean double, spread double, skew double")


def _replicates(at: _Placed, resamples: int, seed: int) -> pd.DataFrame:
    """replicate and its statistics; NaN where undefined."""
    sliced = with_slices(at.groups.select("score", "np", "nn"), at.cuts)
    totals = sliced.groupBy("_slice").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn")).toPandas().sort_values("_slice")
    place = {int(x): i for i, x in enumerate(totals["_slice"])}
    cells = np.concatenate([totals["np"].to_numpy(float), totals["nn"].to_numpy(float)])
    size, slices = int(cells.sum()), len(totals)
    blocks = max(1, min(resamples, TASKS // slices))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        at_slice, block = place[int(rows["_slice"].iloc[0])], int(rows["_block"].iloc[0])
        score, odds = rows["score"].to_numpy(), {c: rows[c].to_numpy(float) for c in ("np", "nn")}
        found = []
        for i in range(block, resamples, blocks):
            top = np.random.default_rng([seed, i]).multinomial(size, cells / cells.sum())
            top_pos, top_neg = top[:slices], top[slices:]
            own = np.random.default_rng([seed, i, at_slice + 1])
            pos, neg = (
                (own.multinomial(n[at_slice], odds[c] / odds[c].sum()) if odds[c].sum() else np.zeros(len(rows), int)).astype(float) for c, n in (("np", top_pos), ("nn", top_neg))
            )
            below = top_neg[:at_slice].sum() + np.cumsum(neg) - neg
            tp = top_pos[at_slice + 1 :].sum() + np.cumsum(pos[::-1])[::-1]
            fp = top_neg[at_slice + 1 :].sum() + np.cumsum(neg[::-1])[::-1]
            found.append((i, float(pos @ (below + neg / 2)), float(pos @ (tp / np.maximum(tp + fp, 1))), float(pos @ (1 - score) ** 2 + neg @ score**2), float(pos.sum()), float(neg.sum())))
        return pd.DataFrame(found, columns=["replicate", "auroc", "auprc", "brier", "p", "n"])

    dealt = sliced.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = dealt.groupBy("_slice", "_block").applyInPandas(draw, "replicate long, auroc double, auprc double, brier double, p double, n double")
    sums = parts.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("auroc", "auprc", "brier", "p", "n"))).toPandas().sort_values("replicate")
    with np.errstate(all="ignore"):
        return pd.DataFrame({"replicate": sums["replicate"], "auroc": sums["auroc"] / (sums["p"] * sums["n"]), "auprc": sums["auprc"] / sums["p"], "brier": sums["brier"] / (sums["p"] + sums["n"])})


def bca_interval(point: float, replicates: np.ndarray, moments: tuple[float, float, float] | None, confidence: float) -> tuple[float, float]:
    """Bias-corrected and accelerated bounds; without moments, only bias-corrected."""
    normal, r = NormalDist(), len(replicates)
    share = min(max(float((replicates < point).mean()), 1 / (2 * r)), 1 - 1 / (2 * r))
    z0 = normal.inv_cdf(share)
    _, square, cube = moments or (0.0, 0.0, 0.0)
    a = -cube / (6 * square**1.5) if square > 0 else 0.0
    bounds = []
    for z in (normal.inv_cdf((1 - confidence) / 2), normal.inv_cdf((1 + confidence) / 2)):
        q = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
        bounds.append(float(np.quantile(replicates, q)))
    return bounds[0], bounds[1]


def intervals(df: DataFrame, names: tuple[str, ...] = STATISTICS, resamples: int = BOOTSTRAP_RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> list[dict]:
    """metric, estimate, ci_lower, ci_upper, n_valid for each statistic.

    To the driver come the slices' totals (4,096 at most) and a few numbers for each replicate. Equal tables give
    equal intervals, however their rows are dealt.
    """
    at = _placed(df)
    if not at.n_pos + at.n_neg:
        return [{"metric": n, "estimate": None, "ci_lower": None, "ci_upper": None, "n_valid": 0} for n in names]
    drawn, found = _replicates(at, resamples, seed), []
    for name in names:
        point, low, high = at.points[name], None, None
        values = drawn[name].replace([np.inf, -np.inf], np.nan).dropna().to_numpy()
        if point is not None and len(values) and at.n_pos + at.n_neg > 1:
            low, high = (point, point) if np.ptp(values) == 0 else bca_interval(point, values, _moments(at, name), confidence)
        found.append({"metric": name, "estimate": point, "ci_lower": low, "ci_upper": high, "n_valid": len(values)})
    return found

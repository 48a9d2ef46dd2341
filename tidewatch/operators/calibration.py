"""Calibration: binned error, reliability curve, logistic recalibration, and its drift by site."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import CALIBRATION_BINS, REFERENCE_FRACTION, SITE_MIN_N
from ..functions import stats
from ..functions.ordered import cumulated, score_cuts
from ..session import stored
from .split import with_phase

RIDGE = 1e-6
CLIP = 1e-6
MAX_STEPS = 200
#: Cells of the logit in which a first fit sums the scores: so many rows at most for each key.
CELLS = 16_384
#: A Newton step this small (over 1 + the point) leaves an error of its square, so no further look is needed.
LAST_STEP = 1e-6


def calibration_bins(df: DataFrame, bins: int = CALIBRATION_BINS, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n, observed, predicted for the bins that hold rows (right-closed, equal width)."""
    rows = df.filter("y_pred_proba is not null and y_true is not null")
    own = rows.groupBy(*(keys or []), stats.right_closed_bin(F.col("y_pred_proba"), bins).alias("bin"))
    return own.agg(F.count("*").alias("n"), F.avg(F.col("y_true").cast("double")).alias("observed"), F.avg("y_pred_proba").alias("predicted"))


def expected_calibration_error(df: DataFrame, bins: int = CALIBRATION_BINS, keys: list[str] | None = None) -> DataFrame:
    """keys, n, ece: mean distance of observed and predicted rate, weighted by bin size."""
    own = calibration_bins(df, bins, keys).groupBy(*(keys or []))
    return own.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, bins: int = CALIBRATION_BINS, strategy: str = "uniform") -> DataFrame:
    """bin, n, prob_true, prob_pred. ``quantile`` bins are cut at the scores' quantiles, left-closed."""
    if strategy == "uniform":
        found = calibration_bins(df, bins)
    elif strategy == "quantile":
        rows = df.filter("y_pred_proba is not null and y_true is not null")
        groups = stored(rows.groupBy(F.col("y_pred_proba").alias("score")).agg(F.count("*").alias("n"), F.sum("y_true").alias("pos")), "scores")
        cuts = [F.lit(c) for c in _quantiles(groups, [i / bins for i in range(1, bins)])]
        index = sum((F.when(F.col("score") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        n = F.sum("n")
        found = groups.groupBy(index.alias("bin")).agg(n.alias("n"), (F.sum("pos").cast("double") / n).alias("observed"), (F.sum(F.col("score") * F.col("n")) / n).alias("predicted"))
    else:
        raise ValueError("strategy is uniform or quantile")
    return found.select("bin", "n", F.col("observed").alias("prob_true"), F.col("predicted").alias("prob_pred"))


def _quantiles(groups: DataFrame, shares: list[float]) -> list[float]:
    """Quantiles with linear interpolation, from counts n by distinct score."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    ranks = sorted({r for q in shares for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    below = F.col("before_n")
    hit = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= below) & (r < below + F.col("n")))
    value = {r["rank"]: r["score"] for r in cumulated(groups, ["n"], cuts=score_cuts(groups)).select("score", F.explode(hit).alias("rank")).collect()}
    found = []
    for q in shares:
        at = q * (total - 1)
        low, high = value[math.floor(at)], value[math.ceil(at)]
        found.append(low + (high - low) * (at - math.floor(at)))
    return found


def _first_fits(groups: DataFrame, keys: list[str], kinds: list[StructField]) -> list[Row]:
    """keys, pos, neg, spread (of p), a, b: a fit to the cells' mean logits, which is off by about the square of a cell's width.

    Without keys there are CELLS rows at most, which the driver fits itself.
    """
    limit = math.log((1 - CLIP) / CLIP)
    cell = F.floor((F.col("x") / limit + 1) * (CELLS / 2)).alias("_cell")
    n = F.col("pos") + F.col("neg")
    cells = groups.groupBy(*keys, cell).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (F.sum(n * F.col("x")) / F.sum(n)).alias("x"), F.min("p").alias("low"), F.max("p").alias("high"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, pos, neg = (rows[c].to_numpy() for c in ("x", "pos", "neg"))
        ab = _newton(x, pos, neg)
        own = {"pos": pos.sum(), "neg": neg.sum(), "spread": rows["high"].max() - rows["low"].min(), "a": ab[0], "b": ab[1]}
        return pd.DataFrame([{k: rows[k].iloc[0] for k in keys} | own])

    double = [StructField(c, DoubleType()) for c in ("pos", "neg", "spread", "a", "b")]
    if not keys:
        rows = cells.toPandas()
        return [Row(**r) for r in fit(rows).to_dict("records")] if len(rows) else [Row(pos=0.0, neg=0.0, spread=0.0, a=0.0, b=1.0)]
    return cells.groupBy(*keys).applyInPandas(fit, StructType([*kinds, *double])).collect()


def _newton(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the ridged logistic fit to weighted points; (0, 1) where Newton's method finds none."""
    n = pos + neg

    def loss(ab: np.ndarray) -> float:
        eta = ab[0] + ab[1] * x
        return float(pos @ np.logaddexp(0, -eta) + neg @ np.logaddexp(0, eta) + RIDGE * ab @ ab)

    ab = np.array([0.0, 1.0])
    for _ in range(MAX_STEPS):
        eta = np.clip(ab[0] + ab[1] * x, -700, 700)
        q = 1 / (1 + np.exp(-eta))
        off, bend = n * q - pos, n * q * (1 - q)
        grad = np.array([off.sum(), off @ x]) + 2 * RIDGE * ab
        curve = np.array([[bend.sum(), bend @ x], [bend @ x, bend @ x**2]]) + 2 * RIDGE * np.eye(2)
        step = np.linalg.solve(curve, grad)
        here, shrink = loss(ab), 1.0
        while shrink > 1e-10 and not loss(ab - shrink * step) <= here + 1e-12 * abs(here):
            shrink /= 2
        ab = ab - shrink * step
        if not np.isfinite(ab).all():
            return 0.0, 1.0
        if np.abs(shrink * step).max() < 1e-10 * (1 + np.abs(ab).max()):
            break
    return float(ab[0]), float(ab[1])


def intercept_slope(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, intercept, slope of the outcome's logistic fit on the score's logit; NULL with fewer than 3 rows, one class or one score.

    Rows are counted by score once. Sums over CELLS cells of the logit give each key a first fit, in its own
    task; from there Newton's method on the ridged loss takes one aggregate of the exact counts a step, and one
    step is enough as a rule. The driver holds a few numbers for each key.
    """
    keys = keys or []
    p = stats.clip(F.col("y_pred_proba"), CLIP, 1 - CLIP)
    rows = df.filter("y_pred_proba is not null and y_true is not null")
    counted = rows.groupBy(*keys, p.alias("p")).agg(F.sum("y_true").cast("double").alias("pos"), F.sum(1 - F.col("y_true")).cast("double").alias("neg"))
    groups = stored(counted.withColumn("x", F.ln("p") - F.log1p(-F.col("p"))), "logits")
    spark = df.sparkSession
    kinds = [df.schema[k] for k in keys]
    fitted = StructType([*kinds, StructField("a", DoubleType()), StructField("b", DoubleType())])
    sized = _first_fits(groups, keys, kinds)
    every = [tuple(r[k] for k in keys) for r in sized]
    starts = {tuple(r[k] for k in keys): (r["a"], r["b"]) for r in sized if r["pos"] and r["neg"] and r["pos"] + r["neg"] >= 3 and r["spread"] > 1e-12}
    wanted = set(starts)

    def look(points: dict[tuple, tuple[float, float]]) -> dict[tuple, tuple[float, ...]]:
        """Loss, its slope and its curvature at a point for each key."""
        if keys:
            at = spark.createDataFrame([(*k, *ab) for k, ab in points.items()], fitted)
            near = groups.join(F.broadcast(at), [groups[k].eqNullSafe(at[k]) for k in keys])
        else:
            near = groups.withColumns({name: F.lit(v) for name, v in zip("ab", points[()], strict=True)})
        head = [groups[k] for k in keys]
        eta, x, n = F.col("a") + F.col("b") * F.col("x"), F.col("x"), F.col("pos") + F.col("neg")
        q = 1 / (1 + F.exp(-eta))
        soft = lambda e: F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e)))
        off, bend = n * q - F.col("pos"), n * q * (1 - q)
        loss = F.sum(F.col("pos") * soft(-eta) + F.col("neg") * soft(eta))
        found = near.groupBy(*head).agg(loss.alias("loss"), F.sum(off).alias("g0"), F.sum(off * x).alias("g1"), F.sum(bend).alias("h0"), F.sum(bend * x).alias("h1"), F.sum(bend * x * x).alias("h2"))
        out = {}
        for r in found.collect():
            k = tuple(r[c] for c in keys)
            a, b = points[k]
            out[k] = (r["loss"] + RIDGE * (a * a + b * b), r["g0"] + 2 * RIDGE * a, r["g1"] + 2 * RIDGE * b, r["h0"] + 2 * RIDGE, r["h1"], r["h2"] + 2 * RIDGE)
        return out

    at = dict(starts)
    here = look(at) if at else {}
    moving, shrink = set(wanted), dict.fromkeys(wanted, 1.0)
    for _ in range(MAX_STEPS):
        if not moving:
            break
        tried, size, last = {}, {}, set()
        for k in moving:
            _, g0, g1, h0, h1, h2 = here[k]
            det = h0 * h2 - h1 * h1
            step = ((h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det)
            tried[k] = tuple(c - shrink[k] * s for c, s in zip(at[k], step, strict=True))
            size[k] = max(abs(shrink[k] * s) for s in step)
            if size[k] < LAST_STEP * (1 + max(map(abs, at[k]))):
                at[k] = tried.pop(k)
                last.add(k)
        moving -= last
        if not tried:
            break
        for k, seen in look(tried).items():
            if not seen[0] <= here[k][0] + 1e-12 * abs(here[k][0]) and shrink[k] > 1e-10:
                shrink[k] /= 2
                continue
            at[k], here[k], shrink[k] = tried[k], seen, 1.0
    done = [(*k, *(at[k] if k in at and all(map(math.isfinite, at[k])) else (None, None))) for k in every]
    return spark.createDataFrame(done, StructType([*kinds, StructField("intercept", DoubleType()), StructField("slope", DoubleType())]))


def summary(df: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """n, brier, ece of all rows."""
    from .ranking import brier

    return brier(df).crossJoin(F.broadcast(expected_calibration_error(df, bins).select("ece")))


def site_calibration(df: DataFrame, fraction: float = REFERENCE_FRACTION, min_n: int = SITE_MIN_N, bins: int = CALIBRATION_BINS, with_fit: bool = True) -> DataFrame:
    """One row per site: n, Brier, ECE, intercept and slope of the reference and the current rows, and the differences."""
    from .ranking import brier

    rows = with_phase(df, fraction, "baseline").filter("site is not null")
    keys = ["site", "phase"]
    found = brier(rows, keys).join(expected_calibration_error(rows, bins, keys).drop("n"), keys)
    measures = ["brier", "ece"]
    if with_fit:
        found = found.join(intercept_slope(rows, keys), keys)
        measures += ["intercept", "slope"]
    pick = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    sites = found.groupBy("site").agg(
        *(F.coalesce(pick(ph, "n"), F.lit(0)).alias(f"{name}_n") for ph, name in (("reference", "baseline"), ("current", "current"))),
        *(pick(ph, c).alias(f"{name}_{c}") for c in measures for ph, name in (("reference", "baseline"), ("current", "current"))),
    )
    enough = (F.col("baseline_n") >= min_n) & (F.col("current_n") >= min_n)
    columns = ["site", "baseline_n", "current_n"]
    for c in measures:
        for name in ("baseline", "current"):
            columns.append(F.when(enough, F.col(f"{name}_{c}")).alias(f"{name}_{c}"))
        columns.append(F.when(enough, F.col(f"current_{c}") - F.col(f"baseline_{c}")).alias(f"{c}_delta"))
    return sites.select(*columns, F.when(enough, "ok").otherwise("insufficient_data").alias("status"))


def is_number(x: float | None) -> bool:
    return x is not None and math.isfinite(x)

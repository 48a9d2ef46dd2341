"""Operators against hand-computed values and plain NumPy."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import AlertThresholds
from tidewatch.functions import ordered, stats
from tidewatch.operators import alerts, bootstrap, calibration, confusion, drift, missing, multiclass, ranking, split, versions
from tidewatch.session import stored

SCHEMA = (
    "patient_id string, study_date timestamp_ntz, model_version string, y_true int, y_pred_proba double, y_pred_binary int, "
    "site string, scanner_manufacturer string, modality string, age_group string, sex string, race_ethnicity string"
)
START = datetime(2026, 1, 1)


def row(i, y, p, day=0, version="v1.0", site="A", sex="F", patient=None):
    return (patient or f"p{i:05d}", START + timedelta(days=day), version, y, float(p), int(p >= 0.5), site, "GE", "DX", "40-64", sex, None)


@pytest.fixture(scope="module")
def mixed(spark):
    scores = [(1, 0.95), (1, 0.80), (1, 0.70), (1, 0.40), (0, 0.60), (0, 0.30), (0, 0.20), (0, 0.10)]
    return spark.createDataFrame([row(i, y, p) for i, (y, p) in enumerate(scores)], SCHEMA)


@pytest.fixture(scope="module")
def drifting(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        day = i // 10
        y = int(rng.random() < 0.35)
        p = float(np.clip(0.3 + (0.45 if day < 75 else 0.15) * y + rng.normal(0, 0.15), 0, 1))
        rows.append(row(i, y, round(p, 3), day, site="AB"[i % 2], sex="FM"[i % 3 % 2]))
    return spark.createDataFrame(rows, SCHEMA), rows


def arrays(rows):
    return np.array([r[3] for r in rows]), np.array([r[4] for r in rows])


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)) if len(pos) and len(neg) else None


def test_wilson_bounds():
    assert stats.wilson(10, 10)[1:] == (pytest.approx(0.7224672), 1.0)
    assert stats.wilson(0, 10)[1:] == (pytest.approx(0.0), pytest.approx(0.2775328))
    for k, n in ((5, 0), (-1, 10), (11, 10)):
        with pytest.raises(ValueError):
            stats.wilson(k, n)


def test_confusion_and_rates(mixed):
    assert confusion.confusion(mixed).first().asDict() == {"n": 8, "tp": 3, "fp": 1, "tn": 3, "fn": 1}
    found = {r["metric"]: r for r in confusion.binary_metrics(mixed).collect()}
    assert [found[m]["estimate"] for m in ("sensitivity", "specificity", "ppv", "npv", "accuracy", "f1", "prevalence")] == [0.75] * 6 + [0.5]
    assert (found["sensitivity"]["ci_lower"], found["sensitivity"]["ci_upper"]) == pytest.approx(stats.wilson(3, 4)[1:])


def test_empty_table_has_null_rates(mixed):
    found = {r["metric"]: r["estimate"] for r in confusion.binary_metrics(mixed.filter("1 = 0")).collect()}
    assert set(found.values()) == {None}
    assert ranking.auroc(mixed.filter("1 = 0")).first()["auroc"] is None


def test_strata_gap_and_suppression(spark):
    rows = [row(i, 1, 0.9 if i % 10 else 0.1, sex="F") for i in range(20)] + [row(i, 1, 0.9 if i % 10 > 2 else 0.1, sex="M") for i in range(20, 40)] + [row(i, 1, 0.9, sex="U") for i in range(3)]
    strata = confusion.stratified(spark.createDataFrame(rows, SCHEMA), ["sex", "race_ethnicity"])
    found = {r["level"]: r for r in strata.collect()}
    assert set(found) == {"F", "M", "U"}
    assert (found["U"]["n"], found["U"]["tp"], found["U"]["sensitivity"], found["U"]["status"]) == (3, 0, None, "insufficient_data")
    assert confusion.largest_gap(strata).first()["gap"] == pytest.approx(0.2)
    assert confusion.largest_gap(strata.filter("level = 'F'")).first()["gap"] == 0.0


def test_strata_count_every_row(drifting):
    df, rows = drifting
    found = confusion.stratified(df).groupBy("stratifier").sum("n").collect()
    assert {r[0]: r[1] for r in found} == {c: len(rows) for c in ("site", "scanner_manufacturer", "modality", "age_group", "sex")}


def test_auroc_and_auprc_match_numpy(drifting):
    df, rows = drifting
    y, p = arrays(rows)
    assert ranking.auroc(df).first()["auroc"] == pytest.approx(auc(y, p), abs=1e-12)
    want = sum((p[y == 1] == s).sum() * (y[p >= s].sum() / (p >= s).sum()) for s in np.unique(p)) / y.sum()
    assert ranking.auprc(df).first()["auprc"] == pytest.approx(want, abs=1e-12)
    assert ranking.auroc(df.repartition(7)).first()["auroc"] == pytest.approx(auc(y, p), abs=1e-12)


def test_roc_area_and_corners(drifting):
    df, rows = drifting
    points = sorted((r["fpr"], r["tpr"]) for r in ranking.roc_points(df).collect())
    assert points[0] == (0, 0) and points[-1] == (1, 1)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    assert area == pytest.approx(auc(*arrays(rows)), abs=1e-12)
    assert len(points) <= ranking.roc_points(df, drop_collinear=False).count()


def test_brier_ece_and_fit(drifting):
    df, rows = drifting
    y, p = arrays(rows)
    found = calibration.summary(df).first()
    assert found["brier"] == pytest.approx(((p - y) ** 2).mean())
    edges = np.linspace(0, 1, 11)
    bins = np.clip(np.digitize(p, edges, right=True) - 1, 0, 9)
    want = sum((bins == b).sum() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in np.unique(bins)) / len(y)
    assert found["ece"] == pytest.approx(want)
    fit = calibration.intercept_slope(df).first()
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.log(q / (1 - q))
    eta = fit["intercept"] + fit["slope"] * x
    rest = y - 1 / (1 + np.exp(-eta))
    assert abs(rest.sum()) < 1e-2 and abs((rest * x).sum()) < 1e-2


def test_bins_follow_the_edges(spark):
    from pyspark.sql import functions as F

    values = [i / 10 for i in range(11)] + [0.30000000000000004, 0.6000000000000001, 0.7000000000000001, 0.05, 0.999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = df.select("x", stats.left_closed_bin(F.col("x"), 10).alias("l"), stats.right_closed_bin(F.col("x"), 10).alias("r")).collect()
    edges = np.linspace(0, 1, 11)
    for r in found:
        left = int(np.histogram([r["x"]], bins=edges)[0].argmax())
        assert r["l"] == left
        assert r["r"] == int(np.clip(np.digitize(r["x"], edges, right=True) - 1, 0, 9))


def test_split_sizes(drifting):
    df, rows = drifting
    sizes = {r["phase"]: r["count"] for r in split.with_phase(df, 0.3).groupBy("phase").count().collect()}
    assert sizes == {"reference": 450, "current": 1050}
    assert split.with_phase(df.limit(4), 0.3, "drift").filter("phase = 'current'").count() == 0
    assert split.with_phase(df.limit(4), 0.3, "baseline").filter("phase = 'current'").count() == 3


def test_psi_kl_and_distances(drifting):
    df, rows = drifting
    y, p = arrays(rows)
    a, b = p[:450], p[450:]
    phased = split.with_phase(df, 0.3)
    found = drift.score_drift(phased).first()
    h = [np.histogram(v, bins=np.linspace(0, 1, 11))[0] / len(v) for v in (a, b)]
    r, c = np.maximum(h[0], 1e-6), np.maximum(h[1], 1e-6)
    assert found["psi"] == pytest.approx(((c - r) * np.log(c / r)).sum())
    r, c = ((v + 1e-10) / (v + 1e-10).sum() for v in h)
    assert found["kl_divergence"] == pytest.approx((r * np.log(r / c)).sum())
    s = np.unique(p)
    gaps = np.abs([(a <= v).mean() - (b <= v).mean() for v in s])
    d = drift.distances(phased).first()
    assert d["ks_statistic"] == pytest.approx(gaps.max())
    assert d["wasserstein"] == pytest.approx((gaps[:-1] * np.diff(s)).sum())
    from pyspark.sql import functions as F

    same = df.withColumn("phase", F.explode(F.array(F.lit("reference"), F.lit("current"))))
    assert drift.score_drift(same).first()["psi"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("width", [30, 15, 7])
def test_rolling_windows_match_a_loop(drifting, width):
    df, rows = drifting
    y, p = arrays(rows)
    days = np.array([(r[1] - START).days for r in rows])
    found = {r["window"]: r for r in drift.rolling_auroc(df, width, 20).collect()}
    n = max(1, int(days.max()) // (width // 2) + 1)
    assert sorted(found) == list(range(n))
    for i in range(n):
        inside = (days >= (i * width) // 2) & (days < (i * width) // 2 + width)
        want = auc(y[inside], p[inside]) if inside.sum() >= 20 else None
        assert found[i]["n"] == inside.sum()
        assert found[i]["auroc"] == (None if want is None else pytest.approx(want))
    assert drift.rolling_auroc(df, width, 10**6).filter("auroc is not null").count() == 0


def test_cusum_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0.9, 0.02, 20), rng.normal(0.5, 0.02, 20)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "window int, auroc double")
    hi, lo = np.zeros(len(v)), np.zeros(len(v))
    for i in range(1, len(v)):
        hi[i], lo[i] = max(0, hi[i - 1] + v[i] - v.mean()), min(0, lo[i - 1] + v[i] - v.mean())
    found = drift.cusum(df, 0.5).orderBy("window").collect()
    assert np.allclose([r["hi"] for r in found], hi) and np.allclose([r["lo"] for r in found], lo)
    assert any(r["detected"] for r in found)
    assert drift.cusum(df.filter("1 = 0")).count() == 0


def test_missing_profile(spark):
    rows = [row(i, i % 2, 0.6)[:10] + (None if i < 30 else "FM"[i % 2], None) for i in range(100)]
    found = {r["column"]: r for r in missing.missing_profile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["sex"]["pct_missing"] == pytest.approx(0.3) and not found["sex"]["mar_indicator"]
    assert found["race_ethnicity"]["n_missing"] == 100 and found["race_ethnicity"]["chi2"] is None
    levels = {r["level"]: r for r in missing.availability(spark.createDataFrame(rows, SCHEMA)).filter("stratifier = 'sex'").collect()}
    assert levels["F"]["n"] + levels["M"]["n"] == 70 and levels["F"]["pct_available"] == pytest.approx(0.7)


def test_chi_square_formula(spark):
    rows = [row(i, int(i < 40), 0.5)[:10] + (None if i % 4 == 0 and i < 60 else "F", None) for i in range(100)]
    found = next(r for r in missing.missing_profile(spark.createDataFrame(rows, SCHEMA)).collect() if r["column"] == "sex")
    t = np.array([[10, 5], [30, 55]], dtype=float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert found["chi2"] == pytest.approx(((np.abs(t - e) - 0.5) ** 2 / e).sum())
    assert found["mar_indicator"] == (stats.chi2_p_value(found["chi2"]) < 0.05)


def test_multiclass_golden(spark):
    pairs = [("normal", "normal"), (" normal", "normal"), ("normal", "pneumonia"), ("pneumonia", "pneumonia"), ("pneumonia", "pneumonia\t"), ("pneumonia", "edema"), ("edema", "edema"), ("edema", "edema"), ("edema", "normal")]
    df = spark.createDataFrame(pairs, "y_true string, y_pred_label string")
    s = {r["metric"]: r["value"] for r in multiclass.summary(df).collect()}
    assert s["accuracy"] == pytest.approx(6 / 9) and s["balanced_accuracy"] == pytest.approx(2 / 3) and s["macro_f1"] == pytest.approx(2 / 3) and s["cohen_kappa"] == pytest.approx(0.5)
    normal = next(r for r in multiclass.per_class(df).collect() if r["label"] == "normal")
    assert (normal["support"], normal["tp"], normal["fp"], normal["fn"]) == (3, 2, 1, 1) and normal["specificity"] == pytest.approx(5 / 6)
    one = spark.createDataFrame([("normal", "edema")], "y_true string, y_pred_label string")
    assert next(r["value"] for r in multiclass.summary(one).collect() if r["metric"] == "balanced_accuracy") == 0.0
    assert None in [r["specificity"] for r in multiclass.per_class(one).collect()]
    assert {(r[0], r[1]): r[2] for r in multiclass.confusion_matrix(df).collect()}[("edema", "pneumonia")] == 0


@pytest.fixture(scope="module")
def two_versions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        y = int(rng.random() < 0.4)
        for v, gap in (("v1.0", 0.4), ("v2.0", 0.15)):
            rows.append(row(i, y, round(float(np.clip(0.3 + gap * y + rng.normal(0, 0.15), 0, 1)), 2), i // 5, v, patient=f"q{i:03d}"))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_delong_placements_match_numpy(two_versions):
    df, rows = two_versions
    y = np.array([r[3] for r in rows[::2]])
    s = [np.array([r[4] for r in rows[k::2]]) for k in (0, 1)]
    values = []
    for x in s:
        order = np.lexsort((np.arange(len(y)), y, -x))
        ys = y[order]
        v = np.empty(len(y))
        v[order] = np.cumsum(ys == 1) / (y == 1).sum() - (np.cumsum(ys == 0) - (ys == 0)) / (y == 0).sum()
        values.append(v[y == 1])
    n = (y == 0).sum()
    found = versions.delong(df).first()
    assert found["auroc_a"] == pytest.approx(auc(y, s[0])) and found["auroc_b"] == pytest.approx(auc(y, s[1]))
    assert found["var_a"] == pytest.approx(values[0].var(ddof=1) / n) and found["var_b"] == pytest.approx(values[1].var(ddof=1) / n)
    assert found["cov_ab"] == pytest.approx(((values[0] - values[0].mean()) * (values[1] - values[1].mean())).mean() / n)
    test = versions.delong_tests(df)[0]
    assert test["p_value"] < 0.05 and test["ci_lower"] < test["auc_diff"] < test["ci_upper"]


def test_textbook_delong(two_versions):
    df, rows = two_versions
    y = np.array([r[3] for r in rows[::2]])
    parts = []
    for k in (0, 1):
        x = np.array([r[4] for r in rows[k::2]])
        psi = (x[y == 1][:, None] > x[y == 0]) + (x[y == 1][:, None] == x[y == 0]) / 2
        parts.append((psi.mean(1), psi.mean(0)))
    var = np.var(parts[0][0] - parts[1][0], ddof=1) / (y == 1).sum() + np.var(parts[0][1] - parts[1][1], ddof=1) / (y == 0).sum()
    assert versions.delong(df, "delong1988").first()["se_diff"] == pytest.approx(math.sqrt(var))


def test_small_or_differing_pairs_are_not_compared(spark):
    rows = [row(i, i % 2, 0.3 + i % 2 * 0.4, version=v, patient=f"q{i}") for i in range(10) for v in ("a", "b")]
    assert versions.delong(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_alert_rules(spark):
    bad = {"current_auroc": 0.70, "baseline_auroc": 0.92, "current_sensitivity": 0.65, "current_specificity": 0.60, "psi": 0.30, "subgroup_gap": 0.15}
    report = alerts.check_alerts(spark, **bad)
    assert [a["rule"] for a in report.alerts] == ["min_auroc", "max_auroc_drop_relative", "min_sensitivity", "min_specificity", "psi_major", "max_subgroup_sens_gap"]
    assert (report.n_critical, report.n_warning) == (5, 1)
    assert "observed 0.2391 (now 0.7000, then 0.9200), limit 0.0500" in report.alerts[1]["message"]
    minor = alerts.check_alerts(spark, psi=0.15)
    assert [(a["rule"], a["severity"]) for a in minor.alerts] == [("psi_minor", "warning")]
    assert alerts.check_alerts(spark).is_clean
    assert alerts.check_alerts(spark, AlertThresholds(min_auroc=0.6), current_auroc=0.7).is_clean


def plain_statistics(y, p):
    """AUROC, AUPRC and Brier score by definition."""
    pos, neg = p[y == 1], p[y == 0]
    won = (pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2
    precision = [(pos >= v).sum() / ((pos >= v).sum() + (neg >= v).sum()) for v in pos]
    return {"auroc": won / (len(pos) * len(neg)), "auprc": np.mean(precision), "brier": ((p - y) ** 2).mean()}


@pytest.mark.parametrize("slice_rows", [2, 50_000])
def test_jackknife_matches_leaving_rows_out(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(bootstrap, "score_cuts", lambda groups: ordered.score_cuts(groups, slice_rows=slice_rows))
    rng = np.random.default_rng(2)
    p = rng.integers(0, 9, 40) / 8
    y = (rng.random(40) < 0.4).astype(int)
    df = spark.createDataFrame([row(i, int(a), b) for i, (a, b) in enumerate(zip(y, p, strict=True))], SCHEMA)
    found = {r["metric"]: r for r in bootstrap.jackknife_moments(df).collect()}
    keep = [np.arange(40) != i for i in range(40)]
    for name, whole in plain_statistics(y, p).items():
        left = np.array([plain_statistics(y[k], p[k])[name] for k in keep])
        d = left - left.mean()
        want = (40, whole, left.mean(), 40 * (d**2).sum(), 1600 * (d**3).sum())
        assert tuple(found[name])[1:] == pytest.approx(want, rel=1e-6, abs=1e-9)
    single = df.filter("y_true = 0")
    assert [r["metric"] for r in bootstrap.jackknife_moments(single).collect()] == ["brier"]
    assert bootstrap.jackknife_moments(df.limit(0)).collect() == []


def test_bootstrap_holds_the_point(drifting):
    df, rows = drifting
    found = bootstrap.intervals(df, resamples=60)
    assert all(r["ci_lower"] < r["estimate"] < r["ci_upper"] and r["n_valid"] == 60 for r in found)
    assert found == bootstrap.intervals(df.repartition(3), resamples=60)
    y, p = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    rng = np.random.default_rng(1)
    drawn = [plain_statistics(y[i], p[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(200))]
    for r in found:
        low, high = np.quantile([d[r["metric"]] for d in drawn], [0.025, 0.975])
        assert abs(r["ci_lower"] - low) < 0.5 * (high - low) and abs(r["ci_upper"] - high) < 0.5 * (high - low)
    assert {r["estimate"] for r in bootstrap.intervals(df.limit(0), resamples=5)} == {None}


def test_bootstrap_in_slices(drifting, monkeypatch):
    df, _ = drifting
    whole = {r["metric"]: r for r in bootstrap.intervals(df, resamples=300)}
    monkeypatch.setattr(bootstrap, "score_cuts", lambda groups: ordered.score_cuts(groups, slice_rows=40))
    for r in bootstrap.intervals(df, resamples=300):
        other = whole[r["metric"]]
        width = other["ci_upper"] - other["ci_lower"]
        assert r["estimate"] == pytest.approx(other["estimate"]) and r["n_valid"] == 300
        assert abs(r["ci_lower"] - other["ci_lower"]) < 0.3 * width and abs(r["ci_upper"] - other["ci_upper"]) < 0.3 * width


def test_site_calibration(drifting):
    df, _ = drifting
    found = {r["site"]: r for r in calibration.site_calibration(df).collect()}
    assert {r["status"] for r in found.values()} == {"ok"} and set(found) == {"A", "B"}
    few = calibration.site_calibration(df, min_n=10**6).collect()
    assert {r["status"] for r in few} == {"insufficient_data"} and {r["baseline_brier"] for r in few} == {None}


def test_exact_kolmogorov_smirnov_p_value():
    from itertools import combinations

    from tidewatch.functions.stats import kolmogorov_p_value

    for n, m in ((4, 6), (5, 5), (7, 3), (1, 4)):
        for q in (1, 3, 5, 8, 12, n * m):
            far = whole = 0
            for own in combinations(range(n + m), n):
                steps = np.isin(np.arange(n + m), own)
                far += np.abs(np.cumsum(steps) * m - np.cumsum(~steps) * n).max() >= q
                whole += 1
            assert q > n * m or kolmogorov_p_value(q / (n * m), n, m) == pytest.approx(far / whole)
    assert kolmogorov_p_value(0.02, 10_000, 10_000) == pytest.approx(0.0366, abs=2e-4)
    assert kolmogorov_p_value(0.02, 20_000, 20_000) == pytest.approx(6.7e-4, rel=0.05)


def test_phases_of_equal_rows_and_null_dates(spark):
    same = [row(1, 1, 0.5, patient="p")] * 40
    df = spark.createDataFrame(same, SCHEMA)
    sizes = {r["phase"]: r["count"] for r in split.with_phase(df, 0.3).groupBy("phase").count().collect()}
    assert sizes == {"reference": 12, "current": 28}
    both = split.with_phases(df, {"a": (0.3, "drift"), "b": (0.5, "baseline")}).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"]): r["count"] for r in both}[("current", "current")] <= 20 and sum(r["count"] for r in both) == 40
    assert split.with_phase(df.filter("1 = 0")).count() == 0


def test_logistic_fit_is_exact_for_crowded_scores(spark):
    from tidewatch.operators import calibration

    rng = np.random.default_rng(3)
    p = rng.random(400) * 1e-4 + 2e-6
    y = (rng.random(400) < p * 5000).astype(int)
    df = spark.createDataFrame([row(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], SCHEMA)
    found = calibration.intercept_slope(df).first()
    x = np.log(p) - np.log1p(-p)
    q = 1 / (1 + np.exp(-(found["intercept"] + found["slope"] * x)))
    assert abs((q - y).sum() + 2e-6 * found["intercept"]) < 1e-4 and abs(((q - y) * x).sum() + 2e-6 * found["slope"]) < 1e-3
    one = spark.createDataFrame([row(i, i % 2, 0.5) for i in range(10)], SCHEMA)
    assert tuple(calibration.intercept_slope(one).first()) == (None, None)
    assert calibration.intercept_slope(one.filter("1 = 0"), ["site"]).count() == 0


def test_stored_tables_go_at_the_end_of_their_block(spark):
    from pathlib import Path

    from tidewatch.session import scratch, shared_dir, stored

    with scratch(spark):
        kept = stored(spark.range(5), "tried")
        assert kept.count() == 5 and list(Path(shared_dir(spark)).glob("tried-*"))
    assert not list(Path(shared_dir(spark)).glob("tried-*"))


def test_slices_are_equally_deep_where_scores_crowd(spark):
    scores = spark.range(40_000).select((F.pow(F.rand(3), F.lit(8)) * 1e-5).alias("score"), (F.col("id") % 7).alias("np"), (F.col("id") % 3).alias("nn"))
    groups = stored(scores, "groups")
    cuts = ordered.score_cuts(groups, slice_rows=1000)
    sizes = [r["count"] for r in ordered.with_slices(groups, cuts).groupBy("_slice").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 1000
    for down in (False, True):
        sums = [ordered.cumulated(groups, ["np", "nn"], descending=down, cuts=c).orderBy("score").collect() for c in (cuts, [])]
        assert sums[0] == sums[1]
    keyed = groups.withColumn("key", F.when(F.col("np") > 1, F.col("np")))
    sums = [ordered.cumulated(keyed, ["nn"], ["key"], cuts=c).orderBy("score").collect() for c in (cuts, [])]
    assert sums[0] == sums[1] and len(sums[0]) == 40_000
    assert ordered.score_cuts(groups.limit(0)) == []


@pytest.mark.parametrize("looked_at", [3, 10_000])
def test_boundary_in_ranges(spark, monkeypatch, looked_at):
    monkeypatch.setattr(split, "LOOKED_AT", looked_at)
    monkeypatch.setattr(split, "RANGES", 5)
    rows = [row(i, i % 2, i % 5 / 5, 0, patient=f"p{i * 37 % 101:03}", site=None if i % 3 else "A") for i in range(300)]
    df = spark.createDataFrame([(*r, i // 4) for i, r in enumerate(rows)], SCHEMA + ", extra int")
    for fraction in (0.1, 0.31, 0.5, 0.9):
        phased = split.with_phase(df, fraction)
        cut = split.cut(300, fraction, "drift")
        key = lambda r: tuple((v is not None, v) for v in (r[:6] + r[6:7] + r[7:12]))
        want = sorted((r[:12] for r in map(tuple, df.collect())), key=key)[:cut]
        assert sorted((tuple(r)[:12] for r in phased.filter("phase = 'reference'").collect()), key=key) == want
        assert phased.count() == 300


def test_boundary_among_copies(spark, monkeypatch):
    monkeypatch.setattr(split, "_CHUNK", 7)
    same = [(*row(1, 1, 0.5, patient="p"), i // 30) for i in range(90)]
    df = spark.createDataFrame(same, SCHEMA + ", extra int")
    phased = split.with_phases(df, {"a": (0.4, "drift"), "b": (0.4, "baseline"), "c": (0.8, "drift")})
    assert {tuple(r) for r in phased.groupBy("a", "b", "c").count().collect()} == {("reference", "reference", "reference", 36), ("current", "current", "reference", 36), ("current", "current", "current", 18)}
    assert {r["extra"]: r["count"] for r in phased.groupBy("extra").count().collect()} == {0: 30, 1: 30, 2: 30}
    window = split.with_phases(df, {"a": (0.4, "drift")})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in window


def test_fit_of_separated_and_plain_scores(spark):
    rng = np.random.default_rng(4)
    sets = {"plain": (rng.random(400) < 0.3, rng.random(400)), "apart": (np.arange(60) >= 30, np.where(np.arange(60) >= 30, 0.9, 0.1)), "far": (np.arange(60) >= 30, np.linspace(1e-7, 1 - 1e-7, 60))}
    rows = [row(i, int(a), float(b), site=name) for name, (y, p) in sets.items() for i, (a, b) in enumerate(zip(y, p, strict=True))]
    found = {r["site"]: r for r in calibration.intercept_slope(spark.createDataFrame(rows, SCHEMA), ["site"]).collect()}
    for name, (y, p) in sets.items():
        q = np.clip(p, 1e-6, 1 - 1e-6)
        a, b = calibration._newton(np.log(q / (1 - q)), y.astype(float), 1 - y.astype(float))
        assert (found[name]["intercept"], found[name]["slope"]) == pytest.approx((a, b), rel=1e-6, abs=1e-6)


def paired_rows(seed):
    """Patients with several rows a version; scores repeat between patients, not within one."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        y = int(rng.random() < 0.5)
        for version in ("v1", "v2"):
            for p in rng.choice(12, rng.integers(1, 5), replace=False) / 12:
                rows.append(row(len(rows), y, min(1.0, p + 0.2 * y), version=version, patient=f"q{i:03}"))
    return rows


def plain_placement(rows):
    pairs = sorted((a[0], a[4], b[4], a[3]) for a in rows for b in rows if a[0] == b[0] and a[2] == "v1" and b[2] == "v2")
    pos, neg = [x for x in pairs if x[3] == 1], [x for x in pairs if x[3] == 0]
    p, n = len(pos), len(neg)
    values = []
    for s in (1, 2):
        by_score = {}
        for i, x in enumerate(pos):
            by_score.setdefault(x[s], []).append(i)
        v = np.empty(p)
        for score, own in by_score.items():
            above, reached = sum(x[s] > score for x in pos), sum(x[s] >= score for x in neg)
            own.sort(key=lambda i: pos[i])
            for nth, i in enumerate(own, 1):
                v[i] = (above + nth) / p - reached / n
        values.append(v)
    a, b = values
    return p, n, np.var(a, ddof=1) / n, np.var(b, ddof=1) / n, ((a - a.mean()) * (b - b.mean())).mean() / n


@pytest.mark.parametrize("tied", [0, 100_000])
def test_placements_of_patients_with_many_rows(spark, monkeypatch, tied):
    monkeypatch.setattr(versions, "TIED", tied)
    rows = paired_rows(6)
    found = versions.delong(spark.createDataFrame(rows, SCHEMA)).first()
    p, n, var_a, var_b, cov = plain_placement(rows)
    assert (found["n_pos"], found["n_neg"]) == (p, n)
    assert (found["var_a"], found["var_b"], found["cov_ab"]) == pytest.approx((var_a, var_b, cov))


def test_a_patient_with_very_many_rows(spark):
    """Half the rows have one score, and one patient has 10^5 rows: 2.5 x 10^9 pairs that are never made."""
    ids = spark.range(100_000).withColumn("half", F.col("id") % 2)
    hot = ids.select(F.lit("hot").alias("patient_id"), (F.col("half") + 1).cast("string").alias("model_version"), F.lit(1).alias("y_true"), F.when(F.col("id") % 4 < 2, 0.5).otherwise(F.col("id") / 100_000).alias("y_pred_proba"))
    others = spark.range(200).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("patient_id"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("model_version"), F.lit(0).alias("y_true"), (F.col("id") / 500).alias("y_pred_proba"))
    df = hot.unionByName(others)
    assert versions.pair_summary(df).select("n_pairs", "n_patients", "comparable").first() == (2_500_000_200, 201, True)
    found = {m: versions.delong(df, m).first() for m in ("placement", "delong1988")}
    assert {r["n_pos"] for r in found.values()} == {2_500_000_000} and found["placement"]["auroc_a"] == pytest.approx(found["delong1988"]["auroc_a"])


@pytest.mark.parametrize("tied", [100_000, 10])
@pytest.mark.parametrize("method", ["placement", "delong1988"])
def test_delong_partitions_follow_the_rows(spark, two_versions, monkeypatch, method, tied):
    df, rows = two_versions
    want = versions.delong(df, method).first()
    monkeypatch.setattr(versions, "TIED", tied)
    monkeypatch.setattr(versions, "TASK_ROWS", len(rows) // 40)
    again = versions.delong(df, method)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(patient_id" in plan and ", 40), REPARTITION_BY_NUM" in plan
    assert again.first().asDict() == pytest.approx(want.asDict())

"""SQL that recomputes the queries of the catalog from the given tables."""

from __future__ import annotations

from .monitoring import MONITORING_SQL, MULTICLASS_SQL

COUNTS = """count(*) AS n, CAST(count_if(y_true=1 AND y_pred_binary=1) AS BIGINT) AS tp, CAST(count_if(y_true=0 AND y_pred_binary=1) AS BIGINT) AS fp,
  CAST(count_if(y_true=0 AND y_pred_binary=0) AS BIGINT) AS tn, CAST(count_if(y_true=1 AND y_pred_binary=0) AS BIGINT) AS fn"""
STRATIFIERS = ("age_group", "sex", "race_ethnicity", "site", "scanner_manufacturer", "modality")
ORDER = "study_date, patient_id, model_version, y_true, y_pred_proba, y_pred_binary, site NULLS FIRST, scanner_manufacturer NULLS FIRST, modality NULLS FIRST, age_group NULLS FIRST, sex NULLS FIRST, race_ethnicity NULLS FIRST"


def _r(x: str) -> str:
    """Rounded, NULL where a denominator is 0 (DuckDB's division then gives NaN or infinity)."""
    return f"round(CAST({x} AS DOUBLE), 6)"


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def _edges(bins: int) -> list[str]:
    return [repr(i * (1.0 / bins)) for i in range(1, bins)]


def _left_bin(bins: int, x: str = "y_pred_proba") -> str:
    return "(" + " + ".join(f"CASE WHEN {x} >= CAST({e} AS DOUBLE) THEN 1 ELSE 0 END" for e in _edges(bins)) + ")"


def _right_bin(bins: int, x: str = "y_pred_proba") -> str:
    return "(" + " + ".join(f"CASE WHEN {x} > CAST({e} AS DOUBLE) THEN 1 ELSE 0 END" for e in _edges(bins)) + ")"


RATES = {
    "sensitivity": _ratio("tp", "tp+fn"), "specificity": _ratio("tn", "tn+fp"), "ppv": _ratio("tp", "tp+fp"), "npv": _ratio("tn", "tn+fn"),
    "accuracy": _ratio("tp+tn", "tp+fp+tn+fn"), "f1": _ratio("2*tp", "2*tp+fp+fn"), "prevalence": _ratio("tp+fn", "tp+fp+tn+fn"),
}
TRIALS = {"sensitivity": ("tp", "tp+fn"), "specificity": ("tn", "tn+fp"), "ppv": ("tp", "tp+fp"), "npv": ("tn", "tn+fn"), "accuracy": ("tp+tn", "tp+fp+tn+fn")}
Z = "CAST(1.9599639845400536 AS DOUBLE)"


def _wilson(k: str, n: str, sign: str) -> str:
    p, m = _ratio(k, n), f"nullif(CAST({n} AS DOUBLE), 0)"
    return f"(({p} + {Z}*{Z}/(2*{m}) {sign} {Z}*sqrt({p}*(1-{p})/{m} + {Z}*{Z}/(4*{m}*{m}))) / (1 + {Z}*{Z}/{m}))"


STRATA = "strata AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS stratifier, {c} AS level, {COUNTS} FROM mon WHERE {c} IS NOT NULL GROUP BY {c}" for c in STRATIFIERS
) + "), metrics AS (SELECT stratifier, level, n, " + ", ".join(f"{v} AS {k}" for k, v in RATES.items()) + ", tp, fp, tn, fn FROM (SELECT stratifier, level, n, " + ", ".join(
    f"CASE WHEN n >= 10 THEN {c} ELSE 0 END AS {c}" for c in ("tp", "fp", "tn", "fn")
) + " FROM strata))"
GAPS = "gaps AS (SELECT stratifier, count(sensitivity) AS levels, CASE WHEN count(sensitivity) >= 2 THEN max(sensitivity) - min(sensitivity) ELSE 0e0 END AS gap FROM metrics GROUP BY stratifier)"
RANKED = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place, count(*) OVER () AS total FROM mon)"
PHASED = RANKED + ", " + "phased AS (SELECT *, CASE WHEN place <= greatest(CAST(floor(total * CAST(0.3 AS DOUBLE)) AS BIGINT), 10) THEN 'reference' ELSE 'current' END AS phase, " + (
    "CASE WHEN place <= greatest(least(CAST(floor(total * CAST(0.3 AS DOUBLE)) AS BIGINT), total - 1), 1) THEN 'reference' ELSE 'current' END AS base_phase FROM ranked)"
)


def _auroc(source: str, keys: str = "") -> str:
    """A subquery of AUROC by pairwise counting over distinct scores."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"(SELECT {k}sum(p) AS n_pos, sum(q) AS n_neg, sum(p * (below + q / 2e0)) / nullif(CAST(sum(p) AS DOUBLE) * sum(q), 0) AS auroc FROM "
        f"(SELECT {k}p, q, coalesce(sum(q) OVER ({part}ORDER BY y_pred_proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
        f"(SELECT {k}y_pred_proba, count_if(y_true=1) AS p, count_if(y_true=0) AS q FROM {source} GROUP BY {k}y_pred_proba)) {group})"
    )


DOWN = """pts AS (
  SELECT y_pred_proba AS s, count_if(y_true=1) AS p, count_if(y_true=0) AS q FROM mon GROUP BY 1
), down AS (
  SELECT s, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, lead(p) OVER (ORDER BY s DESC) AS np, lead(q) OVER (ORDER BY s DESC) AS nq,
    sum(p) OVER () AS pos, sum(q) OVER () AS neg
  FROM pts WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
)"""
#: The ranking statistics with one row left out, by what the row's score and label take away.
LEFT_OUT = """parts AS (
  SELECT *, coalesce(p * tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS a, coalesce(p * tp / nullif(CAST(tp + fp - 1 AS DOUBLE), 0), 0) AS b,
    coalesce(p * (tp - 1) / nullif(CAST(tp - 1 + fp AS DOUBLE), 0), 0) AS c, coalesce((p - 1) * (tp - 1) / nullif(CAST(tp - 1 + fp AS DOUBLE), 0), 0) AS own,
    neg - fp + q / 2e0 AS won, tp - p + p / 2e0 AS lost FROM down
), whole AS (
  SELECT sum(p * won) AS pairs, sum(a) AS area, sum(p * (1 - s) * (1 - s) + q * s * s) AS squares, max(pos) AS pos, max(neg) AS neg FROM parts
), placed AS (
  SELECT parts.*, coalesce(sum(a) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(b) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS from_here, coalesce(sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM parts
), left_out AS (
  SELECT 'auroc' AS metric, p AS w, (pairs - won) / (CAST(whole.pos - 1 AS DOUBLE) * whole.neg) AS v, pairs / (CAST(whole.pos AS DOUBLE) * whole.neg) AS estimate FROM placed, whole
  UNION ALL SELECT 'auroc', q, (pairs - lost) / (CAST(whole.neg - 1 AS DOUBLE) * whole.pos), pairs / (CAST(whole.pos AS DOUBLE) * whole.neg) FROM placed, whole
  UNION ALL SELECT 'auprc', p, (above + own + after) / (whole.pos - 1), area / whole.pos FROM placed, whole
  UNION ALL SELECT 'auprc', q, (above + from_here) / whole.pos, area / whole.pos FROM placed, whole
  UNION ALL SELECT 'brier', p, (squares - (1 - s) * (1 - s)) / (whole.pos + whole.neg - 1), squares / (whole.pos + whole.neg) FROM placed, whole
  UNION ALL SELECT 'brier', q, (squares - s * s) / (whole.pos + whole.neg - 1), squares / (whole.pos + whole.neg) FROM placed, whole
), means AS (SELECT metric, sum(w) AS n, max(estimate) AS estimate, sum(w * v) / sum(w) AS mean FROM left_out WHERE w > 0 GROUP BY metric)"""
SHARES = f"""bins AS (SELECT {_left_bin(10)} AS bin, count_if(phase='reference') AS r, count_if(phase='current') AS c FROM phased GROUP BY 1),
shares AS (SELECT g.i AS bin, coalesce(r, 0) / CAST(sum(r) OVER () AS DOUBLE) AS r, coalesce(c, 0) / CAST(sum(c) OVER () AS DOUBLE) AS c, sum(r) OVER () AS rn, sum(c) OVER () AS cn
  FROM (SELECT unnest(range(10)) AS i) g LEFT JOIN bins ON g.i = bins.bin)"""
PSI = "psi AS (SELECT max(rn) AS reference_n, max(cn) AS current_n, sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))) AS psi FROM shares)"
CDF = """scores AS (SELECT y_pred_proba AS s, count_if(phase='reference') AS r, count_if(phase='current') AS c FROM phased GROUP BY 1),
cdf AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt, sum(r) OVER w / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(c) OVER w / CAST(sum(c) OVER () AS DOUBLE) AS fc,
  sum(r) OVER () AS rn, sum(c) OVER () AS cn FROM scores WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING))"""
WINDOWS = """span AS (SELECT min(study_date) AS first_date, greatest(1, CAST(floor(date_diff('day', min(study_date), max(study_date)) / 15) AS BIGINT) + 1) AS n_windows FROM mon),
win AS (SELECT unnest(range(n_windows)) AS w, first_date FROM span),
bounds AS (SELECT w, first_date + to_days(CAST(w * 15 AS INTEGER)) AS lo, first_date + to_days(CAST(w * 15 + 30 AS INTEGER)) AS hi, first_date + to_days(CAST(w * 15 + 15 AS INTEGER)) AS center FROM win),
hits AS (SELECT w, y_true, y_pred_proba FROM bounds JOIN mon ON study_date >= lo AND study_date < hi)"""
ROLLING = WINDOWS + ", rolled AS (SELECT b.w AS wnd, b.center, coalesce(a.n_pos + a.n_neg, 0) AS n, CASE WHEN a.n_pos + a.n_neg >= 20 THEN a.auroc END AS auroc FROM bounds b LEFT JOIN " + _auroc("hits", "w") + " a ON a.w = b.w)"
PAIRS = """pr AS (SELECT a.model_version AS version_a, b.model_version AS version_b, a.patient_id, a.y_true AS y, b.y_true AS y2, a.y_pred_proba AS sa, b.y_pred_proba AS sb
  FROM mon a JOIN mon b ON a.patient_id = b.patient_id AND a.model_version < b.model_version)"""


def _placed(s: str) -> str:
    return f"""place_{s} AS (
  SELECT s{s} AS score, p, q, coalesce(sum(p) OVER (ORDER BY s{s} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(q) OVER (ORDER BY s{s} DESC ROWS UNBOUNDED PRECEDING) AS reached, coalesce(sum(q) OVER (ORDER BY s{s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    coalesce(sum(p) OVER (ORDER BY s{s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pbelow, sum(p) OVER () AS pos, sum(q) OVER () AS neg
  FROM (SELECT s{s}, count_if(y=1) AS p, count_if(y=0) AS q FROM pr GROUP BY 1))"""


VALUES = PHASED + ", " + SHARES + ", " + PSI + ", " + STRATA + ", " + GAPS + ", areas AS (SELECT * FROM " + _auroc("(SELECT base_phase AS ph, y_true, y_pred_proba FROM phased)", "ph") + f"""),
nowc AS (SELECT {COUNTS} FROM phased WHERE base_phase = 'current'),
vals AS (SELECT (SELECT auroc FROM areas WHERE ph='current') AS ca, (SELECT auroc FROM areas WHERE ph='reference') AS ba,
  (SELECT {RATES['sensitivity']} FROM nowc) AS se, (SELECT {RATES['specificity']} FROM nowc) AS sp, (SELECT psi FROM psi) AS psi, (SELECT coalesce(max(gap), 0e0) FROM gaps) AS gap),
alerts AS (
  SELECT 'critical' AS severity, 'min_auroc' AS rule, ca AS observed, 8e-1 AS threshold FROM vals WHERE ca < 8e-1
  UNION ALL SELECT 'critical', 'max_auroc_drop_relative', (ba - ca) / ba, 5e-2 FROM vals WHERE ba > 0 AND (ba - ca) / ba > 5e-2
  UNION ALL SELECT 'critical', 'min_sensitivity', se, 8e-1 FROM vals WHERE se < 8e-1
  UNION ALL SELECT 'critical', 'min_specificity', sp, 8e-1 FROM vals WHERE sp < 8e-1
  UNION ALL SELECT 'critical', 'psi_major', psi, 25e-2 FROM vals WHERE psi >= 25e-2
  UNION ALL SELECT 'warning', 'psi_minor', psi, 1e-1 FROM vals WHERE psi >= 1e-1 AND psi < 25e-2
  UNION ALL SELECT 'warning', 'max_subgroup_sens_gap', gap, 5e-2 FROM vals WHERE gap > 5e-2)"""
SITES = f"""sited AS (SELECT site, base_phase AS phase, y_true, y_pred_proba FROM phased WHERE site IS NOT NULL),
sb AS (SELECT site, phase, count(*) AS n, avg((y_pred_proba - y_true) * (y_pred_proba - y_true)) AS brier FROM sited GROUP BY ALL),
se AS (SELECT site, phase, sum(n * abs(o - p)) / sum(n) AS ece FROM (SELECT site, phase, {_right_bin(10)} AS bin, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS o, avg(y_pred_proba) AS p FROM sited GROUP BY ALL) GROUP BY ALL),
wide AS (SELECT site, coalesce(max(CASE WHEN phase='reference' THEN n END), 0) AS baseline_n, coalesce(max(CASE WHEN phase='current' THEN n END), 0) AS current_n,
  max(CASE WHEN phase='reference' THEN brier END) AS bb, max(CASE WHEN phase='current' THEN brier END) AS cb,
  max(CASE WHEN phase='reference' THEN ece END) AS be, max(CASE WHEN phase='current' THEN ece END) AS ce FROM sb JOIN se USING (site, phase) GROUP BY site)"""
CLASSES = """lab AS (SELECT DISTINCT unnest([t, p]) AS label FROM mc), tot AS (SELECT count(*) AS total FROM mc),
cls AS (SELECT label, (SELECT count(*) FROM mc WHERE t = label) AS support, (SELECT count(*) FROM mc WHERE p = label) AS predicted,
  (SELECT count(*) FROM mc WHERE t = label AND p = label) AS tp FROM lab),
per AS (SELECT *, predicted - tp AS fp, support - tp AS fn, total - support - predicted + tp AS tn FROM cls, tot),
met AS (SELECT *, coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS sensitivity, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity,
  coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0) AS ppv, tn / nullif(CAST(tn + fn AS DOUBLE), 0) AS npv, coalesce(2 * tp / nullif(CAST(support + predicted AS DOUBLE), 0), 0) AS f1 FROM per)"""
MESSAGES = {
    "min_auroc": "AUROC is too low", "min_sensitivity": "Sensitivity is too low", "min_specificity": "Specificity is too low", "psi_major": "Scores have shifted strongly (PSI)",
    "psi_minor": "Scores have shifted somewhat (PSI)", "max_subgroup_sens_gap": "Sensitivity differs too much between subgroups",
}
TITLES = {"sensitivity": "Sensitivity", "specificity": "Specificity", "ppv": "PPV", "npv": "NPV", "accuracy": "Accuracy", "f1": "F1", "prevalence": "Prevalence"}
INT = lambda x: f"CAST({x} AS BIGINT)"


def _newton(source: str, keys: str) -> str:
    """Tables lx (counts by logit) and newton (25 steps of the ridged logistic fit from intercept 0 and slope 1)."""
    own = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"""lx AS (SELECT *, ln(q) - ln(1 - q) AS x FROM (SELECT {keys}, least(greatest(y_pred_proba, 1e-6), 1 - 1e-6) AS q, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM {source} GROUP BY ALL)),
newton AS (SELECT DISTINCT {keys}, 0 AS k, 0e0 AS a, 1e0 AS b FROM lx UNION ALL
  SELECT {keys}, k + 1, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT {own}, k, a, b, sum((pos + neg) / (1 + exp(-a - b * x)) - pos) + 2e-6 * a AS g0, sum(x * ((pos + neg) / (1 + exp(-a - b * x)) - pos)) + 2e-6 * b AS g1,
      sum((pos + neg) / (1 + exp(-a - b * x)) / (1 + exp(a + b * x))) + 2e-6 AS h0, sum(x * (pos + neg) / (1 + exp(-a - b * x)) / (1 + exp(a + b * x))) AS h1,
      sum(x * x * (pos + neg) / (1 + exp(-a - b * x)) / (1 + exp(a + b * x))) + 2e-6 AS h2
    FROM newton n JOIN lx ON {" AND ".join(f"n.{k} = lx.{k}" for k in keys.split(", "))} WHERE k < 25 GROUP BY {own}, k, a, b))"""


def _missing() -> str:
    """Missing counts and Yates's chi-square for each stratifier."""
    parts = []
    for c in STRATIFIERS:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, count(*) AS n_total, count_if({c} IS NULL AND y_true=1) AS a, count_if({c} IS NULL AND y_true=0) AS b, "
            f"count_if({c} IS NOT NULL AND y_true=1) AS c, count_if({c} IS NOT NULL AND y_true=0) AS d FROM mon"
        )
    chi = "CASE WHEN a+b > 0 AND c+d > 0 AND a+c > 0 AND b+d > 0 THEN power(greatest(0, abs(CAST(a AS DOUBLE)*d - CAST(b AS DOUBLE)*c) - (a+b+c+d) / 2e0), 2) * (a+b+c+d) / (CAST(a+b AS DOUBLE)*(c+d)*(a+c)*(b+d)) END"
    return "gone AS (" + " UNION ALL ".join(parts) + f'), prof AS (SELECT "column", n_missing, n_total, n_missing / CAST(n_total AS DOUBLE) AS pct_missing, TRUE AS is_metadata, {chi} AS chi2 FROM gone)'


def _fault(column: str, rule: str, condition: str) -> str:
    return f"SELECT '{column}' AS \"column\", '{rule}' AS rule, CAST(count_if({condition}) AS BIGINT) AS n FROM f"


def statements() -> dict[str, str]:
    mon, mc = MONITORING_SQL, MULTICLASS_SQL
    rate_columns = ", ".join(f"{_r(v)} AS {k}" for k, v in RATES.items())
    metric_rows = " UNION ALL ".join(
        f"SELECT '{k}' AS metric, {_r(v)} AS estimate, "
        + (f"{_r(f'greatest({_wilson(*TRIALS[k], chr(45))}, 0)')} AS ci_lower, {_r(f'least({_wilson(*TRIALS[k], chr(43))}, 1)')} AS ci_upper FROM cc" if k in TRIALS else "CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper FROM cc")
        for k, v in RATES.items()
    )
    summary = {
        "n": "CAST(sum(support) AS DOUBLE)", "n_classes": "CAST(count(*) AS DOUBLE)", "accuracy": "sum(tp) / CAST(sum(support) AS DOUBLE)", "balanced_accuracy": "avg(CASE WHEN support > 0 THEN sensitivity END)",
        "macro_precision": "avg(ppv)", "macro_recall": "avg(sensitivity)", "macro_f1": "avg(f1)", "weighted_precision": "sum(support * ppv) / sum(support)", "weighted_recall": "sum(support * sensitivity) / sum(support)",
        "weighted_f1": "sum(support * f1) / sum(support)",
        "cohen_kappa": "(sum(tp) / CAST(sum(support) AS DOUBLE) - sum(CAST(support AS DOUBLE) * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support))) / (1 - sum(CAST(support AS DOUBLE) * predicted) / (CAST(sum(support) AS DOUBLE) * sum(support)))",
    }
    se = "sqrt(greatest((var_samp(va) + var_samp(vb) - 2 * covar_pop(va, vb)) / max(neg), 1e-15))"
    number = "CAST(substring(patient_id, 2) AS BIGINT)"
    return {
        "overall_2x2": _with(mon) + f"SELECT {COUNTS} FROM mon",
        "wilson_ci": _with(mon, f"cc AS (SELECT {COUNTS} FROM mon)") + metric_rows,
        "stratified_metrics": _with(mon, STRATA) + "SELECT stratifier, level, n, " + ", ".join(f"{_r(c)} AS {c}" for c in ("sensitivity", "specificity", "ppv", "npv", "accuracy", "prevalence")) + ", CASE WHEN sensitivity IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, tp, fp, tn, fn FROM metrics",
        "subgroup_gap": _with(mon, STRATA, GAPS) + f"SELECT stratifier, levels, {_r('gap')} AS gap FROM gaps",
        "version_summary": _with(mon) + f"SELECT model_version, n, tp, fp, tn, fn, {rate_columns} FROM (SELECT model_version, {COUNTS} FROM mon GROUP BY 1 HAVING count(*) >= 10)",
        "top_subgroups": _with(mon, STRATA) + f"SELECT stratifier || ': ' || level AS label, {_r('sensitivity')} AS value FROM metrics WHERE sensitivity IS NOT NULL ORDER BY sensitivity DESC, label LIMIT 24",
        "missing_profile": _with(mon, _missing()) + f'SELECT "column", n_missing, n_total, {_r("pct_missing")} AS pct_missing, is_metadata, {_r("chi2")} AS chi2, coalesce(chi2 > 3.841458820694124, FALSE) AS mar_indicator FROM prof',
        "mar_chi2": _with(mon, _missing()) + f'SELECT "column", {_r("chi2")} AS chi2 FROM prof WHERE chi2 > 3.841458820694124',
        "subgroup_availability": _with(mon) + " UNION ALL ".join(f"SELECT '{c}' AS stratifier, {c} AS level, count(*) AS n, (SELECT count({c}) FROM mon) AS n_available, {_r(f'(SELECT count({c}) / CAST(count(*) AS DOUBLE) FROM mon)')} AS pct_available FROM mon WHERE {c} IS NOT NULL GROUP BY {c}" for c in STRATIFIERS),
        "multiclass_confusion": _with(mc, CLASSES) + "SELECT a.label AS y_true, b.label AS y_pred_label, (SELECT count(*) FROM mc WHERE t = a.label AND p = b.label) AS n FROM lab a, lab b",
        "multiclass_per_class": _with(mc, CLASSES) + "SELECT label, support, predicted, tp, fp, fn, tn, " + ", ".join(f"{_r(c)} AS {c}" for c in ("sensitivity", "specificity", "ppv", "npv", "f1")) + " FROM met",
        "multiclass_summary": _with(mc, CLASSES) + " UNION ALL ".join(f"SELECT '{k}' AS metric, {_r(v)} AS value FROM met" for k, v in summary.items()),
        "label_space_union": _with(mc) + "SELECT count(DISTINCT x) AS n_labels FROM (SELECT t AS x FROM mc UNION ALL SELECT p FROM mc)",
        "summary_header": _with(mon) + f"SELECT count(*) AS n, {INT('sum(y_true)')} AS n_positive, strftime(min(study_date), '%Y-%m-%d') AS start_date, strftime(max(study_date), '%Y-%m-%d') AS end_date, string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_versions FROM mon",
        "multiclass_header": "SELECT count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS start_date, strftime(max(o_orderdate), '%Y-%m-%d') AS end_date, 'v1.0' AS model_versions FROM orders",
        "auroc": _with(mon) + f"SELECT {INT('n_pos')} AS n_pos, {INT('n_neg')} AS n_neg, {_r('auroc')} AS auroc FROM " + _auroc("mon"),
        "auprc": _with(mon, DOWN) + f"SELECT {_r('sum(p * tp / CAST(tp + fp AS DOUBLE)) / max(pos)')} AS auprc FROM down",
        "jackknife_moments": _with(mon, DOWN, LEFT_OUT) + f"""SELECT metric, {INT('max(n)')} AS n, {_r("max(means.estimate)")} AS estimate, {_r("max(mean)")} AS mean,
            {_r('max(n) * sum(w * (v - mean) * (v - mean))')} AS spread, {_r('CAST(max(n) AS DOUBLE) * max(n) * sum(w * (v - mean) * (v - mean) * (v - mean))')} AS skew
            FROM left_out JOIN means USING (metric) WHERE w > 0 GROUP BY metric""",
        "roc_points": _with(mon, DOWN) + f"SELECT {_r('s')} AS threshold, {_r('fp / CAST(neg AS DOUBLE)')} AS fpr, {_r('tp / CAST(pos AS DOUBLE)')} AS tpr FROM down WHERE np IS NULL OR np <> p OR nq <> q UNION ALL SELECT NULL, 0e0, 0e0",
        "pr_points": _with(mon, DOWN) + f"SELECT {_r('s')} AS threshold, {_r('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {_r('tp / CAST(pos AS DOUBLE)')} AS recall FROM down UNION ALL SELECT NULL, 1e0, 0e0",
        "brier_ece": _with(mon, f"cb AS (SELECT {_right_bin(10)} AS bin, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS o, avg(y_pred_proba) AS p FROM mon GROUP BY 1)") + f"SELECT (SELECT count(*) FROM mon) AS n, {_r('(SELECT avg((y_pred_proba - y_true) * (y_pred_proba - y_true)) FROM mon)')} AS brier, {_r('sum(n * abs(o - p)) / sum(n)')} AS ece FROM cb",
        "reliability_bins": _with(mon) + f"SELECT {_right_bin(10)} AS bin, count(*) AS n, {_r('avg(CAST(y_true AS DOUBLE))')} AS prob_true, {_r('avg(y_pred_proba)')} AS prob_pred FROM mon GROUP BY 1",
        "reference_current_split": _with(mon, PHASED) + "SELECT 'drift' AS kind, phase, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives, min(study_date) AS first_date, max(study_date) AS last_date FROM phased GROUP BY phase UNION ALL SELECT 'baseline', base_phase, count(*), CAST(sum(y_true) AS BIGINT), min(study_date), max(study_date) FROM phased GROUP BY base_phase",
        "psi": _with(mon, PHASED, SHARES, PSI) + f"SELECT {INT('reference_n')} AS reference_n, {INT('current_n')} AS current_n, {_r('psi')} AS psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'none' END AS psi_level FROM psi",
        "kl_divergence": _with(mon, PHASED, SHARES) + f"SELECT {_r('sum((r + 1e-10) / (1 + 1e-9) * ln((r + 1e-10) / (c + 1e-10)))')} AS kl_divergence FROM shares",
        "wasserstein_ks": _with(mon, PHASED, CDF) + f"SELECT {_r('sum(abs(fr - fc) * coalesce(nxt - s, 0))')} AS wasserstein, {_r('max(abs(fr - fc))')} AS ks_statistic, {INT('max(rn)')} AS reference_n, {INT('max(cn)')} AS current_n FROM cdf",
        "rolling_auroc": _with(mon, ROLLING) + f'SELECT wnd AS "window", center, {INT("n")} AS n, {_r("auroc")} AS auroc FROM rolled',
        "cusum": _with(mon, ROLLING, "ser AS (SELECT wnd, CASE WHEN row_number() OVER (ORDER BY wnd) = 1 THEN 0e0 ELSE auroc - avg(auroc) OVER () END AS d FROM rolled WHERE auroc IS NOT NULL)", "cum AS (SELECT wnd, sum(d) OVER (ORDER BY wnd ROWS UNBOUNDED PRECEDING) AS c FROM ser)", "held AS (SELECT wnd, c - min(c) OVER w AS hi, c - max(c) OVER w AS lo FROM cum WINDOW w AS (ORDER BY wnd ROWS UNBOUNDED PRECEDING))") + f'SELECT wnd AS "window", {_r("hi")} AS hi, {_r("lo")} AS lo, abs(hi) > 4 AS detected FROM held',
        "score_histogram": _with(mon) + f"SELECT model_version, bin, n, {_r('n * 30e0 / sum(n) OVER (PARTITION BY model_version)')} AS density FROM (SELECT model_version, {_left_bin(30)} AS bin, count(*) AS n FROM mon GROUP BY ALL)",
        "site_calibration_drift": _with(mon, PHASED, SITES) + "SELECT site, baseline_n, current_n, " + ", ".join(f"CASE WHEN baseline_n >= 30 AND current_n >= 30 THEN {_r(x)} END AS {k}" for k, x in (("baseline_brier", "bb"), ("current_brier", "cb"), ("brier_delta", "cb - bb"), ("baseline_ece", "be"), ("current_ece", "ce"), ("ece_delta", "ce - be"))) + ", CASE WHEN baseline_n >= 30 AND current_n >= 30 THEN 'ok' ELSE 'insufficient_data' END AS status FROM wide",
        "calibration_fit": "WITH RECURSIVE " + ", ".join((mon, _newton("(SELECT 1 AS one, * FROM mon)", "one"))) + f" SELECT {_r('a')} AS intercept, {_r('b')} AS slope FROM newton WHERE k = 25",
        "site_calibration_fit": "WITH RECURSIVE " + ", ".join((mon, PHASED, SITES, _newton("sited", "site, phase"), """fits AS (SELECT site, max(CASE WHEN phase='reference' THEN a END) AS ba, max(CASE WHEN phase='current' THEN a END) AS ca,
            max(CASE WHEN phase='reference' THEN b END) AS bs, max(CASE WHEN phase='current' THEN b END) AS cs FROM newton WHERE k = 25 GROUP BY site)""")) + " SELECT site, baseline_n, current_n, " + ", ".join(
            f"CASE WHEN baseline_n >= 30 AND current_n >= 30 THEN {_r(x)} END AS {k}" for name, b, c in (("brier", "bb", "cb"), ("ece", "be", "ce"), ("intercept", "ba", "ca"), ("slope", "bs", "cs"))
            for k, x in ((f"baseline_{name}", b), (f"current_{name}", c), (f"{name}_delta", f"{c} - {b}"))) + ", CASE WHEN baseline_n >= 30 AND current_n >= 30 THEN 'ok' ELSE 'insufficient_data' END AS status FROM wide JOIN fits USING (site)",
        "version_pairs_join": _with(mon, PAIRS) + "SELECT version_a, version_b, count(*) AS n_pairs, count(DISTINCT patient_id) AS n_patients, bool_and(y = y2) AS labels_agree, count(*) >= 20 AND count(DISTINCT patient_id) >= 20 AND bool_and(y = y2) AS comparable FROM pr GROUP BY ALL",
        "delong_components": _with(mon, PAIRS, _placed("a"), _placed("b"), "rows_ AS (SELECT version_a, version_b, y, patient_id, sa, sb, row_number() OVER (PARTITION BY sa ORDER BY patient_id, sa, sb) AS ta, row_number() OVER (PARTITION BY sb ORDER BY patient_id, sa, sb) AS tb FROM pr WHERE y = 1)", "vals_ AS (SELECT r.*, (a.above + ta) / CAST(a.pos AS DOUBLE) - a.reached / CAST(a.neg AS DOUBLE) AS va, (b.above + tb) / CAST(b.pos AS DOUBLE) - b.reached / CAST(b.neg AS DOUBLE) AS vb, (a.below + a.q / 2e0) / a.neg AS wa, (b.below + b.q / 2e0) / b.neg AS wb, a.pos, a.neg FROM rows_ r JOIN place_a a ON r.sa = a.score JOIN place_b b ON r.sb = b.score)") + f"SELECT version_a, version_b, {INT('max(pos)')} AS n_pos, {INT('max(neg)')} AS n_neg, {_r('avg(wa)')} AS auroc_a, {_r('avg(wb)')} AS auroc_b, {_r('avg(wa) - avg(wb)')} AS auc_diff, {_r('var_samp(va) / max(neg)')} AS var_a, {_r('var_samp(vb) / max(neg)')} AS var_b, {_r('covar_pop(va, vb) / max(neg)')} AS cov_ab, {_r(se)} AS se_diff, {_r(f'(avg(wa) - avg(wb)) / {se}')} AS z FROM vals_ GROUP BY ALL",
        "delong_1988": _with(mon, PAIRS, _placed("a"), _placed("b"), "vals_ AS (SELECT version_a, version_b, y, CASE WHEN y = 1 THEN (a.below + a.q / 2e0) / a.neg END AS va, CASE WHEN y = 1 THEN (b.below + b.q / 2e0) / b.neg END AS vb, CASE WHEN y = 0 THEN 1 - (a.pbelow + a.p / 2e0) / a.pos END AS wa, CASE WHEN y = 0 THEN 1 - (b.pbelow + b.p / 2e0) / b.pos END AS wb, a.pos, a.neg FROM pr JOIN place_a a ON sa = a.score JOIN place_b b ON sb = b.score)") + f"SELECT version_a, version_b, {_r('avg(va)')} AS auroc_a, {_r('avg(vb)')} AS auroc_b, {_r('sqrt(greatest((var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / max(pos) + (var_samp(wa) + var_samp(wb) - 2 * covar_samp(wa, wb)) / max(neg), 1e-15))')} AS se_diff FROM vals_ GROUP BY ALL",
        "alerts": _with(mon, VALUES) + f"SELECT severity, rule, {_r('observed')} AS observed, {_r('threshold')} AS threshold FROM alerts",
        "alert_messages": _with(mon, VALUES) + "SELECT severity, rule, " + "CASE rule " + " ".join(f"WHEN '{k}' THEN printf('{text}: observed %.4f, limit %.4f', observed, threshold)" for k, text in MESSAGES.items())
        + " ELSE printf('Relative fall of AUROC since the reference: observed %.4f (now %.4f, then %.4f), limit %.4f', observed, (SELECT ca FROM vals), (SELECT ba FROM vals), threshold) END AS message FROM alerts",
        "summary_metrics": "WITH RECURSIVE " + ", ".join((mon, f"cc AS (SELECT {COUNTS} FROM mon)", DOWN, _newton("(SELECT 1 AS one, * FROM mon)", "one"))) + " SELECT " + "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + f""" END AS metric, estimate, ci_lower, ci_upper FROM ({metric_rows})
            UNION ALL SELECT 'AUROC', {_r('auroc')}, NULL, NULL FROM {_auroc("mon")} UNION ALL SELECT 'AUPRC', {_r('sum(p * tp / CAST(tp + fp AS DOUBLE)) / max(pos)')}, NULL, NULL FROM down
            UNION ALL SELECT 'Brier score', {_r('avg((y_pred_proba - y_true) * (y_pred_proba - y_true))')}, NULL, NULL FROM mon
            UNION ALL SELECT 'Expected calibration error', {_r('sum(n * abs(o - p)) / sum(n)')}, NULL, NULL FROM (SELECT {_right_bin(10)} AS bin, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS o, avg(y_pred_proba) AS p FROM mon GROUP BY 1)
            UNION ALL SELECT 'Calibration intercept', {_r('a')}, NULL, NULL FROM newton WHERE k = 25 UNION ALL SELECT 'Calibration slope', {_r('b')}, NULL, NULL FROM newton WHERE k = 25""",
        "drift_frame": _with(mon, VALUES, CDF, "dist AS (SELECT sum(abs(fr - fc) * coalesce(nxt - s, 0)) AS w, max(abs(fr - fc)) AS ks, sqrt(CAST(max(rn) AS DOUBLE) * max(cn) / (max(rn) + max(cn))) * max(abs(fr - fc)) AS x FROM cdf)") + f"""SELECT 'PSI' AS metric, {_r('psi')} AS "value", CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'minor' ELSE 'none' END AS level FROM psi
            UNION ALL SELECT 'KL divergence', {_r('sum((r + 1e-10) / (1 + 1e-9) * ln((r + 1e-10) / (c + 1e-10)))')}, '' FROM shares UNION ALL SELECT 'Wasserstein distance', {_r('w')}, '' FROM dist UNION ALL SELECT 'KS statistic', {_r('ks')}, '' FROM dist
            UNION ALL SELECT 'KS p-value', {_r('least(1, greatest(0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2e0 * k * k * x * x)) FROM generate_series(1, 100) AS g(k))))')}, '' FROM dist
            UNION ALL SELECT 'Baseline AUROC', {_r('ba')}, '' FROM vals UNION ALL SELECT 'Current AUROC', {_r('ca')}, '' FROM vals UNION ALL SELECT 'Subgroup sensitivity gap', {_r('gap')}, '' FROM vals""",
        "version_comparison": _with(mon, PAIRS, f"vs AS (SELECT model_version AS v, {RATES['sensitivity']} AS se, {RATES['specificity']} AS sp FROM (SELECT model_version, {COUNTS} FROM mon GROUP BY 1 HAVING count(*) >= 10))") + f"""SELECT 'version_summary' AS comparison_type, v AS version_a, NULL AS version_b, round(se, 4) AS sensitivity_a, NULL::DOUBLE AS sensitivity_b, round(sp, 4) AS specificity_a, NULL::DOUBLE AS specificity_b, NULL::DOUBLE AS auroc_a, NULL::DOUBLE AS auroc_b, NULL::DOUBLE AS auc_diff FROM vs
            UNION ALL SELECT 'pairwise', a.v, b.v, round(a.se, 4), round(b.se, 4), round(a.sp, 4), round(b.sp, 4), round((SELECT auroc FROM {_auroc("(SELECT y AS y_true, sa AS y_pred_proba FROM pr)")}), 4), round((SELECT auroc FROM {_auroc("(SELECT y AS y_true, sb AS y_pred_proba FROM pr)")}), 4),
            round((SELECT auroc FROM {_auroc("(SELECT y AS y_true, sa AS y_pred_proba FROM pr)")}) - (SELECT auroc FROM {_auroc("(SELECT y AS y_true, sb AS y_pred_proba FROM pr)")}), 4) FROM vs a JOIN vs b ON a.v < b.v""",
        "reliability_quantile_bins": _with(mon, "qs AS (SELECT quantile_cont(y_pred_proba, [1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]) AS cuts FROM mon)") + f"SELECT CAST({' + '.join(f'CASE WHEN cuts[{i}] <= y_pred_proba THEN 1 ELSE 0 END' for i in range(1, 10))} AS INTEGER) AS bin, count(*) AS n, {_r('avg(CAST(y_true AS DOUBLE))')} AS prob_true, {_r('avg(y_pred_proba)')} AS prob_pred FROM mon, qs GROUP BY 1",
        "profile_columns": _with(mon) + f"SELECT 'site' AS \"column\", CAST(count_if({number} % 7 <> 0) AS BIGINT) AS n_filled FROM mon UNION ALL SELECT 'scanner_manufacturer', CAST(count_if(length(trim(scanner_manufacturer)) > 0) AS BIGINT) FROM mon UNION ALL SELECT 'modality', CAST(count_if(length(trim(modality)) > 0) AS BIGINT) FROM mon",
        "multiclass_violations": "WITH f AS (SELECT o_orderkey AS n FROM orders) SELECT * FROM (" + " UNION ALL ".join((_fault("y_true", "null", "n % 97 <> 0 AND n % 89 = 0"), _fault("y_true", "empty", "n % 97 = 0"), _fault("y_pred_label", "empty", "n % 83 = 0"))) + ") WHERE n > 0",
        "alert_reviews_join": _with(mon, VALUES, "rev AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'max_subgroup_sens_gap' ELSE 'psi_major' END AS rule, arg_max(r_name, r_regionkey) AS reviewer FROM region GROUP BY 1)") + f"SELECT severity, rule, {_r('observed')} AS observed, {_r('threshold')} AS threshold, coalesce(reviewer, '') AS reviewer, CASE WHEN reviewer IS NULL THEN 'unreviewed' ELSE 'accepted' END AS disposition, CASE WHEN reviewer IS NULL THEN '' ELSE 'watch' END AS follow_up FROM alerts LEFT JOIN rev USING (rule)",
        "alias_adapter": _with(mon) + f"SELECT c_mktsegment AS site, o_orderstatus AS modality, CASE WHEN y_pred_proba >= 6e-1 THEN 1 ELSE 0 END AS y_pred_binary, count(*) AS n, count(DISTINCT patient_id) AS patients, {_r('avg(y_pred_proba)')} AS mean_score FROM mon LEFT JOIN (SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS pid, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey) ON pid = patient_id GROUP BY ALL",
        "detection_label_collapse": f"""WITH lab AS (SELECT l_orderkey AS k, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1),
            j AS (SELECT y, CASE WHEN k % 3 <> 0 AND o_orderkey IS NOT NULL THEN k % 1000 / 1000e0 END AS p, CASE WHEN o_orderkey IS NULL THEN NULL WHEN k % 100 < 18 THEN '0-17' WHEN k % 100 < 40 THEN '18-39' WHEN k % 100 < 65 THEN '40-64' ELSE '65+' END AS age_group, o_orderdate FROM lab LEFT JOIN orders ON k = o_orderkey)
            SELECT age_group, y AS y_true, CASE WHEN coalesce(p >= 5e-1, FALSE) THEN 1 ELSE 0 END AS y_pred_binary, count(*) AS n, count(p) AS scored, {_r('avg(p)')} AS mean_score, CAST(min(o_orderdate) AS TIMESTAMP) AS first_date FROM j GROUP BY ALL""",
        "age_band": """SELECT CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 103 < 18 THEN '0-17' WHEN c_custkey % 103 < 40 THEN '18-39' WHEN c_custkey % 103 < 65 THEN '40-64' ELSE '65+' END AS age_group, count(*) AS n FROM customer GROUP BY 1""",
        "keep_first_dedup": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS part_keys FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS nth FROM lineitem) WHERE nth = 1 GROUP BY 1",
        "validation_violations": _with(mon, f"f AS (SELECT {number} AS n FROM mon)") + "SELECT * FROM (" + " UNION ALL ".join((
            _fault("patient_id", "null", "n % 101 <> 0 AND n % 103 = 0"), _fault("patient_id", "empty", "n % 101 = 0"), _fault("y_pred_proba", "not in [0, 1]", "n % 53 = 0"), _fault("y_pred_proba", "wrong type", "n % 53 <> 0 AND n % 59 = 0"),
            _fault("y_true", "wrong type", "n % 61 = 0"), _fault("y_true", "not 0 or 1", "n % 61 <> 0 AND n % 67 = 0"),
        )) + ") WHERE n > 0",
    }

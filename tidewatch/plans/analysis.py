"""One monitoring analysis: all frames over one validated table."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANALYSIS_RESAMPLES, CONFIDENCE, REFERENCE_FRACTION, SUBGROUP_MIN_N, AlertThresholds, Profile
from ..functions import stats
from ..operators import alerts, bootstrap, calibration, confusion, drift, missing, multiclass, ranking, split, versions
from ..sources import records, storage, tables, validate

TITLES = {"sensitivity": "Sensitivity", "specificity": "Specificity", "ppv": "PPV", "npv": "NPV", "accuracy": "Accuracy", "f1": "F1", "prevalence": "Prevalence"}


def round4(x: float | None) -> float | None:
    return None if x is None or x != x or x in (float("inf"), float("-inf")) else round(float(x), 4)


def header(df: DataFrame, positives: Column | None = None) -> DataFrame:
    """n, n_positive (with an aggregate that counts them), first and last day as text, the sorted model versions: one row."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    found = [] if positives is None else [F.coalesce(positives, F.lit(0)).alias("n_positive")]
    return df.agg(
        F.count("*").alias("n"), *found, day(F.min("study_date")).alias("start_date"), day(F.max("study_date")).alias("end_date"), F.array_sort(F.collect_set("model_version")).alias("model_versions")
    )


@dataclass
class MonitoringAnalysis:
    """Frames are built on first use; those of a few rows are gathered, the table itself never is."""

    table: DataFrame
    thresholds: AlertThresholds = field(default_factory=AlertThresholds)
    plan: records.MonitoringPlan | None = None
    reviews: tuple[records.AlertReview, ...] = ()
    confidence: float = CONFIDENCE
    min_n: int = SUBGROUP_MIN_N
    fraction: float = REFERENCE_FRACTION
    resamples: int = ANALYSIS_RESAMPLES

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @cached_property
    def baseline(self) -> DataFrame:
        return split.with_phase(self.table, self.fraction, "baseline")

    @cached_property
    def stratified(self) -> DataFrame:
        return confusion.stratified(self.table, min_n=self.min_n)

    @cached_property
    def missing(self) -> DataFrame:
        return missing.missing_profile(self.table)

    @cached_property
    def site_calibration(self) -> DataFrame:
        return calibration.site_calibration(self.table, self.fraction, max(self.min_n, 10))

    @cached_property
    def rolling(self) -> DataFrame:
        return drift.rolling_auroc(self.table)

    def summary_rows(self, intervals: bool = True) -> list[dict]:
        """metric, estimate, ci_lower, ci_upper: thirteen rows; the bootstrap's intervals only if asked for."""
        rates = {r["metric"]: r.asDict() for r in confusion.binary_metrics(self.table, self.confidence).collect()}
        plain = lambda x: {"estimate": x, "ci_lower": None, "ci_upper": None}
        if intervals:
            boot = {r["metric"]: r for r in bootstrap.intervals(self.table, resamples=self.resamples, confidence=self.confidence)}
        else:
            boot = {"auroc": plain(ranking.auroc(self.table).first()["auroc"]), "auprc": plain(ranking.auprc(self.table).first()["auprc"]), "brier": plain(ranking.brier(self.table).first()["brier"])}
        ece = calibration.expected_calibration_error(self.table).first()
        fit = calibration.intercept_slope(self.table).first()
        ordered = [(TITLES[m], rates[m]) for m in ("sensitivity", "specificity", "ppv", "npv", "accuracy", "f1")]
        ordered += [("AUROC", boot["auroc"]), ("AUPRC", boot["auprc"]), ("Brier score", boot["brier"]), ("Expected calibration error", plain(ece["ece"]))]
        ordered += [("Calibration intercept", plain(fit["intercept"] if fit else None)), ("Calibration slope", plain(fit["slope"] if fit else None)), ("Prevalence", rates["prevalence"])]
        return [{"metric": name} | {k: r[k] for k in ("estimate", "ci_lower", "ci_upper")} for name, r in ordered]

    @cached_property
    def summary(self) -> list[dict]:
        return [{k: v if k == "metric" else round4(v) for k, v in r.items()} for r in self.summary_rows()]

    @cached_property
    def drift_values(self) -> dict:
        d = drift.drift_report(self.table, self.fraction).first().asDict()
        n, m = d["reference_n"], d["current_n"]
        d["ks_p_value"] = stats.kolmogorov_p_value(d["ks_statistic"], n, m) if d["ks_statistic"] is not None and n and m else None
        return d

    @cached_property
    def alert_inputs(self) -> dict[str, float | None]:
        areas = {r["phase"]: r["auroc"] for r in ranking.auroc(self.baseline, ["phase"]).collect()}
        rates = confusion.rates()
        now = confusion.confusion(self.baseline.filter("phase = 'current'")).select(rates["sensitivity"].alias("a"), rates["specificity"].alias("b")).first()
        overall = ranking.auroc(self.table).first()["auroc"] if None in (areas.get("current"), areas.get("reference")) else None
        pick = lambda phase: overall if areas.get(phase) is None else areas[phase]
        gap = confusion.largest_gap(self.stratified).first()["gap"]
        return {"current_auroc": pick("current"), "baseline_auroc": pick("reference"), "current_sensitivity": now["a"], "current_specificity": now["b"], "psi": self.drift_values["psi"], "subgroup_gap": gap}

    @cached_property
    def alerts(self) -> DataFrame:
        row = self.spark.createDataFrame([tuple(self.alert_inputs[c] for c in alerts.INPUTS)], alerts.SCHEMA)
        return alerts.with_reviews(alerts.alerts(row, self.thresholds), records.reviews_frame(self.spark, self.reviews)).orderBy("place")

    @cached_property
    def alert_report(self) -> alerts.AlertReport:
        return alerts.AlertReport(tuple(r.asDict() for r in self.alerts.collect()))

    @cached_property
    def exact_drift_rows(self) -> list[dict]:
        d, a = self.drift_values, self.alert_inputs
        rows = [("PSI", d["psi"], d["psi_level"]), ("KL divergence", d["kl_divergence"], ""), ("Wasserstein distance", d["wasserstein"], ""), ("KS statistic", d["ks_statistic"], "")]
        rows += [("KS p-value", d["ks_p_value"], ""), ("Baseline AUROC", a["baseline_auroc"], ""), ("Current AUROC", a["current_auroc"], ""), ("Subgroup sensitivity gap", a["subgroup_gap"], "")]
        return [{"metric": m, "value": v, "level": level} for m, v, level in rows]

    @cached_property
    def drift_rows(self) -> list[dict]:
        return [r | {"value": round4(r["value"])} for r in self.exact_drift_rows]

    @cached_property
    def version_rows(self) -> list[dict]:
        """A row for each version, then a row for each comparable pair."""
        own = {r["model_version"]: r for r in confusion.version_summary(self.table).orderBy("model_version").collect()}
        blank = dict.fromkeys(("comparison_type", "version_a", "version_b", "sensitivity_a", "sensitivity_b", "specificity_a", "specificity_b", "auroc_a", "auroc_b", "auc_diff", "p_value"))
        rows = [blank | {"comparison_type": "version_summary", "version_a": v, "sensitivity_a": round4(r["sensitivity"]), "specificity_a": round4(r["specificity"])} for v, r in own.items()]
        tests = {(t["version_a"], t["version_b"]): t for t in versions.delong_tests(self.table, self.confidence)}
        for i, a in enumerate(own):
            for b in list(own)[i + 1 :]:
                t = tests.get((a, b))
                row = blank | {"comparison_type": "pairwise", "version_a": a, "version_b": b}
                row |= {f"{m}_{s}": round4(own[v][m]) for m in ("sensitivity", "specificity") for s, v in (("a", a), ("b", b))}
                rows.append(row | ({k: round4(t[k]) for k in ("auroc_a", "auroc_b", "auc_diff", "p_value")} if t else {}))
        return rows

    @cached_property
    def summary_dict(self) -> dict:
        s = {r["metric"]: r["estimate"] for r in self.summary}
        d = self.drift_values
        one = header(self.table, F.sum("y_true")).first()
        return {
            "n": one["n"], "n_positive": one["n_positive"], "start_date": one["start_date"], "end_date": one["end_date"], "auroc": s["AUROC"], "auprc": s["AUPRC"], "sensitivity": s["Sensitivity"],
            "specificity": s["Specificity"], "calibration_intercept": s["Calibration intercept"], "calibration_slope": s["Calibration slope"], "psi": round4(d["psi"]), "psi_level": d["psi_level"],
            "score_wasserstein": round4(d["wasserstein"]), "score_ks_statistic": round4(d["ks_statistic"]), "score_ks_p_value": round4(d["ks_p_value"]), "alerts": len(self.alert_report.alerts),
            "critical_alerts": self.alert_report.n_critical, "warning_alerts": self.alert_report.n_warning, "model_versions": list(one["model_versions"]), "monitoring_plan": self.plan.to_dict() if self.plan else None,
        }

    def frames(self) -> dict[str, DataFrame]:
        """The output tables by name."""
        new = self.spark.createDataFrame
        text = "comparison_type string, version_a string, version_b string, " + ", ".join(f"{m}_{s} double" for m in ("sensitivity", "specificity", "auroc") for s in "ab")
        version_schema = text + ", auc_diff double, p_value double"
        order = [c.split()[0] for c in version_schema.split(", ")]
        return {
            "summary": new([tuple(r.values()) for r in self.summary], "metric string, estimate double, ci_lower double, ci_upper double"),
            "stratified": self.stratified.orderBy("stratifier", "level"),
            "missing": self.missing,
            "alerts": self.alerts.drop("place"),
            "drift": new([tuple(r.values()) for r in self.drift_rows], "metric string, value double, level string"),
            "site_calibration": self.site_calibration.orderBy("site"),
            "versions": new([tuple(r[c] for c in order) for r in self.version_rows], version_schema),
        }


#: File names of the outputs.
OUTPUTS = {
    "summary": "summary_metrics.csv", "stratified": "stratified_metrics.csv", "missing": "missing_data.csv", "alerts": "alerts.csv", "drift": "drift.csv",
    "site_calibration": "site_calibration_drift.csv", "versions": "model_versions.csv", "json": "metrics_summary.json",
}


def run(
    df: DataFrame, thresholds: AlertThresholds | None = None, plan: records.MonitoringPlan | None = None, profile: Profile | str = Profile.PUBLIC, reviews: Iterable[records.AlertReview] = (),
    confidence: float = CONFIDENCE, min_n: int | None = None, fraction: float = REFERENCE_FRACTION, resamples: int = ANALYSIS_RESAMPLES, validated: bool = False,
) -> MonitoringAnalysis:
    """Validate once and keep the table for all frames. A plan's thresholds win over the argument; an explicit min_n wins over the plan's."""
    table = df if validated else validate.validate(df, profile)
    size = min_n or (plan.subgroup_min_n if plan else 0) or SUBGROUP_MIN_N
    return MonitoringAnalysis(table.persist(), plan.thresholds if plan else thresholds or AlertThresholds(), plan, tuple(reviews), confidence, size, fraction, resamples)


def _written(spark: SparkSession, folder: str | Path, texts: dict[str, str], names: dict[str, str]) -> dict[str, str | Path]:
    """The outputs in their folder; paths are text where they have a scheme."""
    kind = str if storage.is_uri(folder) else Path
    paths = storage.write_texts(spark, folder, {names[k]: text for k, text in texts.items()})
    return {k: kind(paths[names[k]]) for k in texts}


def write_outputs(analysis: MonitoringAnalysis, folder: str | Path, audit_log: str | Path | None = None, actor: str = "tidewatch") -> dict[str, str | Path]:
    """The eight outputs, on the driver's disk or, if ``folder`` has a scheme, on the cluster's storage.

    All of them are computed and staged before the first is in its place, so a failure leaves the folder as it was.
    """
    texts = {name: tables.small_csv(frame) for name, frame in analysis.frames().items()}
    texts["json"] = json.dumps(analysis.summary_dict, indent=2)
    paths = _written(analysis.spark, folder, texts, OUTPUTS)
    if audit_log:
        report = analysis.alert_report
        details = {"output_dir": str(folder), "alerts": len(report.alerts), "critical_alerts": report.n_critical}
        records.append_event(audit_log, records.artifact_event("analysis_outputs_written", actor, paths["json"], details, texts["json"]), analysis.spark)
    return paths


#: Rows of a validated table that may be handed over as one text.
DOWNLOAD_ROWS = 100_000


def export_payloads(analysis: MonitoringAnalysis) -> dict[str, tuple[str, str, str]]:
    """Key: (file name, media type, text), ten of them; nine if the validated table has more than DOWNLOAD_ROWS
    rows, for that is no download: write it with :func:`tables.write_table`."""
    from .report import render

    found = {}
    if analysis.table.limit(DOWNLOAD_ROWS + 1).count() <= DOWNLOAD_ROWS:
        found["validated_csv"] = ("validated_monitoring_data.csv", "text/csv", tables.small_csv(analysis.table))
    found |= {f"{k}_csv": (OUTPUTS[k], "text/csv", tables.small_csv(v)) for k, v in analysis.frames().items()}
    found["metrics_json"] = (OUTPUTS["json"], "application/json", json.dumps(analysis.summary_dict, indent=2) + "\n")
    found["report_html"] = ("monitoring_report.html", "text/html", render(analysis))
    return found


@dataclass
class MulticlassAnalysis:
    table: DataFrame
    profile: Profile = Profile.PUBLIC

    def frames(self) -> dict[str, DataFrame]:
        return {"multiclass_summary": multiclass.summary(self.table), "multiclass_per_class": multiclass.per_class(self.table).orderBy("label"), "multiclass_confusion": multiclass.confusion_matrix(self.table).orderBy("y_true", "y_pred_label")}

    @cached_property
    def summary_dict(self) -> dict:
        one = header(self.table).first()
        frames = {k: [r.asDict() for r in v.collect()] for k, v in self.frames().items()}
        found = {r["metric"]: r["value"] for r in frames["multiclass_summary"]}
        found |= {"labels": [r["label"] for r in frames["multiclass_per_class"]], "per_class": frames["multiclass_per_class"], "confusion": frames["multiclass_confusion"]}
        return found | {"start_date": one["start_date"], "end_date": one["end_date"], "schema_profile": str(self.profile), "model_versions": list(one["model_versions"])}


def run_multiclass(df: DataFrame, profile: Profile | str = Profile.PUBLIC) -> MulticlassAnalysis:
    return MulticlassAnalysis(validate.validate(df, profile, multiclass=True).persist(), Profile(profile))


def write_multiclass(analysis: MulticlassAnalysis, folder: str | Path, audit_log: str | Path | None = None, actor: str = "tidewatch") -> dict[str, str | Path]:
    texts = {k: tables.small_csv(v) for k, v in analysis.frames().items()}
    texts["json"] = json.dumps(analysis.summary_dict, indent=2, allow_nan=False)
    spark = analysis.table.sparkSession
    paths = _written(spark, folder, texts, {k: "multiclass_summary.json" if k == "json" else f"{k}.csv" for k in texts})
    if audit_log:
        event = records.artifact_event("multiclass_outputs_written", actor, paths["json"], {"output_dir": str(folder)}, texts["json"])
        records.append_event(audit_log, event, spark)
    return paths

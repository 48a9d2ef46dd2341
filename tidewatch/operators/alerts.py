"""Stop rules over a few summary values, and the reviews of their alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AlertThresholds

INPUTS = ("current_auroc", "baseline_auroc", "current_sensitivity", "current_specificity", "psi", "subgroup_gap")
SCHEMA = ", ".join(f"{c} double" for c in INPUTS)


def alerts(values: DataFrame, thresholds: AlertThresholds | None = None) -> DataFrame:
    """place, severity, rule, message, observed, threshold for each rule that one row of values breaks.

    A value that is NULL switches its rule off; minor drift is reported only below the major limit.
    """
    t = thresholds or AlertThresholds()
    now, base, sens, spec, psi, gap = (F.col(c) for c in INPUTS)
    drop = F.when(base > 0, (base - now) / base)

    def rule(place: int, severity: str, name: str, broken: Column, observed: Column, limit: float, message: Column) -> Column:
        fields = F.struct(
            F.lit(place).alias("place"), F.lit(severity).alias("severity"), F.lit(name).alias("rule"), message.alias("message"),
            observed.alias("observed"), F.lit(float(limit)).alias("threshold"),
        )
        return F.when(broken, fields)

    def told(what: str, observed: Column, limit: float) -> Column:
        return F.format_string(f"{what}: observed %.4f, limit {limit:.4f}", observed)

    fall = F.format_string(f"Relative fall of AUROC since the reference: observed %.4f (now %.4f, then %.4f), limit {t.max_auroc_drop_relative:.4f}", drop, now, base)
    rules = F.array(
        rule(1, "critical", "min_auroc", now < t.min_auroc, now, t.min_auroc, told("AUROC is too low", now, t.min_auroc)),
        rule(2, "critical", "max_auroc_drop_relative", drop > t.max_auroc_drop_relative, drop, t.max_auroc_drop_relative, fall),
        rule(3, "critical", "min_sensitivity", sens < t.min_sensitivity, sens, t.min_sensitivity, told("Sensitivity is too low", sens, t.min_sensitivity)),
        rule(4, "critical", "min_specificity", spec < t.min_specificity, spec, t.min_specificity, told("Specificity is too low", spec, t.min_specificity)),
        rule(5, "critical", "psi_major", psi >= t.psi_major, psi, t.psi_major, told("Scores have shifted strongly (PSI)", psi, t.psi_major)),
        rule(5, "warning", "psi_minor", (psi >= t.psi_minor) & (psi < t.psi_major), psi, t.psi_minor, told("Scores have shifted somewhat (PSI)", psi, t.psi_minor)),
        rule(6, "warning", "max_subgroup_sens_gap", gap > t.max_subgroup_sens_gap, gap, t.max_subgroup_sens_gap, told("Sensitivity differs too much between subgroups", gap, t.max_subgroup_sens_gap)),
    )
    return values.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))


def with_reviews(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Alerts with reviewer, disposition, follow_up, reviewed_at and review_notes of the rule's last review.

    ``reviews`` has a column ``place`` that gives their order; an alert without one is ``unreviewed``.
    """
    last = Window.partitionBy("rule").orderBy(F.desc("place"))
    latest = reviews.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    latest = latest.select("rule", "reviewer", "disposition", "follow_up", "reviewed_at", F.col("notes").alias("review_notes"))
    joined = found.join(latest, "rule", "left").withColumn("disposition", F.coalesce("disposition", F.lit("unreviewed")))
    joined = joined.na.fill("", ["reviewer", "follow_up", "reviewed_at", "review_notes"])
    return joined.select("place", "severity", "rule", "message", "observed", "threshold", "reviewer", "disposition", "follow_up", "reviewed_at", "review_notes")


@dataclass(frozen=True)
class AlertReport:
    alerts: tuple[dict, ...]

    @property
    def is_clean(self) -> bool:
        return not self.alerts

    @property
    def n_critical(self) -> int:
        return sum(a["severity"] == "critical" for a in self.alerts)

    @property
    def n_warning(self) -> int:
        return sum(a["severity"] == "warning" for a in self.alerts)


def check_alerts(spark: SparkSession, thresholds: AlertThresholds | None = None, **values: float | None) -> AlertReport:
    """The report for the given values (INPUTS); those left out are NULL."""
    row = tuple(None if values.get(c) is None else float(values[c]) for c in INPUTS)
    found = alerts(spark.createDataFrame([row], SCHEMA), thresholds).orderBy("place").collect()
    return AlertReport(tuple(r.asDict() for r in found))

"""The registry of monitoring queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HISTOGRAM_BINS, REFERENCE_FRACTION, STRATIFIERS
from ..operators import alerts, bootstrap, calibration, confusion, drift, missing, multiclass, ranking, split, versions
from ..session import stored
from ..sources import adapters, validate
from . import analysis, oracle
from . import monitoring as m

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _monitoring(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(m.monitoring(spark, sf_dir)))


def _kept(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that look at the table several times: its columns are joined and written once, in one scan of the given tables."""
    return lambda spark, sf_dir: rounded(operator(stored(m.monitoring(spark, sf_dir), "monitored")))


def _multiclass(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(m.multiclass(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(confusion.stratified(m.monitoring(spark, sf_dir), ["site"]))


KINDS = {"drift": (REFERENCE_FRACTION, "drift"), "baseline": (REFERENCE_FRACTION, "baseline")}


def _split_counts(df: DataFrame) -> DataFrame:
    phases = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("phase")) for k in KINDS))
    both = split.with_phases(df, {f"_{k}": v for k, v in KINDS.items()}).select("y_true", "study_date", F.inline(phases))
    return both.groupBy("kind", "phase").agg(F.count("*").alias("n"), F.sum("y_true").alias("positives"), F.min("study_date").alias("first_date"), F.max("study_date").alias("last_date"))


def _psi(df: DataFrame) -> DataFrame:
    return drift.score_drift(drift.score_counts(df, bins=HISTOGRAM_BINS), weight="n").select("reference_n", "current_n", "psi", "psi_level")


def _kl(df: DataFrame) -> DataFrame:
    return drift.score_drift(drift.score_counts(df, bins=HISTOGRAM_BINS), weight="n").select("kl_divergence")


def _distances(df: DataFrame) -> DataFrame:
    return drift.distances(drift.score_counts(df), "n")


def alert_values(df: DataFrame) -> DataFrame:
    """One row of the values that the stop rules look at: counts by both phases and score, and by stratum, come from one scan."""
    y, p = F.col("y_true"), F.col("y_pred_binary")
    strata = [c for c in STRATIFIERS if c in df.columns]
    kinds, by = {f"_{k}": v for k, v in KINDS.items()}, {"y_pred_proba": F.col("y_pred_proba"), "y_true": y, "y_pred_binary": p}
    counts, by_strata = split.phase_counts(df, kinds, by, {"w": F.lit(1)}, [*strata, "y_true", "y_pred_binary"])
    w = F.col("w")
    of = lambda x, name: F.coalesce(F.sum(F.when(x, w)), F.lit(0)).alias(name)
    cells = [of((y == a) & (p == b), name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]
    counts = stored(counts.groupBy(*kinds, "y_pred_proba").agg(F.sum("w").alias("n"), of(y == 1, "np"), of(y == 0, "nn"), *cells), "alert-counts")
    phase = F.col("_baseline").alias("phase")
    groups = counts.filter("y_pred_proba is not null").groupBy(phase, F.col("y_pred_proba").alias("score")).agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))
    pick = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("auroc")))
    one = ranking.grouped_auroc(groups, ["phase"]).agg(pick("current").alias("current_auroc"), pick("reference").alias("baseline_auroc"))
    rates = confusion.rates()
    now = counts.filter("_baseline = 'current'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tp", "fp", "tn", "fn")))
    now = now.select(rates["sensitivity"].alias("current_sensitivity"), rates["specificity"].alias("current_specificity"))
    psi = drift.score_drift(counts.withColumn("phase", F.col("_drift")), weight="n").select("psi")
    by_strata = by_strata.filter(y.isNotNull() & p.isNotNull()).groupBy(*strata).agg(F.sum("w").alias("n"), *cells)
    strata_rows = confusion.stratified_counts(by_strata, strata)
    gap = confusion.largest_gap(strata_rows).select(F.col("gap").alias("subgroup_gap"))
    for other in (now, psi, gap):  # single rows
        one = one.crossJoin(F.broadcast(other))
    return one


def _alerts(df: DataFrame) -> DataFrame:
    return alerts.alerts(alert_values(df)).select("severity", "rule", "observed", "threshold")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with reviews: the reviews' rules, dispositions and order are read off the region table."""
    regions = m.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rule = F.when(F.col("r_regionkey") % 2 == 0, "max_subgroup_sens_gap").otherwise("psi_major")
    reviews = regions.select(F.col("r_regionkey").alias("place"), rule.alias("rule"), F.col("r_name").alias("reviewer"), F.lit("accepted").alias("disposition"), F.lit("watch").alias("follow_up"), F.lit("2026-01-01").alias("reviewed_at"), F.lit("").alias("notes"))
    found = alerts.with_reviews(alerts.alerts(alert_values(m.monitoring(spark, sf_dir))), reviews)
    return rounded(found.select("severity", "rule", "observed", "threshold", "reviewer", "disposition", "follow_up"))


def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with other names and no prediction column, adapted with the operational metadata of its first row."""
    rows = m.monitoring(spark, sf_dir)
    export = rows.select(F.col("patient_id").alias("accession_number_hash"), F.col("study_date").alias("observation_datetime"), F.col("model_version").alias("algorithm_version"), F.col("y_true").alias("ground_truth"), F.col("y_pred_proba").alias("model_score"))
    orders = m.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    customers = m.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    meta = orders.join(customers, F.expr("o_custkey = c_custkey")).select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("subject.reference"), F.col("c_mktsegment").alias("serviceProvider.display"), F.col("o_orderpriority").alias("device.manufacturer"), F.col("o_orderstatus").alias("modality.coding.code")
    )
    found = adapters.in_order(adapters.with_metadata(adapters.normalized_predictions(export, 0.6), adapters.normalized_metadata(meta), [F.col("site")]))
    return rounded(found.groupBy("site", "modality", "y_pred_binary").agg(F.count("*").alias("n"), F.countDistinct("patient_id").alias("patients"), F.avg("y_pred_proba").alias("mean_score")))


def _labels_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes are line items, positive when returned; scores and ages are those of the order."""
    boxes = m.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patientId"), (F.col("l_returnflag") == "R").cast("int").alias("Target"))
    scores = m.table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("patientId"), (F.col("o_orderkey") % 1000 / F.lit(1000.0)).alias("prediction"))
    ages = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patientId"), F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 3, "0"), F.lit("Y")).alias("PatientAge"), F.col("o_orderdate").alias("StudyDate"))
    out = adapters.adapt_detection_labels(boxes, scores, ages)
    return rounded(out.groupBy("age_group", "y_true", "y_pred_binary").agg(F.count("*").alias("n"), F.count("y_pred_proba").alias("scored"), F.avg("y_pred_proba").alias("mean_score"), F.min("study_date").alias("first_date")))


def _age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = m.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 17 == 0, F.lit("n/a")).when(F.col("c_custkey") % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lpad((F.col("c_custkey") % 103).cast("string"), 3, "0"), F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise(".5"))).alias("age"))
    return ages.groupBy(adapters.age_band(F.col("age")).alias("age_group")).agg(F.count("*").alias("n"))


def _first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = m.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    first = adapters.first_per_key(lines, "l_orderkey", [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")])
    return first.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("part_keys"))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with planted faults, and how often each rule of the schema is broken."""
    rows = m.monitoring(spark, sf_dir)
    n = F.expr("cast(substring(patient_id, 2) as bigint)")
    faulty = rows.withColumns({
        "patient_id": F.when(n % 101 == 0, "").when(n % 103 == 0, None).otherwise(F.col("patient_id")),
        "y_pred_proba": F.when(n % 53 == 0, F.lit("1.2")).when(n % 59 == 0, "high").otherwise(F.col("y_pred_proba").cast("string")),
        "y_true": F.when(n % 61 == 0, F.lit("0.5")).when(n % 67 == 0, "2").otherwise(F.col("y_true").cast("string")),
    })
    _, counted = validate.violations(faulty)
    rows = F.array(*(F.struct(F.lit(c.split("|")[0]).alias("column"), F.lit(c.split("|")[1]).alias("rule"), F.col(f"`{c}`").alias("n")) for c in counted.columns))
    return counted.select(F.inline(rows)).filter("n > 0")


def _multiclass_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.multiclass(spark, sf_dir)
    n = F.expr("cast(substring(patient_id, 2) as bigint)")
    faulty = rows.withColumns({"y_true": F.when(n % 97 == 0, " ").when(n % 89 == 0, None).otherwise(F.col("y_true")), "y_pred_label": F.when(n % 83 == 0, "").otherwise(F.col("y_pred_label"))})
    _, counted = validate.violations(faulty, multiclass=True)
    cells = F.array(*(F.struct(F.lit(c.split("|")[0]).alias("column"), F.lit(c.split("|")[1]).alias("rule"), F.col(f"`{c}`").alias("n")) for c in counted.columns))
    return counted.select(F.inline(cells)).filter("n > 0")


def _filled(df: DataFrame) -> DataFrame:
    """Operational columns of rows whose site is blank in one line of seven, and whose scanner is not known everywhere."""
    n = F.expr("cast(substring(patient_id, 2) as bigint)")
    return validate.filled_columns(df.withColumn("site", F.when(n % 7 == 0, "  ").otherwise(F.col("site"))))


def _alert_messages(df: DataFrame) -> DataFrame:
    return alerts.alerts(alert_values(df)).select("severity", "rule", "message")


def _summary(df: DataFrame) -> DataFrame:
    rows = analysis.MonitoringAnalysis(df).summary_rows(intervals=False)
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "metric string, estimate double, ci_lower double, ci_upper double")


def _drift_frame(df: DataFrame) -> DataFrame:
    rows = analysis.MonitoringAnalysis(df).exact_drift_rows
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "metric string, value double, level string")


def _version_rows(df: DataFrame) -> DataFrame:
    columns = ("comparison_type", "version_a", "version_b", "sensitivity_a", "sensitivity_b", "specificity_a", "specificity_b", "auroc_a", "auroc_b", "auc_diff")
    rows = [tuple(r[c] for c in columns) for r in analysis.MonitoringAnalysis(df).version_rows]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} {'double' if c[0] in 'sa' else 'string'}" for c in columns))


def _header(df: DataFrame) -> DataFrame:
    return analysis.header(df, F.sum("y_true")).withColumn("model_versions", F.array_join("model_versions", ","))


def _multiclass_header(df: DataFrame) -> DataFrame:
    return analysis.header(df).withColumn("model_versions", F.array_join("model_versions", ","))


def _version_frame(df: DataFrame) -> DataFrame:
    return versions.pair_summary(df)


def queries() -> dict[str, Query]:
    return {
        "overall_2x2": _monitoring(confusion.confusion),
        "wilson_ci": _monitoring(confusion.binary_metrics),
        "stratified_metrics": _monitoring(confusion.stratified),
        "subgroup_gap": _monitoring(lambda df: confusion.subgroup_gap(confusion.stratified(df))),
        "version_summary": _monitoring(confusion.version_summary),
        "top_subgroups": _monitoring(lambda df: confusion.top_subgroups(confusion.stratified(df))),
        "missing_profile": _monitoring(missing.missing_profile),
        "mar_chi2": _monitoring(lambda df: missing.missing_profile(df).filter("mar_indicator").select("column", "chi2")),
        "subgroup_availability": _monitoring(missing.availability),
        "multiclass_confusion": _multiclass(multiclass.confusion_matrix),
        "multiclass_per_class": _multiclass(multiclass.per_class),
        "multiclass_summary": _multiclass(multiclass.summary),
        "label_space_union": _multiclass(validate.label_space),
        "auroc": _monitoring(ranking.auroc),
        "auprc": _monitoring(ranking.auprc),
        "roc_points": _monitoring(ranking.roc_points),
        "pr_points": _monitoring(ranking.pr_points),
        "jackknife_moments": _monitoring(bootstrap.jackknife_moments),
        "brier_ece": _monitoring(calibration.summary),
        "reliability_bins": _monitoring(calibration.reliability_curve),
        "calibration_fit": _monitoring(calibration.intercept_slope),
        "reference_current_split": _kept(_split_counts),
        "psi": _monitoring(_psi),
        "kl_divergence": _monitoring(_kl),
        "wasserstein_ks": _monitoring(_distances),
        "rolling_auroc": _monitoring(drift.rolling_auroc),
        "cusum": _monitoring(lambda df: drift.cusum(drift.rolling_auroc(df))),
        "score_histogram": _monitoring(drift.score_histogram),
        "site_calibration_drift": _kept(lambda df: calibration.site_calibration(df, with_fit=False)),
        "site_calibration_fit": _kept(calibration.site_calibration),
        "version_pairs_join": _monitoring(_version_frame),
        "delong_components": _monitoring(lambda df: versions.delong(df).select("version_a", "version_b", "n_pos", "n_neg", "auroc_a", "auroc_b", "auc_diff", "var_a", "var_b", "cov_ab", "se_diff", "z")),
        "delong_1988": _monitoring(lambda df: versions.delong(df, "delong1988").select("version_a", "version_b", "auroc_a", "auroc_b", "se_diff")),
        "alerts": _monitoring(_alerts),
        "alert_reviews_join": _reviewed,
        "alias_adapter": _adapted,
        "detection_label_collapse": _labels_collapsed,
        "age_band": _age_bands,
        "keep_first_dedup": _first_rows,
        "validation_violations": _violations,
        "multiclass_violations": _multiclass_violations,
        "profile_columns": _monitoring(_filled),
        "alert_messages": _monitoring(_alert_messages),
        "summary_header": _monitoring(_header),
        "multiclass_header": _multiclass(_multiclass_header),
        "summary_metrics": _kept(_summary),
        "drift_frame": _kept(_drift_frame),
        "version_comparison": _kept(_version_rows),
        "reliability_quantile_bins": _monitoring(lambda df: calibration.reliability_curve(df, strategy="quantile")),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()

"""Validation, adapters, records, synthetic data, outputs and the command line."""

from __future__ import annotations

import json

import pytest

from tidewatch import main
from tidewatch.plans import analysis, report
from tidewatch.sources import adapters, records, synthetic, tables, validate

HEAD = "patient_id,study_date,model_version,y_true,y_pred_proba,y_pred_binary"


def table(spark, *rows, head=HEAD):
    return tables.read_csv_text(spark, "\n".join([head, *rows]))


def test_valid_table_is_coerced(spark):
    found = validate.validate(table(spark, "a,2026-01-01,v1,1,0.9,1,x", "b,2026-01-02T08:30:00,v1,0,0.1,0,y", head=HEAD + ",extra"))
    assert dict(found.dtypes)["study_date"] == "timestamp_ntz" and dict(found.dtypes)["y_true"] == "int" and "extra" in found.columns


def test_all_violations_are_reported(spark):
    with pytest.raises(validate.ValidationError) as e:
        validate.validate(table(spark, "a,2026-01-01,v1,1,1.2,1", "b,never,v1,0.5,0.1,0", ",2026-01-01,v1,2,0.2,0"))
    assert e.value.error_counts == {("y_pred_proba", "not in [0, 1]"): 1, ("study_date", "wrong type"): 1, ("y_true", "wrong type"): 1, ("patient_id", "null"): 1, ("y_true", "not 0 or 1"): 1}
    with pytest.raises(validate.ValidationError, match="missing column"):
        validate.validate(table(spark, "a,v1", head="patient_id,model_version"))


def test_production_profile(spark):
    df = table(spark, "a,2026-01-01,v1,1,0.9,1")
    assert validate.validate(df).count() == 1
    with pytest.raises(ValueError, match="Production schema profile"):
        validate.validate(df, "production")
    blank = table(spark, "a,2026-01-01,v1,1,0.9,1,N,  ,DX", head=HEAD + ",site,scanner_manufacturer,modality")
    with pytest.raises(ValueError, match="scanner_manufacturer"):
        validate.validate(blank, "production")


def test_multiclass_needs_two_labels(spark):
    head = "patient_id,study_date,model_version,y_true,y_pred_label"
    with pytest.raises(ValueError, match="at least two distinct"):
        validate.validate(table(spark, "a,2026-01-01,v1,x, x ", head=head), multiclass=True)
    assert validate.validate(table(spark, "a,2026-01-01,v1,x,y", head=head), multiclass=True).count() == 1


def test_export_adapter(spark):
    texts = records.connector_templates()
    export, meta = tables.read_csv_text(spark, texts["pacs_ris_export.csv"]), tables.read_csv_text(spark, texts["operational_metadata.csv"])
    found = adapters.adapt_predictions(export, meta).orderBy("patient_id").collect()
    assert [(r["y_pred_binary"], r["sex"], r["age_group"], r["model_version"]) for r in found] == [(1, "F", "40-64", "1.0"), (0, "M", "65+", "1.0")]


def test_first_alias_and_first_metadata_row_win(spark):
    df = spark.createDataFrame([("a", 0.2, 0.9)], "patientId string, score double, probability double")
    assert adapters.rename_aliases(df).first()["y_pred_proba"] is None or adapters.rename_aliases(df).first()["y_pred_proba"] == 0.2
    meta = spark.createDataFrame([("a", "first", 1), ("a", "second", 2)], "patient_id string, site string, nth int")
    from pyspark.sql import functions as F

    left = spark.createDataFrame([("a",), ("b",)], "patient_id string")
    assert {r["patient_id"]: r["site"] for r in adapters.with_metadata(left, meta, [F.col("nth")]).collect()} == {"a": "first", "b": None}


def test_detection_labels_collapse(spark):
    labels = spark.createDataFrame([("p1", 1), ("p1", 0), ("p2", 0), ("p3", 1)], "patientId string, Target int")
    scores = spark.createDataFrame([("p1", 0.7), ("p2", 1.4)], "patientId string, prediction double")
    found = adapters.adapt_detection_labels(labels, scores).orderBy("patient_id").collect()
    assert [(r["y_true"], r["y_pred_proba"], r["y_pred_binary"], str(r["study_date"].date())) for r in found] == [(1, 0.7, 1, "2018-01-01"), (0, 1.0, 1, "2018-01-02"), (1, None, 0, "2018-01-03")]
    meta = tables.read_csv_text(spark, records.detection_templates()["metadata.csv"].replace("patient-0001", "p1"))
    with_meta = {r["patient_id"]: r for r in adapters.adapt_detection_labels(labels, None, meta).collect()}
    assert (with_meta["p1"]["age_group"], with_meta["p1"]["modality"], with_meta["p2"]["modality"]) == ("40-64", "DX", "DX")


def test_age_bands(spark):
    from pyspark.sql import functions as F

    ages = ["064Y", "17", "18.9", " 40 ", "", None, "old", "65"]
    found = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a string").select("i", adapters.age_band(F.col("a")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in found] == ["40-64", "0-17", "18-39", "40-64", None, None, None, "65+"]


def test_records_round_trip(tmp_path):
    plan = records.plan_from_dict({"id": "m", "owner": "o", "intended_use": "u", "thresholds": {"min_auroc": 0.7, "unknown": 1}})
    assert records.load_plan(records.save_plan(plan, tmp_path / "plan.json")) == plan and plan.thresholds.min_auroc == 0.7
    item = records.ModelInventoryItem("m", "n", "1", "o", "u")
    for name in ("a.csv", "a.json"):
        assert records.load_inventory(records.save_inventory([item], tmp_path / name)) == (item,)
    protocol = records.StudyProtocol("s", "t", "d", "p", "auroc", 10)
    assert records.load_protocol(records.save_protocol(protocol, tmp_path / "p.json")) == protocol
    (tmp_path / "r.json").write_text(json.dumps({"reviews": [{"rule": "min_auroc", "follow_up_action": "look"}]}))
    assert records.load_reviews(tmp_path / "r.json")[0].follow_up == "look"
    for make in (lambda: records.MonitoringPlan(" ", "o", "u"), lambda: records.MonitoringPlan("m", "o", "u", operating_threshold=2), lambda: records.AlertReview(""), lambda: records.StudyProtocol("s", "t", "d", "p", "e", 0)):
        with pytest.raises(ValueError):
            make()


def test_audit_log(spark, tmp_path):
    artifact, log = tmp_path / "x.txt", tmp_path / "log.jsonl"
    artifact.write_text("x")
    assert records.read_log(log) == ()
    for _ in range(2):
        records.append_event(log, records.artifact_event("made", "me", artifact, {"k": 1}))
    assert [len(e["artifact_sha256"]) for e in records.read_log(log)] == [64, 64]
    assert records.log_frame(spark, str(log)).filter("event_type = 'made'").count() == 2


def test_templates_are_not_replaced(tmp_path):
    main.main(["monitoring-plan-template", "--output", str(tmp_path / "p.json")])
    with pytest.raises(FileExistsError):
        main.main(["monitoring-plan-template", "--output", str(tmp_path / "p.json")])
    main.main(["monitoring-plan-template", "--output", str(tmp_path / "p.json"), "--force"])
    main.main(["study-protocol-template", "--output", str(tmp_path / "s.json")])
    main.main(["study-protocol-validate", "--path", str(tmp_path / "s.json")])
    main.main(["inventory-template", "--output", str(tmp_path / "i.csv")])
    main.main(["inventory-validate", "--path", str(tmp_path / "i.csv")])


def test_synthetic_table_and_whole_analysis(spark, tmp_path):
    df = synthetic.monitoring_table(spark, 600)
    assert df.count() == 600 + 2 * synthetic.HOLDOUT_PATIENTS
    reviews = [records.AlertReview("min_sensitivity", "first"), records.AlertReview("min_sensitivity", "second", "accepted")]
    found = analysis.run(df, reviews=reviews, resamples=40)
    paths = analysis.write_outputs(found, tmp_path, tmp_path / "log.jsonl")
    assert all(p.exists() for p in paths.values()) and len(records.read_log(tmp_path / "log.jsonl")) == 1
    assert len(found.summary) == 13 and len(found.drift_rows) == 8
    fired = {r["rule"]: r for r in found.alert_report.alerts}
    assert all(r["reviewer"] == "second" for k, r in fired.items() if k == "min_sensitivity")
    payloads = analysis.export_payloads(found)
    assert len(payloads) == 10 and "<h1>Model monitoring report</h1>" in payloads["report_html"][2]
    made = report.write(found, tmp_path)
    assert made.html.exists() and (made.pdf or made.pdf_error)


def test_multiclass_outputs(spark, tmp_path):
    head = "patient_id,study_date,model_version,y_true,y_pred_label"
    found = analysis.run_multiclass(table(spark, "a,2026-01-01,v1,x,y", "b,2026-01-02,v1,y,y", head=head))
    paths = analysis.write_multiclass(found, tmp_path)
    assert json.loads(paths["json"].read_text())["accuracy"] == 0.5 and len(paths) == 4


def test_stream_of_batches(spark, tmp_path):
    from tidewatch.streaming import incremental

    df = synthetic.monitoring_table(spark, 80, holdout=False)
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    query = incremental.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.processAllAvailable()
    query.stop()
    assert incremental.totals(spark.read.parquet(str(tmp_path / "out"))).groupBy().sum("n").first()[0] == 80

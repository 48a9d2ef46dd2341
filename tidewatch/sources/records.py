"""Governance records: monitoring plan, model inventory, alert reviews, study protocol, audit log."""

from __future__ import annotations

import csv
import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import STRATIFIERS, SUBGROUP_MIN_N, AlertThresholds
from . import storage

SCHEMA_VERSION = 1


def _need(record: Any, names: Iterable[str]) -> None:
    missing = [n for n in names if not str(getattr(record, n)).strip()]
    if missing:
        raise ValueError(f"{type(record).__name__} lacks {', '.join(missing)}")


def _known(cls: type, data: dict, aliases: dict[str, str] | None = None) -> dict:
    """The fields of ``cls`` in ``data``; an alias counts where the field itself is not given; lists become tuples."""
    for alias, name in (aliases or {}).items():
        if alias in data and name not in data:
            data = {**data, name: data[alias]}
    return {f.name: tuple(v) if isinstance(v := data[f.name], list) else v for f in fields(cls) if f.name in data}


@dataclass(frozen=True)
class MonitoringPlan:
    model_id: str
    model_owner: str
    intended_use: str
    review_cadence: str = "monthly"
    operating_threshold: float = 0.5
    thresholds: AlertThresholds = field(default_factory=AlertThresholds)
    subgroup_min_n: int = SUBGROUP_MIN_N
    required_subgroups: tuple[str, ...] = STRATIFIERS
    stop_rule_contacts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _need(self, ("model_id", "model_owner", "intended_use"))
        if not 0.0 <= self.operating_threshold <= 1.0:
            raise ValueError("the operating threshold is a probability: give a number from 0 to 1")
        if self.subgroup_min_n < 1:
            raise ValueError("a subgroup needs a minimum size of 1 or more")

    def to_dict(self) -> dict:
        return asdict(self) | {"schema_version": SCHEMA_VERSION}


@dataclass(frozen=True)
class ModelInventoryItem:
    model_id: str
    model_name: str
    version: str
    owner: str
    intended_use: str
    status: str = "active"
    monitoring_plan_path: str = ""
    last_reviewed: str = ""
    notes: str = ""

    def __post_init__(self) -> None:
        _need(self, ("model_id", "model_name", "version", "owner", "intended_use"))


@dataclass(frozen=True)
class AlertReview:
    rule: str
    reviewer: str = ""
    disposition: str = "unreviewed"
    follow_up: str = ""
    reviewed_at: str = ""
    notes: str = ""

    def __post_init__(self) -> None:
        _need(self, ("rule", "disposition"))


@dataclass(frozen=True)
class StudyProtocol:
    study_id: str
    title: str
    data_source: str
    prediction_source: str
    primary_endpoint: str
    minimum_cases: int
    locked_at: str = ""
    secondary_endpoints: tuple[str, ...] = ("calibration_error", "subgroup_sensitivity_specificity", "drift_detection_time")
    drift_methods: tuple[str, ...] = ("psi", "kl_divergence", "wasserstein", "ks", "rolling_auroc", "cusum")
    required_subgroups: tuple[str, ...] = STRATIFIERS
    subgroup_min_n: int = SUBGROUP_MIN_N
    alert_threshold_strategy: str = "pre-specified ROC/operating-point analysis"
    reviewer_roles: tuple[str, ...] = ("radiology_ai_practitioner", "data_scientist")
    registration_url: str = ""
    notes: str = ""

    def __post_init__(self) -> None:
        _need(self, ("study_id", "title", "data_source", "prediction_source", "primary_endpoint", "alert_threshold_strategy"))
        if self.minimum_cases < 1 or self.subgroup_min_n < 1:
            raise ValueError("minimum_cases and subgroup_min_n must be positive")
        if not self.drift_methods or not self.required_subgroups:
            raise ValueError("a protocol needs a drift method and a required subgroup")

    def to_dict(self) -> dict:
        return asdict(self) | {"schema_version": SCHEMA_VERSION}


def plan_from_dict(data: dict) -> MonitoringPlan:
    own = _known(MonitoringPlan, data, {"id": "model_id", "owner": "model_owner"})
    return MonitoringPlan(**(own | {"thresholds": AlertThresholds().overlaid(data.get("thresholds"))}))


def protocol_from_dict(data: dict) -> StudyProtocol:
    return StudyProtocol(**_known(StudyProtocol, data))


def _read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _write_json(data: Any, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2) + "\n", encoding="utf-8")
    return path


def _read_rows(path: str | Path, key: str) -> list[dict]:
    """Rows of a CSV file (empty cells stay empty texts), or of a JSON list or of an object's ``key``."""
    if Path(path).suffix.lower() == ".json":
        data = _read_json(path)
        return data[key] if isinstance(data, dict) else data
    with Path(path).open(newline="", encoding="utf-8") as f:
        return [{k: v or "" for k, v in r.items()} for r in csv.DictReader(f)]


def load_plan(path: str | Path) -> MonitoringPlan:
    return plan_from_dict(_read_json(path))


def save_plan(plan: MonitoringPlan, path: str | Path) -> Path:
    return _write_json(plan.to_dict(), path)


def load_protocol(path: str | Path) -> StudyProtocol:
    return protocol_from_dict(_read_json(path))


def save_protocol(protocol: StudyProtocol, path: str | Path) -> Path:
    return _write_json(protocol.to_dict(), path)


def load_inventory(path: str | Path) -> tuple[ModelInventoryItem, ...]:
    return tuple(ModelInventoryItem(**_known(ModelInventoryItem, r, {"name": "model_name", "model_owner": "owner"})) for r in _read_rows(path, "models"))


def save_inventory(items: Iterable[ModelInventoryItem], path: str | Path) -> Path:
    path, rows = Path(path), [asdict(i) for i in items]
    if path.suffix.lower() == ".json":
        return _write_json({"schema_version": SCHEMA_VERSION, "models": rows}, path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, [x.name for x in fields(ModelInventoryItem)])
        out.writeheader()
        out.writerows(rows)
    return path


def load_reviews(path: str | Path) -> tuple[AlertReview, ...]:
    aliases = {"follow_up_action": "follow_up", "review_notes": "notes"}
    return tuple(AlertReview(**_known(AlertReview, r, aliases)) for r in _read_rows(path, "reviews"))


def reviews_frame(spark: SparkSession, reviews: Iterable[AlertReview]) -> DataFrame:
    rows = [(i, *asdict(r).values()) for i, r in enumerate(reviews)]
    return spark.createDataFrame(rows, "place int, rule string, reviewer string, disposition string, follow_up string, reviewed_at string, notes string")


@dataclass(frozen=True)
class AuditEvent:
    event_type: str
    actor: str
    artifact: str
    artifact_sha256: str
    created_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    details: dict[str, Any] = field(default_factory=dict)


def file_sha256(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def artifact_event(event_type: str, actor: str, artifact: str | Path, details: dict | None = None, content: str | None = None) -> AuditEvent:
    """An event about a file; ``content`` is its text where the file isn't on the driver's disk."""
    digest = file_sha256(artifact) if content is None else hashlib.sha256(content.encode()).hexdigest()
    return AuditEvent(event_type, actor, str(artifact), digest, details=details or {})


def append_event(path: str | Path, event: AuditEvent, spark: SparkSession | None = None) -> str | Path:
    """One more event of the log, keys sorted.

    A local path is a file of lines. A path with a scheme is a folder on the cluster's storage (``spark`` is
    needed) with one object an event, which several writers may add to at once.
    """
    line = json.dumps(asdict(event), sort_keys=True)
    if storage.is_uri(path):
        if spark is None:
            raise ValueError("a log on the cluster's storage needs the session")
        storage.Folder(spark, path).write({f"{event.created_at.replace(':', '-')}-{uuid.uuid4().hex}.json": line + "\n"})
        return path
    storage.append_line(Path(path), line)
    return Path(path)


def read_log(path: str | Path, spark: SparkSession | None = None) -> tuple[dict, ...]:
    """The log's events, in order of time where each is an object; none where there is no log."""
    if storage.is_uri(path):
        if spark is None:
            raise ValueError("a log on the cluster's storage needs the session")
        folder = storage.Folder(spark, path)
        return tuple(json.loads(folder.read(name)) for name in folder.names())
    path = Path(path)
    return tuple(json.loads(x) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()) if path.exists() else ()


AUDIT_SCHEMA = "event_type string, actor string, artifact string, artifact_sha256 string, created_at string, details map<string, string>"


def log_frame(spark: SparkSession, path: str) -> DataFrame:
    """A log of any size as a table, whether a file of lines or a folder of events."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def write_template(path: str | Path, text: str, force: bool = False) -> Path:
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(f"{path} is there; use force to replace it")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def plan_template() -> str:
    plan = MonitoringPlan("example-model", "Imaging AI governance", "Triage support for chest radiographs")
    return json.dumps(plan.to_dict(), indent=2) + "\n"


def inventory_template() -> str:
    names = [f.name for f in fields(ModelInventoryItem)]
    return ",".join(names) + "\nexample-model,Example model,1.0,Imaging AI governance,Triage support,active,monitoring_plan.json,,\n"


def protocol_template() -> str:
    protocol = StudyProtocol("study-001", "External evaluation", "local archive", "vendor export", "auroc", 500)
    return json.dumps(protocol.to_dict(), indent=2) + "\n"


def connector_templates() -> dict[str, str]:
    """File name: text, for exports that :mod:`adapters` can read."""
    return {
        "pacs_ris_export.csv": "accession_number_hash,study_date,facility,Manufacturer,Modality,algorithm_version,ground_truth,model_score\nhash-0001,2026-01-01,North,Maker A,DX,1.0,1,0.91\nhash-0002,2026-01-02,South,Maker B,CR,1.0,0,0.12\n",
        "orchestration_export.csv": "study_instance_uid_hash,observation_datetime,site,scanner_manufacturer,modality,modelVersion,label,prediction\nhash-0001,2026-01-01T08:00:00,North,Maker A,DX,1.0,1,0.91\nhash-0002,2026-01-02T09:30:00,South,Maker B,CR,1.0,0,0.12\n",
        "operational_metadata.csv": "subject.reference,effectiveDateTime,serviceProvider.display,device.manufacturer,modality.coding.code,administrativeGender,ageBand,raceEthnicity\nhash-0001,2026-01-01T08:00:00,North,Maker A,DX,F,40-64,\nhash-0002,2026-01-02T09:30:00,South,Maker B,CR,M,65+,\n",
        "README.md": "Fill one export and, if wanted, the metadata, then run `adapt-export --export FILE --metadata FILE --output FILE`.\n",
    }


def detection_templates() -> dict[str, str]:
    """Files for a case study from box-level labels."""
    return {
        "predictions.csv": "patientId,prediction\npatient-0001,0.91\n",
        "metadata.csv": "patientId,StudyDate,PatientSex,PatientAge,Modality,Manufacturer\npatient-0001,2018-01-01,F,064Y,DX,Maker A\n",
        "README.md": "Fill the predictions and, if wanted, the metadata, then run `adapt-detection --labels FILE --predictions FILE --metadata FILE --output FILE`.\n",
        "analysis_plan.md": "# Analysis plan\n\nState the endpoint, the smallest subgroup, the drift methods and the stop rules before looking at results.\n",
    }

"""Names and defaults that the operators share."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from enum import StrEnum

REQUIRED = ("patient_id", "study_date", "model_version", "y_true", "y_pred_proba", "y_pred_binary")
MULTICLASS_REQUIRED = ("patient_id", "study_date", "model_version", "y_true", "y_pred_label")
OPTIONAL = ("site", "scanner_manufacturer", "modality", "age_group", "sex", "race_ethnicity")
DEMOGRAPHIC = ("age_group", "sex", "race_ethnicity")
OPERATIONAL = ("site", "scanner_manufacturer", "modality")
STRATIFIERS = (*DEMOGRAPHIC, *OPERATIONAL)

CONFIDENCE = 0.95
BOOTSTRAP_RESAMPLES = 1000
ANALYSIS_RESAMPLES = 200
SEED = 42
SUBGROUP_MIN_N = 10
CALIBRATION_BINS = 10
HISTOGRAM_BINS = 10
ROLLING_WINDOW_DAYS = 30
ROLLING_MIN_SAMPLES = 20
REFERENCE_FRACTION = 0.3
SITE_MIN_N = 30
PAIRED_MIN_N = 20
CUSUM_THRESHOLD = 4.0

#: A total order of rows: fully equal rows may change places.
TOTAL_ORDER = ("study_date", "patient_id", "model_version", "y_true", "y_pred_proba", "y_pred_binary", *OPTIONAL)


class Profile(StrEnum):
    PUBLIC = "public"
    PRODUCTION = "production"


@dataclass(frozen=True)
class AlertThresholds:
    min_auroc: float = 0.80
    max_auroc_drop_relative: float = 0.05
    min_sensitivity: float = 0.80
    min_specificity: float = 0.80
    psi_major: float = 0.25
    psi_minor: float = 0.10
    max_subgroup_sens_gap: float = 0.05

    def to_dict(self) -> dict[str, float]:
        return asdict(self)

    def overlaid(self, values: dict | None) -> AlertThresholds:
        """These thresholds with the known keys of ``values`` in their place; unknown keys are ignored."""
        known = self.to_dict()
        return AlertThresholds(**(known | {k: float(v) for k, v in (values or {}).items() if k in known}))

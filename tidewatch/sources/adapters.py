"""Adapters from exports of other systems to the monitoring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OPTIONAL, REQUIRED, Profile
from ..functions.stats import clip
from ..session import stored
from . import validate

#: Column names that other systems use, in the order in which they are tried.
ALIASES: dict[str, tuple[str, ...]] = {
    "patient_id": ("patient_id", "patientId", "patient_hash", "accession_number_hash", "study_instance_uid_hash", "subject.reference"),
    "study_date": ("study_date", "StudyDate", "effectiveDateTime", "observation_datetime"),
    "model_version": ("model_version", "algorithm_version", "modelVersion", "software_version"),
    "y_true": ("y_true", "ground_truth", "target", "label", "outcome"),
    "y_pred_proba": ("y_pred_proba", "prediction", "score", "probability", "model_score"),
    "site": ("site", "facility", "serviceProvider.display", "MSH.4"),
    "scanner_manufacturer": ("scanner_manufacturer", "Manufacturer", "device.manufacturer", "Device.manufacturer"),
    "modality": ("modality", "Modality", "modality.coding.code", "OBR.24"),
    "age_group": ("age_group", "ageBand", "PatientAgeGroup"),
    "sex": ("sex", "PatientSex", "administrativeGender"),
    "race_ethnicity": ("race_ethnicity", "raceEthnicity", "race_ethnicity_group"),
}
METADATA = ("patient_id", "study_date", *OPTIONAL)


def quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def rename_aliases(df: DataFrame, names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Known columns under their own names: the first alias that is there, unless the name itself is."""
    found = {}
    for name, candidates in names.items():
        if name not in df.columns and (alias := next((c for c in candidates if c in df.columns), None)):
            found.setdefault(alias, name)
    return df.select(*(quoted(c).alias(found.get(c, c)) for c in df.columns))


def normalized_predictions(df: DataFrame, threshold: float = 0.5, model_version: str = "external-model") -> DataFrame:
    """Aliases renamed; model_version and y_pred_binary added where they are not there."""
    found = rename_aliases(df)
    if "model_version" not in found.columns:
        found = found.withColumn("model_version", F.lit(model_version))
    if "y_pred_binary" not in found.columns and "y_pred_proba" in found.columns:
        found = found.withColumn("y_pred_binary", (F.expr("try_cast(y_pred_proba as double)") >= threshold).cast("int"))
    return found


def normalized_metadata(df: DataFrame) -> DataFrame:
    return rename_aliases(df, {k: v for k, v in ALIASES.items() if k in METADATA})


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that is first by the columns of ``order``: smallest values, nulls first; of ties a checksum of the row decides.

    It is a minimum for each key, which tasks take before they shuffle: a key of many rows costs no task
    more, and no row is sorted.
    """
    rows, check = F.struct(*(quoted(c) for c in df.columns)), F.xxhash64(*(quoted(c) for c in df.columns))
    place = F.struct(*(x.alias(f"o{i}") for i, x in enumerate([*order, check])))
    best = df.groupBy(quoted(key).alias("_key")).agg(F.min_by(rows, place).alias("_row"))
    return best.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))


def nulls_last(c: Column) -> list[Column]:
    """Two columns whose rising order is that of ``c`` with nulls last."""
    return [c.isNull(), c]


def with_metadata(predictions: DataFrame, metadata: DataFrame, order: list[Column]) -> DataFrame:
    """Left join on patient_id of the metadata columns that the predictions lack; the first metadata row of a patient counts."""
    new = [c for c in metadata.columns if c not in predictions.columns]
    own = first_per_key(metadata, "patient_id", order).select("patient_id", *(quoted(c) for c in new))
    return predictions.join(own, "patient_id", "left")


def in_order(df: DataFrame) -> DataFrame:
    """Required columns, optional ones (null where they are not there), then the rest."""
    known = (*REQUIRED, *OPTIONAL)
    head = [quoted(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in known if c in df.columns or c in OPTIONAL]
    return df.select(*head, *(quoted(c) for c in df.columns if c not in known))


def adapt_predictions(
    predictions: DataFrame, metadata: DataFrame | None = None, threshold: float = 0.5, model_version: str = "external-model", profile: Profile | str = Profile.PRODUCTION, metadata_order: list[Column] | None = None
) -> DataFrame:
    """A validated monitoring table from an export, with operational metadata joined on."""
    found = normalized_predictions(predictions, threshold, model_version)
    if metadata is not None:
        meta = normalized_metadata(metadata)
        order = metadata_order or [x for c in meta.columns for x in nulls_last(quoted(c))]
        found = with_metadata(found, meta, order)
    return validate.validate(in_order(found), profile)


def age_band(age: Column) -> Column:
    """Age text such as 064Y or 64.0 to 0-17, 18-39, 40-64, 65+; NULL if it can't be read."""
    number = F.regexp_replace(F.trim(age.cast("string")), "[A-Za-z]$", "").try_cast("double").cast("int")
    return F.when(number < 18, "0-17").when(number < 40, "18-39").when(number < 65, "40-64").when(number >= 65, "65+")


def adapt_detection_labels(labels: DataFrame, predictions: DataFrame | None = None, metadata: DataFrame | None = None, threshold: float = 0.5, model_version: str = "external-model", seed: int = 42) -> DataFrame:
    """A monitoring table from box-level labels: a patient is positive if any box is.

    Without predictions a synthetic score around the outcome stands in; a patient without a prediction
    has a null score and predicts 0; without dates, one day per patient in order of patient id.
    """
    key = "patientId" if "patientId" in labels.columns else "patient_id"
    target = "Target" if "Target" in labels.columns else "target"
    out = labels.groupBy(quoted(key).cast("string").alias("patient_id")).agg(F.max(quoted(target).cast("int")).alias("y_true"))
    if predictions is not None:
        own = rename_aliases(predictions, {"patient_id": ALIASES["patient_id"], "y_pred_proba": ALIASES["y_pred_proba"]})
        out = out.join(own.select(F.col("patient_id").cast("string").alias("patient_id"), F.col("y_pred_proba").cast("double").alias("y_pred_proba")), "patient_id", "left")
    else:
        out = out.withColumn("y_pred_proba", clip(0.22 + 0.58 * F.col("y_true") + 0.18 * F.randn(seed), 0.001, 0.999))
    given: list[str] = []
    if metadata is not None:
        meta = normalized_metadata(metadata)
        if "age_group" not in meta.columns and "PatientAge" in meta.columns:
            meta = meta.withColumn("age_group", age_band(quoted("PatientAge")))
        given = [c for c in ("study_date", "sex", "age_group", "modality", "scanner_manufacturer", "site", "race_ethnicity") if c in meta.columns]
        meta = first_per_key(meta.select(F.col("patient_id").cast("string").alias("patient_id"), *given), "patient_id", [x for c in given for x in nulls_last(F.col(c))])
        out = out.join(meta, "patient_id", "left")
    if "study_date" not in given:
        place = _positions(out.select("patient_id"))
        out = out.join(place, "patient_id").withColumn("study_date", F.expr("date_add(date'2018-01-01', int(_place - 1))").cast("timestamp_ntz")).drop("_place")
    else:
        out = out.withColumn("study_date", F.col("study_date").try_cast("timestamp_ntz"))
    fixed = {"site": "RSNA/NIH CXR8", "modality": "DX"}
    for c, value in fixed.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(value)) if c in given else F.lit(value))
    out = out.withColumn("y_pred_proba", clip(F.col("y_pred_proba"), 0.0, 1.0))
    out = out.withColumns({"model_version": F.lit(model_version), "y_pred_binary": F.coalesce((F.col("y_pred_proba") >= threshold).cast("int"), F.lit(0))})
    return in_order(out)


def _positions(ids: DataFrame) -> DataFrame:
    """patient_id, _place: positions in order of the id.

    Ids are dealt by range, so a part holds a stretch of them whatever their prefixes; they are ranked
    within the part, and the parts' sizes give the offsets. The parts are stored, for a second reading
    must see the same cuts.
    """
    dealt = stored(ids.repartitionByRange("patient_id").withColumn("_part", F.spark_partition_id()), "positions")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("patient_id")))
    return ranked.join(F.broadcast(sizes), "_part").select("patient_id", (F.col("_before") + F.col("_nth")).alias("_place"))

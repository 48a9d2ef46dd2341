"""Declared schemas: coercion, and all violations in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MULTICLASS_REQUIRED, OPERATIONAL, OPTIONAL, REQUIRED, Profile

TYPES = {"study_date": "timestamp_ntz", "y_pred_proba": "double", "y_pred_binary": "int", "y_true": "int"}
DESCRIPTIONS = {
    "patient_id": "hashed case identifier", "study_date": "time of the study", "model_version": "version that made the prediction", "y_true": "outcome",
    "y_pred_proba": "predicted probability of the outcome", "y_pred_binary": "prediction at the operating threshold", "y_pred_label": "predicted class",
    "site": "where the study was made", "scanner_manufacturer": "maker of the device", "modality": "kind of study", "age_group": "age band", "sex": "recorded sex",
    "race_ethnicity": "recorded race or ethnicity",
}


class ValidationError(ValueError):
    """All violations of a table: error_counts maps (column, rule) to the number of rows."""

    def __init__(self, error_counts: dict[tuple[str, str], int]) -> None:
        self.error_counts = error_counts
        super().__init__("; ".join(f"{c}: {rule} ({n} rows)" for (c, rule), n in sorted(error_counts.items())))


def _typed(c: str, kind: str) -> Column:
    text = F.col(f"`{c}`")
    if kind == "int":  # 1.0 is 1, but 0.5 is no label
        number = F.expr(f"try_cast(`{c}` as double)")
        return F.when(number == F.floor(number), number.cast("int"))
    return F.expr(f"try_cast(`{c}` as {kind})") if kind != "string" else text.cast("string")


def _rules(c: str, multiclass: bool) -> dict[str, Column]:
    """Rule: whether a coerced value breaks it."""
    x = F.col(f"_to_{c}")
    if c in ("patient_id", "model_version", "y_pred_label") or (multiclass and c == "y_true"):
        return {"empty": F.length(F.trim(x)) == 0}
    if c in ("y_true", "y_pred_binary"):
        return {"not 0 or 1": ~x.isin(0, 1)}
    if c == "y_pred_proba":
        return {"not in [0, 1]": ~x.between(0.0, 1.0) | F.isnan(x)}
    return {}


def violations(df: DataFrame, multiclass: bool = False) -> tuple[DataFrame, DataFrame]:
    """(coerced table with extra columns as they were, one row of counts named ``column|rule``)."""
    required = MULTICLASS_REQUIRED if multiclass else REQUIRED
    known = [c for c in (*required, *OPTIONAL) if c in df.columns]
    kinds = {c: "string" if multiclass and c == "y_true" else TYPES.get(c, "string") for c in known}
    wide = df.select("*", *(_typed(c, kinds[c]).alias(f"_to_{c}") for c in known))
    counts = []
    for c in required:
        if c in df.columns:
            given, made = F.col(f"`{c}`"), F.col(f"_to_{c}")
            counts.append(F.count_if(given.isNull()).alias(f"{c}|null"))
            counts.append(F.count_if(given.isNotNull() & made.isNull()).alias(f"{c}|wrong type"))
            counts += [F.count_if(F.coalesce(broken, F.lit(False))).alias(f"{c}|{rule}") for rule, broken in _rules(c, multiclass).items()]
    note = lambda c: {"description": DESCRIPTIONS.get(c, "")}
    order = [F.col(f"_to_{c}").alias(c, metadata=note(c)) if c in known else F.col(f"`{c}`") for c in df.columns]
    return wide.select(*order), wide.agg(*counts) if counts else df.agg(F.count("*").alias("rows|rows"))


def filled_columns(df: DataFrame) -> DataFrame:
    """column, n_filled for each operational column that is there: rows whose value is not blank."""
    present = [c for c in OPERATIONAL if c in df.columns]
    counted = df.agg(F.count("*").alias("rows"), *(F.count_if(F.length(F.trim(F.col(c).cast("string"))) > 0).alias(c) for c in present))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_filled")) for c in present)))) if present else counted.select(F.lit("").alias("column"), F.col("rows").alias("n_filled")).limit(0)


def _check_profile(df: DataFrame, profile: Profile) -> None:
    if profile != Profile.PRODUCTION:
        return
    filled = {r["column"]: r["n_filled"] for r in filled_columns(df).collect()}
    missing, empty = [c for c in OPERATIONAL if c not in filled], [c for c, n in filled.items() if not n]
    if missing or empty:
        raise ValueError(f"Production schema profile: missing columns {missing}, columns without values {empty}")


def label_space(df: DataFrame) -> DataFrame:
    """Number of distinct labels over true and predicted ones, without outer white space."""
    both = df.select(F.explode(F.array("y_true", "y_pred_label")).alias("label"))
    return both.agg(F.countDistinct(F.regexp_replace("label", "^\\s+|\\s+$", "")).alias("n_labels"))


def validate(df: DataFrame, profile: Profile | str = Profile.PUBLIC, multiclass: bool = False) -> DataFrame:
    """The coerced table, or an error with every violation. Extra columns pass through."""
    profile = Profile(profile)
    required = MULTICLASS_REQUIRED if multiclass else REQUIRED
    errors = {(c, "missing column"): 0 for c in required if c not in df.columns}
    coerced, counted = violations(df, multiclass)
    errors |= {tuple(k.split("|")): n for k, n in counted.first().asDict().items() if n and k != "rows|rows"}
    if errors:
        raise ValidationError(errors)
    _check_profile(coerced, profile)
    if multiclass and label_space(coerced).first()["n_labels"] < 2:
        raise ValueError("a multi-class table must contain at least two distinct labels")
    return coerced


def monitoring_schema(multiclass: bool = False) -> T.StructType:
    required = MULTICLASS_REQUIRED if multiclass else REQUIRED
    kinds = {"timestamp_ntz": T.TimestampNTZType(), "double": T.DoubleType(), "int": T.IntegerType()}
    kind = lambda c: T.StringType() if multiclass and c == "y_true" else kinds.get(TYPES.get(c, ""), T.StringType())
    return T.StructType([T.StructField(c, kind(c), c not in required, {"description": DESCRIPTIONS[c]}) for c in (*required, *OPTIONAL)])

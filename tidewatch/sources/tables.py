"""Reading and writing monitoring tables."""

from __future__ import annotations

import csv
import io
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config import Profile
from . import validate


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; empty cells are NULL."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(str(path))


def read_csv_text(spark: SparkSession, text: str | bytes) -> DataFrame:
    """A CSV file's content, as an upload has it (small by its nature)."""
    text = text.decode("utf-8-sig") if isinstance(text, bytes) else text
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        raise ValueError("the file is empty")
    head, body = rows[0], [tuple(v or None for v in r) for r in rows[1:] if r]
    return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in head))


def load(spark: SparkSession, path: str, profile: Profile | str = Profile.PUBLIC, multiclass: bool = False) -> DataFrame:
    """A validated table from CSV or, by its suffix, Parquet."""
    df = spark.read.parquet(path) if str(path).rstrip("/").endswith(".parquet") else read_csv(spark, path)
    return validate.validate(df, profile, multiclass)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of any size, as a folder of part files in the format of its suffix."""
    writer = df.write.mode(mode)
    writer.parquet(path) if path.rstrip("/").endswith(".parquet") else writer.option("header", True).csv(path)


def write_small_csv(df: DataFrame, path: str | Path) -> Path:
    """A result of a few rows as one CSV file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(small_csv(df), encoding="utf-8")
    return path


def small_csv(df: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in r] for r in df.collect())
    return out.getvalue()

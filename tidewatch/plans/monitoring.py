"""The monitoring table as a projection of the given tables, in integer arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. They do not change, so their files' footers are asked for the schema once a session."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: outcome from the order's status, score k / 1000 with planted version and time effects."""
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    joined = (
        lines.join(read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.expr("l_orderkey = o_orderkey"))
        .join(read("customer", "c_custkey", "c_mktsegment"), F.expr("o_custkey = c_custkey"))
        .join(read("part", "p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
        .join(read("supplier", "s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
        .join(read("nation", "n_nationkey", "n_regionkey"), F.expr("s_nationkey = n_nationkey"))
        .join(read("region", "r_regionkey", "r_name"), F.expr("n_regionkey = r_regionkey"))
    )
    ill = F.col("o_orderstatus") == "F"
    second = F.col("l_linenumber") % 2 == 0
    noise = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 500
    shift = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 200 - 100
    late = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & ~ill
    k = F.least(F.lit(1000), noise + F.when(ill, 400).otherwise(100) + F.when(second, shift).otherwise(0) + F.when(late, 120).otherwise(0))
    joined = joined.withColumn("k", k)
    return joined.select(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("patient_id"),
        F.col("l_shipdate").alias("study_date"),
        F.when(second, "v2.0").otherwise("v1.0").alias("model_version"),
        F.when(ill, 1).otherwise(0).alias("y_true"),
        (F.col("k") / F.lit(1000.0)).alias("y_pred_proba"),
        F.when(F.col("k") >= 500, 1).otherwise(0).alias("y_pred_binary"),
        F.col("r_name").alias("site"),
        F.when(F.col("l_partkey") % 29 != 0, F.col("p_brand")).alias("scanner_manufacturer"),
        F.col("l_returnflag").alias("modality"),
        F.col("o_orderpriority").alias("age_group"),
        F.col("l_linestatus").alias("sex"),
        F.when(~((F.col("l_suppkey") % 7 == 0) | (ill & (F.col("l_partkey") % 11 == 0))), F.col("c_mktsegment")).alias("race_ethnicity"),
    )


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as true labels, and a relabelling of two in seven orders as predictions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    other = F.when(F.col("o_orderkey") % 7 == 0, "1-URGENT").when(F.col("o_orderkey") % 7 == 1, "5-LOW").otherwise(F.col("o_orderpriority"))
    return orders.select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("patient_id"), F.col("o_orderdate").alias("study_date"), F.lit("v1.0").alias("model_version"),
        F.concat(F.lit(" "), F.col("o_orderpriority")).alias("y_true"), other.alias("y_pred_label"),
    )


#: The same projections for the SQL check.
MONITORING_SQL = """
base AS (
  SELECT *, LEAST(1000, (l_partkey*7919 + l_suppkey*104729 + l_linenumber*31) % 500
      + CASE WHEN o_orderstatus = 'F' THEN 400 ELSE 100 END
      + CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey*31 + l_suppkey*17) % 200 - 100 ELSE 0 END
      + CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' AND o_orderstatus <> 'F' THEN 120 ELSE 0 END) AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), mon AS (
  SELECT 'p' || CAST(l_orderkey AS VARCHAR) AS patient_id, l_shipdate AS study_date,
    CASE WHEN l_linenumber % 2 = 0 THEN 'v2.0' ELSE 'v1.0' END AS model_version,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true, k / 1000e0 AS y_pred_proba,
    CASE WHEN k >= 500 THEN 1 ELSE 0 END AS y_pred_binary, r_name AS site,
    CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE p_brand END AS scanner_manufacturer,
    l_returnflag AS modality, o_orderpriority AS age_group, l_linestatus AS sex,
    CASE WHEN l_suppkey % 7 = 0 OR (o_orderstatus = 'F' AND l_partkey % 11 = 0) THEN NULL ELSE c_mktsegment END AS race_ethnicity
  FROM base
)"""

MULTICLASS_SQL = """
mc AS (
  SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 1 THEN '5-LOW' ELSE o_orderpriority END AS p FROM orders
)"""

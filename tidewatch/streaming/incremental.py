"""Confusion counts and score histograms that follow a stream of predictions.

Both are sums over rows, so a micro-batch only adds its own sums to a table of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.stats import left_closed_bin
from ..operators import confusion


def batch_sums(batch: DataFrame, batch_id: int, bins: int = 10) -> DataFrame:
    """batch_id, model_version, bin and confusion counts of one micro-batch."""
    own = batch.withColumn("bin", left_closed_bin(F.col("y_pred_proba"), bins))
    return own.groupBy("model_version", "bin").agg(*confusion.counts()).select(F.lit(batch_id).cast("long").alias("batch_id"), "*")


def start(stream: DataFrame, path: str, checkpoint: str, bins: int = 10) -> StreamingQuery:
    """Write each micro-batch's sums to a folder named by its id; a batch that is run again replaces its own folder."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch_sums(batch, batch_id, bins).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def totals(sums: DataFrame) -> DataFrame:
    """Counts and rates by version over all batches."""
    found = sums.groupBy("model_version").agg(*(F.sum(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn")))
    return found.select("*", *(v.alias(k) for k, v in confusion.rates().items()))

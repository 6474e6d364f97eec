"""Distinct counts and extremes of a stream, kept as mergeable state that every micro-batch adds to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import SKETCH, c


def batch_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, low, high and sketch of each column of a batch."""
    parts = [F.struct(F.lit(x).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(c(x).isNull()).alias("nulls"), F.min(c(x).cast("string")).alias("low"), F.max(c(x).cast("string")).alias("high"), F.hll_sketch_agg(c(x).cast("string"), F.lit(SKETCH)).alias("sketch")) for x in columns]
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def merged(states: DataFrame) -> DataFrame:
    """The facts of all batches together; the order in which they came doesn't matter."""
    return states.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.least(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.sum("rows") - F.sum("nulls")).alias("distinct"))


def profile_stream(stream: DataFrame, columns: list[str], folder: str, checkpoint: str | None = None):
    """Start a query that writes each batch's state under the batch's number, so a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch_state(batch, columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{folder}-checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).start()

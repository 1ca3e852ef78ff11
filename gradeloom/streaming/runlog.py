"""Following a run log: the newest status of each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gradeloom.operators.status import latest_status
from gradeloom.streaming.scoring import file_stream


def follow_status(
    spark: SparkSession, source: str, schema: StructType, to_log, sink: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Keep ``sink/current`` at the newest status per step.

    The state has one entry per step of the run, a fixed list, so it needs no
    watermark. Each trigger writes the complete table to its own folder.
    """
    latest = latest_status(to_log(file_stream(spark, source, schema, max_files)))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        latest.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """The table of the last trigger."""
    batches = spark.read.parquet(sink)
    last = batches.agg({"batch": "max"}).scalar()
    return batches.filter(batches["batch"] == last).drop("batch")

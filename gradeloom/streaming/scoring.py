"""Scoring new files as they arrive, resumable through stream checkpoints.

Work already done is recorded in the stream's checkpoint and the file sink's
commit log, both in shared storage: a lost executor or a restarted driver
repeats at most the batch that was not committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

COMMITS = "checkpoint string, batch bigint, attempt string"


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def score_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    max_files: int | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Score every file not seen before with row-wise ``score`` and stop."""
    scored = score(file_stream(spark, source, schema, max_files, fmt))
    query = (
        scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def add_test_sets(
    spark: SparkSession,
    source: str,
    schema: StructType,
    score_all: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    max_files: int | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Run every stored model over each batch of new files.

    Each attempt at a batch writes a folder of its own and then one row in the table of commits
    that names it. Readers (``read_committed``) see the attempts named there: nothing of a batch that
    failed half-way, and a batch that is repeated after its commit is not written again.
    """
    spark.createDataFrame([], COMMITS).write.mode("append").parquet(f"{sink}/commits")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = spark.read.schema(COMMITS).parquet(f"{sink}/commits").filter((F.col("checkpoint") == checkpoint) & (F.col("batch") == batch_id))
        if done.isEmpty():
            attempt = f"{batch_id}-{uuid.uuid4().hex}"
            score_all(batch).write.parquet(f"{sink}/data/attempt={attempt}")
            _commit(spark, sink, checkpoint, batch_id, attempt)

    query = (
        file_stream(spark, source, schema, max_files, fmt).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _commit(spark: SparkSession, sink: str, checkpoint: str, batch_id: int, attempt: str) -> None:
    """One file with one row, moved into place when it is whole."""
    spark.createDataFrame([(checkpoint, batch_id, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{sink}/commits")


def read_committed(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """The rows of all committed batches under ``sink``; ``schema`` is that of the written rows."""
    commits = spark.read.schema(COMMITS).parquet(f"{sink}/commits")
    if commits.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, attempt string").parquet(f"{sink}/data")
    return rows.join(commits.select("attempt"), "attempt", "left_semi").drop("attempt")

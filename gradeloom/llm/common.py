"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import gradeloom
from gradeloom.session import fresh_path

SHIPPED = "spark.gradeloom.shipped"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(SHIPPED, "") != app:
        root = os.path.dirname(os.path.dirname(os.path.abspath(gradeloom.__file__)))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="gradeloom-code-"))
        archive = shutil.make_archive(f"{folder}/gradeloom-code", "zip", root, "gradeloom")
        spark.sparkContext.addPyFile(archive)
        spark.conf.set(SHIPPED, app)


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same rows as a table in the shared folder, and where it lies."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    return written_at(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a batch holds about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start = size = 0
        for row, length in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            if row > start and size + (length or 0) > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def carried(docs: DataFrame, text_col: str) -> DataFrame:
    """``text`` and, as one ``record``, all other columns: whatever their names, they pass untouched."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("none")]
    return docs.select(F.struct(*others).alias("record"), F.col(f"`{text_col}`").cast("string").alias("text"))


def restored(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of ``docs`` again, from what ``carried`` made of them."""
    return [F.col("text").alias(c) if c == text_col else F.col(f"record.`{c}`").alias(c) for c in docs.columns]

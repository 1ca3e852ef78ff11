"""Writing features, predictions and surprisal results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.probs import to_map
from gradeloom.operators.decide import argmax, rounded
from gradeloom.operators.scale import require
from gradeloom.session import full_uri, ship_code


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by feature set and dataset, so that readers can prune."""
    features.write.mode(mode).partitionBy("feature_set", "dataset").parquet(path)


def soft_predictions(probs: DataFrame) -> DataFrame:
    return probs.withColumn("probabilities", to_map(F.col("p"))).drop("p")


def write_predictions(probs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Soft, argmax and rounded predictions as JSON under ``model/dataset``."""
    shapes = {
        "soft_predictions": soft_predictions(probs),
        "argmax_predictions": argmax(probs).select("model", "dataset", "sample_id", F.col("pred_label").alias("predicted_label"), "confidence"),
        "rounded_avg_predictions": rounded(probs).select(
            "model", "dataset", "sample_id", F.col("pred_label").alias("predicted_label"), "expected_value", "rounded_index"
        ),
    }
    for name, df in shapes.items():
        df.write.mode(mode).partitionBy("model", "dataset").json(f"{path}/{name}")


def nest_aggregate(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of a text as one struct column ``aggregate``."""
    return scores.select("sample_id", "model", F.struct(*columns).alias("aggregate"))


def flatten_aggregate(nested: DataFrame) -> DataFrame:
    return nested.select("sample_id", "model", "aggregate.*")


def write_surprisal(nested: DataFrame, path: str, fmt: str = "json", aggregate_only: bool = False, mode: str = "overwrite") -> None:
    """json (one object per line), csv or parquet; csv is always flat."""
    flat = aggregate_only or fmt == "csv"
    df = flatten_aggregate(nested) if flat else nested
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format("json" if fmt in ("json", "jsonl") else fmt).save(path)


def _file_writer(uri: str):
    """Writes rows (name, text) sorted by name, gives the number of files; a file shows up under its name when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(uri)
        task = TaskContext.get()
        folder, draft = f"{root}/part={task.partitionId()}", f".{task.taskAttemptId()}"
        store.create_dir(folder)
        rows = (row for batch in batches for row in zip(batch["name"].to_pylist(), batch["text"].to_pylist()))
        n = 0
        for name, same in groupby(rows, key=lambda row: row[0]):
            if "/" in name:
                raise ValueError(f"no file name: {name}")
            with store.open_output_stream(f"{folder}/{draft}") as out:
                for _, text in same:
                    out.write(f"{text or ''}\n".encode())
            store.move(f"{folder}/{draft}", f"{folder}/{name}.txt")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return write


def write_text_files(texts: DataFrame, path: str, name: str, text: str) -> int:
    """One file ``<name>.txt`` per row, in a folder per task; gives the number of files. A missing name is ``null``, a missing text empty.

    Rows of one name in one task share a file, a line each. Files are written by the tasks themselves, with no folder, checksum
    file or rename at the driver for each; ``path`` must lie in a file system that pyarrow reaches. ``readers.read_whole_texts`` reads them.
    """
    require(texts, name, text)
    ship_code(texts.sparkSession)
    rows = texts.select(F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text"))
    uri = full_uri(texts.sparkSession, path)
    store, root = FileSystem.from_uri(uri)
    store.create_dir(root)  # a table without rows has a folder, too
    return rows.sortWithinPartitions("name").mapInArrow(_file_writer(uri), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

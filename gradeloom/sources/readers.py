"""Reading corpora, labels, features and predictions with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.text import clean_text, strip
from gradeloom.operators.scale import require
from gradeloom.sources.ranges import read_csv

CORPUS_SCHEMA = "sample_id bigint, grp string, label string, text string"

# Texts hold quotes and line breaks. Spark's own reader gives such a file to one
# task; ``ranges.read_csv`` reads the same format by byte ranges.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, fmt: str = "csv") -> DataFrame:
    """Labelled texts; a missing text is empty."""
    df = read_csv(spark, path, schema).drop("file") if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    require(df, "text")
    return df.withColumn("text", clean_text(F.col("text")))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)


def read_corpus_dir(spark: SparkSession, folders: list[str], schema: str = CORPUS_SCHEMA, fmt: str = "csv") -> DataFrame:
    """All files of one or more folders in one read; ``dataset`` is the folder
    name for partitioned data and else the file stem."""
    if fmt == "csv":
        df = read_csv(spark, folders, schema)
    else:
        df = spark.read.schema(schema).format(fmt).load(folders).withColumn("file", F.input_file_name())
    parent = F.regexp_extract("file", r"dataset=([^/]+)/", 1)
    name = F.when(parent != "", parent).otherwise(file_stem(F.col("file")))
    return df.withColumn("dataset", name).withColumn("text", clean_text(F.col("text"))).drop("file")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per non-blank line."""
    return text_lines(spark.read.text(path), "value")


def text_lines(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same rule for texts that sit in a column."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(column), r"\r\n|\r|\n")).alias("line", "text"))
    lines = lines.withColumn("text", strip(F.col("text"))).filter(F.length("text") > 0)
    return lines if keys else lines.drop("line")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: ``(name, text)`` plus any partition columns."""
    files = spark.read.text(path, wholetext=True)
    return files.withColumn("name", file_stem(F.input_file_name())).withColumnRenamed("value", "text")


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feature CSV, compressed or not, without index and id leftovers.

    A gzip file is read by one task; the rows are spread right after.
    """
    df = spark.read.options(header="true").schema(schema).csv(path)
    return df.drop("Unnamed: 0", "writing_id").repartition(spark.sparkContext.defaultParallelism)


def ground_truth(df: DataFrame, id_column: str, label_column: str, order_column: str | None = None) -> DataFrame:
    """``(sample_id, label)`` as strings; of repeated ids the last one counts."""
    require(df, id_column, label_column)
    sid, label = F.col(id_column).cast("string"), F.col(label_column).cast("string")
    if order_column is None:
        return df.select(sid.alias("sample_id"), label.alias("label")).dropDuplicates(["sample_id"])
    last = F.max_by(F.struct(label.alias("label")), F.struct(F.col(order_column), label))
    return df.groupBy(sid.alias("sample_id")).agg(last.alias("_r")).select("sample_id", "_r.label")


def attach_labels(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and the ids that one side lacks."""
    from gradeloom.operators.joins import unmatched, with_labels

    return with_labels(features, labels), unmatched(features, labels)


def line_labels(df: DataFrame, text: str, key: str) -> DataFrame:
    """Labels stored one per line, numbered by line within their file."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line", "label"))
    return lines.withColumn("label", strip(F.col("label")))

"""Predictions made elsewhere: soft JSON files and free-text answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.answers import label_from_keys, parse_answer
from gradeloom.functions.lets import let
from gradeloom.functions.levels import LEVELS, ordinal
from gradeloom.functions.probs import from_map, one_hot
from gradeloom.operators.scale import require
from gradeloom.sources.ranges import read_json_entries
from gradeloom.sources.readers import file_stem, read_whole_texts


def soft_file_rows(spark: SparkSession, paths, levels=LEVELS) -> DataFrame:
    """``(model, sample_id, p)`` from files that hold one object ``id -> {label: prob}`` each, read by byte ranges; the model is the file's folder or, without one, its stem."""
    entries = read_json_entries(spark, paths, "map<string,double>")
    folder = F.regexp_extract("file", r"model=([^/]+)/", 1)
    model = F.when(folder != "", folder).otherwise(file_stem(F.col("file")))
    return entries.select(model.alias("model"), F.col("id").alias("sample_id"), from_map(F.col("value"), levels).alias("p"))


def labels_from_answers(answers: DataFrame, answer: str = "answer", levels=LEVELS) -> DataFrame:
    """Adds ``label`` (null when unreadable) and ``parsed``."""
    require(answers, answer)
    both = lambda m: F.struct(label_from_keys(m, levels).alias("label"), m.isNotNull().alias("parsed"))
    return answers.withColumn("_found", let(parse_answer(F.col(answer), levels), both)).select("*", "_found.*").drop("_found")


def answers_to_probs(answers: DataFrame, answer: str = "answer", levels=LEVELS) -> DataFrame:
    """Readable answers as one-hot probabilities."""
    labelled = labels_from_answers(answers, answer, levels).filter(F.col("label").isNotNull())
    return labelled.withColumn("p", one_hot(ordinal(F.col("label"), levels), len(levels)))


def parse_totals(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many answers could be parsed, how many of them named a level, and how many could not be parsed."""
    return labelled.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("parsed")).alias("n_parsed"),
        F.count_if(F.col("label").isNotNull()).alias("n_labelled"),
        F.count_if(~F.col("parsed")).alias("n_failed"),
    )


def answers_from_folder(spark: SparkSession, path: str, levels=LEVELS) -> DataFrame:
    """``(name, answer, label, parsed)`` and the folder's partition columns, one row per file; the name is the file's stem.

    ``parse_totals`` counts the rows; the names with ``parsed`` false are the files that failed.
    """
    files = read_whole_texts(spark, path).withColumnRenamed("text", "answer")
    return labels_from_answers(files, "answer", levels)

"""Which outputs exist, which are missing, and which label file fits a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.lets import int_range


def missing_outputs(expected: DataFrame, existing: DataFrame, keys=("model", "dataset")) -> DataFrame:
    """Expected outputs with a flag for those already there."""
    have = existing.select(*keys).distinct().withColumn("_have", F.lit(True))
    return expected.join(have, list(keys), "left").withColumn("exists", F.coalesce("_have", F.lit(False))).drop("_have")


def match_label_files(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Best label file per dataset, null when none fits.

    Tried in turn: same name, ``norm-`` prefix, upper case, prefixed upper case,
    then a file whose name contains the dataset's, ignoring case. All of these
    are equality joins: the four spellings are listed per dataset, and file
    names are listed with their substrings. The first name wins inside a class.
    """
    name = F.col("dataset")
    spellings = F.array(name, F.concat(F.lit("norm-"), name), F.upper(name), F.concat(F.lit("norm-"), F.upper(name)))
    wanted = datasets.select("dataset").distinct()
    exact = wanted.select("dataset", F.posexplode(spellings).alias("match_class", "label_file"))
    exact = exact.join(files.select("label_file").distinct(), "label_file")
    low = F.lower("label_file")
    parts = F.transform(
        int_range(1, F.length(low)),
        lambda i: F.transform(int_range(1, F.length(low) - i + 1), lambda n: F.substring(low, i, n)),
    )
    pieces = files.select("label_file").distinct().select(
        "label_file", F.explode(F.array_distinct(F.flatten(parts))).alias("piece")
    )
    loose = wanted.withColumn("piece", F.lower("dataset")).join(pieces, "piece").select("dataset", F.lit(4).alias("match_class"), "label_file")
    found = exact.select("dataset", "match_class", "label_file").unionByName(loose)
    best = found.groupBy("dataset").agg(F.min(F.struct("match_class", "label_file")).alias("_b"))
    return wanted.join(best, "dataset", "left").select("dataset", F.col("_b.match_class").alias("match_class"), F.col("_b.label_file").alias("label_file"))


def dataset_union(feature_files: DataFrame) -> DataFrame:
    """Distinct dataset names over all feature folders."""
    return feature_files.select("dataset").distinct()


def dataset_gaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(dataset, missing_in)`` of names that only one side has."""
    a, b = left.select("dataset"), right.select("dataset")
    only_left = a.subtract(b).withColumn("missing_in", F.lit("right"))
    return only_left.unionByName(b.subtract(a).withColumn("missing_in", F.lit("left")))


def label_overlap(labels: DataFrame, levels: DataFrame) -> DataFrame:
    return labels.select("label").intersect(levels.select("label"))


def label_union(true: DataFrame, predicted: DataFrame) -> DataFrame:
    return true.select("label").union(predicted.select("label")).distinct()

"""No join runs on a handful of keys when nothing is broadcast by size."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "keys"),
    [("token_topk", "model"), ("lm_unigrams", "model"), ("tfidf_grouped_fit", "grp"), ("split_stratified", "true_label")],
)
def test_no_sort_merge_join_on_few_keys(spark, name, keys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.findall(rf"SortMergeJoin \[{keys}#\d+\], \[{keys}#\d+\]", plan)


def test_language_models_scan_the_texts_once(spark):
    plan = entry.queries()["lm_fit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # the counted pairs are stored, and all else reads those

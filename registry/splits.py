"""Splits, encodings and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.levels import LEVELS, ordinal
from gradeloom.operators import split as S
from registry.base import SAMPLES_SQL, query, rounded_out, samples, table, with_sql


@query(
    "split_random",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= ceil((SELECT count(*) FROM documents) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents",
)
def split_random(spark, sf):
    return S.split_random(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2)


QUOTA_SQL = (
    SAMPLES_SQL
    + """,
c AS (SELECT true_label, count(*)::BIGINT AS n FROM samples GROUP BY 1),
q AS (SELECT *, (sum(n) OVER ())::BIGINT AS n_all, ceil((sum(n) OVER ()) * 0.25::DOUBLE)::BIGINT AS n_test FROM c),
b AS (SELECT *, (n * n_test) // n_all AS base, (n * n_test) % n_all AS rest FROM q),
quotas AS (SELECT true_label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, true_label) <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
parts AS (SELECT sample_id, true_label, CASE WHEN row_number() OVER (PARTITION BY true_label ORDER BY md5('42|' || sample_id), sample_id) <= quota THEN 'test' ELSE 'train' END AS split
  FROM samples JOIN quotas USING (true_label))"""
)


def _split(spark, sf):
    return S.split_stratified(samples(spark, sf).select("sample_id", "true_label"), "sample_id", "true_label", 0.25)


@query("split_stratified", with_sql(QUOTA_SQL, "SELECT sample_id, true_label, split FROM parts"))
def split_stratified(spark, sf):
    return _split(spark, sf).select("sample_id", "true_label", "split")


@query("split_distribution", with_sql(QUOTA_SQL, "SELECT split, true_label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM parts GROUP BY split, true_label"))
def split_distribution(spark, sf):
    return rounded_out(S.label_distribution(_split(spark, sf), "true_label", ["split"]))


@query("label_distribution", with_sql(SAMPLES_SQL, "SELECT true_label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM samples GROUP BY true_label"))
def label_distribution(spark, sf):
    return rounded_out(S.label_distribution(samples(spark, sf), "true_label"))


@query("encode_labels", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS code FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)")
def encode_labels(spark, sf):
    return S.encode_labels(table(spark, sf, "orders"), "o_orderpriority")


@query("encode_ordinal", with_sql(SAMPLES_SQL, "SELECT sample_id, true_label, true_ord AS code FROM samples"))
def encode_ordinal(spark, sf):
    return samples(spark, sf).select("sample_id", "true_label", ordinal(F.col("true_label")).alias("code"))


@query(
    "remap_contiguous",
    with_sql(SAMPLES_SQL, "SELECT label, ord, (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS code FROM (SELECT DISTINCT true_label AS label, true_ord AS ord FROM samples WHERE true_ord NOT IN (1, 3))"),
)
def remap_contiguous(spark, sf):
    return S.remap_contiguous(samples(spark, sf).filter("true_ord NOT IN (1, 3)"), "true_label", LEVELS)


FREQ_SQL = SAMPLES_SQL + ", f AS (SELECT true_label, count(*)::BIGINT AS n, (sum(count(*)) OVER ()) / (count(*) OVER () * count(*)) AS w FROM samples GROUP BY true_label)"


@query("class_weights", with_sql(FREQ_SQL, "SELECT true_label, n, round(w, 6) AS weight FROM f"))
def class_weights(spark, sf):
    return rounded_out(S.class_weights(samples(spark, sf), "true_label"))


@query("sample_weights", with_sql(FREQ_SQL, "SELECT sample_id, round(0.3::DOUBLE + 0.7::DOUBLE * sqrt(w), 6) AS weight FROM samples JOIN f USING (true_label)"))
def sample_weights(spark, sf):
    rows = samples(spark, sf).select("sample_id", "true_label")
    return rounded_out(S.sample_weights(rows, "true_label", len(LEVELS), "inverse_sqrt", 0.7).select("sample_id", "weight"))

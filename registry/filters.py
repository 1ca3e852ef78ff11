"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import levels as L, names as N, text as T
from gradeloom.operators import features as FE, filters as FI
from gradeloom.operators.split import hash_sample
from registry.base import LEVEL_LIST, METRICS_SQL, PROBS_SQL, SAMPLES_SQL, SPACE_SQL, metric_records, probs, query, rounded_out, samples, table, with_sql


@query("filter_min_length", with_sql(SAMPLES_SQL, "SELECT sample_id, length(text)::INTEGER AS n FROM samples WHERE length(text) >= 800"))
def filter_min_length(spark, sf):
    return FI.min_length(samples(spark, sf), 800).select("sample_id", F.length("text").alias("n"))


BLANKS_SQL = """
lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS text FROM documents)"""


@query(
    "filter_blank",
    with_sql(
        BLANKS_SQL,
        "SELECT doc_id, count(*)::BIGINT AS n_lines FROM lines WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY doc_id",
    ),
)
def filter_blank(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("text"))
    return FI.not_blank(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("limit_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def limit_rows(spark, sf):
    return FI.first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query("sample_rows", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 150")
def sample_rows(spark, sf):
    return hash_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 150)


@query(
    "numeric_features",
    """SELECT event_id, user_id::DOUBLE AS user_id, value, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0::DOUBLE) AS event_type,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0::DOUBLE) AS k FROM events""",
)
def numeric_features(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "value", "event_type", F.get_json_object("props", "$.k").alias("k"), F.lit("note").alias("text"), F.lit("m").alias("model")
    )
    return FE.numeric_columns(e, keep=("event_id",))


@query("filter_metrics", with_sql(METRICS_SQL, "SELECT model, dataset, strategy, round(accuracy, 6) AS accuracy FROM metrics WHERE strategy = 'argmax' AND dataset NOT IN ('src3', 'src4') AND lower(dataset) NOT LIKE '%src1%'"))
def filter_metrics(spark, sf):
    kept = FI.select_metrics(metric_records(spark, sf), strategy="argmax", exclude=["src3", "src4"], exclude_containing="src1")
    return rounded_out(kept.select("model", "dataset", "strategy", "accuracy"))


@query("filter_level", with_sql(SAMPLES_SQL, "SELECT sample_id, dataset FROM samples WHERE true_label = 'B2'"))
def filter_level(spark, sf):
    return FI.of_level(samples(spark, sf), "B2", "true_label").select("sample_id", "dataset")


@query(
    "rename_prefix",
    "SELECT vec_id AS sample_id, 'emb' || label || '__v' || (i - 1) AS feature, round(embedding[i]::DOUBLE, 6) AS \"value\" FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)",
)
def rename_prefix(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "value"))
    long = e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("v"), F.col("i")).alias("feature"), F.col("value").cast("double").alias("value"), "label")
    return rounded_out(FE.prefix_features(long, F.concat(F.lit("emb"), F.col("label"))).drop("label"))


NAMES_SQL = """
named AS (SELECT o_orderkey, o_orderkey % 997 AS h,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'train_Logistic_' WHEN '2-HIGH' THEN 'train_xgboost_' WHEN '3-MEDIUM' THEN 'set_RandomForest_'
       WHEN '4-NOT SPECIFIED' THEN 'an-external-model-with-a-long-name_' ELSE 'train_svm_' END
  || substr(md5(o_orderkey::VARCHAR), 1, 8) ||
  CASE o_orderstatus WHEN 'O' THEN '_tfidf' WHEN 'F' THEN '_tfidf_grouped' ELSE '_perplexity' END AS model FROM orders)"""


def _names(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = (
        F.when(p == "1-URGENT", "train_Logistic_").when(p == "2-HIGH", "train_xgboost_").when(p == "3-MEDIUM", "set_RandomForest_")
        .when(p == "4-NOT SPECIFIED", "an-external-model-with-a-long-name_").otherwise("train_svm_")
    )
    tail = F.when(s == "O", "_tfidf").when(s == "F", "_tfidf_grouped").otherwise("_perplexity")
    return o.select("o_orderkey", F.concat(kind, F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), tail).alias("model"))


@query(
    "display_name",
    with_sql(
        NAMES_SQL,
        """SELECT o_orderkey, CASE WHEN kind IS NULL THEN substr(model, 1, 30) ELSE kind || ' ' || feat END AS display_name FROM (
           SELECT o_orderkey, model, CASE WHEN lower(model) LIKE '%logistic%' THEN 'Logistic Reg.' WHEN lower(model) LIKE '%xgboost%' THEN 'XGBoost'
             WHEN lower(model) LIKE '%randomforest%' THEN 'Random Forest' WHEN lower(model) LIKE '%multinomialnb%' THEN 'Naive Bayes'
             WHEN lower(model) LIKE '%svm%' THEN 'SVM' END AS kind,
             CASE WHEN lower(model) LIKE '%tfidf%' THEN 'tf-idf' WHEN lower(model) LIKE '%perp%' THEN 'perplexities' ELSE 'unknown' END AS feat FROM named)""",
    ),
)
def display_name(spark, sf):
    return _names(spark, sf).select("o_orderkey", N.display_name(F.col("model")).alias("display_name"))


@query("parse_model_name", with_sql(NAMES_SQL, "SELECT o_orderkey, model, nullif(regexp_extract(model, '_([0-9a-f]{8}_tfidf(?:_grouped)?)', 1), '') AS feature_key FROM named"))
def parse_model_name(spark, sf):
    return _names(spark, sf).select("o_orderkey", "model", N.feature_key(F.col("model")).alias("feature_key"))


@query(
    "level_distance",
    with_sql(
        PROBS_SQL,
        f"""SELECT model, sample_id, true_label, {LEVEL_LIST}[pred + 1] AS pred_label, abs(true_ord - pred)::INTEGER AS distance,
            abs(true_ord - pred) <= 1 AS adjacent, {LEVEL_LIST}[nullif(true_ord + 2, 0)] AS next_label, true_ord + 1 <= 5 AS next_valid
            FROM (SELECT *, (list_position(p, list_max(p)) - 1)::INTEGER AS pred FROM probs)""",
    ),
)
def level_distance(spark, sf):
    p = probs(spark, sf)
    pred = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    p = p.withColumn("pred_label", L.label_at(pred))
    a, b = L.ordinal(F.col("true_label")), L.ordinal(F.col("pred_label"))
    return p.select(
        "model", "sample_id", "true_label", "pred_label", L.distance(a, b).alias("distance"), L.is_adjacent(a, b).alias("adjacent"),
        L.label_at(a + 1).alias("next_label"), L.is_valid_ord(a + 1).alias("next_valid"),
    )


RAW_LABELS_SQL = (
    SAMPLES_SQL
    + """,
raw AS (SELECT sample_id, CASE WHEN dataset LIKE 'src1%' THEN ' ' || lower(true_label) || ' ' WHEN dataset = 'src2' THEN true_label || '+'
               WHEN dataset = 'src3' THEN '' ELSE true_label END AS label FROM samples)"""
)


def _raw_labels(spark, sf):
    d, t = F.col("dataset"), F.col("true_label")
    label = F.when(d.startswith("src1"), F.concat(F.lit(" "), F.lower(t), F.lit(" "))).when(d == "src2", F.concat(t, F.lit("+"))).when(d == "src3", "").otherwise(t)
    return samples(spark, sf).select("sample_id", label.alias("label"))


@query("validate_labels", with_sql(RAW_LABELS_SQL, "SELECT sample_id, label FROM raw WHERE upper(trim(label)) NOT IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2')"))
def validate_labels(spark, sf):
    return FI.invalid_labels(_raw_labels(spark, sf))


@query(
    "validate_probs",
    with_sql(
        PROBS_SQL,
        """SELECT model, sample_id, NOT (s BETWEEN 0.99::DOUBLE AND 1.01::DOUBLE) AS bad_sum, NOT (c BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE) AS bad_confidence FROM (
           SELECT model, sample_id, list_sum(q) AS s, list_max(q) * 1.5::DOUBLE AS c FROM (
             SELECT model, sample_id, list_transform(p, lambda v: v * (CASE WHEN true_ord = 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END)) AS q FROM probs))
           WHERE NOT (s BETWEEN 0.99::DOUBLE AND 1.01::DOUBLE) OR NOT (c BETWEEN 0.0::DOUBLE AND 1.0::DOUBLE)""",
    ),
)
def validate_probs(spark, sf):
    factor = F.when(F.col("true_ord") == 0, F.lit(1.05)).otherwise(F.lit(1.0))
    off = probs(spark, sf).withColumn("p", F.transform("p", lambda v: v * factor)).withColumn("confidence", F.array_max("p") * F.lit(1.5))
    return FI.invalid_probs(off).select("model", "sample_id", "bad_sum", "bad_confidence")


SCALAR_SQL = """
SELECT l_orderkey, l_linenumber, upper(l_returnflag) || lower(l_linestatus) AS flags, round(log2(l_quantity), 6) AS bits, round(ln(l_extendedprice), 6) AS nats,
       round(exp(l_discount), 6) AS growth, round(sqrt(l_quantity), 6) AS root, round(pow(l_quantity, 2), 6) AS squared,
       least(5.0::DOUBLE, greatest(0.0::DOUBLE, round_even(l_quantity / 10.0, 0))) AS clipped, replace(l_returnflag, 'A', 'a') AS replaced,
       substr(sha256(l_orderkey::VARCHAR), 1, 8) AS digest FROM lineitem"""


@query("scalar_functions", SCALAR_SQL)
def scalar_functions(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded_out(
        li.select(
            "l_orderkey", "l_linenumber", F.concat(F.upper("l_returnflag"), F.lower("l_linestatus")).alias("flags"),
            F.log2("l_quantity").alias("bits"), F.log("l_extendedprice").alias("nats"), F.exp("l_discount").alias("growth"),
            F.sqrt("l_quantity").alias("root"), F.pow("l_quantity", F.lit(2)).alias("squared"),
            F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.rint(F.col("l_quantity") / 10.0))).alias("clipped"),
            F.replace("l_returnflag", F.lit("A"), F.lit("a")).alias("replaced"),
            F.substring(F.sha2(F.col("l_orderkey").cast("string"), 256), 1, 8).alias("digest"),
        )
    )


@query("word_count", with_sql(SAMPLES_SQL, f"SELECT sample_id, len(list_filter(string_split_regex(text, '{SPACE_SQL}+'), lambda t: t <> ''))::INTEGER AS n_words FROM samples"))
def word_count(spark, sf):
    return samples(spark, sf).select("sample_id", F.size(T.space_tokens(F.col("text"))).alias("n_words"))

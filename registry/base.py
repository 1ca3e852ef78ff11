"""Views shared by the registered queries, in Spark and as SQL common tables.

The given tables carry no level column, so the views derive one: the true level
is a band of the text length, and three simple scorers stand in for models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.functions.lets import let
from gradeloom.functions.levels import LEVELS, label_at
from gradeloom.functions.text import clean_text, space_tokens
from gradeloom.operators import decide, metrics as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BANDS = (500, 900, 1500, 2700, 5300)
SCORERS = ("train_logistic_005ebc16_tfidf", "train_multinomialnb_e2752d18_tfidf", "train_xgboost_10b21d1b_tfidf_grouped")
STRATEGIES = ("argmax", "rounded_avg")


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can say the same, its twin."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def band(size: Column) -> Column:
    out = F.when(size < BANDS[0], 0)
    for k, top in enumerate(BANDS[1:], start=1):
        out = out.when(size < top, k)
    return out.otherwise(len(BANDS))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    return docs.select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"), F.col("lang").alias("grp"),
        clean_text(F.col("text")).alias("text"), band(F.col("n_chars")).alias("true_ord"),
    ).withColumn("true_label", label_at(F.col("true_ord")))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as unseen texts."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), clean_text(F.col("text")).alias("text"))


def _peaked(x: Column) -> Column:
    """Six probabilities that peak at position x."""
    weights = [1.0 / (1.0 + (F.lit(float(k)) - x) * (F.lit(float(k)) - x)) for k in range(6)]
    return let(F.array(*weights), lambda w: F.transform(w, lambda v: v / (w[0] + w[1] + w[2] + w[3] + w[4] + w[5])))


def probs(spark: SparkSession, sf: str) -> DataFrame:
    """``(model, dataset, sample_id, true_ord, true_label, p)``."""
    s = samples(spark, sf).withColumn("ts", space_tokens(F.col("text")))
    s = s.select(
        "dataset", "sample_id", "true_ord", "true_label",
        F.size("ts").cast("double").alias("w"), F.size(F.array_distinct("ts")).cast("double").alias("d"),
        F.length("text").cast("double").alias("c"),
    )
    cap = lambda x: F.least(F.lit(5.0), x)
    at = F.array(
        F.struct(F.lit(SCORERS[0]).alias("model"), cap(F.col("w") / 80.0).alias("x")),
        F.struct(F.lit(SCORERS[1]).alias("model"), cap(F.col("d") / 60.0).alias("x")),
        F.struct(F.lit(SCORERS[2]).alias("model"), cap(F.col("c") / (F.col("w") + 1.0) / 2.0).alias("x")),
    )
    s = s.select("dataset", "sample_id", "true_ord", "true_label", F.inline(at))
    return s.withColumn("p", _peaked(F.col("x"))).drop("x")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return decide.both_strategies(probs(spark, sf))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(predictions(spark, sf))


def metric_records(spark: SparkSession, sf: str) -> DataFrame:
    return M.report_metrics(confusion(spark, sf))


def rounded_out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions to six digits, for comparison only."""
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


# ---------------------------------------------------------------- SQL twins

# The white space that Python, and a Unicode pattern in Spark, knows.
SPACE_SQL = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

LEVEL_LIST = "[" + ", ".join(f"'{l}'" for l in LEVELS) + "]"

SAMPLES_SQL = f"""
samples AS (
  SELECT *, {LEVEL_LIST}[true_ord + 1] AS true_label FROM (
    SELECT doc_id AS sample_id, source AS dataset, lang AS grp, coalesce(text, '') AS text,
           CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 900 THEN 1 WHEN n_chars < 1500 THEN 2
                WHEN n_chars < 2700 THEN 3 WHEN n_chars < 5300 THEN 4 ELSE 5 END AS true_ord
    FROM documents))"""

TURNS_SQL = "turns AS (SELECT conv_id * 1000 + turn AS sample_id, coalesce(text, '') AS text FROM conversations)"

_W = [f"(1.0::DOUBLE / (1.0::DOUBLE + ({k}.0::DOUBLE - x) * ({k}.0::DOUBLE - x)))" for k in range(6)]

PROBS_SQL = (
    SAMPLES_SQL
    + f""",
sized AS (
  SELECT dataset, sample_id, true_ord, true_label, len(ts)::DOUBLE AS w, len(list_distinct(ts))::DOUBLE AS d, length(text)::DOUBLE AS c
  FROM (SELECT *, list_filter(string_split_regex(text, '{SPACE_SQL}+'), lambda t: t <> '') AS ts FROM samples)),
scored AS (
  SELECT '{SCORERS[0]}' AS model, dataset, sample_id, true_ord, true_label, least(5.0::DOUBLE, w / 80.0::DOUBLE) AS x FROM sized
  UNION ALL SELECT '{SCORERS[1]}', dataset, sample_id, true_ord, true_label, least(5.0::DOUBLE, d / 60.0::DOUBLE) FROM sized
  UNION ALL SELECT '{SCORERS[2]}', dataset, sample_id, true_ord, true_label, least(5.0::DOUBLE, c / (w + 1.0::DOUBLE) / 2.0::DOUBLE) FROM sized),
heights AS (SELECT *, {", ".join(f"{w} AS w{k}" for k, w in enumerate(_W))} FROM scored),
probs AS (
  SELECT model, dataset, sample_id, true_ord, true_label,
         list_transform([w0, w1, w2, w3, w4, w5], lambda v: v / (w0 + w1 + w2 + w3 + w4 + w5)) AS p
  FROM heights)"""
)

PREDICTIONS_SQL = (
    PROBS_SQL
    + f""",
ready AS (
  SELECT *, list_max(p) AS confidence,
         0.0 + p[1] * 0.0 + p[2] * 1.0::DOUBLE + p[3] * 2.0::DOUBLE + p[4] * 3.0::DOUBLE + p[5] * 4.0::DOUBLE + p[6] * 5.0::DOUBLE AS expected_value
  FROM probs),
predictions AS (
  SELECT *, {LEVEL_LIST}[pred_ord + 1] AS pred_label FROM (
    SELECT model, dataset, sample_id, true_ord, true_label, p, confidence, expected_value, 'argmax' AS strategy,
           (list_position(p, confidence) - 1)::INTEGER AS pred_ord FROM ready
    UNION ALL
    SELECT model, dataset, sample_id, true_ord, true_label, p, confidence, expected_value, 'rounded_avg',
           greatest(0, least(5, round_even(expected_value, 0)::INTEGER)) FROM ready))"""
)

CONFUSION_SQL = (
    PREDICTIONS_SQL
    + """,
confusion AS (
  SELECT model, dataset, strategy, true_ord, pred_ord, count(*)::BIGINT AS n
  FROM predictions GROUP BY ALL)"""
)

CLASS_SQL = (
    CONFUSION_SQL
    + """,
class_counts AS (
  SELECT model, dataset, strategy, ord, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(support)::BIGINT AS support
  FROM (SELECT model, dataset, strategy, true_ord AS ord, CASE WHEN true_ord = pred_ord THEN n ELSE 0 END AS tp, 0 AS n_pred, n AS support FROM confusion
        UNION ALL SELECT model, dataset, strategy, pred_ord, 0, n, 0 FROM confusion)
  GROUP BY ALL),
class_report AS (
  SELECT *, coalesce(tp / nullif(n_pred, 0), 0.0) AS "precision", coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(n_pred + support, 0), 0.0) AS f1
  FROM class_counts)"""
)

METRICS_SQL = (
    CLASS_SQL
    + """,
basic AS (
  SELECT model, dataset, strategy, sum(CASE WHEN true_ord = pred_ord THEN n ELSE 0 END) / sum(n) AS accuracy,
         sum(CASE WHEN abs(true_ord - pred_ord) <= 1 THEN n ELSE 0 END) / sum(n) AS adjacent_accuracy, sum(n)::BIGINT AS n_samples
  FROM confusion GROUP BY ALL),
truth_avg AS (
  SELECT model, dataset, strategy, CASE WHEN count(*) > 1 THEN avg(f1) ELSE 0.0 END AS macro_f1,
         CASE WHEN count(*) > 1 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS weighted_f1,
         CASE WHEN count(*) > 1 THEN 2.0 * sum(tp) / sum(n_pred + support) ELSE 0.0 END AS micro_f1
  FROM class_report WHERE support > 0 GROUP BY ALL),
metrics AS (
  SELECT model, dataset, strategy, accuracy, adjacent_accuracy, macro_f1, weighted_f1, micro_f1, n_samples
  FROM basic JOIN truth_avg USING (model, dataset, strategy))"""
)


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"

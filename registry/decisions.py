"""Decision rules on class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import decide as D
from registry.base import LEVEL_LIST, PREDICTIONS_SQL, PROBS_SQL, SAMPLES_SQL, predictions, probs, query, rounded_out, samples, table, with_sql


@query(
    "predict_argmax",
    with_sql(PREDICTIONS_SQL, "SELECT model, sample_id, pred_label, round(confidence, 6) AS confidence FROM predictions WHERE strategy = 'argmax'"),
)
def predict_argmax(spark, sf):
    return rounded_out(D.argmax(probs(spark, sf)).select("model", "sample_id", "pred_label", "confidence"))


@query(
    "predict_rounded",
    with_sql(
        PREDICTIONS_SQL,
        "SELECT model, sample_id, pred_label, round(expected_value, 6) AS expected_value, pred_ord AS rounded_index FROM predictions WHERE strategy = 'rounded_avg'",
    ),
)
def predict_rounded(spark, sf):
    return rounded_out(D.rounded(probs(spark, sf)).select("model", "sample_id", "pred_label", "expected_value", "rounded_index"))


@query(
    "predict_threshold",
    with_sql(
        PREDICTIONS_SQL,
        f"""SELECT model, sample_id, {LEVEL_LIST}[k + 1] AS pred_label, k AS pred_ord FROM (
            SELECT model, sample_id, ((expected_value >= 0.7)::INTEGER + (expected_value >= 1.6)::INTEGER + (expected_value >= 2.4)::INTEGER
              + (expected_value >= 3.1)::INTEGER + (expected_value >= 3.9)::INTEGER) AS k FROM ready)""",
    ),
)
def predict_threshold(spark, sf):
    return D.by_threshold(probs(spark, sf), [0.7, 1.6, 2.4, 3.1, 3.9]).select("model", "sample_id", "pred_label", "pred_ord")


@query(
    "predict_topk",
    with_sql(
        PROBS_SQL,
        f"""SELECT model, sample_id, "rank", label, round(prob, 6) AS prob FROM (
            SELECT model, sample_id, {LEVEL_LIST}[i] AS label, p[i] AS prob, (row_number() OVER (PARTITION BY model, sample_id ORDER BY p[i] DESC, i))::INTEGER AS "rank"
            FROM probs, unnest(range(1, 7)) t(i)) WHERE "rank" <= 3""",
    ),
)
def predict_topk(spark, sf):
    return rounded_out(D.top_k(probs(spark, sf), 3, keys=("model", "sample_id")))


@query(
    "latest_prediction",
    """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_prediction(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return D.latest(e, "ts", ["user_id"], "event_id")


@query(
    "majority_baseline",
    with_sql(
        SAMPLES_SQL,
        """SELECT dataset, true_label AS majority_label, n, n_samples, round(n / n_samples, 6) AS accuracy FROM (
           SELECT dataset, true_label, count(*)::BIGINT AS n, (sum(count(*)) OVER (PARTITION BY dataset))::BIGINT AS n_samples,
                  row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, true_label) AS r FROM samples GROUP BY dataset, true_label) WHERE r = 1""",
    ),
)
def majority_baseline(spark, sf):
    return rounded_out(D.majority_baseline(samples(spark, sf)))


@query("predict_eval_lm", with_sql(PREDICTIONS_SQL, "SELECT model, sample_id, pred_label, true_label, pred_label = true_label AS correct FROM predictions WHERE strategy = 'argmax'"))
def predict_eval_lm(spark, sf):
    return D.correctness(D.argmax(probs(spark, sf))).select("model", "sample_id", "pred_label", "true_label", "correct")


@query("predict_eval_accuracy", with_sql(PREDICTIONS_SQL, "SELECT model, round(avg((pred_label = true_label)::INTEGER), 6) AS accuracy, count(*)::BIGINT AS n FROM predictions WHERE strategy = 'argmax' GROUP BY model"))
def predict_eval_accuracy(spark, sf):
    rows = D.correctness(D.argmax(probs(spark, sf)))
    return rounded_out(rows.groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


@query(
    "predict_both",
    with_sql(PREDICTIONS_SQL, "SELECT model, dataset, strategy, pred_label, count(*)::BIGINT AS n, round(avg(confidence), 6) AS confidence FROM predictions GROUP BY ALL"),
)
def predict_both(spark, sf):
    return rounded_out(
        predictions(spark, sf).groupBy("model", "dataset", "strategy", "pred_label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    )

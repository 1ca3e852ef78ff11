"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import agreement as A, calibration as C, metrics as M, status as S
from registry.base import (
    CLASS_SQL, CONFUSION_SQL, METRICS_SQL, PREDICTIONS_SQL, confusion, metric_records, predictions, query, rounded_out, table, with_sql,
)

K3 = "model, dataset, strategy"


@query(
    "confusion_matrix",
    with_sql(
        CONFUSION_SQL,
        f"""SELECT t.*, p.pred_ord, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT {K3}, true_ord FROM confusion) t
            CROSS JOIN (SELECT unnest(range(0, 6))::INTEGER AS pred_ord) p LEFT JOIN confusion c USING ({K3}, true_ord, pred_ord)""",
    ),
)
def confusion_matrix(spark, sf):
    return M.dense_confusion(confusion(spark, sf))


@query("class_report", with_sql(CLASS_SQL, f'SELECT {K3}, ord, tp, n_pred, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_report'))
def class_report(spark, sf):
    return rounded_out(M.class_report(confusion(spark, sf)))


@query("macro_avg", with_sql(CLASS_SQL, f'SELECT {K3}, round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM class_report GROUP BY ALL'))
def macro_avg(spark, sf):
    avg = M.averages(M.class_report(confusion(spark, sf)))
    return rounded_out(avg.select("model", "dataset", "strategy", "macro_precision", "macro_recall", "macro_f1"))


@query(
    "weighted_avg",
    with_sql(
        CLASS_SQL,
        f"""SELECT {K3}, round(sum("precision" * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
            round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM class_report GROUP BY ALL""",
    ),
)
def weighted_avg(spark, sf):
    avg = M.averages(M.class_report(confusion(spark, sf)))
    return rounded_out(avg.select("model", "dataset", "strategy", "weighted_precision", "weighted_recall", "weighted_f1", "support"))


@query("accuracy", with_sql(METRICS_SQL, f"SELECT {K3}, round(accuracy, 6) AS accuracy, n_samples FROM metrics"))
def accuracy(spark, sf):
    return rounded_out(M.accuracy(confusion(spark, sf)))


@query("adjacent_accuracy", with_sql(METRICS_SQL, f"SELECT {K3}, round(adjacent_accuracy, 6) AS adjacent_accuracy FROM metrics"))
def adjacent_accuracy(spark, sf):
    return rounded_out(M.adjacent_accuracy(confusion(spark, sf)))


@query("f1_micro", with_sql(METRICS_SQL, f"SELECT {K3}, round(micro_f1, 6) AS micro_f1 FROM metrics"))
def f1_micro(spark, sf):
    return rounded_out(metric_records(spark, sf).select("model", "dataset", "strategy", "micro_f1"))


PRIORITY_SQL = """
graded AS (SELECT o_orderstatus AS model, o_custkey % 5 AS dataset, (substr(o_orderpriority, 1, 1)::INTEGER - 1) AS true_ord,
  CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1 WHEN o_totalprice < 300000 THEN 2 WHEN o_totalprice < 400000 THEN 3 ELSE 4 END AS pred_ord FROM orders),
freq AS (SELECT model, dataset, true_ord, count(*) AS n_c, sum(count(*)) OVER (PARTITION BY model, dataset) AS n_all, count(*) OVER (PARTITION BY model, dataset) AS k FROM graded GROUP BY model, dataset, true_ord),
cm AS (SELECT g.model, g.dataset, g.true_ord, g.pred_ord, count(*)::BIGINT AS n, sum(n_all / (k * n_c))::DOUBLE AS w FROM graded g JOIN freq USING (model, dataset, true_ord) GROUP BY g.model, g.dataset, g.true_ord, g.pred_ord)"""


def _priorities(spark, sf):
    """A second, five-valued scale: order priority against a price band."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice")
    price = F.col("o_totalprice")
    pred = F.when(price < 100000, 0).when(price < 200000, 1).when(price < 300000, 2).when(price < 400000, 3).otherwise(4)
    return o.select(
        F.col("o_orderstatus").alias("model"), (F.col("o_custkey") % 5).alias("dataset"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("true_ord"), pred.alias("pred_ord"),
    )


def _weighted_cm(spark, sf):
    """Balanced class weights applied to counted cells, not to rows."""
    keys = ("model", "dataset")
    cm = M.confusion(_priorities(spark, sf), keys).drop("w")
    per_class = cm.groupBy(*keys, "true_ord").agg(F.sum("n").alias("n_c"))
    per_group = per_class.groupBy(*keys).agg(F.sum("n_c").alias("n_all"), F.count(F.lit(1)).alias("k"))
    weights = per_class.join(per_group, list(keys)).withColumn("weight", F.col("n_all") / (F.col("k") * F.col("n_c")))
    return cm.join(weights.select(*keys, "true_ord", "weight"), [*keys, "true_ord"]).withColumn("w", F.col("n") * F.col("weight")).drop("weight")


SET_SQL = (
    PRIORITY_SQL
    + """,
sides AS (SELECT model, dataset, ord, sum(tp) AS tp, sum(np) AS np, sum(s) AS s FROM (
   SELECT model, dataset, true_ord AS ord, CASE WHEN true_ord = pred_ord THEN w ELSE 0 END AS tp, 0.0 AS np, w AS s FROM cm
   UNION ALL SELECT model, dataset, pred_ord, 0.0, w, 0.0 FROM cm) GROUP BY ALL),
per AS (SELECT model, dataset, avg(coalesce(2 * tp / nullif(np + s, 0), 0)) AS f1_macro, sum(coalesce(2 * tp / nullif(np + s, 0), 0) * s) / sum(s) AS f1_weighted,
   2 * sum(tp) / sum(np + s) AS f1_micro, avg(coalesce(tp / nullif(np, 0), 0)) AS precision_macro, avg(coalesce(tp / nullif(s, 0), 0)) AS recall_macro FROM sides GROUP BY ALL),
ords AS (SELECT model, dataset, sum(CASE WHEN true_ord = pred_ord THEN w ELSE 0 END) / sum(w) AS accuracy,
   sum(CASE WHEN abs(true_ord - pred_ord) <= 1 THEN w ELSE 0 END) / sum(w) AS ordinal_accuracy,
   sum(w * (1 - abs(true_ord - pred_ord) / 5.0::DOUBLE)) / sum(w) AS ordinal_distance_linear,
   sum(w * (1 - (true_ord - pred_ord) * (true_ord - pred_ord) / 25.0::DOUBLE)) / sum(w) AS ordinal_distance_quadratic,
   1 - sum(w * (true_ord - pred_ord) * (true_ord - pred_ord)) / sum(w) / 25.0::DOUBLE AS ordinal_mse FROM cm GROUP BY ALL)"""
)


@query(
    "metric_set",
    with_sql(
        SET_SQL,
        """SELECT model, dataset, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted, round(f1_micro, 6) AS f1_micro,
           round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro, round(ordinal_accuracy, 6) AS ordinal_accuracy,
           round(ordinal_distance_linear, 6) AS ordinal_distance_linear, round(ordinal_distance_quadratic, 6) AS ordinal_distance_quadratic, round(ordinal_mse, 6) AS ordinal_mse
           FROM per JOIN ords USING (model, dataset)""",
    ),
)
def metric_set(spark, sf):
    return rounded_out(M.metric_set(_weighted_cm(spark, sf), ("model", "dataset")))


@query("ordinal_accuracy", with_sql(SET_SQL, "SELECT model, dataset, round(ordinal_accuracy, 6) AS ordinal_accuracy FROM ords"))
def ordinal_accuracy(spark, sf):
    return rounded_out(M.ordinal_scores(_weighted_cm(spark, sf), ("model", "dataset"), "w").select("model", "dataset", "ordinal_accuracy"))


@query(
    "ordinal_distance",
    with_sql(SET_SQL, "SELECT model, dataset, round(ordinal_distance_linear, 6) AS ordinal_distance_linear, round(ordinal_distance_quadratic, 6) AS ordinal_distance_quadratic FROM ords"),
)
def ordinal_distance(spark, sf):
    s = M.ordinal_scores(_weighted_cm(spark, sf), ("model", "dataset"), "w")
    return rounded_out(s.select("model", "dataset", "ordinal_distance_linear", "ordinal_distance_quadratic"))


@query("ordinal_mse", with_sql(SET_SQL, "SELECT model, dataset, round(ordinal_mse, 6) AS ordinal_mse FROM ords"))
def ordinal_mse(spark, sf):
    return rounded_out(M.ordinal_scores(_weighted_cm(spark, sf), ("model", "dataset"), "w").select("model", "dataset", "ordinal_mse"))


@query(
    "mae_mse",
    with_sql(CONFUSION_SQL, f"SELECT {K3}, round(sum(n * abs(true_ord - pred_ord)) / sum(n), 6) AS mae, round(sum(n * (true_ord - pred_ord) * (true_ord - pred_ord)) / sum(n), 6) AS mse FROM confusion GROUP BY ALL"),
)
def mae_mse(spark, sf):
    return rounded_out(M.ordinal_scores(confusion(spark, sf)).select("model", "dataset", "strategy", "mae", "mse"))


MARGIN_SQL = (
    CONFUSION_SQL
    + f""",
grid AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM unnest(range(0, 6)) a(i), unnest(range(0, 6)) b(j)),
rows_ AS (SELECT {K3}, true_ord AS i, sum(n)::DOUBLE AS r FROM confusion GROUP BY ALL),
cols_ AS (SELECT {K3}, pred_ord AS j, sum(n)::DOUBLE AS c FROM confusion GROUP BY ALL),
obs AS (SELECT {K3}, sum(n)::DOUBLE AS n, sum(n * (true_ord - pred_ord) * (true_ord - pred_ord))::DOUBLE AS o,
        sum(n * (1 - (true_ord - pred_ord) * (true_ord - pred_ord) / 25.0::DOUBLE))::DOUBLE AS a FROM confusion GROUP BY ALL)"""
)


@query(
    "qwk",
    with_sql(
        MARGIN_SQL,
        f"""SELECT {K3}, round(CASE WHEN e = 0 THEN 1.0 ELSE 1 - o / e END, 6) AS qwk FROM (
            SELECT {K3}, o, coalesce(sum((i - j) * (i - j) * r * c), 0) / n AS e FROM obs LEFT JOIN rows_ USING ({K3}) LEFT JOIN cols_ USING ({K3}) GROUP BY {K3}, o, n)""",
    ),
)
def qwk(spark, sf):
    return rounded_out(A.quadratic_kappa(confusion(spark, sf)))


@query(
    "gwet_ac2",
    with_sql(
        MARGIN_SQL,
        f"""SELECT {K3}, round(coalesce((pa - pe) / nullif(1 - pe, 0), 1.0), 6) AS ac2 FROM (
            SELECT {K3}, a / n AS pa, (SELECT sum(1 - (i - j) * (i - j) / 25.0::DOUBLE) FROM grid) / 30.0::DOUBLE * s AS pe FROM obs JOIN (
              SELECT {K3}, sum(q * (1 - q)) AS s FROM (
                SELECT {K3}, k, sum(m) / 2 / max(n) AS q FROM (SELECT {K3}, i AS k, r AS m FROM rows_ UNION ALL SELECT {K3}, j, c FROM cols_) JOIN obs USING ({K3}) GROUP BY {K3}, k)
              GROUP BY ALL) USING ({K3}))""",
    ),
)
def gwet_ac2(spark, sf):
    return rounded_out(A.gwet_ac2(confusion(spark, sf)))


@query("rmse", with_sql(PREDICTIONS_SQL, "SELECT model, dataset, round(sqrt(avg((expected_value - true_ord) * (expected_value - true_ord))), 6) AS rmse FROM ready GROUP BY ALL"))
def rmse(spark, sf):
    one = predictions(spark, sf).filter("strategy = 'argmax'")
    return rounded_out(A.continuous_errors(one).select("model", "dataset", "rmse"))


@query("within1", with_sql(PREDICTIONS_SQL, "SELECT model, dataset, round(avg((abs(expected_value - true_ord) <= 1)::INTEGER), 6) AS within1 FROM ready GROUP BY ALL"))
def within1(spark, sf):
    one = predictions(spark, sf).filter("strategy = 'argmax'")
    return rounded_out(A.continuous_errors(one).select("model", "dataset", "within1"))


@query(
    "spearman",
    with_sql(
        PREDICTIONS_SQL,
        """SELECT model, round(coalesce(corr(rx, ry), 0.0), 6) AS spearman FROM (
           SELECT model, rank() OVER (PARTITION BY model ORDER BY true_ord) + (count(*) OVER (PARTITION BY model, true_ord) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY model ORDER BY ev) + (count(*) OVER (PARTITION BY model, ev) - 1) / 2.0 AS ry
           FROM (SELECT model, true_ord, round(expected_value, 12) AS ev FROM ready)) GROUP BY model""",
    ),
)
def spearman(spark, sf):
    one = predictions(spark, sf).filter("strategy = 'argmax'").withColumn("expected_value", F.round("expected_value", 12))  # sums of doubles, equal up to their order
    return rounded_out(A.spearman(one, ("model",)))


BIN_SQL = (
    PREDICTIONS_SQL
    + """,
binned AS (SELECT model, dataset, (SELECT count(*) FROM unnest(range(0, 10)) t(k) WHERE confidence > k * 0.1::DOUBLE)::INTEGER AS bin, confidence, (pred_ord = true_ord)::INTEGER AS hit
   FROM predictions WHERE strategy = 'argmax'),
bins AS (SELECT g.model, g.dataset, k::INTEGER AS bin, count(b.hit)::BIGINT AS n, g.n_all, coalesce(avg(b.hit), 0.0) AS accuracy, coalesce(avg(b.confidence), 0.0) AS mean_confidence
   FROM (SELECT model, dataset, count(*)::BIGINT AS n_all FROM binned GROUP BY ALL) g CROSS JOIN unnest(range(1, 11)) t(k)
   LEFT JOIN binned b ON b.model = g.model AND b.dataset = g.dataset AND b.bin = k GROUP BY g.model, g.dataset, k, g.n_all)"""
)


@query(
    "calibration_bins",
    with_sql(BIN_SQL, "SELECT model, dataset, bin, n, n_all, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence, round(mean_confidence - accuracy, 6) AS gap FROM bins"),
)
def calibration_bins(spark, sf):
    return rounded_out(C.bins(predictions(spark, sf).filter("strategy = 'argmax'")))


@query("ece", with_sql(BIN_SQL, "SELECT model, dataset, round(sum(abs(mean_confidence - accuracy) * n / n_all), 6) AS ece FROM bins GROUP BY ALL"))
def ece(spark, sf):
    return rounded_out(C.expected_error(C.bins(predictions(spark, sf).filter("strategy = 'argmax'"))))


@query(
    "class_calibration",
    with_sql(
        PREDICTIONS_SQL,
        "SELECT model, dataset, pred_label, round(avg(confidence), 6) AS avg_prob, round(avg((pred_ord = true_ord)::INTEGER), 6) AS accuracy, count(*)::BIGINT AS n FROM predictions WHERE strategy = 'argmax' GROUP BY ALL",
    ),
)
def class_calibration(spark, sf):
    return rounded_out(C.per_class(predictions(spark, sf).filter("strategy = 'argmax'")))


ROUNDED_METRICS = "round(accuracy, 6) AS accuracy, round(adjacent_accuracy, 6) AS adjacent_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(micro_f1, 6) AS micro_f1, n_samples"


@query("eval_all", with_sql(METRICS_SQL, f"SELECT {K3}, {ROUNDED_METRICS} FROM metrics"))
def eval_all(spark, sf):
    return rounded_out(metric_records(spark, sf))


# Step names of the run log, user_id % 8 picks one.
STEPS = (
    "setup_experiment_directory", "generate_synthetic_data", "create_pipeline_config", "run_tfidf_training",
    "run_feature_extraction", "run_classifier_training", "run_prediction", "pipeline_complete",
)
# How event types stand for log states.
STATES = {"purchase": "success", "error": "error", "view": "started", "click": "warning", "signup": "skipped"}

LOG_SQL = (
    "log AS (SELECT event_id, ts, [" + ", ".join(f"'{s}'" for s in STEPS) + "][user_id % 8 + 1] AS step, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END AS status FROM events)"
)


def to_log(events):
    """Events as a run log."""
    status = F.lit(None).cast("string")
    for kind, state in STATES.items():
        status = F.when(F.col("event_type") == kind, state).otherwise(status)
    step = F.get(F.array(*[F.lit(s) for s in STEPS]), (F.col("user_id") % 8).cast("int"))
    return events.select("event_id", "ts", step.alias("step"), status.alias("status"))


def _log(spark, sf):
    return to_log(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))


@query(
    "status_summary",
    with_sql(
        LOG_SQL,
        """SELECT count(*)::BIGINT AS n_events, count(*) FILTER (status = 'success')::BIGINT AS n_success, count(*) FILTER (status = 'error')::BIGINT AS n_error,
           count(*) FILTER (status = 'warning')::BIGINT AS n_warning, count(*) FILTER (status = 'started')::BIGINT AS n_started, count(*) FILTER (status = 'skipped')::BIGINT AS n_skipped,
           CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'success') > 0 AND count(*) FILTER (step = 'pipeline_complete') > 0 THEN 'SUCCESS' ELSE 'INCOMPLETE' END AS overall FROM log""",
    ),
)
def status_summary(spark, sf):
    return S.totals(_log(spark, sf))


@query(
    "status_critical_steps",
    with_sql(
        LOG_SQL,
        """SELECT s.step, CASE coalesce(max(CASE status WHEN 'success' THEN 3 WHEN 'skipped' THEN 2 WHEN 'error' THEN 1 ELSE 0 END), 0) WHEN 3 THEN 'success' WHEN 2 THEN 'skipped' WHEN 1 THEN 'error' ELSE 'missing' END AS state,
           coalesce(max(CASE status WHEN 'success' THEN 3 WHEN 'skipped' THEN 2 WHEN 'error' THEN 1 ELSE 0 END), 0) >= 2 AS ok
           FROM (SELECT DISTINCT step FROM log UNION SELECT 'a_step_never_run') s LEFT JOIN (SELECT * FROM log WHERE NOT (step = 'run_prediction' AND status IN ('success', 'skipped'))) l ON l.step = s.step GROUP BY s.step""",
    ),
)
def status_critical_steps(spark, sf):
    log = _log(spark, sf)
    steps = log.select("step").distinct().union(spark.createDataFrame([("a_step_never_run",)], "step string"))
    return S.critical_steps(log.filter("NOT (step = 'run_prediction' AND status IN ('success', 'skipped'))"), steps)


@query("run_duration", with_sql(LOG_SQL, "SELECT step, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 6) AS seconds FROM log GROUP BY step"))
def run_duration(spark, sf):
    return rounded_out(S.duration_seconds(_log(spark, sf)))

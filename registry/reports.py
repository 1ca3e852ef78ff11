"""Rankings, tables and selection logic on metric records."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.names import feature_key
from gradeloom.operators import ranking as R, screening as SC
from registry.base import METRICS_SQL, metric_records, query, rounded_out, table, with_sql

K3 = "model, dataset, strategy"
RANK = "ORDER BY coalesce(round({c}, 9), -1.0) DESC, model, dataset, strategy"


@query("rank_models", with_sql(METRICS_SQL, f"SELECT {K3}, round(macro_f1, 6) AS macro_f1, (row_number() OVER ({RANK.format(c='macro_f1')}))::INTEGER AS \"rank\" FROM metrics"))
def rank_models(spark, sf):
    return rounded_out(R.rank(metric_records(spark, sf), "macro_f1").select("model", "dataset", "strategy", "macro_f1", "rank"))


@query(
    "rank_by_dataset",
    with_sql(METRICS_SQL, f'SELECT * FROM (SELECT {K3}, round(accuracy, 6) AS accuracy, (row_number() OVER (PARTITION BY dataset {RANK.format(c="accuracy")}))::INTEGER AS "rank" FROM metrics) WHERE "rank" <= 3'),
)
def rank_by_dataset(spark, sf):
    return rounded_out(R.rank_by_dataset(metric_records(spark, sf), "accuracy", 3).select("model", "dataset", "strategy", "accuracy", "rank"))


TOP_SQL = " UNION ALL ".join(f"SELECT '{c}' AS criterion, strategy, model, dataset, {c} AS v FROM metrics" for c in R.CRITERIA)


@query(
    "top10_by_criterion",
    with_sql(
        METRICS_SQL,
        f"""SELECT criterion, strategy, "rank", model, dataset, round(v, 6) AS "value" FROM (
            SELECT *, (row_number() OVER (PARTITION BY criterion, strategy ORDER BY coalesce(round(v, 9), -1.0) DESC, model, dataset))::INTEGER AS "rank" FROM ({TOP_SQL})) WHERE "rank" <= 10""",
    ),
)
def top10_by_criterion(spark, sf):
    return rounded_out(R.top_by_criteria(metric_records(spark, sf)))


@query(
    "avg_micro_f1",
    with_sql(
        METRICS_SQL,
        """SELECT model, strategy, round(avg(micro_f1), 6) AS micro_f1, sum(n_samples)::BIGINT AS n_samples, 'avg_across_' || count(*) || '_datasets' AS dataset,
           string_agg(dataset || '=' || printf('%.3f', micro_f1), ',' ORDER BY dataset) AS per_dataset FROM metrics GROUP BY model, strategy""",
    ),
)
def avg_micro_f1(spark, sf):
    avg = R.average_micro_f1(metric_records(spark, sf))
    cell = lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))
    listed = F.array_join(F.transform(F.map_entries("per_dataset"), cell), ",")
    return rounded_out(avg.select("model", "strategy", "micro_f1", "n_samples", "dataset", listed.alias("per_dataset")))


# The columns of the given data, for the twins.
SOURCES = [f"src{i}" for i in range(20)]
PIVOT_CELLS = ", ".join(f"round(max(CASE WHEN dataset = '{d}' THEN f1 END), 6) AS {d}" for d in SOURCES)


@query(
    "f1_pivot",
    with_sql(
        METRICS_SQL,
        f"""SELECT model, {PIVOT_CELLS}, round(avg(f1), 6) AS avg, CASE model WHEN 'train_logistic_005ebc16_tfidf' THEN 'Logistic Reg. tf-idf'
            WHEN 'train_multinomialnb_e2752d18_tfidf' THEN 'Naive Bayes tf-idf' ELSE 'XGBoost tf-idf' END AS display_name
            FROM (SELECT model, dataset, CASE WHEN weighted_f1 <> 0 THEN weighted_f1 ELSE macro_f1 END AS f1 FROM metrics WHERE strategy = 'argmax') GROUP BY model""",
    ),
)
def f1_pivot(spark, sf):
    return rounded_out(R.f1_pivot(metric_records(spark, sf)))


@query(
    "dataset_detail",
    with_sql(
        METRICS_SQL,
        """SELECT (row_number() OVER (ORDER BY round(CASE WHEN weighted_f1 <> 0 THEN weighted_f1 ELSE coalesce(macro_f1, 0) END, 9) DESC, model))::INTEGER AS "rank",
           CASE model WHEN 'train_logistic_005ebc16_tfidf' THEN 'Logistic Reg. tf-idf' WHEN 'train_multinomialnb_e2752d18_tfidf' THEN 'Naive Bayes tf-idf' ELSE 'XGBoost tf-idf' END AS display_name,
           model, n_samples, round(accuracy, 6) AS accuracy, round(adjacent_accuracy, 6) AS adjacent_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1
           FROM metrics WHERE dataset = 'src5' AND strategy = 'argmax'""",
    ),
)
def dataset_detail(spark, sf):
    return rounded_out(R.dataset_detail(metric_records(spark, sf), "src5"))


AVG_CELLS = ", ".join(f"round(max(CASE WHEN dataset = '{d}' THEN micro_f1 END), 6) AS {d}" for d in SOURCES)


@query("avg_table", with_sql(METRICS_SQL, f"SELECT model, strategy, round(avg(micro_f1), 6) AS micro_f1, sum(n_samples)::BIGINT AS n_samples, {AVG_CELLS} FROM metrics WHERE strategy = 'rounded_avg' GROUP BY ALL"))
def avg_table(spark, sf):
    return rounded_out(R.average_table(metric_records(spark, sf), "rounded_avg"))


@query(
    "scenario_compare",
    with_sql(
        METRICS_SQL,
        """, published AS (SELECT 'train_logistic_005ebc16_tfidf' AS model, source AS dataset, avg(quality) AS published FROM documents JOIN labels USING (doc_id) GROUP BY source)
           SELECT p.model, p.dataset, round(published, 6) AS published, round(macro_f1, 6) AS measured, round(macro_f1 - published, 6) AS difference
           FROM published p LEFT JOIN (SELECT * FROM metrics WHERE strategy = 'argmax') m ON m.model = p.model AND m.dataset = p.dataset""",
    ).replace("\n, published", ", published"),
)
def scenario_compare(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    published = labelled.groupBy(F.lit("train_logistic_005ebc16_tfidf").alias("model"), F.col("source").alias("dataset")).agg(F.avg("quality").alias("published"))
    return rounded_out(R.compare_published(metric_records(spark, sf).filter("strategy = 'argmax'"), published, "macro_f1"))


@query(
    "config_analysis",
    with_sql(
        METRICS_SQL,
        """SELECT regexp_extract(model, '_([0-9a-f]{8}_tfidf(?:_grouped)?)', 1) AS feature_set, round(avg(accuracy), 6) AS avg_accuracy, round(min(accuracy), 6) AS min_accuracy,
           round(max(accuracy), 6) AS max_accuracy, count(*)::BIGINT AS n_evaluations FROM metrics WHERE strategy = 'argmax' GROUP BY 1""",
    ),
)
def config_analysis(spark, sf):
    return rounded_out(R.config_analysis(metric_records(spark, sf).withColumn("feature_set", feature_key(F.col("model")))))


@query("overview_counts", with_sql(METRICS_SQL, "SELECT count(DISTINCT model)::BIGINT AS n_models, count(DISTINCT dataset)::BIGINT AS n_datasets, count(DISTINCT strategy)::BIGINT AS n_strategies, count(*)::BIGINT AS n_evaluations FROM metrics"))
def overview_counts(spark, sf):
    return R.overview(metric_records(spark, sf))


@query(
    "best_per_dataset",
    with_sql(
        METRICS_SQL,
        """, m AS (SELECT * FROM metrics WHERE strategy = 'argmax'),
        a AS (SELECT dataset, model, accuracy, row_number() OVER (PARTITION BY dataset ORDER BY round(accuracy, 9) DESC, model) AS r FROM m),
        b AS (SELECT dataset, model, adjacent_accuracy, row_number() OVER (PARTITION BY dataset ORDER BY round(adjacent_accuracy, 9) DESC, model) AS r FROM m)
        SELECT a.dataset, a.model AS best_model, round(a.accuracy, 6) AS best_accuracy, b.model AS best_adjacent_model, round(b.adjacent_accuracy, 6) AS best_adjacent_accuracy,
          (SELECT count(*) FROM m WHERE m.dataset = a.dataset)::BIGINT AS n_models FROM a JOIN b ON a.dataset = b.dataset AND a.r = 1 AND b.r = 1""",
    ).replace("\n, m AS", ", m AS"),
)
def best_per_dataset(spark, sf):
    return rounded_out(R.best_per_dataset(metric_records(spark, sf)))


SCORES_SQL = 'scores AS (SELECT p_brand AS feature_set, avg(CASE WHEN p_size <= 20 THEN 1.0 ELSE 0.0 END) AS score FROM part GROUP BY 1)'
SCREEN_SQL = SCORES_SQL + """,
screened AS (SELECT feature_set, score, (row_number() OVER (ORDER BY round(score, 9) DESC, feature_set))::INTEGER AS "rank", count(*) OVER () AS n FROM scores),
flagged AS (SELECT *, score < 0.35 AS below, "rank" > n - floor(n * 25.0 / 100) AS bottom FROM screened)"""


def _screened(spark, sf):
    scores = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature_set")).agg(F.avg(F.when(F.col("p_size") <= 20, 1.0).otherwise(0.0)).alias("score"))
    return SC.screen(scores, "f1_macro", threshold=0.35, percentile=25.0)


@query(
    "screen_features",
    with_sql(
        SCREEN_SQL,
        """SELECT feature_set, round(score, 6) AS score, "rank", NOT (below OR bottom) AS passed,
           CASE WHEN below THEN 'f1_macro ' || printf('%.4f', score) || ' < threshold 0.3500' WHEN bottom THEN 'Bottom 25.0% percentile' END AS discard_reason FROM flagged""",
    ),
)
def screen_features(spark, sf):
    return rounded_out(_screened(spark, sf))


TRIALS_SQL = """,
trials AS (SELECT p_brand AS feature_set, p_size AS trial, 'c=' || p_size AS params, avg(p_retailprice) / 2000.0 AS score FROM part GROUP BY p_brand, p_size),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY round(score, 9) DESC, trial) AS r, count(*) OVER (PARTITION BY feature_set)::BIGINT AS n_trials FROM trials) WHERE r = 1)"""


def _trials(spark, sf):
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature_set"), F.col("p_size").alias("trial")).agg((F.avg("p_retailprice") / 2000.0).alias("score"))
    return rows.withColumn("params", F.concat(F.lit("c="), F.col("trial").cast("string")))


@query("tuning_history", with_sql(SCREEN_SQL + TRIALS_SQL, "SELECT feature_set, trial AS best_trial, params AS best_params, round(score, 6) AS best_score, n_trials FROM best"))
def tuning_history(spark, sf):
    return rounded_out(SC.best_trials(_trials(spark, sf)))


@query(
    "tune_top_k",
    with_sql(
        SCREEN_SQL + TRIALS_SQL,
        """, chosen AS (SELECT feature_set, score FROM flagged WHERE NOT (below OR bottom) ORDER BY "rank" LIMIT 8)
        SELECT feature_set, round(chosen.score, 6) AS stage1_score, best.trial AS best_trial, best.params AS best_params, round(best.score, 6) AS best_score, best.n_trials,
          round(best.score - chosen.score, 6) AS improvement, (row_number() OVER (ORDER BY round(best.score, 9) DESC, feature_set))::INTEGER AS final_rank FROM chosen JOIN best USING (feature_set)""",
    ).replace("\n, chosen", ", chosen"),
)
def tune_top_k(spark, sf):
    chosen = SC.survivors(_screened(spark, sf), 8)
    return rounded_out(SC.final_ranking(chosen, SC.best_trials(_trials(spark, sf))))

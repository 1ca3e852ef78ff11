"""Incremental jobs; each must give what the batch job gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.text import clean_text
from gradeloom.operators import decide
from gradeloom.session import fresh_path
from gradeloom.streaming import runlog as RL, scoring as SC
from registry.base import PREDICTIONS_SQL, SCORERS, _peaked, query, rounded_out, table, with_sql
from registry.fits import GRADED, PER_LABEL_SQL, graded_rows, per_label, stored_models
from registry.metrics import LOG_SQL, to_log

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _arrivals(spark, sf, n_files: int = 4) -> str:
    """The documents as several files, as if they came in over time."""
    path = fresh_path(spark, "arrivals")
    table(spark, sf, "documents").repartition(n_files, "doc_id").write.parquet(path)
    return path


def _score(docs):
    """Row-wise scoring: the first stand-in model on new texts."""
    from gradeloom.functions.text import space_tokens

    words = F.size(space_tokens(clean_text(F.col("text")))).cast("double")
    scored = docs.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"), F.least(F.lit(5.0), words / 80.0).alias("x"))
    scored = scored.select(F.lit(SCORERS[0]).alias("model"), "dataset", "sample_id", _peaked(F.col("x")).alias("p"))
    return decide.argmax(scored).select("model", "dataset", "sample_id", "pred_label", "confidence")


SCORED_SQL = with_sql(
    PREDICTIONS_SQL,
    f"SELECT model, dataset, sample_id, pred_label, round(confidence, 6) AS confidence FROM predictions WHERE strategy = 'argmax' AND model = '{SCORERS[0]}'",
)


@query("stream_score", SCORED_SQL)
def stream_score(spark, sf):
    sink, check = fresh_path(spark, "scored"), fresh_path(spark, "scored-checkpoint")
    schema = spark.createDataFrame([], DOCS).schema
    SC.score_new_files(spark, _arrivals(spark, sf), schema, _score, sink, check, max_files=2)
    return rounded_out(spark.read.parquet(sink))


@query("stream_resume_check", SCORED_SQL)
def stream_resume_check(spark, sf):
    """Stopped after the first files and started again: every row once."""
    source, sink, check = fresh_path(spark, "arrivals"), fresh_path(spark, "scored"), fresh_path(spark, "scored-checkpoint")
    docs = table(spark, sf, "documents").repartition(4, "doc_id")
    schema = spark.createDataFrame([], DOCS).schema
    docs.filter("coalesce(n_chars, 0) < 1500").write.parquet(source)
    SC.score_new_files(spark, source, schema, _score, sink, check)
    docs.filter("coalesce(n_chars, 0) >= 1500").write.mode("append").parquet(source)
    SC.score_new_files(spark, source, schema, _score, sink, check)
    SC.score_new_files(spark, source, schema, _score, sink, check)  # nothing new
    return rounded_out(spark.read.parquet(sink))


@query(
    "stream_status",
    with_sql(LOG_SQL, "SELECT step, ts, status, n_events FROM (SELECT step, ts, status, (count(*) OVER (PARTITION BY step))::BIGINT AS n_events, row_number() OVER (PARTITION BY step ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1"),
)
def stream_status(spark, sf):
    source, sink, check = fresh_path(spark, "runlog"), fresh_path(spark, "status"), fresh_path(spark, "status-checkpoint")
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    events.repartition(3).write.parquet(source)
    RL.follow_status(spark, source, events.schema, to_log, sink, check, max_files=1)
    return RL.current_status(spark, sink)


@query("latest_status", with_sql(LOG_SQL, "SELECT step, ts, status, n_events FROM (SELECT step, ts, status, (count(*) OVER (PARTITION BY step))::BIGINT AS n_events, row_number() OVER (PARTITION BY step ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1"))
def latest_status(spark, sf):
    from gradeloom.operators.status import latest_status as newest

    return newest(to_log(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")))


@query("stream_add_test_set", PER_LABEL_SQL)
def stream_add_test_set(spark, sf):
    """New files graded by every stored model, batch by batch; only committed batches are read."""
    stored = stored_models(spark, sf)
    sink, check = fresh_path(spark, "test-sets"), fresh_path(spark, "test-sets-checkpoint")
    schema = spark.createDataFrame([], DOCS).schema
    corpus = lambda docs: docs.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"), clean_text(F.col("text")).alias("text"))
    SC.add_test_sets(spark, _arrivals(spark, sf, 2), schema, lambda docs: graded_rows(stored, corpus(docs)), sink, check, max_files=1)
    return per_label(SC.read_committed(spark, sink, GRADED))

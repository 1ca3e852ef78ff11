"""Run logs: totals, overall state and critical steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# States of a log line, and which one wins for a critical step.
STATES = ("success", "error", "warning", "started", "skipped")
STEP_PRECEDENCE = ("success", "skipped", "error")


def totals(log: DataFrame) -> DataFrame:
    """Counts per state and the overall verdict."""
    counted = log.agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES],
        F.count_if(F.col("step") == "pipeline_complete").alias("_complete"),
    )
    overall = (
        F.when(F.col("n_error") > 0, "FAILED")
        .when((F.col("n_success") > 0) & (F.col("_complete") > 0), "SUCCESS")
        .otherwise("INCOMPLETE")
    )
    return counted.withColumn("overall", overall).drop("_complete")


def critical_steps(log: DataFrame, steps: DataFrame) -> DataFrame:
    """``(step, state)`` of each required step; ``missing`` when never reached."""
    code = F.lit(0)
    for i, s in enumerate(reversed(STEP_PRECEDENCE), start=1):
        code = F.greatest(code, F.when(F.col("status") == s, i).otherwise(0))
    reached = log.groupBy("step").agg(F.max(code).alias("code"))
    names = F.array(F.lit("missing"), *[F.lit(s) for s in reversed(STEP_PRECEDENCE)])
    joined = steps.select("step").distinct().join(reached, "step", "left")
    state = F.get(names, F.coalesce("code", F.lit(0)))
    return joined.select("step", state.alias("state"), state.isin("success", "skipped").alias("ok"))


def latest_status(log: DataFrame) -> DataFrame:
    """Newest line per step; the event id decides between equal times."""
    newest = F.max_by(F.struct("ts", "status"), F.struct("ts", "event_id")).alias("last")
    return log.groupBy("step").agg(newest, F.count(F.lit(1)).alias("n_events")).select(
        "step", F.col("last.ts").alias("ts"), F.col("last.status").alias("status"), "n_events"
    )


def duration_seconds(log: DataFrame, by: str = "step") -> DataFrame:
    """Seconds between the first and the last line."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = micros(F.max("ts")) - micros(F.min("ts"))
    return log.groupBy(by).agg((span / F.lit(1e6)).alias("seconds"))

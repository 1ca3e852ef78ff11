"""Routing and bookkeeping for texts longer than a model's window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.functions.text import clean_text, word_tokens
from gradeloom.operators.scale import require
from gradeloom.session import written

# The three long-text rules.
STRATEGIES = ("truncate", "sliding_window", "immediate_context")


def passes(strategy: str, n: Column, limit: int) -> Column:
    """Model passes a long text of ``n`` tokens needs."""
    if strategy == "truncate":
        return F.lit(1).cast("bigint")
    if strategy == "sliding_window":
        return F.ceil(n / limit).cast("bigint")
    if strategy == "immediate_context":
        return (1 + n - limit).cast("bigint")
    raise ValueError(f"unknown long-text rule {strategy}")


def strategy_metadata(texts: DataFrame, limit: int, strategies=STRATEGIES) -> DataFrame:
    """One row per strategy for each text above the limit; others need none."""
    require(texts, "sample_id", "text")
    sized = texts.select("sample_id", F.size(word_tokens(F.col("text"))).alias("n")).filter(F.col("n") > limit)
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"),
                passes(s, F.col("n"), limit).alias("num_forward_passes"),
                F.lit(True).alias("max_length_exceeded"),
                F.col("n").cast("bigint").alias("text_length_tokens"),
                (F.when(F.lit(s == "truncate"), F.col("n") - limit)).cast("bigint").alias("tokens_lost"),
            )
            for s in strategies
        ]
    )
    return sized.select("sample_id", F.inline(rows))


def immediate_spans(texts: DataFrame, limit: int) -> DataFrame:
    """First and last context position of every scored token of long texts."""
    from gradeloom.operators.surprisal import scored_pairs

    long_texts = texts.filter(F.size(word_tokens(F.col("text"))) > limit)
    start = F.greatest(F.lit(0), F.col("pos") - (limit - 1))
    start = F.when(F.col("pos") < limit, F.lit(0)).otherwise(start)
    return scored_pairs(long_texts).select(
        "sample_id", "pos", start.alias("context_start"), (F.col("pos") - start).alias("context_length")
    )


def route(texts: DataFrame, max_tokens: int, key: str = "sample_id") -> DataFrame:
    """Rough token count (a quarter of the characters) and the route it implies."""
    estimate = F.floor(F.length(clean_text(F.col("text"))) / 4).cast("bigint")
    return texts.select(key, estimate.alias("est_tokens")).withColumn(
        "route", F.when(F.col("est_tokens") < max_tokens, "short").otherwise("long")
    )


def dense_row_numbers(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``row_idx`` (0-based, per group, by ``key`` of any type; null first) without one big sort.

    Rows are partitioned by ranges of group and key and written sorted, each with its
    partition and its place there; the rows that a group has in earlier partitions are
    its offset. The table of offsets has one row per group and partition that hold rows of
    each other: at most partitions plus groups, whatever the keys. Rows of equal keys
    take neighbouring numbers in no fixed order.
    """
    sorted_ = df.repartitionByRange(*group, key).sortWithinPartitions(*group, key)
    placed = written(sorted_.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_place")), "row-numbers")
    starts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = W.partitionBy(*([F.col(g) for g in group] or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    keys = [*group, "_part"]
    starts = starts.select(*[F.col(c).alias(f"_at_{k}") for k, c in enumerate(keys)], offset.alias("_offset"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_at_{k}")) for k, c in enumerate(keys)])
    return placed.join(starts, same).select(*df.columns, (F.col("_offset") + F.col("_place")).alias("row_idx"))


def assign_batches(routed: DataFrame, batch_size: int, key: str = "sample_id") -> DataFrame:
    """Consecutive batches of short texts; each long text is its own batch."""
    numbered = dense_row_numbers(routed, ["route"], key)
    batch = F.when(F.col("route") == "short", F.floor(F.col("row_idx") / batch_size)).otherwise(F.col("row_idx"))
    return numbered.withColumn("batch", batch.cast("bigint")).drop("row_idx")


def assign_chunks(df: DataFrame, n_chunks: int, key: str = "sample_id") -> DataFrame:
    """Split rows in key order into ``n_chunks`` ranges of ``ceil(N / n)`` rows."""
    numbered = dense_row_numbers(df, [], key)
    size = F.ceil(F.lit(df.count()) / F.lit(n_chunks))
    return numbered.withColumn("chunk", F.floor(F.col("row_idx") / size).cast("bigint")).drop("row_idx")


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """Union of scored parts, whichever route they took."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

"""Two-pass external shuffle of a table into shards.

Pass 1 scatters the records uniformly into buckets by a seeded hash of the
row's number; the number of buckets follows from the counted bytes, so that a
bucket fits in memory at any size of the input. Pass 2 shuffles each bucket
with Fisher-Yates (Spark's ``shuffle`` of the bucket's array) and writes it.
The buckets in order, each in its shuffled order, are one random permutation of
the table; shard k of n holds the k-th of n cuts of it, whose row counts differ
by at most one (the law ``rows``).

Everything is DataFrame code. A row's bucket does not depend on its values, so
equal texts, one source or one identifier that hold a third of all rows spread
over all buckets. A single record larger than a bucket makes that bucket as
large as the record. The written table fixes the permutation: tasks that are
repeated after a lost executor read it, they do not shuffle again. The scatter
depends on the seed and on how the files are cut into tasks.

Defined cases: a null text has no bytes (size 8); rows with equal or null
identifiers are separate records; an empty table gives an empty result; input
columns keep their values and names, ``shard`` and ``slot`` of the input are
replaced in ``shards`` only if the caller asks for those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.llm.common import require, text_or_empty, written

ROW_BYTES = 8
BROADCAST_BUCKETS = 100_000


def record_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text plus eight."""
    return F.octet_length(text_or_empty(text_col)).cast("bigint") + ROW_BYTES


def shuffled(docs: DataFrame, text_col: str = "text", seed: int = 7, bucket_bytes: int = 16 << 20) -> DataFrame:
    """The written permutation: ``bucket, place`` (from 0) and ``record`` (all columns of the input)."""
    require(docs, text_col)
    total = docs.agg(F.coalesce(F.sum(record_size(text_col)), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(1, -(-total // bucket_bytes))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), record.alias("record"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(n_buckets))
    gathered = rows.select(bucket.alias("bucket"), F.struct("row", "record").alias("item")).groupBy("bucket").agg(F.collect_list("item").alias("items"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle(F.sort_array("items"), F.lit(seed))).alias("place", "item"))
    return written(mixed.select("bucket", F.col("place").cast("bigint").alias("place"), "item.record"), "sharding")


def shards(docs: DataFrame, n_shards: int, text_col: str = "text", seed: int = 7, bucket_bytes: int = 16 << 20,
           shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """The columns of the input, with each row's shard and its slot there (gapless from 0).

    An input column of one of the two names is refused; choose others.
    """
    if clash := {c for c in docs.columns if c.lower() in (shard_name.lower(), slot_name.lower())}:
        raise ValueError(f"the input has columns {sorted(clash)}; choose other names")
    mixed = shuffled(docs, text_col, seed, bucket_bytes)
    counts = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket.
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", before.alias("start"))
    if counts.count() <= BROADCAST_BUCKETS:  # of 16 bytes; beyond that, the plain join
        starts = F.broadcast(starts)
    whole = counts.agg(F.sum("n").alias("whole"))
    at = mixed.join(starts, "bucket").join(F.broadcast(whole)).withColumn("at", F.col("start") + F.col("place"))  # one row
    at = at.withColumn("in_shard", F.expr(f"({n_shards} * (at + 1) - 1) div whole"))
    slot = F.col("at") - F.expr(f"(in_shard * whole) div {n_shards}")
    own = [F.col(f"record.`{c}`").alias(c) for c in docs.columns]
    return at.select(*own, F.col("in_shard").cast("int").alias(shard_name), slot.alias(slot_name))


def write_shards(docs: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write one folder per shard; the rows of a shard are in slot order within each file."""
    out = shards(docs, n_shards, **options)
    shard, slot = options.get("shard_name", "shard"), options.get("slot_name", "slot")
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)

"""Exact deduplication with disk-backed streaming state.

A streaming aggregation keyed by the SHA-256 digest of the normalised text
keeps, for each digest, the count of rows and the row that stays: its stable
identifier and the locator of its content. The state lives in RocksDB on the
executors' disks with snapshots in the shared folder, and never expires: a
later run over the same checkpoint knows all texts seen before. Digests that
hold more than one row are hits; for them the full bytes are compared, and a
group whose bytes differ is grouped again by the bytes themselves.

Everything is DataFrame code. The digest aggregation combines before its
shuffle, so a text that holds a third of all rows sends one row per task; the
joins on the digest are plain equi-joins that adaptive execution can split.

Defined cases: a null text counts as the empty text, and empty texts are equal.
Of equal texts the row with the largest identifier stays; a null identifier
counts as smaller than any other. Of rows that also share the identifier, the
one with the largest locator stays, so exactly one row of a group is kept. An
empty table gives an empty result. Columns of the input with the names of
result columns are not touched: ``classes`` returns the identifier and its own
columns only, ``keep_one`` the input's columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from gradeloom.llm.common import free_name, fresh_path, require, text_or_empty, written, written_at

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small partitions must not hold disk that they don't use, nor stores that no task reads.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Identifier, locator (file and position of the row in it), text and digest of each row."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    text = text_or_empty(text_col)
    return rows.select(F.col(f"`{id_col}`").alias("id"), at.alias("locator"), text.alias("text"), digest(text).alias("digest"))


def update_state(spark: SparkSession, path: str, schema: StructType, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
                 digest=sha256, max_files: int | None = None) -> None:
    """Bring the keyed state under ``checkpoint`` up to date with every file of ``path`` not seen before, and stop.

    One run is one resumable stream: a lost executor restores its state from
    the snapshots and change logs in the checkpoint.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    # As a pattern, which matches this path alone: a plain path would have to be a folder.
    path = path.rstrip("/")
    rows = _keyed(reader.load(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n_rows"))
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(digest, keep, n_rows)`` of the stored state, one row per digest."""
    state = spark.read.format("statestore").load(checkpoint)
    kept, count = (f"`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{kept}").alias("keep"), F.col(f"value.{count}").alias("n_rows"))


def classes_of_files(spark: SparkSession, path: str, schema: StructType | None = None, id_col: str = "doc_id", text_col: str = "text",
                     digest=sha256, max_files: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """One row per row of the files: ``id, locator, keep_id, keep_locator, group_size, kept, digest``."""
    schema = schema or spark.read.parquet(path).schema
    require(spark.createDataFrame([], schema), id_col, text_col)
    checkpoint = checkpoint or fresh_path(spark, "exact-dedup-state")
    stored = StructType([StructField(f.name, f.dataType) for f in schema if f.name in (id_col, text_col)])
    update_state(spark, path, stored, checkpoint, id_col, text_col, digest, max_files)
    state = written(read_state(spark, checkpoint), "exact-dedup-keys")
    rows = _keyed(spark.read.schema(stored).parquet(path), id_col, text_col, digest)

    # Full bytes on hits. Equal smallest and largest bytes mean that all are equal.
    # They are combined before the shuffle: a text that many rows share is one row per task.
    hits = state.filter("n_rows > 1").select("digest")
    bytes_of = rows.select("digest", F.col("text").cast("binary").alias("bytes"))
    ends = bytes_of.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).join(hits, "digest", "left_semi")
    unequal = written(ends.filter("low <> high").select("digest"), "exact-dedup-unequal")
    found = rows.select("id", "locator", "digest").join(state, "digest")
    if not unequal.isEmpty():
        # Digests shared by different bytes: there, the bytes are the key.
        apart = rows.join(unequal, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n_rows"))
        apart = apart.join(by_text, ["digest", "text"]).select("digest", "id", "locator", "keep", "n_rows")
        found = found.join(unequal, "digest", "left_anti").select(*apart.columns).unionByName(apart)
    return found.select(
        "id", "locator", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), F.col("n_rows").alias("group_size"),
        ((F.col("keep.locator.file") == F.col("locator.file")) & (F.col("keep.locator.row") == F.col("locator.row"))).alias("kept"), "digest",
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """``classes_of_files`` for any table: its identifiers and texts are written to the shared folder first."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    _, path = written_at(docs.select(f"`{id_col}`", f"`{text_col}`"), "exact-dedup-rows")
    return classes_of_files(spark, path, None, id_col, text_col, digest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    rows, path = written_at(docs, "exact-dedup-rows")
    found = classes_of_files(spark, path, rows.schema, id_col, text_col, digest).filter("kept")
    file, row = free_name(docs, "__file"), free_name(docs, "__row")
    stay = found.select(F.col("locator.file").alias(file), F.col("locator.row").alias(row))
    at = rows.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    return at.join(stay, [file, row], "left_semi").select(*[f"`{c}`" for c in docs.columns])

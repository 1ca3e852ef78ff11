"""Streaming queries on rows that the given tables don't have."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gradeloom.streaming import scoring as SC
from registry import streams


def test_resume_check_keeps_rows_without_length(spark, tmp_path):
    rows = [(i, f"some text {i}", "en", "web", n) for i, n in enumerate([10, 1499, 1500, 9000, None, None])]
    spark.createDataFrame(rows, streams.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = streams.stream_resume_check(spark, str(tmp_path))
    assert sorted(r.sample_id for r in got.select("sample_id").collect()) == list(range(6))


ROWS = "id bigint, twice bigint"


def _stream(spark, tmp_path, score):
    schema = spark.createDataFrame([], "id bigint").schema
    return SC.add_test_sets(spark, f"{tmp_path}/in", schema, score, f"{tmp_path}/out", f"{tmp_path}/check", max_files=1)


def _seen(spark, tmp_path):
    return sorted(r.id for r in SC.read_committed(spark, f"{tmp_path}/out", ROWS).collect())


def _twice(batch):
    return batch.select("id", (F.col("id") * 2).alias("twice"))


def test_crash_inside_a_batch_and_before_its_commit(spark, tmp_path, monkeypatch):
    spark.range(40).repartition(2).write.parquet(f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()

    def torn(batch):  # some tasks write their rows, the one with row 17 fails
        bad = F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id") * 2)
        return batch.repartition(4, "id").select("id", bad.alias("twice"))

    with pytest.raises(StreamingQueryException):
        _stream(spark, tmp_path, torn)
    first = _seen(spark, tmp_path)
    assert 17 not in first and first in [[], *(f.ids for f in files)]  # whole batches only

    commit = SC._commit
    with monkeypatch.context() as m:
        m.setattr(SC, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(StreamingQueryException):
            _stream(spark, tmp_path, _twice)
    assert _seen(spark, tmp_path) == first  # written, but never committed

    def late(*a):  # killed after the commit, before the stream has noted it
        commit(*a)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(SC, "_commit", late)
        with pytest.raises(StreamingQueryException):
            _stream(spark, tmp_path, _twice)
    _stream(spark, tmp_path, _twice)
    _stream(spark, tmp_path, _twice)
    assert _seen(spark, tmp_path) == list(range(40))


def test_nothing_committed_reads_as_no_rows(spark, tmp_path):
    spark.createDataFrame([], SC.COMMITS).write.parquet(f"{tmp_path}/out/commits")
    assert SC.read_committed(spark, f"{tmp_path}/out", ROWS).count() == 0

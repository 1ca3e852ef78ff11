"""Records of large files whose separator may also stand inside quoted strings.

A file is read by byte ranges, as many tasks as its size asks for. Whether a
range begins inside a string follows from the quotes before it, so three scans
do the work: the first counts quotes per range, a running parity over the
ranges of a file (one row a range) tells where each begins, the second keeps the
ends of records that cross a border, and the third joins the pieces of
all other records where they lie. Texts are never shuffled, but for the few that
cross a border.

Both scans must cut files alike. The cut depends on the session's settings and
core count; a range that the count did not see raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gradeloom.session import ship_code, written

RANGE = ["file", "range_start", "range_length"]
# Byte ranges of one input, whose starts go to all tasks: pieces must stay in file order, so they can't be shuffled to them.
MAX_RANGES = 2_000_000
PIECE = "file string, range_start bigint, whole boolean, opens boolean, first boolean, record binary"


def odd_quotes(piece: Column) -> Column:
    """Whether a piece of CSV holds an odd number of quotes."""
    return (F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))) % 2 == 1


def odd_json_quotes(piece: Column) -> Column:
    """The same for JSON, where a backslash hides the character after it."""
    return odd_quotes(F.regexp_replace(piece, r"\\.", ""))


def _pieces(spark: SparkSession, paths, separator: str, odd: Callable[[Column], Column]) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_start"),
        F.col("_metadata.file_block_length").alias("range_length"), "value", odd(F.col("value")).alias("odd"),
    )


def _started(pieces: DataFrame) -> DataFrame:
    """``inside``: whether a range begins within a string; a file that ends within one is refused."""
    counts = pieces.groupBy(*RANGE).agg((F.count_if("odd") % 2).alias("odd"))
    counts = written(counts, "range-quotes")  # one row a range
    n_ranges = counts.count()
    if n_ranges > MAX_RANGES:
        raise ValueError(f"{n_ranges} byte ranges, at most {MAX_RANGES}: raise spark.sql.files.maxPartitionBytes")
    torn = counts.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").select("file").first()
    if torn:
        raise ValueError(f"{torn[0]} ends inside a quoted string")
    before = W.partitionBy("file").orderBy("range_start").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*RANGE, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _joiner(separator: str, edges: bool):
    """Joins the pieces of each record of a range.

    With ``edges`` it gives only records that a border cuts, else only the
    whole ones. It holds one batch and the open record.
    """
    sep = separator.encode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, cut, first = None, [], False, False  # the open record: its pieces, whether its start is elsewhere

        def rows(file, start, whole, opens, firsts, records):
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([whole] * n), pa.array([opens] * n), firsts, records],
                names=["file", "range_start", "whole", "opens", "first", "record"],
            )

        def closed():
            """What is still open at the end of a range, or began before it."""
            record = pa.array([sep.join(held)], pa.binary())
            return rows(*here, False, not cut, pa.array([first]), record)

        for batch in batches:
            files, starts = batch["file"], batch["range_start"].to_numpy()
            named = files.dictionary_encode().indices.to_numpy()
            change = np.flatnonzero((np.diff(starts) != 0) | (np.diff(named) != 0)) + 1
            for lo, hi in zip(np.r_[0, change], np.r_[change, len(starts)]):
                if lo == hi:
                    continue
                at, begin = (files[int(lo)].as_py(), int(starts[lo])), False
                values, odd = batch["value"].slice(lo, hi - lo), batch["odd"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                if at != here:
                    if held and edges:
                        yield closed()
                    begin, here, held = True, at, []
                    inside = cut = bool(batch["inside"][int(lo)].as_py())
                    first = at[1] == 0
                state = (np.cumsum(odd) + inside) % 2 == 1  # after each piece
                inside, ends = bool(state[-1]), np.flatnonzero(~state)
                done = 0
                if held or (begin and cut):
                    stop = int(ends[0]) + 1 if len(ends) else hi - lo
                    held += values.slice(0, stop).to_pylist()
                    done = stop
                    if not len(ends):
                        continue
                    if cut:
                        if edges:
                            yield closed()
                    elif not edges:
                        yield rows(*here, True, True, pa.array([first]), pa.array([sep.join(held)], pa.binary()))
                    held, cut, first, ends = [], False, False, ends[1:]
                if len(ends):
                    offsets = np.r_[done, ends + 1].astype(np.int32)
                    if not edges:
                        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                        firsts = np.zeros(len(ends), bool)
                        firsts[0] = first
                        yield rows(*here, True, True, pa.array(firsts), pc.binary_join(lists, sep))
                    done, first = int(offsets[-1]), False
                held = values.slice(done).to_pylist()
        if held and edges:
            yield closed()

    return join


def _across(parts: DataFrame) -> DataFrame:
    """Records that a border cuts; only their places are ordered, a file at a time."""
    order = W.partitionBy("file").orderBy("range_start", "opens")  # in a range, the end of a record comes before the next one's start
    place = parts.select("file", "range_start", "opens").withColumn("_number", F.sum(F.col("opens").cast("bigint")).over(order))
    numbered = parts.join(place, ["file", "range_start", "opens"])
    found = numbered.groupBy("file", "_number").agg(
        F.array_sort(F.collect_list(F.struct("range_start", F.col("record").cast("string").alias("text")))).alias("parts"), F.bool_or("first").alias("first"),
    )
    return found.select("file", "first", "parts.text")


def records(spark: SparkSession, paths, separator: str, odd: Callable[[Column], Column]) -> DataFrame:
    """``(file, first, record)``: what stands between separators outside of strings; ``first`` marks the first one of a file.

    ``odd`` says whether a piece between two separators turns the string state.
    The separator is one ASCII character. An empty file has no records.
    """
    ship_code(spark)
    pieces = _pieces(spark, paths, separator, odd)
    known = pieces.join(F.broadcast(_started(pieces)), RANGE, "left")  # MAX_RANGES short rows at most
    missing = F.raise_error(F.lit("files were cut differently in two scans; set spark.sql.files.minPartitionNum"))
    known = known.select("file", "range_start", F.col("value").cast("binary").alias("value"), "odd", F.coalesce("inside", missing.cast("boolean")).alias("inside"))
    parts = written(known.mapInArrow(_joiner(separator, True), PIECE), "range-borders")
    whole = known.mapInArrow(_joiner(separator, False), PIECE).select("file", "first", F.col("record").cast("string").alias("record"))
    joined = _across(parts).select("file", "first", F.array_join("text", separator).alias("record"))
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, paths, schema: str, header: bool = True) -> DataFrame:
    """``(file, columns...)`` of quoted CSV with line breaks in its fields, many tasks a file.

    Quotes are doubled within quoted fields. A quote within an unquoted field is
    taken as the multi-line reader takes it as long as its line has an even number.
    Blank lines are no rows; missing fields are null. Line breaks inside fields stay as they are.
    """
    rows = records(spark, paths, "\n", odd_quotes)
    if header:
        rows = rows.filter(~F.col("first"))
    rows = rows.withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record <> ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return rows.select("file", F.from_csv("record", schema, options).alias("_row")).select("file", "_row.*")


def read_json_entries(spark: SparkSession, paths, value: str) -> DataFrame:
    """``(file, id, value)`` of objects ``{id: {...}}`` whose inner objects are flat, many tasks a file.

    ``value`` is the type of an inner object. Every closing bracket outside a string ends an entry
    or the whole object; ids may hold brackets, quotes and escapes. Files may hold several objects.
    """
    entries = records(spark, paths, "}", odd_json_quotes)
    body = F.regexp_replace("record", r"^[\s,{]+", "")
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}}")), f"map<string,{value}>")
    return entries.filter(body != "").select("file", F.explode(parsed).alias("id", "value"))

"""Packing of tokenised documents into sequences by cutting-stock column generation.

Each document's ids, closed by an end id, are cut into full pieces of the
sequence length and one rest. Rests go into classes of ``grain`` tokens. Which
combinations of classes share a sequence is the cutting-stock problem on the
histogram of classes: its linear program is solved by column generation, where
a knapsack dynamic program over the dual prices finds the next pattern. The
pattern counts are rounded down; what is left over is filled first-fit
decreasing by class. Last, pieces are ranked inside their class and take the
slots of the patterns in that order.

Only the histogram, of at most ``length / grain`` rows whatever the input,
reaches the driver, and only the patterns (no more than classes, and the
patterns of the left-over) go back to the tasks. Ranks are counted in two steps,
inside buckets of a class and over the buckets, so a length that a third of
all documents share is ranked by many tasks. A sequence holds few pieces, so
the offsets inside it are a small window. The pieces are a written table: no
text is tokenised twice, also after a lost executor.

Defined cases: a null or empty text has the end id alone; repeated rows are
separate documents; an empty table gives no pieces. The result has its own
columns (``id`` for the identifier), so input columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gradeloom.llm.common import pieces, require, ship_code, written
from gradeloom.llm.tokens import word_bpe

GRAIN = 8
GAP = 5e-3


# ------------------------------------------------------------------ pieces

PIECE = [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]


def _cutting(tokenizer: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_bpe(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in pieces(batches, "text"):
            rows, parts, ids = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                whole = encode(text or "") + end
                n = len(whole) // 4
                for start in range(0, n, length):
                    part = whole[4 * start : 4 * (start + length)]
                    rows.append(row)
                    parts.append((start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*parts))]
            if parts:
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], ["id", *(f.name for f in PIECE), *(["ids"] if with_ids else [])])

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    require(docs, id_col, text_col)
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([rows.schema["id"], *PIECE, *([StructField("ids", BinaryType())] if with_ids else [])])
    return rows.mapInArrow(_cutting(tokenizer, end_id, length, with_ids), schema)


# ------------------------------------------------------------------ patterns


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest combination of sizes that fits, and its value."""
    value = np.zeros(room + 1)
    last = np.full(room + 1, -1)
    order = np.argsort(sizes)
    by_size, price = sizes[order], prices[order]
    fitting = np.searchsorted(by_size, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        if n := fitting[c]:
            with_it = value[c - by_size[:n]] + price[:n]
            k = int(with_it.argmax())
            if with_it[k] > value[c] + 1e-12:
                value[c], last[c] = with_it[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[order[last[c]]] += 1
            c -= by_size[last[c]]
    return float(value[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per column) and how often each is used, for the least number of sequences; not rounded.

    Stops when no pattern has a price above 1, or when the number of sequences
    is within ``gap`` of the lower bound that the prices give.
    """
    n = len(sizes)
    fill = (room // sizes).astype(float)
    basis, inverse, used = np.diag(fill), np.diag(1 / fill), demand / fill
    while True:
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, room)
        if value <= 1 + gap:  # the bound is the number of sequences / value
            return basis, used
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """``(sequences, {class: pieces in each})``: whole patterns that cover the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes])
    out: list[tuple[int, dict[int, int]]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        if times > 0:
            out.append((times, {int(s): int(k) for s, k in zip(sizes, pattern) if k}))
            left = left - times * pattern.astype(int)

    basis, used = column_generation(sizes, left.astype(float), room)
    for column, x in zip(basis.T, used):
        # Rounded down; a basis pattern may also hold more of a class than is left.
        some = column > 0
        use(column, min(int(x + 1e-6), int((left[some] // column[some]).min())))
    while left.any():
        pattern, free = np.zeros(len(sizes), dtype=int), room
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], free // sizes[k])
            free -= pattern[k] * sizes[k]
        some = pattern > 0
        use(pattern, int((left[some] // pattern[some]).min()))
    return out


# ---------------------------------------------------------------- assignment


def _slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Class -> for each pattern with it: rank of its first piece, first sequence, pieces a sequence, place of the first in a sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for times, pattern in patterns:
        place = 0
        for size in sorted(pattern, reverse=True):
            rows.setdefault(size, []).append((taken.get(size, 0), base, pattern[size], place))
            taken[size] = taken.get(size, 0) + times * pattern[size]
            place += pattern[size]
        base += times
    return {size: tuple(np.array(c) for c in zip(*some)) for size, some in rows.items()}


def _assigning(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            sequence, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, each, begins = slots[int(s)]
                k = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[k]
                sequence[at], place[at] = base[k] + within // each[k], begins[k] + within % each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(place)], [*batch.schema.names, "sequence_id", "place"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         grain: int = GRAIN, with_ids: bool = False, bucket_rows: int = 100_000) -> DataFrame:
    """One row per piece: what ``cut`` gives, ``sequence_id`` and ``offset`` (gapless from 0)."""
    spark = docs.sparkSession
    cuts = cut(docs, tokenizer, end_id, length, id_col, text_col, with_ids)
    size = F.ceil(F.col("length") / grain).cast("int")
    parts = written(cuts.withColumns({"size": size, "row": F.monotonically_increasing_id()}), "packing-pieces")
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # length / grain rows at most
    shared = spark.sparkContext.broadcast(_slots(plan(histogram, length // grain)))

    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = parts.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("size", "bucket").orderBy("row")) - 1
    ranked = parts.withColumn("inside", inside).join(counts, ["size", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "inside", "before", "row")
    schema = StructType([*ranked.schema.fields, StructField("sequence_id", LongType()), StructField("place", LongType())])
    placed = ranked.mapInArrow(_assigning(shared), schema)
    earlier = F.sum("length").over(W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(earlier, F.lit(0))).drop("size", "rank", "place")

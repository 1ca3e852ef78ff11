"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every byte that a string of ``length`` bytes covers which also starts anywhere
else, in the same text or in another, is removed; strings do not cross texts and
are judged on the input. The merge runs on pieces that share a tile, so that it
spreads over tasks:

1. All windows of ``length`` bytes choose their smallest k-mer, in an order by
   hash that puts frequent k-mers last (a sketch of fixed size counts them over
   all texts). Equal windows choose equal k-mers. Consecutive windows with the
   same choice form a run; a run is described by its k-mer, its fingerprint and
   its place.
2. Per k-mer: a run whose k-mer occurs nowhere else has no repeated window. Runs
   that share a k-mer and are all equal are repeated as a whole. Copies of a
   text, however many, end here; they are counted, combined before the shuffle.
3. Where different runs share a k-mer, each distinct run is read once. The
   runs of a task are dealt into shards, each shard's Burrows-Wheeler transform
   is built, and the transforms are merged: starting from one transform after
   the other, each round moves the interleave from an order by h symbols to one
   by h + 1 (a stable distribution of the transforms' symbols), and the
   round in which two neighbours part is their common prefix. Suffixes are never
   sorted across shards. After ``length / 8`` rounds (a symbol is a word of eight
   bytes), an interval of the merged order that still holds two windows is a
   repeated string.
4. The intervals go back to all texts that have those runs, and are joined there.

K-mers and runs are compared by 64-bit hashes each, together 128 bits.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; overlapping strings of one text count (a run of one letter loses all);
rows with equal identifier and text are copies of each other; a null identifier
is an identifier; an empty table gives an empty result; long texts are cut into
overlapping blocks of windows. The result has its own columns, and ``removed``
carries input columns in one nested column, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, ship_code, written

LENGTH = 200
KMER = 32
SKETCH_BITS = 20
SKETCH_BLOCKS = 16
BLOCK = 1 << 20
WORD = 8
CHUNK = 50_000
SHARDS = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93


# ------------------------------------------------------------------ k-mer order


def kmer_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the ``KMER`` bytes that start at each position; doubles the width five times."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _MIX
    width = 1
    while width < KMER:
        h = h[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, v
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _joined(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, bytes]]:
    """Blocks of about ``BLOCK`` bytes: rows, where each begins in the block, at which of its bytes, and the bytes.

    A text longer than a block is in several, each with the bytes that the windows starting there need.
    """
    rows, starts, offsets, parts, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        data = (text or "").encode()
        for at in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
            part = data[at : at + BLOCK + LENGTH - 1]
            rows.append(row)
            starts.append(size)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield rows, np.array(starts), np.array(offsets), b"".join(parts)
                rows, starts, offsets, parts, size = [], [], [], [], 0
    if rows:
        yield rows, np.array(starts), np.array(offsets), b"".join(parts)


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, empty = np.zeros(1 << SKETCH_BITS, np.int64), True
    for batch in pieces(batches, "text"):
        for _, _, _, data in _joined(batch.column("text").to_pylist()):
            h = kmer_hashes(np.frombuffer(data, np.uint8))
            counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            empty = False
    if not empty:
        parts = [p.tobytes() for p in np.split(counts, SKETCH_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(counts, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])


def frequency_classes(texts: DataFrame) -> np.ndarray:
    """Class of each sketch cell: 0 up to eight times the mean, then one for each doubling."""
    parts = texts.select("text").mapInArrow(_sketching, "block int, counts binary").repartition(SKETCH_BLOCKS, "block")
    rows = sorted(parts.mapInArrow(_adding, "block int, counts binary").collect(), key=lambda r: r["block"])  # 2 ** SKETCH_BITS counters
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(1 << SKETCH_BITS)
    usual = max(8 * counts.mean(), 16)
    return np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0).astype(np.uint64)


# ------------------------------------------------------------------------ runs

RUN = [StructField(n, LongType()) for n in ("kmer", "print", "start", "windows", "selfish")]


def runs_of(texts: list[str | None], classes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: row, k-mer, fingerprint, start in the text, windows, and whether the k-mer occurs in the run more than once."""
    width = LENGTH - KMER + 1
    for rows, starts, offsets, data in _joined(texts):
        x = np.frombuffer(data, np.uint8)
        h = kmer_hashes(x)
        order = (classes[h >> np.uint64(64 - SKETCH_BITS)] << np.uint64(58)) | (h >> np.uint64(6))
        least = sliding_min(order, width)
        ends = np.append(starts[1:], len(x))
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        valid = np.ones(len(least), bool)
        for stop, begin in zip(ends[:-1], starts[1:]):
            valid[max(stop - LENGTH + 1, 0) : begin] = False
            change[begin : begin + 1] = True
        begin = np.flatnonzero(change & valid)
        last = np.r_[np.flatnonzero(change)[1:], len(least)]
        last = last[np.searchsorted(np.flatnonzero(change), begin)]
        text_no = np.searchsorted(starts, begin, "right") - 1
        last = np.minimum(last, ends[text_no] - LENGTH + 1)
        count = last - begin
        chosen = least[begin]
        steps = np.arange(width)
        selfish = np.zeros(len(begin), np.int64)
        for k in range(0, len(begin), 4096):
            some = slice(k, k + 4096)
            first = (order[begin[some, None] + steps] == chosen[some, None]).argmax(axis=1) + begin[some]
            final = last[some] + width - 2 - (order[last[some, None] + width - 2 - steps] == chosen[some, None]).argmax(axis=1)
            selfish[some] = first != final
        view = memoryview(data)
        prints = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), (last + LENGTH - 1).tolist())]
        yield (
            np.array(rows)[text_no], chosen.view(np.int64), np.array(prints, np.uint64).view(np.int64),
            begin - starts[text_no] + offsets[text_no], count, selfish,
        )


def _running(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for row, *columns in runs_of(batch.column("text").to_pylist(), shared.value):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("same").take(at), *(pa.array(c, pa.int64()) for c in columns)], ["id", "same", *(f.name for f in RUN)])

    return run


# ----------------------------------------------------------------------- merge


def shard_transform(symbols: np.ndarray, following: np.ndarray, before: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform of one shard.

    ``symbols`` from 1; ``ends`` marks the string ends, which differ from each
    other and come first. The transform has 0 where no symbol precedes.
    """
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    step = following
    while True:
        # Ranks by twice as many symbols; ends are alone in their rank already.
        key = rank * (int(rank.max()) + 2) + np.where(ends, 0, rank[step] + 1)
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order][1:] != key[order][:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        step = np.where(ends[step], step, step[step])
    has = before >= 0
    transform = np.where(has, symbols[np.where(has, before, 0)], 0)
    return order, transform[order]


def merge(transforms: list[np.ndarray], n_ends: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms (the shard of each suffix) and common prefixes with the suffix before.

    A common prefix counts symbols; ``rounds`` stands for that many or more.
    """
    bwt = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    end_shards = np.repeat(np.arange(len(transforms), dtype=np.uint8), n_ends)
    n, ends = len(bwt), len(end_shards)
    block = np.zeros(n, np.int32)
    common = np.full(n, rounds, np.int16)
    common[0] = 0
    place = np.empty(n, np.int64)
    for h in range(1, rounds + 1):
        # Where each suffix of the interleave stands in its own shard.
        place[np.argsort(shard, kind="stable")] = np.arange(n)
        symbol = bwt[place]
        moved = np.argsort(symbol, kind="stable")[ends:]
        shard = np.concatenate([end_shards, shard[moved]])
        parted = np.ones(n, bool)
        parted[ends + 1 :] = (symbol[moved[1:]] != symbol[moved[:-1]]) | (block[moved[1:]] != block[moved[:-1]])
        new = parted & (common == rounds)
        if h > 1 and not new.any():
            break
        common[new] = h - 1
        block = np.cumsum(parted, dtype=np.int32)
    return shard, common


def repeated_windows(strings: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes (a multiple of eight) start anywhere else too."""
    shards = min(shards, len(strings))
    sizes = np.array([len(s) for s in strings])
    # Each string is followed by as many ends as a symbol has bytes, one for each phase.
    starts = np.concatenate([[0], np.cumsum(sizes + WORD)[:-1]])
    total = int((sizes + WORD).sum())
    data = np.zeros(total + WORD, np.uint8)
    data[:total] = np.frombuffer(b"".join(s + bytes(WORD) for s in strings), np.uint8)
    words = np.zeros(total, np.uint64)
    for j in range(WORD):
        words = (words << np.uint64(8)) | data[j : j + total]
    number = np.repeat(np.arange(len(strings)), sizes + WORD)
    offset = np.arange(total) - starts[number]
    ends = offset >= sizes[number]
    distinct, symbols = np.unique(words, return_inverse=True)
    symbols = (symbols + 1).astype(np.uint16 if len(distinct) < 65_000 else np.uint32)

    bounds = [k * len(strings) // shards for k in range(shards + 1)]
    orders, transforms, n_ends = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        low = int(starts[a])
        high = int(starts[b]) if b < len(strings) else total
        own = slice(low, high)
        here = np.arange(high - low)
        following = np.where(ends[own], here, here + WORD)
        before = np.where(offset[own] >= WORD, here - WORD, -1)
        order, transform = shard_transform(symbols[own], following, before, ends[own])
        orders.append(order + low)
        transforms.append(transform.astype(symbols.dtype))
        n_ends.append(int(ends[own].sum()))
    shard, common = merge(transforms, n_ends, length // WORD)
    place = np.empty(total, np.int64)
    place[np.argsort(shard, kind="stable")] = np.arange(total)
    suffix = np.concatenate(orders)[place]
    interval = np.cumsum(common < length // WORD)
    window = offset[suffix] + length <= sizes[number[suffix]]
    many = np.bincount(interval[window], minlength=int(interval[-1]) + 1) >= 2
    flagged = np.zeros(total, bool)
    flagged[suffix] = window & many[interval]
    return [flagged[s : s + max(n - length + 1, 0)] for s, n in zip(starts.tolist(), sizes.tolist())]


def spans_of(flags: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes that flagged windows cover."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return joined_spans([(int(a), int(b) + length - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in k-mer order; merges whole k-mers, about ``CHUNK`` bytes at once, one k-mer at least."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def done() -> pa.RecordBatch:
        found = repeated_windows([h[3] for h in held])
        spans = [[(0, len(h[3]))] if h[2] > 1 else spans_of(f) for h, f in zip(held, found)]
        columns = [pa.array([h[k] for h in held], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)], ["kmer", "print", "spans"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("kmer", "print", "n", "bytes"))):
            if held and size >= CHUNK and row[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + WORD
    if held:
        yield done()


# -------------------------------------------------------------------- operator


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``id, same, spans`` of the rows ``(id, text, same)`` that have repeated windows; ``same`` is a hash of the text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(frequency_classes(texts))
    runs = written(texts.mapInArrow(_running(shared), StructType([texts.schema["id"], StructField("same", LongType()), *RUN])), "suffix-runs")
    kmers = runs.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("low"), F.max("print").alias("high"), F.max("selfish").alias("selfish"))
    kmers = kmers.filter("n > 1 or selfish = 1").select("kmer", ((F.col("low") == F.col("high")) & (F.col("selfish") == 0)).alias("equal"))
    shared_runs = written(runs.join(kmers, "kmer").drop("selfish"), "suffix-shared")
    whole = shared_runs.filter("equal").select("id", "same", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))

    mixed = shared_runs.filter("not equal")
    first = F.min(F.struct("id", "same", "start", "windows")).alias("at")
    distinct = mixed.groupBy("kmer", "print").agg(F.count(F.lit(1)).alias("n"), first).select("kmer", "print", "n", "at.*")
    wanted = distinct.groupBy("id", "same").agg(F.collect_list(F.struct("kmer", "print", "n", "start", "windows")).alias("wanted"))
    source = texts.alias("t").join(wanted.alias("w"), F.expr("t.id <=> w.id and t.same = w.same"))
    source = source.select(F.col("t.text").alias("text"), F.col("w.wanted").alias("wanted"))
    cut = source.select(F.col("text").cast("binary").alias("text"), F.inline("wanted"))
    cut = cut.select("kmer", "print", "n", F.substring("text", F.col("start").cast("int") + 1, (F.col("windows") + LENGTH - 1).cast("int")).alias("bytes"))
    spans = cut.dropDuplicates(["kmer", "print"]).repartition("kmer").sortWithinPartitions("kmer").mapInArrow(
        _merging, StructType([StructField("kmer", LongType()), StructField("print", LongType()), StructField("spans", SPANS)])
    )
    found = mixed.join(spans.filter(F.size("spans") > 0), ["kmer", "print"]).select("id", "same", "start", F.explode("spans").alias("s"))
    parts = found.select("id", "same", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))
    every = whole.unionByName(parts)
    return every.groupBy("id", "same").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        kept, spans = [], []
        for text, some in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = (text or "").encode()
            cuts = joined_spans([(s["start"], s["end"]) for s in some or ()])
            at, left = 0, []
            for a, b in cuts:
                left.append(data[at:a])
                at = b
            kept.append(b"".join([*left, data[at:]]))
            spans.append([{"start": a, "end": b} for a, b in cuts])
        yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(kept, pa.binary()), pa.array(spans, _SPANS)], ["record", "kept", "spans"])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``record`` (the other columns of the input), ``kept`` (the bytes that stay) and ``spans`` (the bytes removed, end exclusive)."""
    require(docs, id_col, text_col)
    ship_code(docs.sparkSession)
    rows = carried(docs, text_col).withColumn("same", F.xxhash64("text"))
    texts = rows.select(F.col(f"record.`{id_col}`").alias("id"), "text", "same")
    spans = repeated_spans(texts)
    both = rows.alias("r").join(spans.alias("s"), F.expr(f"r.record.`{id_col}` <=> s.id and r.same = s.same"), "left")
    schema = StructType([rows.schema["record"], StructField("kept", BinaryType()), StructField("spans", SPANS)])
    return both.select("r.record", "r.text", "s.spans").mapInArrow(_removing, schema)

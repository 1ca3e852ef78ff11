"""Benchmark decontamination as a prefix-filtered set join.

An item of the benchmark gives windows of 13 consecutive words; an item of
fewer words, but not none, is one window. A document contains a window when
its words occur in it consecutively. As with any containment join, every
shingle of the window must occur in the document, so one suffices to find all
candidates, and the rarest one finds the fewest:

1. The shingles (three words, fewer in shorter windows) of all windows are
   counted over all documents.
2. Each distinct window is indexed under its rarest shingle, with the
   shingle's place in the window and the window's length. A window with a
   shingle that no document has is dropped: it cannot occur.
3. The documents are joined to this index. The place of the shingle gives the
   one place where the window can lie; positional and length bounds drop those
   that would begin before the text or end after it; the words of an
   item-sized window of the document are then compared exactly.

The benchmark is a stated query set: the index is sent to the tasks in blocks
of at most ``block_windows`` windows, and each block runs over all documents and writes
what it found before the next one begins, so tasks hold one block and the driver
two, whatever the benchmark's size. Documents are not shuffled; a row depends on nothing but its own text, so
neither hot groups nor repeated rows matter, and a lost task is simply repeated.

Defined cases: null and empty texts have no words and no hits; an empty
benchmark or empty table gives no hits; benchmark rows with the same item_id
are one item; a null item_id reads as the empty string. Input columns are
carried in one nested column, so names cannot clash with those added.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, restored, ship_code, written

WINDOW = 13
SHINGLE = 3
# Word characters are digits, letters and all that is not ASCII; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, texts = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for i in range(max(len(words) - WINDOW, 0) + 1 if words else 0):
                items.append(item)
                texts.append(b" ".join(words[i : i + WINDOW]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item_id", "window"])


def windows_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(window, item_ids)``: each distinct window, as its words joined by blanks, and the items that have it."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(_windows, "item_id string, window string")
    return found.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def _shingled(windows: DataFrame) -> DataFrame:
    """Each window with its shingles and their places."""
    parts = F.split("window", " ", -1)
    q = F.least(F.lit(SHINGLE), F.size(parts))
    places = F.transform(F.sequence(F.lit(0), F.size(parts) - q), lambda i: F.array_join(F.slice(parts, i + 1, q), " "))
    return windows.select("window", "item_ids", F.posexplode(places).alias("place", "shingle"))


def _by_first(shingles: list[bytes]) -> dict[bytes, list[tuple[int, set[bytes]]]]:
    """First word -> (number of words, shingles of that many words)."""
    out: dict[bytes, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
    for s in shingles:
        words = s.split(b" ")
        out[words[0]][len(words)].add(s)
    return {w: list(by.items()) for w, by in out.items()}


def _counting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _by_first(shared.value)
        counts: Counter[bytes] = Counter()
        for batch in pieces(batches, "text"):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for i in [i for i, w in enumerate(words) if w in first]:
                    for q, some in first[words[i]]:
                        if (s := b" ".join(words[i : i + q])) in some:
                            counts[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array([s.decode() for s in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["shingle", "n"])

    return run


def _blocks(df: DataFrame, key: str, most: int) -> Iterator[list]:
    """The rows in blocks of about ``most``, by a hash of their unique key."""
    n = -(-df.count() // most)
    for k in range(n):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k).collect()  # at most about ``most`` rows


def index_of(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", block_windows: int = 50_000) -> DataFrame:
    """``(window, item_ids, shingle, place)``: each window that can occur, under its rarest shingle."""
    spark = documents.sparkSession
    texts = documents.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    shingled = written(_shingled(windows_of(benchmark)), "contamination-shingles")
    counted = None
    for block in _blocks(shingled.select("shingle").distinct(), "shingle", block_windows):
        shared = spark.sparkContext.broadcast([r["shingle"].encode() for r in block])
        some = texts.mapInArrow(_counting(shared), "shingle string, n bigint")
        counted = some if counted is None else counted.unionByName(some)
    if counted is None:
        return shingled.select("window", "item_ids", "shingle", "place")
    counts = counted.groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = W.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    ranked = shingled.join(counts, "shingle", "left").withColumn("rank", F.row_number().over(rarest))
    return written(ranked.filter("rank = 1 and n > 0").select("window", "item_ids", "shingle", "place"), "contamination-index")


FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    StructField("item_ids", ArrayType(StringType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _joining(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, list] = defaultdict(list)
        for window, items, shingle, place in shared.value:
            words = window.split(b" ")
            index[shingle].append((place, len(words), words, items))
        first = _by_first(list(index))
        for batch in pieces(batches, "text"):
            n_words, all_spans, all_items = [], [], []
            for text, spans, items in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "item_ids"))):
                words = words_of(text)
                n = len(words)
                hits = [(s["start"], s["end"]) for s in spans]
                named = set(items)
                for i in [i for i, w in enumerate(words) if w in first]:
                    for q, some in first[words[i]]:
                        if (s := b" ".join(words[i : i + q])) in some:
                            for place, length, window, has in index[s]:
                                at = i - place
                                if 0 <= at and at + length <= n and words[at : at + length] == window:
                                    hits.append((at, at + length))
                                    named.update(has)
                n_words.append(n)
                all_spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                all_items.append(sorted(named))
            out = [batch.column("record"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(all_spans, _SPANS), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["record", "text", "n_words", "spans", "item_ids"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", block_windows: int = 50_000) -> DataFrame:
    """``record`` (the other columns of the input), ``text``, ``n_words``, ``spans`` (merged, of words, end exclusive), ``item_ids`` and ``n_hit``."""
    require(documents, text_col)
    spark = documents.sparkSession
    ship_code(spark)
    rows = carried(documents, text_col).select(
        "record", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(FOUND["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("item_ids"),
    )
    schema = StructType([StructField("record", rows.schema["record"].dataType), StructField("text", StringType()), *FOUND.fields])
    index = index_of(documents, benchmark, text_col, block_windows)
    blocks = _broadcasts(spark, index, block_windows)
    shared = next(blocks, None) or spark.sparkContext.broadcast([])
    while shared is not None:
        rows, following = rows.mapInArrow(_joining(shared), schema), next(blocks, None)
        if following is not None:  # a block's stage ends before the next one's begins
            rows = written(rows, "contamination-block")
            shared.unpersist()
        shared = following
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.withColumn("n_hit", n_hit)


def _broadcasts(spark, index: DataFrame, block_windows: int):
    for block in _blocks(index, "window", block_windows):
        yield spark.sparkContext.broadcast([(r["window"].encode(), list(r["item_ids"]), r["shingle"].encode(), r["place"]) for r in block])


def contaminated(least_share: int = 20):
    """At least one word in ``least_share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = matches(documents, benchmark, text_col)
    return found.filter(~contaminated()).select(*restored(documents, text_col))

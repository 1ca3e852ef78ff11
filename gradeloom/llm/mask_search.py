"""Ranked lexical search by presence masks.

Every item of a query set gets the documents that score highest on its terms,
with whole-number scores that do not depend on the order of summation:

    w(t)    = floor(1000 ln((2N + 2) / (2 df(t) + 1)))
    m(d)    = 50 + (50 n(d) N) div L
    score   = sum over the item's distinct terms of w(t) * (10^9 tf div (1000 tf + 20 m(d)))

N counts the documents with a term, L their terms, n(d) a document's terms.

1. One scan of the texts writes, per document with a term, its n and the query
   terms that it holds with their tf: small rows, from which N, L and df come.
2. Each task reads those rows in blocks of documents and holds one bitmap per
   term. For an item, the bitmaps of its terms are transposed into one mask of
   matched terms per document; documents with the same mask form a group, and
   a mask's highest possible score follows from the highest tf of its terms
   and the lowest m in the block. Masks are evaluated by descending highest
   score, until it is below the score that the item's last place already has in
   this task: no later mask can then enter.
3. A task hands on at most ``limit`` documents per item, whatever its size; the
   best of all tasks are ranked in two steps.

The items are a stated query set. It goes through in blocks of about
``block_bytes`` of query text, each with its own scan and its own written
result, so tasks and driver hold the terms of one block (of one item at least).
Documents are never grouped by term or item, so frequent terms and repeated
documents make no hot task.

Defined cases: null and empty texts have no term and are not counted; an item
without terms, or whose terms no document holds, gets no row; rows with the
same item id (null included) are one item with the terms of all; a repeated
document is ranked as often as it is there; equal scores go by ascending id,
null first; empty tables give no rows. Only the named columns are read, so no
other name can clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gradeloom.llm.common import pieces, require, ship_code, written
from gradeloom.llm.contamination import words_of
from gradeloom.operators.scale import top_n_per_group

#: Documents whose bitmaps a task holds at once.
BLOCK_DOCS = 4096


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item and distinct term of one query text."""
    for batch in pieces(batches, "text"):
        rows, terms = [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            own = sorted(set(words_of(text)))
            rows.extend([row] * len(own))
            terms.extend(w.decode() for w in own)
        item = batch.column("item").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([item, pa.array(terms, pa.string())], ["item", "term"])


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term)``: the distinct terms of every item."""
    rows = queries.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([rows.schema["item"], StructField("term", StringType())])
    return rows.mapInArrow(_term_rows, schema).distinct()


def _posting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value)}
        for batch in pieces(batches, "text"):
            rows, sizes, ends, terms, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                tf = Counter(words)
                held = number.keys() & tf.keys()
                terms.extend(number[w] for w in held)
                counts.extend(tf[w] for w in held)
                rows.append(row)
                sizes.append(len(words))
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ], ["id", "n", "terms", "tfs"])

    return run


def postings(documents: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term: its number of terms and the listed terms that it holds."""
    shared = documents.sparkSession.sparkContext.broadcast([t.encode() for t in terms])
    rows = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_posting(shared), "id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _counting(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], ["term", "df"])

    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """Whole-number weights; terms that no document holds get 0."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) if k else 0 for k in df], np.int64)


def lengths(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of n terms; products beyond 64 bits are taken in Python's integers."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([50 + 50 * int(k) * n_docs // n_words for k in n], np.int64)
    return 50 + 50 * n * n_docs // n_words


def gain(w, tf, m):
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Block:
    """Bitmaps and counts of the terms in one block of documents."""

    def __init__(self, ids, known, m, terms, docs, tfs, n_terms):
        self.ids, self.known, self.m, self.size = ids, known, m, len(m)
        order = np.lexsort((docs, terms))
        self.docs, self.tfs = docs[order], tfs[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, tfs)
        self.bits = np.zeros((n_terms, -(-self.size // 8)), np.uint8)
        for first in range(0, n_terms, 1024):
            last = min(first + 1024, n_terms)
            a, b = self.starts[first], self.starts[last]
            plain = np.zeros((last - first, self.size), bool)
            plain[np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1])), self.docs[a:b]] = True
            self.bits[first:last] = np.packbits(plain, axis=1)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct masks over ``terms``, as rows of 0 and 1, and each document's mask."""
        columns = np.packbits(np.unpackbits(self.bits[terms], axis=1, count=self.size), axis=0)
        width = -(-len(columns) // 8) * 8
        keys = np.zeros((self.size, width), np.uint8)
        keys[:, : len(columns)] = columns.T
        words = keys.view(np.uint64)
        if words.shape[1] == 1:
            distinct, of = np.unique(words[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, of = np.unique(words, axis=0, return_inverse=True)
        return np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, count=len(terms)), of.ravel()

    def scores(self, terms: np.ndarray, w: np.ndarray, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for t in terms:
            a, b = self.starts[t], self.starts[t + 1]
            if a < b:
                at = np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1) + a
                total += np.where(self.docs[at] == docs, gain(w[t], self.tfs[at], self.m[docs]), 0)
        return total


def best(block: Block, terms: np.ndarray, w: np.ndarray, held: tuple, limit: int) -> tuple:
    """The ``limit`` best of those held (scores, ids, known) and this block's documents."""
    masks, of = block.masks(terms)
    bounds = masks.astype(np.int64) @ gain(w[terms], block.most[terms], block.m.min())
    order = np.argsort(-bounds, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = np.argsort(place[of], kind="stable")  # documents, highest masks first
    ends = np.cumsum(np.bincount(place[of], minlength=len(order)))
    done = k = 0
    while k < len(order) and bounds[order[k]] > 0:
        if len(held[0]) == limit and bounds[order[k]] < held[0][-1]:
            break
        k = max(k + 1, int(np.searchsorted(ends, done + 4 * limit)))  # whole masks, a few times ``limit`` documents at once
        docs = by_mask[done : ends[min(k, len(ends)) - 1]]
        done += len(docs)
        scores = block.scores(terms, w, docs)
        hits = scores > 0
        scores, ids, known = (np.concatenate(p) for p in zip(held, (scores[hits], block.ids[docs[hits]], block.known[docs[hits]])))
        first = np.lexsort((ids, known, -scores))[:limit]
        held = scores[first], ids[first], known[first]
    return held


def _scoring(shared, n_docs: int, n_words: int, limit: int):
    def blocks(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[Block]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(first, BLOCK_DOCS)
                ids, n, terms, tfs = (part.column(c) for c in ("id", "n", "terms", "tfs"))
                docs = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False))
                flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield Block(
                    ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                    lengths(n.to_numpy(), n_docs, n_words), flat(terms), docs, flat(tfs), n_terms,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, items = shared.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = [none] * len(items)
        for block in blocks(batches, len(w)):
            for k, terms in enumerate(items):
                held[k] = best(block, terms, w, held[k], limit)
        for first in range(0, len(items), 1000):
            some = held[first : first + 1000]
            scores, ids, known = (np.concatenate(p) for p in zip(*some))
            number = np.repeat(np.arange(first, first + len(some)), [len(s[0]) for s in some])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], ["number", "id", "score"])

    return run


def _block(documents: DataFrame, asked: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """The ranking of one block of items, given as ``(item, term)``."""
    spark = documents.sparkSession
    of_item: dict = {}
    for item, term in asked.collect():  # one block of the query set
        of_item.setdefault(item, []).append(term)
    vocabulary = sorted({t for terms in of_item.values() for t in terms})
    number = {t: k for k, t in enumerate(vocabulary)}
    items = list(of_item)
    found = written(postings(documents, vocabulary, id_col, text_col), "search-postings")
    n_docs, n_words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = found.select("terms").mapInArrow(_counting(len(vocabulary)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for term, n in counted.collect():  # as many rows as terms in the block
        df[term] = n
    w = weights(n_docs, df)
    sets = [np.array(sorted(k for t in of_item[item] if w[k := number[t]] > 0), np.int64) for item in items]
    asks = [k for k, s in enumerate(sets) if len(s)]
    shared = spark.sparkContext.broadcast((w, [sets[k] for k in asks]))
    scored = found.mapInArrow(_scoring(shared, n_docs, n_words, limit), "number int, id bigint, score bigint")
    top = top_n_per_group(scored, ["number"], [F.col("score").desc(), F.col("id").asc_nulls_first()], limit, ["id"])
    names = StructType([StructField("number", IntegerType()), asked.schema["item"]])
    named = spark.createDataFrame([(k, items[i]) for k, i in enumerate(asks)], names)  # one row per item of the block
    return top.join(F.broadcast(named), "number").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def search(
    documents: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", query_col: str = "text", limit: int = 50, block_bytes: int = 16 << 20,
) -> DataFrame:
    """``(item, rank, id, score)``: per item the ``limit`` documents of the highest scores above 0."""
    require(documents, id_col, text_col)
    require(queries, item_col, query_col)
    spark = documents.sparkSession
    ship_code(spark)
    asked = written(query_terms(queries, item_col, query_col), "search-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    out = None
    for k in range(n):
        part = _block(documents, asked.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k), id_col, text_col, limit)
        part = written(part, "search-ranked") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out

"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, bounds included, and of itself.
Their embeddings are averaged to the word, the words' to the document, and a
linear softmax over that average gives the class. Embeddings and softmax are
trained jointly in numpy, with labels at documents only. A misspelling that was
never seen shares most n-grams with the word it stands for.

The model is fitted on a bounded sample of labelled rows (``sample_per_class``,
a documented bound: the first rows of each class in hash order), and its size is
fixed by the number of buckets. Steps that are scaled by their own gradients are as long for an n-gram
of one document as for one of all, so rare ones would learn documents by heart: a step is
weighted by n / (n + ``doubt``) for the n documents that have the n-gram. None is left out.
The sample's words are counted in the tasks; the driver receives a bag per document, however long
its text is. Scoring covers all rows: the model goes to the
tasks, where a word's share of the logit is a number that is computed once and
kept in a bounded table; very long texts are split into words one at a time. Rows are independent, so neither hot groups nor
repeated rows matter, and a lost task is repeated.

Defined cases: texts without words (null, empty, punctuation) get the score of
an average of zero, which is that of the bias alone; labels that are null are not used; of
several labels of a document the largest counts; without labels of both
classes every score is the share of toxic labels, or 0 without labels; an empty table has no scores. Input
columns are carried in one nested column, so names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import filterfalse
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, restored, ship_code


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    sample_per_class: int = 1500
    doubt: float = 5.0
    epochs: int = 40
    rate: float = 0.02
    decay: float = 1e-5
    scale: float = 1000.0
    pad: int = 20
    shrink: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's share of the logit, and the bias."""

    share: np.ndarray
    bias: float
    params: Params


def words_of(text: str | None) -> list[str]:
    """Lower-cased chunks between blanks without the punctuation around them."""
    return [w for w in (c.strip(punctuation) for c in (text or "").lower().split()) if w]


def bag_of(text: str | None) -> tuple[str, bytes]:
    """The distinct words of a text, with blanks between, and how often each occurs (32-bit numbers)."""
    bag = Counter(words_of(text))
    return " ".join(bag), np.fromiter(bag.values(), np.int32, len(bag)).tobytes()


def subwords(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams, bounds included, and of the word itself: (bucket, number of the word)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    one, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - p.buckets.bit_length() + 1)
    rolling, found, owner = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, p.longest + 1):
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n >= p.shortest:
            inside = word[: len(rolling)] == word[n - 1 :]
            found.append(((rolling[inside] + np.uint64(n)) * one >> shift).astype(np.int32))
            owner.append(word[: len(rolling)][inside])
    place = np.arange(len(codes)) - starts[word]
    powers = np.multiply.accumulate(np.concatenate([[1], np.full(max(sizes.max() - 1, 0), 0x100000001B3)]).astype(np.uint64))
    found.append((np.add.reduceat(codes * powers[place], starts) * one >> shift).astype(np.int32))
    owner.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(found), np.concatenate(owner)


PART = 1 << 18


class _Sums:
    """For each of ``n`` targets, the sum of the rows that it takes, weighted if asked for."""

    def __init__(self, target: np.ndarray, source: np.ndarray, n: int, weight: np.ndarray | None = None):
        order = np.argsort(target, kind="stable")
        self.n, self.source = n, source[order].astype(np.int32)
        self.weight = None if weight is None else weight[order][:, None]
        self.present, starts = np.unique(target[order], return_index=True)
        # Summed in parts of about PART rows, so that little is copied at once.
        self.starts = np.append(starts, len(order))
        self.parts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(order), PART), "left"), len(starts)))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]), np.float32)
        for a, b in zip(self.parts, self.parts[1:]):
            own = slice(self.starts[a], self.starts[b])
            taken = rows[self.source[own]]
            if self.weight is not None:
                taken *= self.weight[own]
            out[self.present[a:b]] = np.add.reduceat(taken, self.starts[a:b] - self.starts[a], axis=0)
        return out


def fit(bags: Iterable[tuple[str, bytes]], toxic: list[int], p: Params = Params(), prior: float | None = None) -> Model:
    """A model of ``bag_of`` each text. ``prior`` is the share of toxic rows; its log-odds are the bias, so a text that says nothing is as likely toxic as any."""
    y = np.array(toxic)
    if len(y) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(p.buckets, np.float32), -30.0 if rate == 0 else 30.0, p)
    number: dict[str, int] = {}
    numbers, shares = [], []
    for words, counts in bags:
        own = words.split()
        numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
        counts = np.frombuffer(counts, np.int32)
        shares.append((counts / (counts.sum() + p.pad)).astype(np.float32))
    n_docs = len(numbers)
    doc = np.repeat(np.arange(n_docs), [len(x) for x in numbers])
    word, share = np.concatenate(numbers), np.concatenate(shares)
    if not number:
        return Model(np.zeros(p.buckets, np.float32), log_odds(prior if prior is not None else float(y.mean())), p)
    gram, owner = subwords(list(number), p)
    size = np.bincount(owner, minlength=len(number)).astype(np.float32)
    in_docs = np.zeros(p.buckets, np.int64)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(size).astype(np.int64)
    for x in numbers:
        if len(x):
            in_docs[np.unique(np.concatenate([gram[order[ends[k] - int(size[k]) : ends[k]]] for k in x]))] += 1
    del order, ends, numbers, shares
    known = in_docs > 0
    gram, n_rows = (np.cumsum(known) - 1).astype(np.int32)[gram], int(known.sum())
    trust = (in_docs[known] / (in_docs[known] + p.doubt)).astype(np.float32)[:, None]

    rng = np.random.default_rng(p.seed)
    e = rng.normal(0, 0.1 / p.scale, (n_rows, p.dim)).astype(np.float32)
    w = rng.normal(0, 1.0, (p.dim, 2)).astype(np.float32)
    b = np.array([0, log_odds(prior if prior is not None else float(y.mean()))], np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    weight = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)], np.float32)[y] / len(y)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w)]

    of_words, of_docs = _Sums(owner, gram, len(number)), _Sums(doc, word, n_docs, share)
    to_words, to_rows = _Sums(word, doc, len(number), share), _Sums(gram, owner, n_rows)
    for epoch in range(1, p.epochs + 1):
        words = of_words(e) / size[:, None]
        docs = p.scale * of_docs(words)
        logits = docs @ w + b
        probs = np.exp(logits - logits.max(axis=1, keepdims=True))
        probs /= probs.sum(axis=1, keepdims=True)
        d_logits = (probs - target) * weight[:, None]
        d_e = to_rows(to_words(d_logits @ (p.scale * w.T)) / size[:, None]) + p.decay * e
        rate = p.rate * (1 - (epoch - 1) / p.epochs)
        for x, g, weigh, (m, v) in zip((e, w), (d_e, docs.T @ d_logits + p.decay * w), (trust, 1), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * weigh * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        # Embeddings that the gradient doesn't keep pulling the same way shrink to zero.
        norm = np.sqrt((e * e).sum(axis=1, keepdims=True)) + 1e-12
        e *= np.maximum(0, 1 - p.shrink * rate / norm)
    shares = np.zeros(p.buckets, np.float32)
    shares[known] = p.scale * e @ (w[:, 1] - w[:, 0])
    return Model(shares, float(b[1] - b[0]), p)


class Scorer:
    """Scores texts in pieces; a chunk's share of the logit is kept in a bounded table."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most = model, most
        self.known: dict[str, complex] = {}  # share + number of words * 1j

    def _learn(self, chunks: list[str]) -> None:
        words = [c.strip(punctuation) for c in chunks]
        full = [w for w in words if w]
        if full:
            gram, owner = subwords(full, self.model.params)
            shares = np.bincount(owner, self.model.share[gram], len(full)) / np.bincount(owner, minlength=len(full))
            shares = iter((shares + 1j).tolist())
        self.known.update((c, next(shares) if w else 0j) for c, w in zip(chunks, words))

    def score(self, texts: list[str | None]) -> list[float]:
        split = [(t or "").lower().split() for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new: set[str] = set()
        for chunks in split:
            new.update(filterfalse(self.known.__contains__, chunks))
        if new:
            self._learn(list(new))
        sums = [sum(map(self.known.__getitem__, chunks), 0j) for chunks in split]
        return [logistic(self.model.bias + x.real / (x.imag + self.model.params.pad)) for x in sums]


def log_odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in pieces(batches, "text"):
            scores = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """One fold of the identifiers, never learned from. A null identifier is in no fold."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(text, toxic)`` of at most ``sample_per_class`` documents of each class outside the held-out fold."""
    known = labels.filter(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1))
    known = known.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(p.seed), "id")
    some = [known.filter(F.col("toxic") == c).orderBy(order, "id").limit(p.sample_per_class) for c in (0, 1)]
    few = F.broadcast(some[0].unionByName(some[1]))  # 2 * sample_per_class rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Of documents that share an identifier, one text.
    return texts.join(few, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")


def _bagging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words, counts = zip(*map(bag_of, batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(words, pa.string()), pa.array(counts, pa.binary())], ["id", "toxic", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    ship_code(docs.sparkSession)
    few = sample(docs, labels, p, id_col, text_col, label_col)
    fields = [few.schema["id"], few.schema["toxic"], StructField("words", StringType()), StructField("counts", BinaryType())]
    rows = few.select("id", "toxic", "text").mapInArrow(_bagging, StructType(fields)).collect()  # 2 * sample_per_class rows at most
    rows.sort(key=lambda r: r["id"])
    prior = labels.filter(~held_out(id_col)).agg(F.avg(F.when(F.col(f"`{label_col}`").isin(0, 1), F.col(f"`{label_col}`"))).alias("share")).first()["share"]
    return fit([(r["words"], r["counts"]) for r in rows], [r["toxic"] for r in rows], p, prior)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``record`` (the other columns of the input), ``text`` and ``score``."""
    require(docs, text_col)
    spark = docs.sparkSession
    ship_code(spark)
    rows = carried(docs, text_col)
    return rows.mapInArrow(_scoring(spark.sparkContext.broadcast(model)), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params(), text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The documents with a score under the cut, with all their columns."""
    out = scored(docs, train(docs, labels, p, text_col=text_col), text_col)
    return out.filter(F.col("score") < cut).select(*restored(docs, text_col))

"""Many stored models applied together: their numbers are tables, and one join and one aggregate score all of them.

Covers every model whose score is a sum over features: closed-form and
MLlib naive Bayes, logistic, hinge and ordinal models, each on its own feature
set. Tree models are loaded one by one (``models.load_models``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from gradeloom.functions.lets import double_literals
from gradeloom.functions.text import word_tokens
from gradeloom.operators import tfidf
from gradeloom.operators.bayes import softmax
from gradeloom.operators.models import Fitted
from gradeloom.operators.scale import bounded, require, skew_join
from gradeloom.plans.grading import BayesGrader
from gradeloom.session import ship_code, written

HEAD = "model string, kind string, link string, feature_key string, n_classes int, classes array<int>, bias array<double>, place int, width int"
# Weights up to this many numbers (64 MB) go to all tasks, which score each text in its row; counted when they are stored, more are joined in a shuffle.
BROADCAST_NUMBERS = 8_000_000


@dataclass(frozen=True)
class FeatureSet:
    """A TF-IDF configuration with its fitted vocabulary."""

    params: tfidf.TfidfParams
    vocab: DataFrame

    @property
    def key(self) -> str:
        return f"{self.params.key}_tfidf"


def _numbers(fitted: Fitted) -> tuple[str, np.ndarray, np.ndarray, list[int]]:
    """Link, weights (feature by column), intercepts or cuts, and the classes of the columns."""
    model = fitted.models[0]
    if fitted.kind == "multinomialnb":
        theta = model.theta.toArray()
        return "softmax", theta.T, model.pi.toArray(), list(range(len(theta)))
    if fitted.kind in ("logistic", "svm", "mord-lr"):
        return model.loss, model.weights, model.free, list(model.classes)
    raise ValueError(f"{fitted.kind} does not score by a sum over features")


def _bayes_weights(grader: BayesGrader) -> tuple[DataFrame, list[float]]:
    """``(idx, w)`` for the whole vocabulary, and the classes' log priors."""
    priors = {r["ord"]: r for r in grader.priors.collect()}  # a row per class
    rest = [float(priors[k]["log_rest"]) if k in priors else 0.0 for k in range(grader.n_classes)]
    bias = [float(priors[k]["log_prior"]) if k in priors else float("-inf") for k in range(grader.n_classes)]
    known = grader.vocab.select("idx").join(grader.weights, "idx", "left")
    w = F.transform(double_literals(rest), lambda r, k: r + F.coalesce(F.get("w", k), F.lit(0.0)))
    return known.select("idx", w.alias("w")), bias


def save(spark: SparkSession, path: str, feature_sets: list[FeatureSet], models: dict[str, tuple[str, Fitted | BayesGrader]]) -> None:
    """Store ``models`` (name to feature key and model): heads, vocabularies, and the weights of all in one table.

    A feature's weights of all models on its set lie in one array, each model at its ``place``.
    """
    heads, parts = [], []
    for fs in feature_sets:
        place = 0
        for name, (key, model) in models.items():
            if key != fs.key:
                continue
            if isinstance(model, BayesGrader):
                cells, bias = _bayes_weights(model)
                kind, link, width, n, classes = "bayes", "softmax", model.n_classes, model.n_classes, list(range(model.n_classes))
            else:
                link, weights, free, classes = _numbers(model)
                kind, n, width, bias = model.kind, model.n_classes, weights.shape[1], [float(b) for b in free]
                cells = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(weights)], "idx int, w array<double>")
            heads.append((name, kind, link, key, n, classes, bias, place, width))
            parts.append(cells.select(F.lit(key).alias("feature_key"), "idx", F.lit(place).alias("place"), "w"))
            place += width
    keys = [fs.key for fs in feature_sets]
    widths = {k: sum(h[8] for h in heads if h[3] == k) for k in keys}
    cells = written(reduce(DataFrame.unionByName, parts), "weights")
    # Models without a weight for a feature leave zeros at their place.
    slot = lambda h: F.coalesce(F.max(F.when(F.col("place") == h[7], F.col("w"))), F.lit([0.0] * h[8]))
    for k in keys:
        own = [h for h in heads if h[3] == k]
        if own:
            packed = cells.filter(F.col("feature_key") == k).groupBy("idx").agg(F.concat(*[slot(h) for h in own]).alias("w"))
            packed.write.parquet(f"{path}/weights/feature_key={k}")
    spark.createDataFrame(heads, HEAD).coalesce(1).write.parquet(f"{path}/models")
    sets = [(fs.key, json.dumps(asdict(fs.params)), cells.filter(F.col("feature_key") == fs.key).select("idx").distinct().count() * widths[fs.key]) for fs in feature_sets]
    spark.createDataFrame(sets, "feature_key string, params string, n_numbers bigint").coalesce(1).write.parquet(f"{path}/feature_sets")
    for fs in feature_sets:
        fs.vocab.select("idx", "term", "idf").write.parquet(f"{path}/vocab/feature_key={fs.key}")


@dataclass(frozen=True)
class Stored:
    """Loaded models: one head each, and the weights of all of them as a table."""

    heads: list[Row]
    vocabs: dict[str, tuple[tfidf.TfidfParams, tfidf.RowVocab]]
    weights: DataFrame
    n_numbers: int

    @property
    def names(self) -> DataFrame:
        """``(model, kind, feature_key)``"""
        return self.weights.sparkSession.createDataFrame([(h.model, h.kind, h.feature_key) for h in self.heads], "model string, kind string, feature_key string")

    def grade(self, corpus: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
        """``(model, dataset, sample_id, p)`` of ``corpus(sample_id, dataset, text)`` for every model, or every matched job ``(model, dataset)``.

        A sample is one id in one dataset; null and empty texts get what a text without known terms gets.
        """
        require(corpus, "sample_id", "dataset", "text")
        keys = sorted({h.feature_key for h in self.heads})
        if self.n_numbers <= BROADCAST_NUMBERS:
            scored = self._in_rows(corpus, keys)
        else:
            unit = reduce(lambda out, k: out.when(F.col("feature_key") == keys[k], k), range(1, len(keys)), F.when(F.col("feature_key") == keys[0], 0))
            weights = self.weights.select(unit.alias("unit"), "idx", "w").filter("unit is not null")
            known = skew_join(self._entries(corpus, keys), weights, ["unit", "idx"], ["sample_id", "dataset"])
            sums = [
                F.coalesce(F.sum(F.when(F.col("unit") == keys.index(h.feature_key), F.col("value") * F.get("w", F.lit(h.place + k)))), F.lit(0.0)).alias(f"s{m}_{k}")
                for m, h in enumerate(self.heads) for k in range(h.width)
            ]
            scored = known.groupBy("sample_id", "dataset").agg(*sums)
        rows = [F.struct(F.lit(h.model).alias("model"), _probabilities(h, [F.col(f"s{m}_{k}") for k in range(h.width)]).alias("p")) for m, h in enumerate(self.heads)]
        out = scored.select("sample_id", "dataset", F.inline(F.array(*rows))).select("model", "dataset", "sample_id", "p")
        if jobs is None:
            return out
        wanted = jobs.select(F.col("model").alias("_model"), F.col("dataset").alias("_dataset")).distinct()
        wanted = bounded(wanted, wanted.count())
        return out.join(wanted, (F.col("model") == F.col("_model")) & F.col("dataset").eqNullSafe(F.col("_dataset")), "left_semi")

    def _entries(self, corpus: DataFrame, keys: list[str]) -> DataFrame:
        """``(sample_id, dataset, unit, idx, value)``; a sample without known terms has one row of nulls."""
        found = tfidf.entries_of([self.vocabs[k][1] for k in keys], corpus.sparkSession)(word_tokens(F.col("text")))
        return corpus.select("sample_id", "dataset", found.alias("entries")).select("sample_id", "dataset", F.inline_outer("entries"))

    def _in_rows(self, corpus: DataFrame, keys: list[str]) -> DataFrame:
        """``(sample_id, dataset, s0_0, ...)``: a text's sums are taken in its row, those of a sample's texts added up."""
        spark = corpus.sparkSession
        ship_code(spark)
        vocabs = [self.vocabs[k][1] for k in keys]
        widths = [max((h.place + h.width for h in self.heads if h.feature_key == k), default=0) for k in keys]
        numbers = [np.zeros((max(len(v.terms), 1), n)) for v, n in zip(vocabs, widths)]
        for r in self.weights.filter(F.col("feature_key").isin(*keys)).collect():  # n_numbers, counted when stored
            if r["idx"] < len(numbers[keys.index(r["feature_key"])]):
                numbers[keys.index(r["feature_key"])][r["idx"], : len(r["w"])] = r["w"]
        shared, ready = spark.sparkContext.broadcast((vocabs, numbers)), []

        def sums(texts: pa.Array) -> pa.Array:
            vocabs, numbers = shared.value
            if not ready:
                ready.append(tfidf.TermIndex(vocabs))
            parts = []
            for (rows, idx, value), weights in zip(ready[0].entries(texts), numbers):
                value = np.nan_to_num(value, nan=0.0)
                parts += [np.bincount(rows, value * w[idx], len(texts)) for w in np.ascontiguousarray(weights.T)]
            cells = np.array(parts).reshape(len(parts), len(texts)).T
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(parts)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(cells).ravel(), pa.float64()))

        scored = corpus.select("sample_id", "dataset", F.arrow_udf(sums, "array<double>")(word_tokens(F.col("text"))).alias("s"))
        first = dict(zip(keys, np.cumsum([0, *widths])))
        columns = [F.sum(F.get("s", F.lit(int(first[h.feature_key]) + h.place + k))).alias(f"s{m}_{k}") for m, h in enumerate(self.heads) for k in range(h.width)]
        return scored.groupBy("sample_id", "dataset").agg(*columns)


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _probabilities(head: Row, scores: list[Column]) -> Column:
    """The class probabilities by position; a class that training had not seen has 0."""
    bias = [F.lit(float(b)) for b in head.bias]
    if head.link == "steps":
        below = [_sigmoid(cut - scores[0]) for cut in bias] + [F.lit(1.0)]
        p = [below[0], *[b - a for a, b in zip(below, below[1:])]]
    elif head.link == "softmax":
        soft = softmax(F.array(*[s + b for s, b in zip(scores, bias)]))
        p = [F.get(soft, F.lit(k)) for k in range(len(scores))]
    else:
        p = [_sigmoid(s + b) for s, b in zip(scores, bias)]
        total = reduce(lambda a, b: a + b, p)
        p = [v / total for v in p]
    at = dict(zip(head.classes, p))
    return F.array(*[at.get(k, F.lit(0.0)) for k in range(head.n_classes)])


def load(spark: SparkSession, path: str) -> Stored:
    """Heads and vocabularies are fetched (a row per model, at most ``max_features`` terms per set); weights stay a table."""
    heads = spark.read.schema(HEAD).parquet(f"{path}/models").orderBy("feature_key", "place").collect()
    vocabs, total = {}, 0
    for r in spark.read.parquet(f"{path}/feature_sets").collect():
        settings = json.loads(r["params"])
        params = tfidf.TfidfParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
        vocab = spark.read.schema("idx int, term string, idf double").parquet(f"{path}/vocab/feature_key={r['feature_key']}")
        vocabs[r["feature_key"]] = (params, tfidf.in_rows(vocab, params))
        total += r["n_numbers"]
    weights = spark.read.schema("idx int, w array<double>, feature_key string").parquet(f"{path}/weights")
    return Stored(heads, vocabs, weights, total)

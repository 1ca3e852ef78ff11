"""Models as tables against each model on its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import models as ML, tfidf as TF
from gradeloom.plans import grading as G, stored as ST
from gradeloom.session import fresh_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus_of(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"d{i % 3}", " ".join(rng.choice(WORDS[k : k + 6], 30)), k) for i in range(150) for k in [int(i % 4)]]
    return spark.createDataFrame(rows, "sample_id bigint, dataset string, text string, true_ord int")


@pytest.fixture(scope="module")
def trained(spark):
    corpus = corpus_of(spark)
    params = [TF.TfidfParams(60, (1, 2)), TF.TfidfParams(8, (1, 1), max_df=1.0)]
    graders = [G.train_bayes(corpus, p) for p in params]
    sets = [ST.FeatureSet(g.params, g.vocab) for g in graders]
    rows = {fs.key: G.training_vectors(corpus.withColumnRenamed("true_ord", "ord"), fs.vocab, fs.params) for fs in sets}
    kinds = {"logistic": {"max_iter": 15}, "svm": {"max_iter": 15}, "mord-lr": {"max_iter": 15}, "multinomialnb": {}}
    fits = {n: (ML.m_key(n), m) for n, m in ML.train_all(rows, kinds, 6, "t").items()}
    path = fresh_path(spark, "stored")
    ST.save(spark, path, sets, fits | {f"own_{fs.key}": (fs.key, g) for fs, g in zip(sets, graders)})
    return path, sets, dict(zip([fs.key for fs in sets], graders)), fits


@pytest.mark.parametrize("numbers", [ST.BROADCAST_NUMBERS, 0])
def test_scores_equal_each_model_alone(spark, trained, monkeypatch, numbers):
    monkeypatch.setattr(ST, "BROADCAST_NUMBERS", numbers)
    path, sets, graders, fits = trained
    odd = spark.createDataFrame([(900, None, "alpha beta"), (901, "d0", ""), (902, "d0", None), (903, "d1", "nothing known " * 4000)], "sample_id bigint, dataset string, text string")
    asked = corpus_of(spark).drop("true_ord").unionByName(odd)
    got = {(r.model, r.sample_id): r.p for r in ST.load(spark, path).grade(asked).collect()}
    assert len(got) == 154 * 10
    filled = asked.withColumn("text", F.coalesce("text", F.lit("")))
    for fs in sets:
        vectors = G.training_vectors(filled, fs.vocab, fs.params)
        alone = {n: m.predict(vectors) for n, (k, m) in fits.items() if k == fs.key} | {f"own_{fs.key}": G.grade_bayes(graders[fs.key], filled)}
        for name, df in alone.items():
            for r in df.select("sample_id", "p").collect():
                assert np.allclose(got[name, r.sample_id], list(r.p), atol=1e-9), (name, r.sample_id)


def test_jobs_choose_models_and_datasets(spark, trained):
    path, sets, _, fits = trained
    names = sorted(fits)[:2]
    jobs = spark.createDataFrame([(names[0], "d0"), (names[0], "d0"), (names[1], None)], "model string, dataset string")
    asked = corpus_of(spark).drop("true_ord").unionByName(spark.createDataFrame([(900, None, "alpha")], "sample_id bigint, dataset string, text string"))
    got = ST.load(spark, path).grade(asked, jobs).groupBy("model", "dataset").count().collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(names[0], "d0", 50), (names[1], None, 1)]))


def test_trees_are_refused(spark):
    with pytest.raises(ValueError, match="sum over features"):
        ST._numbers(ML.Fitted("xgboost", (None,), 6))

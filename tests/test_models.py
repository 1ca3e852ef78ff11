import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gradeloom.operators import decide, models as ML, tfidf
from gradeloom.operators.screening import screen
from gradeloom.plans import grading

SMALL = {
    "multinomialnb": {}, "logistic": {"max_iter": 20}, "randomforest": {"n_trees": 5, "depth": 4}, "svm": {"max_iter": 10},
    "xgboost": {"n_trees": 3, "depth": 3}, "xgboost_ordinal": {"n_trees": 5, "depth": 3}, "mord-lr": {"max_iter": 20, "alpha": 0.1},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, i % 3, Vectors.dense([abs(rng.gauss(i % 3, 0.3)), rng.random(), abs(rng.gauss(2 - i % 3, 0.3))])) for i in range(150)]
    return spark.createDataFrame(data, ["sample_id", "ord", "features"]).repartition(2).persist()


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_fit(rows, kind):
    out = decide.argmax(ML.FITS[kind](rows, 4, **SMALL[kind]).predict(rows), levels=["0", "1", "2", "3"])
    got = out.select("ord", "pred_ord", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("p").alias("n"), F.array_min("p").alias("low")).collect()
    assert all(r["total"] == pytest.approx(1.0) and r["n"] == 4 and r["low"] >= 0 for r in got)
    assert sum(r["ord"] == r["pred_ord"] for r in got) / len(got) > 0.6


def test_same_seed_same_forest(rows):
    a, b = (sorted((r["sample_id"], tuple(r["p"])) for r in ML.fit_forest(rows, 3, n_trees=5, depth=3).predict(rows).collect()) for _ in range(2))
    assert a == b


def test_vectors_without_exchange(spark):
    corpus = spark.createDataFrame([(1, "one two two", 3), (2, None, 4), (3, "none known", 5)], "sample_id int, text string, ord int")
    params = tfidf.TfidfParams(max_features=7, ngram_range=(1, 2), min_df=1, max_df=1.0)
    vocab = tfidf.fit_vocab(corpus.filter("sample_id = 1"), params)
    got = {r["sample_id"]: r for r in tfidf.vectors(corpus, vocab, params).collect()}
    rows = {(r["sample_id"], r["idx"]): r["value"] for r in tfidf.transform(corpus, vocab, params).collect()}
    assert got[2]["features"] == got[3]["features"] == Vectors.sparse(7, [], []) and got[3]["ord"] == 5
    assert {(1, int(i)): v for i, v in zip(got[1]["features"].indices, got[1]["features"].values)} == rows and len(rows) == 4
    plan = tfidf.transform(corpus, vocab, params)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rounding_is_half_even_and_clipped(spark):
    p = [[0.5, 0.5, 0, 0, 0, 0], [0, 0.5, 0.5, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0], [0, 0, 0, 0, 0, 1.0]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "sample_id int, p array<double>")
    assert [r["rounded_index"] for r in decide.rounded(df).orderBy("sample_id").collect()] == [0, 2, 2, 5]
    assert [r["pred_label"] for r in decide.argmax(df).orderBy("sample_id").collect()] == ["A1", "A2", "B1", "C2"]


def test_screening_rules(spark):
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate([0.9, 0.2, 0.7, 0.5, 0.6])], "feature_set string, score double")
    got = {r["feature_set"]: r for r in screen(df, "f1_macro", threshold=0.3, percentile=40).collect()}
    assert [f for f in got if not got[f]["passed"]] and not got["f1"]["passed"] and not got["f3"]["passed"] and got["f4"]["passed"]
    assert got["f1"]["discard_reason"] == "f1_macro 0.2000 < threshold 0.3000"
    assert got["f3"]["discard_reason"] == "Bottom 40% percentile"


@pytest.mark.parametrize("kind", sorted(SMALL))
def test_loaded_equals_fitted(spark, rows, tmp_path, kind):
    fitted = ML.FITS[kind](rows, 4, **SMALL[kind])
    ML.save_models(spark, {"m_0123abcd_tfidf": fitted}, str(tmp_path), {"m_0123abcd_tfidf": 150})
    loaded = ML.load_models(spark, str(tmp_path))["m_0123abcd_tfidf"]
    assert (loaded.kind, loaded.n_classes, loaded.params, loaded.cuts) == (fitted.kind, 4, fitted.params, fitted.cuts)
    both = [{r["sample_id"]: tuple(r["p"]) for r in m.predict(rows).collect()} for m in (fitted, loaded)]
    assert both[0] == both[1]
    row = ML.load_registry(spark, str(tmp_path)).first()
    assert row["feature_key"] == "0123abcd_tfidf" and row["n_train"] == 150


def test_refit_takes_the_first_best(rows):
    history = [{"trial": 0, "params": {"alpha": 1.0}, "score": 0.5}, {"trial": 1, "params": {"alpha": 2.0}, "score": 0.7}, {"trial": 2, "params": {"alpha": 3.0}, "score": 0.7}]
    assert ML.refit_best(rows, "multinomialnb", 3, history).params == {"alpha": 2.0}


def test_stored_grader(spark, tmp_path):
    corpus = spark.createDataFrame([(i, ["good fine text", "bad poor words"][i % 2] + f" w{i % 5}x", i % 2) for i in range(40)], "sample_id bigint, text string, true_ord int")
    grader = grading.train_bayes(corpus, tfidf.TfidfParams(max_features=50))
    grading.save_bayes(grader, str(tmp_path / "g"))
    loaded = grading.load_bayes(spark, str(tmp_path / "g"))
    assert loaded.params == grader.params
    both = [{r["sample_id"]: tuple(r["p"]) for r in grading.grade_bayes(g, corpus).collect()} for g in (grader, loaded)]
    assert both[0] == both[1]

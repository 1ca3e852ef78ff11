import math

import pytest

from gradeloom.operators import agreement as A, calibration as C, metrics as M

K = ("model",)
# A published confusion matrix (B1, B2, C1, C2) and its metrics.
PUBLISHED = [[0, 93, 16, 0], [2, 468, 100, 0], [0, 234, 78, 0], [0, 10, 5, 0]]


def table(spark, matrix, first=0):
    rows = [("m", i + first, j + first, n, float(n)) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    return spark.createDataFrame(rows, "model string, true_ord int, pred_ord int, n bigint, w double")


def test_published_report(spark):
    cm = table(spark, PUBLISHED, 2)
    r = M.report_metrics(cm, K).first()
    assert r["n_samples"] == 1006
    assert round(r["accuracy"], 2) == 0.54
    assert round(r["adjacent_accuracy"], 2) == 0.97
    assert round(r["macro_f1"], 2) == 0.25
    assert round(r["weighted_f1"], 2) == 0.48
    per = {x["ord"]: x for x in M.class_report(cm, K).collect()}
    assert round(per[3]["recall"], 2) == 0.82 and round(per[4]["recall"], 2) == 0.25
    assert per[5]["precision"] == 0.0 and per[5]["f1"] == 0.0


@pytest.mark.parametrize("d,linear,squared", [(0, 1.0, 1.0), (1, 0.8, 0.96), (2, 0.6, 0.84), (3, 0.4, 0.64), (4, 0.2, 0.36), (5, 0.0, 0.0)])
def test_scores_by_distance(spark, d, linear, squared):
    s = M.ordinal_scores(spark.createDataFrame([("m", 0, d, 1, 1.0)], "model string, true_ord int, pred_ord int, n bigint, w double"), K).first()
    assert s["ordinal_distance_linear"] == pytest.approx(linear)
    assert s["ordinal_distance_quadratic"] == pytest.approx(squared)
    assert s["ordinal_mse"] == pytest.approx(squared)


def test_one_known_class_has_no_f1(spark):
    r = M.report_metrics(table(spark, [[5, 2]]), K).first()
    assert (r["macro_f1"], r["micro_f1"]) == (0.0, 0.0) and r["accuracy"] == pytest.approx(5 / 7)


def test_agreement_extremes(spark):
    perfect = table(spark, [[3, 0, 0], [0, 4, 0], [0, 0, 5]])
    assert A.quadratic_kappa(perfect, K).first()["qwk"] == pytest.approx(1.0)
    assert A.gwet_ac2(perfect, K).first()["ac2"] == pytest.approx(1.0)
    chance = table(spark, [[10, 10], [10, 10]])
    assert A.quadratic_kappa(chance, K).first()["qwk"] == pytest.approx(0.0)


def test_spearman_with_ties(spark):
    import pandas as pd

    xs = [0, 0, 1, 1, 2, 3, 3, 3, 4, 5]
    ys = [0.1, 0.4, 0.4, 1.2, 0.4, 2.2, 2.2, 3.9, 3.0, 4.1]
    df = spark.createDataFrame([("m", "d", x, y) for x, y in zip(xs, ys)], "model string, dataset string, true_ord int, expected_value double")
    want = pd.Series(xs).rank().corr(pd.Series(ys).rank())
    assert A.spearman(df).first()["spearman"] == pytest.approx(want)


def test_bins_keep_the_edges(spark):
    rows = [("m", "d", 1, 1, c) for c in (0.0, 0.1, 0.3, 0.30000000000000004, 0.95, 1.0)]
    df = spark.createDataFrame(rows, "model string, dataset string, true_ord int, pred_ord int, confidence double")
    got = {r["bin"]: r["n"] for r in C.bins(df).collect()}
    assert sorted(got) == list(range(1, 11))
    assert got[1] == 1 and got[3] == 2 and got[10] == 2 and sum(got.values()) == 5
    assert 0 <= C.expected_error(C.bins(df)).first()["ece"] <= 1


def test_weighted_equals_repeated_rows(spark):
    rows = [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0), (2, 1, 1.0)]
    weighted = spark.createDataFrame([("m", *r) for r in rows], "model string, true_ord int, pred_ord int, weight double")
    repeated = spark.createDataFrame([("m", t, p) for t, p, w in rows for _ in range(int(w))], "model string, true_ord int, pred_ord int")
    a = M.metric_set(M.confusion(weighted, K, weight="weight"), K).first().asDict()
    b = M.metric_set(M.confusion(repeated, K), K).first().asDict()
    assert all(math.isclose(a[k], b[k]) for k in a if k != "model")


def test_unknown_truth_counts_as_a_miss(spark):
    rows = [("m", 0, 0, 3, 3.0), ("m", 1, 1, 2, 2.0), ("m", None, 1, 5, 5.0)]
    cm = spark.createDataFrame(rows, "model string, true_ord int, pred_ord int, n bigint, w double")
    r = M.report_metrics(cm, K).first()
    assert (r["n_samples"], r["accuracy"], r["adjacent_accuracy"]) == (10, 0.5, 0.5)
    assert r["macro_f1"] == pytest.approx((1.0 + 4 / 9) / 2)

import math

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators import tfidf as TF

DOCS = [
    (1, "en", "The cat sat. The cat ran!"),
    (2, "en", "A dog sat on the mat"),
    (3, "fr", "Le chat était là, le chien là-bas"),
    (4, "fr", ""),
    (5, "en", None),
    (6, "fr", "x y z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "sample_id bigint, grp string, text string")


def test_tokens(docs):
    rows = {r["sample_id"]: r for r in docs.select("sample_id", T.word_tokens(F.col("text")).alias("w"), T.space_tokens(F.col("text")).alias("s")).collect()}
    assert rows[1]["w"] == ["the", "cat", "sat", "the", "cat", "ran"]
    assert rows[3]["w"] == ["le", "chat", "était", "là", "le", "chien", "là", "bas"]
    assert rows[6]["w"] == [] and rows[6]["s"] == ["x", "y", "z"]
    assert rows[5]["s"] == [] and rows[4]["s"] == []


def test_ngrams_and_counts(docs):
    got = docs.filter("sample_id = 1").select(T.ngrams(T.word_tokens(F.col("text")), 1, 2).alias("g")).first()["g"]
    assert got[6:] == ["the cat", "cat sat", "sat the", "the cat", "cat ran"]
    tf = {r["term"]: r["tf"] for r in TF.document_terms(docs, (1, 2)).filter("sample_id = 1").collect()}
    assert tf["the cat"] == 2 and tf["ran"] == 1 and len(tf) == 8


def test_vocabulary_and_weights(docs):
    params = TF.TfidfParams(max_features=3, ngram_range=(1, 1), min_df=1, max_df=1.0)
    vocab = {r["term"]: r for r in TF.fit_vocab(docs, params).collect()}
    assert set(vocab) == {"cat", "le", "the"}
    assert vocab["the"]["df"] == 2 and vocab["the"]["cf"] == 3 and vocab["the"]["n_docs"] == 6
    assert vocab["the"]["idf"] == pytest.approx(math.log(7 / 3) + 1)
    assert [vocab[t]["idx"] for t in sorted(vocab)] == [0, 1, 2]


def test_unit_norm_whatever_the_partitions(docs):
    params = TF.TfidfParams(20, (1, 2), 1, 1.0)
    one, many = ({(r["sample_id"], r["term"]): round(r["value"], 12) for r in TF.transform(d, TF.fit_vocab(d, params), params).collect()} for d in (docs.coalesce(1), docs.repartition(16)))
    assert one == many
    for sid in {k[0] for k in one}:
        assert sum(v * v for k, v in one.items() if k[0] == sid) == pytest.approx(1.0)


def test_grouped_forms_agree(docs, monkeypatch):
    """Vocabularies looked up in the row and in a shuffle give the same blocks."""
    params = TF.TfidfParams(5, (1, 2), 1, 1.0)
    vocab = TF.fit_grouped(docs, "grp", params)
    take = lambda: sorted((r["sample_id"], r["grp"], r["idx"], r["feature"], round(r["value"], 12)) for r in TF.transform_grouped(docs, vocab, params).collect())
    a = take()
    monkeypatch.setattr(TF, "ROW_VOCABS", 0)
    assert a == take() and any(f.startswith("fr_") for _, _, _, f, _ in a)


def test_sweep_equals_single_runs(docs):
    grid = [TF.TfidfParams(4, (1, 1), 1, 1.0), TF.TfidfParams(6, (2, 2), 1, 1.0, False)]
    rows = TF.transform_sweep(docs, TF.fit_sweep(docs, grid), grid).collect()
    for p in grid:
        single = {(r["sample_id"], r["term"]): round(r["value"], 12) for r in TF.transform(docs, TF.fit_vocab(docs, p), p).collect()}
        assert {(r["sample_id"], r["feature"]): round(r["value"], 12) for r in rows if r["feature_set"] == p.key} == single


def test_bad_parameters():
    for bad in (dict(max_features=0), dict(min_df=0), dict(max_df=0.0), dict(ngram_range=(2, 1))):
        with pytest.raises(ValueError):
            TF.TfidfParams(**bad)


@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (2, 2)])
def test_term_statistics_call_no_function_for_each_term(spark, ngram_range):
    rows = [(1, "a", "red red cat and red cat"), (2, "a", "cat"), (3, "b", ""), (4, None, None), (5, None, "cat and cat"), (1, "a", "cat"), (6, "b", "x")]
    corpus = spark.createDataFrame(rows, "sample_id int, grp string, text string")
    for group in ([], ["grp"]):
        got = TF.corpus_stats(corpus, ngram_range, group)
        want = TF.term_stats(TF.document_terms(corpus, ngram_range, tuple(group)), group)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "lambda" not in TF.corpus_stats(corpus)._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_in_arrays(spark, monkeypatch):
    """No row per occurrence is made: tasks send counted terms, also in many small runs, of any length, for any group."""
    rows = [(k, ["a", "b", None][k % 3], "red cat and red cat " * (k % 4) + "the end") for k in range(30)]
    corpus = spark.createDataFrame(rows, "sample_id int, grp string, text string").repartition(2)
    assert "Generate" not in TF.corpus_stats(corpus, (1, 2))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(TF, "AT_ONCE", 7)
    for group in ([], ["grp"]):
        want = TF.term_stats(TF.document_terms(corpus, (1, 4), tuple(group)), group)
        assert sorted(map(str, TF.corpus_stats(corpus, (1, 4), group).collect())) == sorted(map(str, want.collect()))


def test_long_terms_are_found_in_rows(spark):
    docs = spark.createDataFrame([(1, "red cat and red cat and"), (2, "cat red"), (3, None)], "sample_id int, text string")
    params = TF.TfidfParams(50, (2, 4), 1, 1.0, False)
    got = {(r["sample_id"], r["term"]): r["value"] for r in TF.transform(docs, TF.fit_vocab(docs, params), params).collect()}
    counts = {(r["sample_id"], r["term"]): r["tf"] for r in TF.document_terms(docs, (2, 4)).collect()}
    assert set(got) == set(counts) and got[2, "cat red"] == 1.0
    idf = {t: math.log(4 / 2) + 1 for _, t in counts}
    norm = math.sqrt(sum((n * idf[t]) ** 2 for (i, t), n in counts.items() if i == 1))
    assert all(got[i, t] == pytest.approx(n * idf[t] / norm) for (i, t), n in counts.items() if i == 1)

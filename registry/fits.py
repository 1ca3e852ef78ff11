"""Classifiers fitted on features of the given texts and vectors."""

from __future__ import annotations

import json

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradeloom.functions.levels import LEVELS
from gradeloom.functions.text import clean_text
from gradeloom.operators import decide, joins as J, metrics as M, models as ML, split as S, tfidf as TF
from gradeloom.plans import grading as G, selection as SEL, stored as ST
from gradeloom.session import fresh_path, written
from registry.base import LEVEL_LIST, SAMPLES_SQL, query, rounded_out, samples, table, with_sql
from registry.tfidf import PAT, TF12_SQL, TF_SQL

TEXT = TF.TfidfParams()
N = len(LEVELS)

NB_SQL = (
    TF12_SQL
    + """,
top AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM samples) ORDER BY cf DESC, term LIMIT 5000),
vocab AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM samples)) / (1.0::DOUBLE + df)) + 1.0 AS idf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx FROM top),
feat AS (SELECT sample_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS v FROM (SELECT sample_id, idx, (ln(tf::DOUBLE) + 1.0) * idf AS w FROM tf JOIN vocab USING (term))),
sums AS (SELECT true_ord AS ord, idx, sum(v) AS s FROM feat JOIN samples USING (sample_id) GROUP BY ALL),
mass AS (SELECT ord, sum(s) AS m FROM sums GROUP BY ord),
prior AS (SELECT true_ord AS ord, count(*)::BIGINT AS n, ln(count(*) / (SELECT count(*) FROM samples)) AS log_prior FROM samples GROUP BY 1),
cells AS (SELECT p.ord, v.idx, ln((coalesce(s.s, 0) + 1.0) / (m.m + (SELECT count(*) FROM vocab))) AS lp FROM prior p CROSS JOIN vocab v JOIN mass m ON m.ord = p.ord LEFT JOIN sums s ON s.ord = p.ord AND s.idx = v.idx),
raw AS (SELECT x.sample_id, p.ord, p.log_prior + coalesce(sum(f.v * c.lp), 0) AS score FROM samples x CROSS JOIN prior p LEFT JOIN feat f ON f.sample_id = x.sample_id LEFT JOIN cells c ON c.ord = p.ord AND c.idx = f.idx GROUP BY x.sample_id, p.ord, p.log_prior),
top_score AS (SELECT sample_id, max(score) AS best FROM raw GROUP BY 1),
soft AS (SELECT sample_id, ord, exp(score - best) / sum(exp(score - best)) OVER (PARTITION BY sample_id) AS p FROM raw JOIN top_score USING (sample_id)),
graded AS (SELECT sample_id, arg_min(ord, [-p, ord]) AS pred_ord, max(p) AS confidence FROM soft GROUP BY sample_id),
cm AS (SELECT true_ord, pred_ord, count(*)::BIGINT AS n FROM graded JOIN samples USING (sample_id) GROUP BY ALL)"""
)


def _grader(spark, sf):
    s = samples(spark, sf)
    return s, G.train_bayes(s, TEXT)


@query("fit_nb", with_sql(NB_SQL, "SELECT ord, idx, round(lp - ln(1.0 / (m + (SELECT count(*) FROM vocab))), 6) AS weight FROM cells JOIN mass USING (ord)"))
def fit_nb(spark, sf):
    """Log probability of each feature above that of an unseen one, per class."""
    _, g = _grader(spark, sf)
    return rounded_out(g.weights.select("idx", F.posexplode("w").alias("ord", "weight")))


@query("fit_nb_priors", with_sql(NB_SQL, "SELECT ord, n, round(log_prior, 6) AS log_prior, round(ln(1.0 / (m + (SELECT count(*) FROM vocab))), 6) AS log_rest FROM prior JOIN mass USING (ord)"))
def fit_nb_priors(spark, sf):
    _, g = _grader(spark, sf)
    return rounded_out(g.priors)


@query("predict_soft", with_sql(NB_SQL, "SELECT sample_id, ord, round(p, 6) AS p FROM soft"))
def predict_soft(spark, sf):
    s, g = _grader(spark, sf)
    return rounded_out(G.grade_bayes(g, s).select("sample_id", F.posexplode("p").alias("ord", "p")))


@query("predict_from_text", with_sql(NB_SQL, f"SELECT sample_id, {LEVEL_LIST}[pred_ord + 1] AS pred_label, round(confidence, 6) AS confidence FROM graded"))
def predict_from_text(spark, sf):
    s, g = _grader(spark, sf)
    return rounded_out(decide.argmax(G.grade_bayes(g, s)).select("sample_id", "pred_label", "confidence"))


@query(
    "grade_report",
    with_sql(
        NB_SQL,
        """, sides AS (SELECT ord, sum(tp)::BIGINT AS tp, sum(np)::BIGINT AS n_pred, sum(s)::BIGINT AS support FROM (
           SELECT true_ord AS ord, CASE WHEN true_ord = pred_ord THEN n ELSE 0 END AS tp, 0 AS np, n AS s FROM cm UNION ALL SELECT pred_ord, 0, n, 0 FROM cm) GROUP BY ord)
        SELECT 'bayes' AS model, ord, tp, n_pred, support, round(coalesce(tp / nullif(n_pred, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
           round(coalesce(2.0 * tp / nullif(n_pred + support, 0), 0), 6) AS f1 FROM sides""",
    ).replace("\n, sides", ", sides"),
)
def grade_report(spark, sf):
    """The flagship: texts to vocabulary, features, classifier, grades, report."""
    s, g = _grader(spark, sf)
    graded = decide.argmax(G.grade_bayes(g, s)).join(s.select("sample_id", "true_ord"), "sample_id").withColumn("model", F.lit("bayes"))
    return rounded_out(M.class_report(M.confusion(graded, ("model",)), ("model",)))


def text_vectors(spark, sf, params=TEXT):
    """Sparse TF-IDF vectors with the level as target, stored once for the iterations."""
    s = samples(spark, sf).select("sample_id", "text", F.col("true_ord").alias("ord"))
    return G.training_vectors(s, written(TF.fit_vocab(s, params), "vocab"), params)


def dense_vectors(spark, sf):
    """Given embeddings with their ten classes."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("ord"))


def _beats_majority(judged):
    counts = judged.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_ord") == F.col("ord")).alias("hits"))
    return counts.agg((F.sum("hits") > F.max("n")).alias("beats_majority"))


def _judge(fitted, rows, n=N, known=None):
    """Per class: held-out rows, whether their probabilities sum to one, and whether the model beats the most frequent class.

    The last is asked of the held-out rows, or of ``known`` rows where the labels can't be learned from the features.
    """
    grade = lambda data: decide.argmax(fitted.predict(data), levels=[str(k) for k in range(n)])
    judged = grade(rows)
    whole = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6
    per_class = judged.groupBy("ord").agg(F.count(F.lit(1)).alias("support"), F.bool_and(whole).alias("sums_to_one"))
    beats = _beats_majority(judged if known is None else grade(known))
    named = per_class.select(F.lit(fitted.kind).alias("model"), F.col("ord").cast("int").alias("ord"), "support", "sums_to_one")
    return named.join(F.broadcast(beats))  # one row


def held_out_sql(kind: str, rows: str) -> str:
    """What ``_judge`` must give: the quotas of the stratified split, with good probabilities and a useful model."""
    return f"""WITH rows_ AS ({rows}), c AS (SELECT ord, count(*)::BIGINT AS n FROM rows_ GROUP BY 1),
        q AS (SELECT *, (sum(n) OVER ())::BIGINT AS n_all, ceil((sum(n) OVER ()) * 0.25::DOUBLE)::BIGINT AS n_test FROM c),
        b AS (SELECT *, (n * n_test) // n_all AS base, (n * n_test) % n_all AS rest FROM q),
        quotas AS (SELECT ord, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, ord) <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
        SELECT '{kind}' AS model, ord::INTEGER AS ord, quota::BIGINT AS support, true AS sums_to_one, true AS beats_majority FROM quotas WHERE quota > 0"""


VECTOR_ROWS = "SELECT vec_id AS id, label AS ord FROM embeddings"
TEXT_ROWS = with_sql(SAMPLES_SQL, "SELECT sample_id AS id, true_ord AS ord FROM samples")


def _halves(rows, share=0.25):
    split = written(S.split_stratified(rows, "sample_id", "ord", share), "split")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


@query("fit_logistic", held_out_sql("logistic", TEXT_ROWS))
def fit_logistic(spark, sf):
    train, test = _halves(text_vectors(spark, sf))
    weighted = S.sample_weights(train, "ord", N, "inverse")
    return _judge(ML.fit_logistic(weighted, N), test)


@query("fit_rf", held_out_sql("randomforest", VECTOR_ROWS))
def fit_rf(spark, sf):
    train, test = _halves(dense_vectors(spark, sf))
    weighted = S.sample_weights(train, "ord", 10, "inverse")
    return _judge(ML.fit_forest(weighted, 10), test, 10, train)


@query("fit_svm", held_out_sql("svm", VECTOR_ROWS))
def fit_svm(spark, sf):
    train, test = _halves(dense_vectors(spark, sf))
    return _judge(ML.fit_svm(S.sample_weights(train, "ord", 10, "inverse"), 10), test, 10, train)


@query("fit_gbt", held_out_sql("xgboost", VECTOR_ROWS))
def fit_gbt(spark, sf):
    train, test = _halves(dense_vectors(spark, sf))
    return _judge(ML.fit_boosted(train, 10), test, 10, train)


@query("fit_gbt_ordinal", held_out_sql("xgboost_ordinal", TEXT_ROWS))
def fit_gbt_ordinal(spark, sf):
    train, test = _halves(text_vectors(spark, sf))
    return _judge(ML.fit_boosted_ordinal(train, N), test)


@query("fit_ordinal", held_out_sql("mord-lr", TEXT_ROWS))
def fit_ordinal(spark, sf):
    train, test = _halves(text_vectors(spark, sf))
    return _judge(ML.fit_ordinal(train, N), test)


@query("fit_bayes_mllib", held_out_sql("multinomialnb", TEXT_ROWS))
def fit_bayes_mllib(spark, sf):
    train, test = _halves(text_vectors(spark, sf))
    return _judge(ML.fit_bayes(train, N), test)


KINDS = {"multinomialnb": {}, "logistic": {}, "mord-lr": {}}


UNI = TF.TfidfParams(ngram_range=(1, 1))


# What a fit with its own defaults is registered with.
TRAINED = {"multinomialnb": (1, {"alpha": 1.0}), "logistic": (1, {"c": 1.0, "l1_ratio": 0.0, "max_iter": 100}), "mord-lr": (1, {"alpha": 1.0, "max_iter": 1000})}
TRAINED_SQL = ", ".join(
    f"('documents_{kind}_{p.key}_tfidf', '{kind}', '{p.key}_tfidf', {parts}, '{json.dumps(params, sort_keys=True)}')" for p in (TEXT, UNI) for kind, (parts, params) in TRAINED.items()
)


@query("train_all", f"SELECT m.*, {N} AS n_classes, (SELECT count(*) FROM documents)::BIGINT AS n_train FROM (VALUES {TRAINED_SQL}) m(model, kind, feature_key, n_parts, params)")
def train_all(spark, sf):
    """Every kind on each of two feature sets, stored; the registry as it is read back."""
    sets = {f"{p.key}_tfidf": text_vectors(spark, sf, p) for p in (TEXT, UNI)}
    models = ML.train_all(sets, KINDS, N, "documents")
    path = fresh_path(spark, "models")
    counts = {key: rows.count() for key, rows in sets.items()}
    ML.save_models(spark, models, path, {name: counts[ML.m_key(name)] for name in models})
    return ML.load_registry(spark, path).drop("cuts")


NB_NAMES = tuple(f"documents_multinomialnb_{p.key}_tfidf" for p in (TEXT, UNI))
FITTED = tuple(f"documents_{kind}_{TEXT.key}_tfidf" for kind in ("logistic", "mord-lr"))
GRADED = "model string, dataset string, sample_id bigint, pred_label string"


_STORED: dict[tuple[str, str], str] = {}  # where this session has stored the models of a data folder


def stored_models(spark, sf) -> ST.Stored:
    """Naive Bayes on two feature sets and two fitted kinds on one, stored once a session and loaded for each query."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        s = samples(spark, sf)
        graders = [G.train_bayes(s, p) for p in (TEXT, UNI)]
        sets = [ST.FeatureSet(g.params, g.vocab) for g in graders]
        models = {name: (fs.key, g) for name, fs, g in zip(NB_NAMES, sets, graders)}
        rows = G.training_vectors(s.select("sample_id", "text", F.col("true_ord").alias("ord")), sets[0].vocab, TEXT)
        fits = ML.train_all({sets[0].key: rows}, {"logistic": {}, "mord-lr": {}}, N, "documents")
        path = fresh_path(spark, "stored-models")
        ST.save(spark, path, sets, models | {name: (sets[0].key, fit) for name, fit in fits.items()})
        _STORED[at] = path
    return ST.load(spark, _STORED[at])


def graded_rows(stored, corpus):
    """Labels from every stored model for the datasets that its features have."""
    keys = stored.names
    have = corpus.select("dataset").distinct().crossJoin(F.broadcast(keys.select("feature_key").distinct()))  # one row per feature set
    jobs = J.match_models(keys, keys, have, corpus.select("dataset", F.lit(None).cast("string").alias("label_file")).distinct())
    return decide.argmax(stored.grade(corpus, jobs)).select("model", "dataset", "sample_id", "pred_label")


def per_label(graded):
    """Rows by model, dataset and label; SQL can tell the label for the closed form only, so fitted kinds are counted without it."""
    label = F.when(F.col("model").isin(*NB_NAMES), F.col("pred_label"))
    return graded.groupBy("model", "dataset", label.alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


NB_UNI_SQL = NB_SQL.replace(TF12_SQL, TF_SQL)
ASKED_DOCS = "asked AS (SELECT sample_id, dataset FROM samples)"
ASKED_TURNS = "asked AS (SELECT conv_id * 1000 + turn AS sample_id, role AS dataset, coalesce(text, '') AS text FROM conversations)"


def per_label_sql(asked: str, first: str, second: str) -> str:
    """The two closed-form models by label (``first`` and ``second`` give ``graded``), the others by dataset."""
    by = [with_sql(f"{sql}", f"SELECT '{name}' AS model, dataset, {LEVEL_LIST}[pred_ord + 1] AS pred_label, count(*)::BIGINT AS n FROM graded JOIN asked USING (sample_id) GROUP BY ALL") for name, sql in zip(NB_NAMES, (first, second))]
    names = ", ".join(f"('{n}')" for n in FITTED)
    rest = with_sql(f"{SAMPLES_SQL}, {asked}", f"SELECT model, dataset, NULL::VARCHAR AS pred_label, count(*)::BIGINT AS n FROM asked CROSS JOIN (VALUES {names}) m(model) GROUP BY ALL")
    return " UNION ALL ".join(f"SELECT * FROM ({q})" for q in [*by, rest])


PER_LABEL_SQL = per_label_sql(ASKED_DOCS, f"{NB_SQL}, {ASKED_DOCS}", f"{NB_UNI_SQL}, {ASKED_DOCS}")


@query("predict_batch", PER_LABEL_SQL)
def predict_batch(spark, sf):
    return per_label(graded_rows(stored_models(spark, sf), samples(spark, sf).select("sample_id", "dataset", "text")))


def asked_turns(nb: str, terms: str) -> str:
    """The tables of ``nb``, asked for the conversations."""
    return (
        nb.split("raw AS (")[0]
        + f"""{ASKED_TURNS},
atoks AS (SELECT sample_id, regexp_extract_all(lower(text), '{PAT}') AS ts FROM asked),
atf AS (SELECT sample_id, term, count(*)::BIGINT AS tf FROM (SELECT sample_id, unnest({terms}) AS term FROM atoks) GROUP BY ALL),
afeat AS (SELECT sample_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS v FROM (SELECT sample_id, idx, (ln(tf::DOUBLE) + 1.0) * idf AS w FROM atf JOIN vocab USING (term))),
raw AS (SELECT x.sample_id, p.ord, p.log_prior + coalesce(sum(f.v * c.lp), 0) AS score FROM asked x CROSS JOIN prior p LEFT JOIN afeat f ON f.sample_id = x.sample_id LEFT JOIN cells c ON c.ord = p.ord AND c.idx = f.idx GROUP BY x.sample_id, p.ord, p.log_prior),
graded AS (SELECT sample_id, arg_min(ord, [-score, ord]) AS pred_ord FROM raw GROUP BY sample_id)"""
    )


WITH_PAIRS = "list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))"


@query("add_test_set", per_label_sql(ASKED_TURNS, asked_turns(NB_SQL, WITH_PAIRS), asked_turns(NB_UNI_SQL, "ts")))
def add_test_set(spark, sf):
    """A new dataset, the conversations, graded by the stored models."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("role").alias("dataset"), clean_text(F.col("text")).alias("text"))
    return per_label(graded_rows(stored_models(spark, sf), turns))


TRIALS = ML.draw_params("logistic", 50)
TRIALS_SQL = ", ".join(f"({k}, '{ML.setting_text(t)}')" for k, t in enumerate(TRIALS))


@query("tune_single", f"""SELECT '{TEXT.key}_tfidf' AS feature_set, trial, params, true AS scored, true AS stored FROM (VALUES {TRIALS_SQL}) t(trial, params) WHERE (SELECT count(*) FROM documents) > 0""")
def tune_single(spark, sf):
    """Fifty settings in one descent on the texts; the winner is fitted on all rows, stored, loaded and asked."""
    vectors = text_vectors(spark, sf)
    train, valid = _halves(vectors, 0.2)
    history = ML.tune_together(train, valid, TRIALS)
    best = ML.best_trial(history)
    path = fresh_path(spark, "tuned")
    ML.save_models(spark, {"best": ML.refit_best(vectors, "logistic", N, history)}, path)
    loaded = ML.load_models(spark, path)["best"]
    right = loaded.predict(vectors).agg(F.count_if(F.expr("array_position(p, array_max(p)) - 1 = ord")) / F.count(F.lit(1))).first()[0]
    stored = loaded.params["c"] == best["params"]["c"] and right > 0
    table_ = ML.history_table(spark, f"{TEXT.key}_tfidf", history)
    return table_.withColumn("scored", F.col("score").between(0, 1)).withColumn("stored", F.lit(bool(stored))).drop("score")


@query("two_stage_selection")
def two_stage_selection(spark, sf):
    """Screening and tuning over two vocabularies of the documents."""
    s = samples(spark, sf).select("sample_id", "text", F.col("true_ord").alias("ord"))
    sets = {}
    for params in (TF.TfidfParams(1000, (1, 1)), TEXT):
        sets[params.name] = G.training_vectors(s, written(TF.fit_vocab(s, params), "vocab"), params)
    return rounded_out(SEL.two_stage(spark, sets, "logistic", N, trials=ML.draw_params("logistic", 3), top_k=1))

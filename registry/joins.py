"""Alignment by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import decide, features as FE, joins as J, tfidf as TF
from gradeloom.sources import catalog as C
from registry.base import METRICS_SQL, PROBS_SQL, SAMPLES_SQL, SCORERS, metric_records, probs, query, rounded_out, samples, table, with_sql

SPARSE_LABELS = "truth AS (SELECT doc_id AS sample_id, quality FROM labels UNION ALL SELECT -1 - doc_id, quality FROM labels WHERE toxic = 1)"


def _truth(spark, sf):
    """The given partial labels, plus some for texts that do not exist."""
    given = table(spark, sf, "labels")
    known = given.select(F.col("doc_id").alias("sample_id"), "quality")
    return known.unionByName(given.filter("toxic = 1").select((-1 - F.col("doc_id")).alias("sample_id"), "quality"))


def _graded(spark, sf):
    return decide.argmax(probs(spark, sf)).select("model", "sample_id", "pred_label")


GRADED_SQL = PROBS_SQL + ", graded AS (SELECT model, sample_id, ['A1','A2','B1','B2','C1','C2'][list_position(p, list_max(p))] AS pred_label FROM probs), " + SPARSE_LABELS


@query("join_labels", with_sql(GRADED_SQL, "SELECT model, sample_id, pred_label, quality FROM graded JOIN truth USING (sample_id)"))
def join_labels(spark, sf):
    return J.with_labels(_graded(spark, sf), _truth(spark, sf))


@query("join_unlabelled", with_sql(GRADED_SQL, "SELECT model, sample_id, pred_label, quality FROM graded LEFT JOIN truth USING (sample_id)"))
def join_unlabelled(spark, sf):
    return J.with_optional_labels(_graded(spark, sf), _truth(spark, sf))


@query(
    "join_missing",
    with_sql(
        SAMPLES_SQL + ", " + SPARSE_LABELS,
        """SELECT sample_id, 'no_label' AS side FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM truth)
           UNION ALL SELECT sample_id, 'no_row' FROM truth WHERE sample_id NOT IN (SELECT sample_id FROM samples)""",
    ),
)
def join_missing(spark, sf):
    return J.unmatched(table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id")), _truth(spark, sf))


@query("join_labelled", with_sql(SAMPLES_SQL + ", " + SPARSE_LABELS, "SELECT sample_id, dataset FROM samples WHERE sample_id IN (SELECT sample_id FROM truth)"))
def join_labelled(spark, sf):
    return J.labelled_only(samples(spark, sf).select("sample_id", "dataset"), _truth(spark, sf))


@query("remove_samples", "SELECT doc_id AS sample_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def remove_samples(spark, sf):
    gone = table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("sample_id"))
    return J.remove_samples(table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "source"), gone)


@query(
    "has_features",
    """WITH have AS (SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) > 5)
       SELECT source AS dataset, count(*)::BIGINT AS n_samples, sum((h.doc_id IS NULL)::INTEGER)::BIGINT AS n_missing, sum((h.doc_id IS NULL)::INTEGER) = 0 AS has_features
       FROM documents d LEFT JOIN have h ON d.doc_id = h.doc_id GROUP BY source""",
)
def has_features(spark, sf):
    s = samples(spark, sf)
    from gradeloom.functions.text import word_tokens

    long_enough = s.filter(F.size(word_tokens(F.col("text"))) > 5)
    return J.feature_coverage(s, TF.document_terms(long_enough), "dataset")


BLOCKS_SQL = """
emb AS (SELECT vec_id AS sample_id, 'v' || (i - 1) AS feature, embedding[i]::DOUBLE AS "value" FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)),
doc AS (SELECT doc_id AS sample_id, 'chars' AS feature, n_chars::DOUBLE AS "value" FROM documents UNION ALL SELECT doc_id, 'lines', len(string_split(text, chr(10)))::DOUBLE FROM documents)"""


def _blocks(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "v"))
    emb = e.select("sample_id", F.concat(F.lit("v"), F.col("i")).alias("feature"), F.col("v").cast("double").alias("value"))
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", "\n")).cast("double").alias("lines")
    )
    return emb, FE.unpivot_features(d, ["sample_id"])


@query(
    "concat_matrices",
    with_sql(BLOCKS_SQL, "SELECT sample_id, 'emb__' || feature AS feature, round(\"value\", 6) AS \"value\" FROM emb UNION ALL SELECT sample_id, 'doc__' || feature, round(\"value\", 6) FROM doc"),
)
def concat_matrices(spark, sf):
    emb, doc = _blocks(spark, sf)
    return rounded_out(FE.concat_blocks({"emb": emb, "doc": doc}))


EMB_NAMES = [f"emb__v{k}" for k in range(64)]
EMB_CELLS = ", ".join(f"round(coalesce(max(CASE WHEN f = '{n}' THEN v END), 0.0), 6) AS {n}" for n in EMB_NAMES)


@query(
    "concat_matrices_wide",
    with_sql(
        BLOCKS_SQL,
        f"""SELECT sample_id, round(coalesce(max(CASE WHEN f = 'doc__chars' THEN v END), 0.0), 6) AS doc__chars,
           round(coalesce(max(CASE WHEN f = 'doc__lines' THEN v END), 0.0), 6) AS doc__lines, {EMB_CELLS}
           FROM (SELECT sample_id, 'emb__' || feature AS f, "value" AS v FROM emb UNION ALL SELECT sample_id, 'doc__' || feature, "value" FROM doc) GROUP BY sample_id""",
    ),
)
def concat_matrices_wide(spark, sf):
    emb, doc = _blocks(spark, sf)
    return rounded_out(FE.pivot_features(FE.concat_blocks({"emb": emb, "doc": doc}), ["doc__chars", "doc__lines", *EMB_NAMES]))


SETS_SQL = """
sets AS (
  SELECT source AS dataset, 'size' AS feature_set, doc_id AS sample_id, 'chars' AS feature, n_chars::DOUBLE AS "value" FROM documents
  UNION ALL SELECT source, 'shape', doc_id, 'lines', len(string_split(text, chr(10)))::DOUBLE FROM documents WHERE lang <> 'de'
  UNION ALL SELECT source, 'other', doc_id, 'lang', length(lang)::DOUBLE FROM documents)"""


def _sets(spark, sf):
    d = table(spark, sf, "documents")
    base = [F.col("source").alias("dataset"), F.col("doc_id").alias("sample_id")]
    part = lambda df, s, f, v: df.select(*base, F.lit(s).alias("feature_set"), F.lit(f).alias("feature"), v.cast("double").alias("value"))
    out = part(d, "size", "chars", F.col("n_chars"))
    out = out.unionByName(part(d.filter("lang <> 'de'"), "shape", "lines", F.size(F.split("text", "\n"))))
    return out.unionByName(part(d, "other", "lang", F.length("lang")))


@query(
    "concat_feature_sets",
    with_sql(SETS_SQL, "SELECT dataset, 'size++shape' AS feature_set, sample_id, feature_set || '-' || feature AS feature, \"value\" FROM sets WHERE feature_set IN ('size', 'shape')"),
)
def concat_feature_sets(spark, sf):
    return FE.concat_feature_sets(_sets(spark, sf), ["size", "shape"])


JOBS_SQL = """
models AS (SELECT DISTINCT 'train_logistic_' || substr(md5(p_brand), 1, 8) || CASE WHEN p_size % 2 = 0 THEN '_tfidf' ELSE '_tfidf_grouped' END AS model FROM part),
keyed AS (SELECT model, regexp_extract(model, '_([0-9a-f]{8}_tfidf(?:_grouped)?)', 1) AS feature_key FROM models),
feature_files AS (SELECT DISTINCT substr(md5('Brand#' || regexp_extract(source, '[0-9]+')), 1, 8) || '_tfidf' AS feature_key, lang || '-' || source AS dataset FROM documents),
label_files AS (SELECT DISTINCT lang || '-' || source AS dataset, lang || '-' || source || '.csv' AS label_file FROM documents d JOIN labels USING (doc_id))"""


def _jobs(spark, sf):
    from gradeloom.functions.names import feature_key

    parts, docs = table(spark, sf, "part"), table(spark, sf, "documents")
    tail = F.when(F.col("p_size") % 2 == 0, "_tfidf").otherwise("_tfidf_grouped")
    models = parts.select(F.concat(F.lit("train_logistic_"), F.substring(F.md5("p_brand"), 1, 8), tail).alias("model")).distinct()
    models = models.withColumn("feature_key", feature_key(F.col("model")))
    brand = F.concat(F.lit("Brand#"), F.regexp_extract("source", "[0-9]+", 0))
    dataset = F.concat_ws("-", "lang", "source")
    files = docs.select(F.concat(F.substring(F.md5(brand), 1, 8), F.lit("_tfidf")).alias("feature_key"), dataset.alias("dataset")).distinct()
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(dataset.alias("dataset"), F.concat(dataset, F.lit(".csv")).alias("label_file"))
    return models, files, labelled.distinct()


@query("join_model_features", with_sql(JOBS_SQL, "SELECT model, feature_key, dataset, label_file FROM keyed JOIN feature_files USING (feature_key) LEFT JOIN label_files USING (dataset)"))
def join_model_features(spark, sf):
    models, files, labels = _jobs(spark, sf)
    return J.match_models(models, files, files, labels)


@query("join_model_orphans", with_sql(JOBS_SQL, "SELECT model, feature_key FROM keyed WHERE feature_key NOT IN (SELECT feature_key FROM feature_files)"))
def join_model_orphans(spark, sf):
    models, files, _ = _jobs(spark, sf)
    return J.orphan_models(models, files)


VOCAB_IDX_SQL = """
tok AS (SELECT doc_id AS sample_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT sample_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY ALL),
top AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM documents) ORDER BY cf DESC, term LIMIT 2000),
vocab AS (SELECT *, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx FROM top)"""


@query("join_vocab", with_sql(VOCAB_IDX_SQL, "SELECT sample_id, idx, tf FROM tf JOIN vocab USING (term)"))
def join_vocab(spark, sf):
    s, params = samples(spark, sf), TF.TfidfParams(2000, (1, 1))
    vocab = TF.bounded(TF.fit_vocab(s, params).select("term", "idx"), params.max_features)
    return TF.document_terms(s).join(vocab, "term").select("sample_id", "idx", "tf")


CONFIG_SQL = "config AS (SELECT 'train_logistic_005ebc16_tfidf' AS model, '005ebc16_tfidf' AS feature_set, 'logistic' AS classifier_type UNION ALL SELECT 'train_xgboost_10b21d1b_tfidf_grouped', '10b21d1b_tfidf_grouped', 'xgboost')"


@query("join_config", with_sql(METRICS_SQL + ", " + CONFIG_SQL, "SELECT model, dataset, strategy, round(accuracy, 6) AS accuracy, feature_set, classifier_type FROM metrics LEFT JOIN config USING (model)"))
def join_config(spark, sf):
    rows = [(SCORERS[0], "005ebc16_tfidf", "logistic"), (SCORERS[2], "10b21d1b_tfidf_grouped", "xgboost")]
    config = spark.createDataFrame(rows, "model string, feature_set string, classifier_type string")
    m = metric_records(spark, sf).select("model", "dataset", "strategy", "accuracy")
    return rounded_out(m.join(F.broadcast(config), "model", "left"))  # a fixed list of models


@query(
    "cross_grid",
    """SELECT feature_set, classifier, dataset FROM (VALUES ('tfidf_1000_ngram1-1'), ('tfidf_5000_ngram1-2')) a(feature_set),
       (VALUES ('logistic'), ('xgboost'), ('multinomialnb')) b(classifier), (SELECT DISTINCT source AS dataset FROM documents)""",
)
def cross_grid(spark, sf):
    configs = spark.createDataFrame([("tfidf_1000_ngram1-1",), ("tfidf_5000_ngram1-2",)], "feature_set string")
    kinds = spark.createDataFrame([("logistic",), ("xgboost",), ("multinomialnb",)], "classifier string")
    datasets = table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    return J.grid(datasets, configs, kinds).select("feature_set", "classifier", "dataset")


@query("dataset_union", "SELECT DISTINCT source AS dataset FROM documents UNION SELECT role FROM conversations UNION SELECT lang FROM documents")
def dataset_union(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(F.col("source").alias("dataset")).union(table(spark, sf, "conversations").select("role")).union(d.select("lang"))
    return C.dataset_union(files)


GAPS_SQL = "l AS (SELECT DISTINCT lang || '-' || source AS dataset FROM documents WHERE n_chars >= 2700), r AS (SELECT DISTINCT lang || '-' || source AS dataset FROM documents JOIN labels USING (doc_id))"


@query("dataset_gaps", with_sql(GAPS_SQL, "(SELECT dataset, 'right' AS missing_in FROM l EXCEPT SELECT dataset, 'right' FROM r) UNION ALL (SELECT dataset, 'left' FROM r EXCEPT SELECT dataset, 'left' FROM l)"))
def dataset_gaps(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat_ws("-", "lang", "source").alias("dataset")
    left = d.filter("n_chars >= 2700").select(name).distinct()
    right = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(name).distinct()
    return C.dataset_gaps(left, right)


@query("label_overlap", "SELECT DISTINCT upper(substr(o_orderpriority, 1, 1)) AS label FROM orders INTERSECT SELECT DISTINCT substr(p_type, 1, 1) FROM part UNION ALL SELECT DISTINCT 'z' || lang FROM documents INTERSECT SELECT 'zen'")
def label_overlap(spark, sf):
    seen = table(spark, sf, "orders").select(F.upper(F.substring("o_orderpriority", 1, 1)).alias("label"))
    seen = seen.union(table(spark, sf, "documents").select(F.concat(F.lit("z"), F.col("lang"))))
    known = table(spark, sf, "part").select(F.substring("p_type", 1, 1).alias("label"))
    return C.label_overlap(seen, known.union(spark.createDataFrame([("zen",)], "label string")))


@query("label_union", with_sql(PROBS_SQL, "SELECT DISTINCT true_label AS label FROM probs UNION SELECT DISTINCT ['A1','A2','B1','B2','C1','C2'][list_position(p, list_max(p))] FROM probs"))
def label_union(spark, sf):
    p = decide.argmax(probs(spark, sf))
    return C.label_union(p.select(F.col("true_label").alias("label")), p.select(F.col("pred_label").alias("label")))

"""Sources and sinks, each exercised on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from gradeloom.operators import tfidf as TF
from gradeloom.session import fresh_path
from gradeloom.sources import catalog as C, readers as RD, sinks as SK
from registry.base import LEVEL_LIST, PREDICTIONS_SQL, SAMPLES_SQL, SPACE_SQL, probs, query, rounded_out, samples, table, with_sql


def _corpus(spark, sf):
    return samples(spark, sf).select("sample_id", "dataset", "grp", F.col("true_label").alias("label"), "text")


@query("src_corpus", with_sql(SAMPLES_SQL, "SELECT sample_id, grp, true_label AS label, md5(text) AS digest FROM samples"))
def src_corpus(spark, sf):
    """The corpus as CSV with quotes and line breaks in it, read back."""
    path = fresh_path(spark, "corpus-csv")
    _corpus(spark, sf).select("sample_id", "grp", "label", "text").write.options(**RD.CSV_OPTIONS, emptyValue="").csv(path)
    return RD.read_corpus(spark, path).select("sample_id", "grp", "label", F.md5("text").alias("digest"))


@query("src_corpus_dir", with_sql(SAMPLES_SQL, "SELECT dataset, grp, count(*)::BIGINT AS n_texts, sum(length(text))::BIGINT AS n_chars FROM samples GROUP BY ALL"))
def src_corpus_dir(spark, sf):
    """Two folders (test and training) of one file per dataset, read in one go."""
    path = fresh_path(spark, "corpus-dir")
    docs = _corpus(spark, sf).repartition("dataset", F.col("sample_id") % 4)
    docs.filter("sample_id % 5 = 0").write.partitionBy("dataset").parquet(f"{path}/test")
    docs.filter("sample_id % 5 <> 0").write.partitionBy("dataset").parquet(f"{path}/training")
    both = RD.read_corpus_dir(spark, [f"{path}/test/*", f"{path}/training/*"], fmt="parquet")
    return both.groupBy("dataset", "grp").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars"))


LINES_SQL = f"raw AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS l FROM documents), lines AS (SELECT doc_id, regexp_replace(l, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS text FROM raw)"


@query("src_text_lines", with_sql(LINES_SQL, "SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM lines WHERE text <> '' GROUP BY 1"))
def src_text_lines(spark, sf):
    path = fresh_path(spark, "lines")
    samples(spark, sf).select("text").write.text(path)
    lines = RD.read_text_lines(spark, path)
    return lines.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("src_whole_text", "SELECT md5(coalesce(text, '') || chr(10)) AS digest, count(*)::BIGINT AS n_files FROM benchmark GROUP BY 1")
def src_whole_text(spark, sf):
    """Whole files as documents: one file for each benchmark item."""
    path = fresh_path(spark, "whole")
    table(spark, sf, "benchmark").select(F.coalesce("text", F.lit("")).alias("text")).write.option("maxRecordsPerFile", "1").text(path)
    return RD.read_whole_texts(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "src_labels",
    """SELECT d.doc_id AS sample_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'matched' END AS side FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def src_labels(spark, sf):
    features = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    matched, rest = RD.attach_labels(features, labels)
    return matched.withColumn("side", F.lit("matched")).unionByName(rest, allowMissingColumns=True)


@query(
    "src_line_labels",
    f"SELECT d.doc_id, i::INTEGER AS line, regexp_replace(ls[i + 1], '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS label FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents) d, unnest(range(0, len(ls))) t(i)",
)
def src_line_labels(spark, sf):
    return RD.line_labels(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


DIMENSIONS = 64  # of the given vectors


@query("src_gz_features", f"SELECT vec_id AS sample_id, {', '.join(f'round(embedding[{k + 1}]::DOUBLE, 6) AS f{k}' for k in range(DIMENSIONS))}, label AS target FROM embeddings")
def src_gz_features(spark, sf):
    path = fresh_path(spark, "features-gz")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("Unnamed: 0"), (F.col("vec_id") * 7).alias("writing_id"), F.col("vec_id").alias("sample_id"),
        *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(DIMENSIONS)], F.col("label").alias("target"),
    )
    e.write.options(header="true", compression="gzip").csv(path)
    schema = "`Unnamed: 0` bigint, writing_id bigint, sample_id bigint, " + "".join(f"f{k} double, " for k in range(DIMENSIONS)) + "target int"
    return rounded_out(RD.read_features(spark, path, schema))


@query(
    "src_ground_truth",
    """SELECT user_id::VARCHAR AS sample_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def src_ground_truth(spark, sf):
    return RD.ground_truth(table(spark, sf, "events"), "user_id", "event_type", "event_id")


FEATURES_SQL = SAMPLES_SQL + ", toks AS (SELECT sample_id, dataset, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM samples)"


@query("sink_features", with_sql(FEATURES_SQL, "SELECT 'counts' AS feature_set, dataset, term AS feature, count(*)::DOUBLE AS \"value\" FROM toks GROUP BY dataset, term"))
def sink_features(spark, sf):
    """Features of all datasets written by partition and read back."""
    path, s = fresh_path(spark, "features"), samples(spark, sf)
    terms = TF.document_terms(s, (1, 1), ("dataset",))
    features = terms.select("sample_id", "dataset", F.lit("counts").alias("feature_set"), F.col("term").alias("feature"), F.col("tf").cast("double").alias("value"))
    SK.write_features(features, path)
    back = spark.read.parquet(path)
    return back.groupBy("feature_set", "dataset", "feature").agg(F.sum("value").alias("value"))


@query(
    "sink_predictions",
    with_sql(
        PREDICTIONS_SQL,
        f"""SELECT model, dataset, sample_id, strategy, pred_label AS predicted_label, NULL::DOUBLE AS prob FROM predictions
            UNION ALL SELECT model, dataset, sample_id, 'soft', {LEVEL_LIST}[i], round(p[i], 6) FROM probs, unnest(range(1, 7)) t(i)""",
    ),
)
def sink_predictions(spark, sf):
    path = fresh_path(spark, "predictions")
    SK.write_predictions(probs(spark, sf).select("model", "dataset", "sample_id", "p"), path)
    schema = "model string, dataset string, sample_id bigint, predicted_label string"
    parts = [
        spark.read.schema(schema).json(f"{path}/{name}_predictions").withColumn("strategy", F.lit(name))
        for name in ("argmax", "rounded_avg")
    ]
    soft = spark.read.schema("model string, dataset string, sample_id bigint, probabilities map<string,double>").json(f"{path}/soft_predictions")
    soft = soft.select("model", "dataset", "sample_id", F.lit("soft").alias("strategy"), F.explode("probabilities").alias("predicted_label", "prob"))
    return rounded_out(parts[0].unionByName(parts[1]).withColumn("prob", F.lit(None).cast("double")).unionByName(soft))


CATALOG_SQL = """
names AS (SELECT DISTINCT lang || '-' || source AS dataset, regexp_extract(source, '[0-9]+')::INTEGER AS k FROM documents),
files AS (SELECT CASE k % 6 WHEN 0 THEN dataset WHEN 1 THEN 'norm-' || dataset WHEN 2 THEN upper(dataset) WHEN 3 THEN 'norm-' || upper(dataset)
   WHEN 4 THEN 'all-' || upper(dataset) || '-labels' END AS label_file FROM names WHERE k % 6 <> 5),
options AS (SELECT n.dataset, f.label_file, CASE WHEN f.label_file = n.dataset THEN 0 WHEN f.label_file = 'norm-' || n.dataset THEN 1 WHEN f.label_file = upper(n.dataset) THEN 2
   WHEN f.label_file = 'norm-' || upper(n.dataset) THEN 3 WHEN contains(lower(f.label_file), lower(n.dataset)) THEN 4 END AS c FROM names n, files f)"""


@query(
    "dir_catalog",
    with_sql(
        CATALOG_SQL,
        """SELECT n.dataset, o.c::INTEGER AS match_class, o.label_file FROM names n LEFT JOIN (
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c, label_file) AS r FROM options WHERE c IS NOT NULL) WHERE r = 1) o ON o.dataset = n.dataset""",
    ),
)
def dir_catalog(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("dataset"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("k")).distinct()
    d, k = F.col("dataset"), F.col("k") % 6
    name = (
        F.when(k == 0, d).when(k == 1, F.concat(F.lit("norm-"), d)).when(k == 2, F.upper(d)).when(k == 3, F.concat(F.lit("norm-"), F.upper(d)))
        .when(k == 4, F.concat(F.lit("all-"), F.upper(d), F.lit("-labels")))
    )
    files = docs.select(name.alias("label_file")).filter(F.col("label_file").isNotNull())
    return C.match_label_files(docs.select("dataset"), files)


@query(
    "dir_missing",
    """WITH expected AS (SELECT model, source AS dataset FROM (VALUES ('a'), ('b')) m(model), (SELECT DISTINCT source FROM documents)),
       have AS (SELECT DISTINCT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS model, source AS dataset FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
       SELECT e.model, e.dataset, h.model IS NOT NULL AS "exists" FROM expected e LEFT JOIN have h ON h.model = e.model AND h.dataset = e.dataset""",
)
def dir_missing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    expected = docs.select(F.col("source").alias("dataset")).distinct().crossJoin(F.broadcast(models))  # two rows
    labelled = docs.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id")
    have = labelled.select(F.when(F.col("quality") == 1, "a").otherwise("b").alias("model"), F.col("source").alias("dataset"))
    return C.missing_outputs(expected, have).select("model", "dataset", "exists")

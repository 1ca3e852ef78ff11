"""Predictions made elsewhere."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from gradeloom.functions import answers as AN, probs as P
from gradeloom.functions.levels import LEVELS, label_at, ordinal
from gradeloom.operators import decide, ingest as I, metrics as M
from gradeloom.session import fresh_path
from gradeloom.sources.sinks import write_text_files
from registry.base import CLASS_SQL, LEVEL_LIST, METRICS_SQL, PREDICTIONS_SQL, PROBS_SQL, query, rounded_out, samples, table, with_sql

ANSWERS_SQL = f"""
base AS (SELECT conv_id * 1000 + turn AS answer_id, (conv_id * 7 + turn) % 10 AS shape, conv_id % 20 AS src, {LEVEL_LIST}[length(text) % 6 + 1] AS lv, lower(replace(replace(coalesce(text, ''), '{{', ''), '}}', '')) AS body FROM conversations),
answers AS (SELECT answer_id, src, CASE shape
  WHEN 0 THEN 'Result: {{"score": "' || lv || '"}}' || ' ' || body
  WHEN 1 THEN 'text before {{"level":"' || lv || '", "note": "n"}} text after' || ' ' || body
  WHEN 2 THEN 'Here is the JSON file: {{"score": "' || lv || '"' || ' ' || body
  WHEN 3 THEN '{{"cefr": "' || lower(lv) || '"°}}' || ' ' || body
  WHEN 4 THEN 'The writer is at ' || lv || ' level.' || ' ' || body
  WHEN 5 THEN 'no json here at all' || ' ' || body
  WHEN 6 THEN '{{"invalid": "X9"}}' || ' ' || body
  WHEN 7 THEN '{{''label'': ''' || lv || '''}}' || ' ' || body
  WHEN 8 THEN '{{"grade": " ' || lv || '"' || ' ' || body
  ELSE '{{"score": "Z9", "level": "' || lv || '"}}' || ' ' || body END AS answer FROM base)"""


def _answers(spark, sf):
    c = table(spark, sf, "conversations")
    lv = F.get(F.array(*[F.lit(l) for l in LEVELS]), F.length("text") % 6)
    shape = (F.col("conv_id") * 7 + F.col("turn")) % 10
    body = F.lower(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("{")), F.lit("}")))
    forms = [
        F.concat(F.lit('Result: {"score": "'), lv, F.lit('"}')),
        F.concat(F.lit('text before {"level":"'), lv, F.lit('", "note": "n"} text after')),
        F.concat(F.lit('Here is the JSON file: {"score": "'), lv, F.lit('"')),
        F.concat(F.lit('{"cefr": "'), F.lower(lv), F.lit('"°}')),
        F.concat(F.lit("The writer is at "), lv, F.lit(" level.")),
        F.lit("no json here at all"),
        F.lit('{"invalid": "X9"}'),
        F.concat(F.lit("{'label': '"), lv, F.lit("'}")),
        F.concat(F.lit('{"grade": " '), lv, F.lit('"')),
        F.concat(F.lit('{"score": "Z9", "level": "'), lv, F.lit('"}')),
    ]
    form = F.when(shape == 0, forms[0])
    for k, other in enumerate(forms[1:], start=1):
        form = form.when(shape == k, other)
    answer = F.concat(form, F.lit(" "), body)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), (F.col("conv_id") % 20).alias("src"), answer.alias("answer")
    )


KEYED = ", ".join(f"nullif(upper(regexp_extract(answer, '(?i)\\{{\\s*\"{k}\"\\s*:\\s*\"([A-C][12])\"', 1)), '') AS k_{k}" for k in AN.LABEL_KEYS)
LABELS_SQL = (
    ANSWERS_SQL
    + f""",
flat AS (SELECT *, replace(regexp_replace(nullif(regexp_extract(answer, '\\{{[^{{}}]*\\}}', 0), ''), '[°\\s]*\\}}', '}}'), '''', '"') AS obj, {KEYED},
  nullif(regexp_extract(answer, '\\{{\\s*"([^"]+)"\\s*:\\s*"([^"]+)"', 2), '') AS loose, nullif(regexp_extract(answer, '\\b([A-C][12])\\b', 1), '') AS bare FROM answers),
picked AS (SELECT *, CASE WHEN obj IS NOT NULL AND json_valid(obj) THEN
     CASE WHEN json_exists(obj, '$.score') THEN json_extract_string(obj, '$.score') WHEN json_exists(obj, '$.level') THEN json_extract_string(obj, '$.level')
          WHEN json_exists(obj, '$.label') THEN json_extract_string(obj, '$.label') WHEN json_exists(obj, '$.cefr') THEN json_extract_string(obj, '$.cefr')
          WHEN len(json_keys(obj)) = 1 THEN json_extract_string(obj, '$.' || json_keys(obj)[1]) END
     ELSE coalesce(k_score, k_level, k_label, k_cefr, loose, bare) END AS raw,
     (obj IS NOT NULL AND json_valid(obj)) OR coalesce(k_score, k_level, k_label, k_cefr, loose, bare) IS NOT NULL AS parsed FROM flat),
labelled AS (SELECT answer_id, src, parsed, CASE WHEN upper(trim(raw)) IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2') THEN upper(trim(raw)) END AS label FROM picked)"""
)


@query("parse_llm_output", with_sql(LABELS_SQL, "SELECT answer_id, parsed, label FROM labelled"))
def parse_llm_output(spark, sf):
    return I.labels_from_answers(_answers(spark, sf)).select("answer_id", "parsed", "label")


@query("label_from_keys", with_sql(LABELS_SQL, "SELECT label, count(*)::BIGINT AS n FROM labelled GROUP BY label"))
def label_from_keys(spark, sf):
    found = _answers(spark, sf).select(AN.label_from_keys(AN.parse_answer(F.col("answer"))).alias("label"))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_hot",
    with_sql(LABELS_SQL, f"SELECT answer_id, l.i::INTEGER AS ord, CASE WHEN {LEVEL_LIST}[l.i + 1] = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM labelled, unnest(range(0, 6)) l(i) WHERE label IS NOT NULL"),
)
def one_hot(spark, sf):
    return I.answers_to_probs(_answers(spark, sf)).select("answer_id", F.posexplode("p").alias("ord", "p"))


@query("parse_stats", with_sql(LABELS_SQL, "SELECT src, count(*)::BIGINT AS n_total, count(*) FILTER (parsed)::BIGINT AS n_parsed, count(label)::BIGINT AS n_labelled, count(*) FILTER (NOT parsed)::BIGINT AS n_failed FROM labelled GROUP BY src"))
def parse_stats(spark, sf):
    return I.parse_totals(I.labels_from_answers(_answers(spark, sf)), ["src"])


EXTERNAL_SQL = (
    PROBS_SQL
    + f""",
soft AS (SELECT model, dataset, sample_id::VARCHAR AS sample_id, p FROM probs)"""
)


def _soft_json(spark, sf):
    """Each model's probabilities as the one object ``{id: {level: prob}}`` that an external tool writes: one file a model."""
    from registry.base import probs

    path, one = fresh_path(spark, "soft"), W.partitionBy("model").orderBy("sample_id")
    p = probs(spark, sf).select("model", "sample_id", F.to_json(F.create_map(F.col("sample_id").cast("string"), P.to_map(F.col("p")))).alias("entry"))
    opening = F.when(F.row_number().over(one) == 1, "{").otherwise(",")
    closing = F.when(F.lead("sample_id").over(one).isNull(), "}").otherwise("")
    inner = F.expr("substring(entry, 2, length(entry) - 2)")
    p.select("model", F.concat(opening, inner, closing).alias("value")).write.partitionBy("model").text(path)
    return path


@query("src_soft_json", with_sql(EXTERNAL_SQL, f"SELECT model, sample_id, {LEVEL_LIST}[i] AS label, round(p[i], 6) AS prob FROM soft, unnest(range(1, 7)) t(i)"))
def src_soft_json(spark, sf):
    rows = I.soft_file_rows(spark, _soft_json(spark, sf))
    return rounded_out(rows.select("model", "sample_id", F.explode(P.to_map(F.col("p"))).alias("label", "prob")))


@query(
    "eval_external",
    with_sql(METRICS_SQL, "SELECT model, dataset, strategy, round(accuracy, 6) AS accuracy, round(adjacent_accuracy, 6) AS adjacent_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(micro_f1, 6) AS micro_f1, n_samples FROM metrics"),
)
def eval_external(spark, sf):
    probs = I.soft_file_rows(spark, _soft_json(spark, sf))
    truth = samples(spark, sf).select(F.col("sample_id").cast("string").alias("sample_id"), "dataset", "true_ord")
    judged = decide.both_strategies(probs.join(truth, "sample_id"))
    return rounded_out(M.report_metrics(M.confusion(judged)))


@query(
    "eval_answers",
    with_sql(
        LABELS_SQL,
        f"""SELECT src, round(avg((label = truth)::INTEGER), 6) AS accuracy, count(*)::BIGINT AS n_samples FROM (
            SELECT l.*, {LEVEL_LIST}[(l.answer_id // 1000) % 6 + 1] AS truth FROM labelled l WHERE label IS NOT NULL) GROUP BY src""",
    ),
)
def eval_answers(spark, sf):
    rows = I.answers_to_probs(_answers(spark, sf))
    truth = F.floor(F.col("answer_id") / 1000).cast("bigint") % 6
    judged = decide.argmax(rows).withColumn("true_ord", truth.cast("int"))
    return rounded_out(M.accuracy(M.confusion(judged, ("src",)), ("src",)))


@query("ingest_llm_dir", with_sql(LABELS_SQL, "SELECT answer_id, label, parsed FROM labelled"))
def ingest_llm_dir(spark, sf):
    """A folder with one file per answer, read back and parsed: every answer by id, with what was read or that it failed."""
    path = fresh_path(spark, "answers")
    write_text_files(_answers(spark, sf), path, "answer_id", "answer")
    return I.answers_from_folder(spark, path).select(F.col("name").try_cast("bigint").alias("answer_id"), "label", "parsed")

"""Surprisal features: language models fitted on documents, conversations scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.text import TOKEN_CLASSES, token_class
from gradeloom.operators import longtext as L, surprisal as S
from gradeloom.plans.surprisal_features import extract, token_records
from gradeloom.operators.scale import bounded
from gradeloom.session import written
from gradeloom.sources import sinks
from registry.base import SAMPLES_SQL, TURNS_SQL, query, rounded_out, samples, turns, with_sql

PAT = "[\\p{L}\\p{N}_]{2,}"
GENERAL = ["general"]
ALL_MODELS = ["general", "lm_en", "lm_fr", "lm_de", "lm_es"]
WINDOW = 16  # tokens a model sees at once, for the long-text rules

LM_SQL = f"""
dtok AS (SELECT lang, regexp_extract_all(lower(coalesce(text, '')), '{PAT}') AS ts FROM documents),
mrows AS MATERIALIZED (SELECT 'general' AS model, ts FROM dtok UNION ALL SELECT 'lm_' || lang, ts FROM dtok),
uni AS MATERIALIZED (SELECT model, token, count(*)::BIGINT AS n FROM (SELECT model, unnest(ts) AS token FROM mrows) GROUP BY ALL),
sizes AS MATERIALIZED (SELECT model, sum(n)::BIGINT AS n_total, count(*)::BIGINT AS n_vocab FROM uni GROUP BY model),
bi AS MATERIALIZED (SELECT model, ts[i] AS context, ts[i + 1] AS token, count(*)::BIGINT AS n FROM mrows, unnest(range(1, len(ts))) t(i) GROUP BY ALL),
heads AS MATERIALIZED (SELECT model, context, sum(n)::BIGINT AS n_context FROM bi GROUP BY ALL),
words AS MATERIALIZED (SELECT model, token, n, (n + 0.5::DOUBLE) / (n_total + 0.5::DOUBLE * (n_vocab + 1)) AS pu FROM uni JOIN sizes USING (model)
          UNION ALL SELECT model, '<UNK>', 0, (0 + 0.5::DOUBLE) / (n_total + 0.5::DOUBLE * (n_vocab + 1)) FROM sizes),
{TURNS_SQL},
ttok AS (SELECT sample_id, regexp_extract_all(lower(text), '{PAT}') AS ts FROM turns),
pairs AS MATERIALIZED (SELECT sample_id, i::INTEGER AS pos, ts[i] AS context, ts[i + 1] AS token FROM ttok, unnest(range(1, len(ts))) t(i)),
asked AS MATERIALIZED (SELECT DISTINCT model, context, token FROM pairs, sizes),
probs AS MATERIALIZED (SELECT a.model, a.context, a.token, coalesce(w.pu, u.pu) AS pu, h.n_context, coalesce(b.n, 0) AS n_pair,
     CASE WHEN h.n_context IS NULL THEN coalesce(w.pu, u.pu) ELSE (1.0::DOUBLE - 0.7::DOUBLE) * coalesce(w.pu, u.pu) + 0.7::DOUBLE * (coalesce(b.n, 0)::DOUBLE / h.n_context) END AS prob
   FROM asked a LEFT JOIN words w ON w.model = a.model AND w.token = a.token AND w.n > 0 JOIN words u ON u.model = a.model AND u.n = 0
   LEFT JOIN heads h ON h.model = a.model AND h.context = a.context LEFT JOIN bi b ON b.model = a.model AND b.context = a.context AND b.token = a.token),
scored AS (SELECT sample_id, pos, context, token, model, prob, -log2(prob + 1e-10::DOUBLE) AS entropy, pow(2.0::DOUBLE, -log2(prob + 1e-10::DOUBLE)) AS perplexity, -ln(prob) AS loss
   FROM pairs JOIN probs USING (context, token))"""

# The same with the model of all groups alone.
GENERAL_SQL = LM_SQL.replace(" UNION ALL SELECT 'lm_' || lang, ts FROM dtok", "")


def _lm(spark, sf, models=ALL_MODELS) -> S.NgramModels:
    rows = S.model_rows(samples(spark, sf), "grp")
    if list(models) == GENERAL:  # the texts of all groups train one model, and no other is fitted
        return S.fitted_lm(rows.withColumn("model", F.lit("general")), general=None)
    return S.fitted_lm(rows)


def _scored(spark, sf, models=GENERAL, **rule):
    return S.score_texts(turns(spark, sf), _lm(spark, sf, models), models, **rule)


@query("lm_fit", with_sql(LM_SQL, "SELECT model, context, token, n, n_context FROM bi JOIN heads USING (model, context)"))
def lm_fit(spark, sf):
    lm = S.fitted_lm(S.model_rows(samples(spark, sf), "grp"))
    return lm.bigrams.join(lm.heads, ["model", "context"]).select("model", "context", "token", "n", "n_context")


@query("lm_unigrams", with_sql(LM_SQL, "SELECT model, token, n, n_total, n_vocab FROM uni JOIN sizes USING (model)"))
def lm_unigrams(spark, sf):
    lm = S.fit_lm(S.model_rows(samples(spark, sf), "grp"))
    sizes = written(lm.sizes, "sizes")  # a row per model
    return lm.unigrams.join(bounded(sizes, sizes.count()), "model").select("model", "token", "n", "n_total", "n_vocab")


@query("lm_train_split", with_sql(LM_SQL, "SELECT model, count(*)::BIGINT AS n_texts, sum(len(ts))::BIGINT AS n_tokens FROM mrows GROUP BY model"))
def lm_train_split(spark, sf):
    rows = S.model_rows(samples(spark, sf), "grp")
    per_model = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("tokens")).alias("n_tokens"))
    whole = per_model.agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    return per_model.unionByName(whole.select(F.lit("general").alias("model"), "n_texts", "n_tokens"))


@query("token_prob", with_sql(GENERAL_SQL, "SELECT sample_id, pos, context, token, round(prob, 9) AS prob FROM scored WHERE model = 'general'"))
def token_prob(spark, sf):
    return rounded_out(_scored(spark, sf).select("sample_id", "pos", "context", "token", "prob"), 9)


@query("token_surprisal", with_sql(GENERAL_SQL, "SELECT sample_id, pos, round(entropy, 6) AS entropy, round(perplexity, 4) AS perplexity, round(loss, 6) AS loss FROM scored WHERE model = 'general'"))
def token_surprisal(spark, sf):
    t = _scored(spark, sf)
    return t.select("sample_id", "pos", F.round("entropy", 6).alias("entropy"), F.round("perplexity", 4).alias("perplexity"), F.round("loss", 6).alias("loss"))


RANK_SQL = (
    GENERAL_SQL
    + """,
g AS (SELECT context, token, prob, n_context IS NOT NULL AS seen FROM probs WHERE model = 'general'),
levels AS (SELECT pu, count(*)::BIGINT AS n FROM words WHERE model = 'general' GROUP BY pu),
everywhere AS (SELECT d.seen, d.prob, coalesce(sum(l.n), 0)::BIGINT AS n_all FROM (SELECT DISTINCT seen, prob FROM g) d
   LEFT JOIN levels l ON CASE WHEN d.seen THEN (1.0::DOUBLE - 0.7::DOUBLE) * l.pu ELSE l.pu END > d.prob GROUP BY d.seen, d.prob),
after_ AS (SELECT b.context, (1.0::DOUBLE - 0.7::DOUBLE) * w.pu AS low, (1.0::DOUBLE - 0.7::DOUBLE) * w.pu + 0.7::DOUBLE * (b.n::DOUBLE / h.n_context) AS high
   FROM bi b JOIN words w ON w.model = 'general' AND w.token = b.token JOIN heads h ON h.model = 'general' AND h.context = b.context WHERE b.model = 'general'),
local AS (SELECT d.context, d.prob, coalesce(sum((a.high > d.prob)::INTEGER), 0) - coalesce(sum((a.low > d.prob)::INTEGER), 0) AS n_local
   FROM (SELECT DISTINCT context, prob FROM g) d LEFT JOIN after_ a ON a.context = d.context GROUP BY d.context, d.prob)"""
)


@query(
    "token_rank",
    with_sql(RANK_SQL, 'SELECT g.context, g.token, (1 + n_all + n_local)::BIGINT AS "rank" FROM g JOIN everywhere USING (seen, prob) JOIN local ON local.context = g.context AND local.prob = g.prob'),
)
def token_rank(spark, sf):
    lm, pairs = _lm(spark, sf, GENERAL), S.scored_pairs(turns(spark, sf))
    probs = written(S.pair_probs(pairs, lm, GENERAL), "pair-probs")
    return S.token_ranks(probs, S.of_models(lm, GENERAL)).drop("model")


TOPK_SQL = (
    GENERAL_SQL
    + """,
ctx AS (SELECT DISTINCT context FROM pairs),
w AS (SELECT * FROM words WHERE model = 'general' AND n > 0),
options AS (SELECT c.context, b.token, b.n FROM ctx c JOIN bi b ON b.model = 'general' AND b.context = c.context
   UNION ALL SELECT c.context, t.token, 0 FROM ctx c CROSS JOIN (SELECT token FROM w ORDER BY pu DESC, token LIMIT 40) t),
every AS (SELECT o.context, o.token, CASE WHEN h.n_context IS NULL THEN w.pu ELSE (1.0::DOUBLE - 0.7::DOUBLE) * w.pu + 0.7::DOUBLE * (o.n::DOUBLE / h.n_context) END AS prob
   FROM (SELECT context, token, max(n) AS n FROM options GROUP BY ALL) o JOIN w USING (token) LEFT JOIN (SELECT * FROM heads WHERE model = 'general') h USING (context))"""
)


@query(
    "token_topk",
    with_sql(
        TOPK_SQL,
        """SELECT context, "rank", token, round(prob, 9) AS prob FROM (SELECT context, token, prob, (row_number() OVER (PARTITION BY context ORDER BY prob DESC, token))::INTEGER AS "rank" FROM every) WHERE "rank" <= 5""",
    ),
)
def token_topk(spark, sf):
    lm, pairs = _lm(spark, sf, GENERAL), S.scored_pairs(turns(spark, sf))
    asked = pairs.select(F.lit("general").alias("model"), "context").distinct()
    return rounded_out(S.top_continuations(asked, S.of_models(lm, GENERAL), 5).drop("model"), 9)


@query(
    "token_context",
    with_sql(
        LM_SQL,
        """SELECT sample_id, i::INTEGER AS pos, ts[i + 1] AS token, array_to_string(ts[greatest(i - 3, 0) + 1 : i], ' ') AS context_before, array_to_string(ts[i + 2 : i + 4], ' ') AS context_after
           FROM ttok, unnest(range(1, len(ts))) t(i)""",
    ),
)
def token_context(spark, sf):
    c = S.token_contexts(turns(spark, sf), 3)
    return c.select("sample_id", "pos", "token", F.array_join("context_before", " ").alias("context_before"), F.array_join("context_after", " ").alias("context_after"))


RECORDS_SQL = (
    RANK_SQL
    + TOPK_SQL.removeprefix(GENERAL_SQL)
    + """,
ranks AS (SELECT g.context, g.token, (1 + n_all + n_local)::BIGINT AS "rank" FROM g JOIN everywhere USING (seen, prob) JOIN local ON local.context = g.context AND local.prob = g.prob),
tops AS (SELECT context, string_agg(token, ' ' ORDER BY place) AS top_k, round(max(prob), 9) AS top_prob
   FROM (SELECT context, token, prob, row_number() OVER (PARTITION BY context ORDER BY prob DESC, token) AS place FROM every) WHERE place <= 5 GROUP BY context),
around AS (SELECT sample_id, i::INTEGER AS pos, ts[i] AS context, ts[i + 1] AS token, array_to_string(ts[greatest(i - 3, 0) + 1 : i], ' ') AS context_before,
   array_to_string(ts[i + 2 : i + 4], ' ') AS context_after FROM ttok, unnest(range(1, len(ts))) t(i))"""
)


@query(
    "token_records",
    with_sql(
        RECORDS_SQL,
        """SELECT sample_id, pos, context, token, model, round(prob, 9) AS prob, "rank", top_k, top_prob, round(-log2(prob + 1e-10::DOUBLE), 6) AS entropy,
           round(pow(2.0::DOUBLE, -log2(prob + 1e-10::DOUBLE)), 4) AS perplexity, round(-ln(prob), 6) AS loss, context_before, context_after
           FROM around JOIN (SELECT * FROM probs WHERE model = 'general') USING (context, token) JOIN ranks USING (context, token) JOIN tops USING (context)""",
    ),
)
def token_record_rows(spark, sf):
    """Every field of a scored token in one row; of the alternatives the words by rank, and the probability of the first."""
    r = token_records(turns(spark, sf), _lm(spark, sf, GENERAL), "general")
    words = F.array_join(F.transform("top_k", lambda w: w["token"]), " ")
    return r.select(
        "sample_id", "pos", "context", "token", "model", F.round("prob", 9).alias("prob"), "rank", words.alias("top_k"), F.round(F.get("top_k", F.lit(0))["prob"], 9).alias("top_prob"),
        F.round("entropy", 6).alias("entropy"), F.round("perplexity", 4).alias("perplexity"), F.round("loss", 6).alias("loss"),
        F.array_join("context_before", " ").alias("context_before"), F.array_join("context_after", " ").alias("context_after"),
    )


AGG = """count(s.loss)::BIGINT AS total_tokens, round(coalesce(avg(perplexity), 0), 3) AS mean_perplexity, round(coalesce(quantile_cont(perplexity, 0.5), 0), 3) AS median_perplexity,
  round(coalesce(stddev_pop(perplexity), 0), 1) AS std_perplexity, round(coalesce(min(perplexity), 0), 3) AS min_perplexity, round(coalesce(max(perplexity), 0), 3) AS max_perplexity,
  round(coalesce(avg(entropy), 0), 6) AS mean_entropy, round(coalesce(stddev_pop(entropy), 0), 6) AS std_entropy"""


def _aggregated(spark, sf, models=GENERAL, **rule):
    texts = turns(spark, sf)
    tokens = S.score_texts(texts, _lm(spark, sf, models), models, **rule, together=True)
    return S.aggregate_scores(tokens, texts, models)


def _agg_out(agg):
    digits = lambda c: 1 if c == "std_perplexity" else 3 if c.endswith("perplexity") else 6
    return agg.select("sample_id", "model", "total_tokens", *[F.round(c, digits(c)).alias(c) for c in S.STATS])


def _agg_sql(where: str = "", models: str = "model = 'general'") -> str:
    return with_sql(LM_SQL, f"SELECT t.sample_id, m.model, {AGG} FROM turns t CROSS JOIN (SELECT model FROM sizes WHERE {models}) m LEFT JOIN (SELECT * FROM scored {where}) s ON s.sample_id = t.sample_id AND s.model = m.model GROUP BY t.sample_id, m.model")


@query("ppl_aggregate", _agg_sql(models="true"))
def ppl_aggregate(spark, sf):
    return _agg_out(_aggregated(spark, sf, ALL_MODELS))


@query("long_truncate", _agg_sql(f"WHERE pos < {WINDOW}"))
def long_truncate(spark, sf):
    return _agg_out(_aggregated(spark, sf, max_tokens=WINDOW, mode="truncate"))


@query("long_sliding", _agg_sql(f"WHERE pos % {WINDOW} <> 0"))
def long_sliding(spark, sf):
    return _agg_out(_aggregated(spark, sf, max_tokens=WINDOW, mode="sliding_window"))


@query(
    "long_immediate",
    with_sql(
        GENERAL_SQL,
        f"""SELECT p.sample_id, p.pos, CASE WHEN p.pos < {WINDOW} THEN 0 ELSE p.pos - {WINDOW - 1} END::INTEGER AS context_start, CASE WHEN p.pos < {WINDOW} THEN p.pos ELSE {WINDOW - 1} END::INTEGER AS context_length, round(s.loss, 6) AS loss
            FROM pairs p JOIN ttok t USING (sample_id) JOIN scored s ON s.sample_id = p.sample_id AND s.pos = p.pos AND s.model = 'general' WHERE len(t.ts) > {WINDOW}""",
    ),
)
def long_immediate(spark, sf):
    texts = turns(spark, sf)
    losses = S.score_texts(texts, _lm(spark, sf, GENERAL), GENERAL, WINDOW, "immediate_context").select("sample_id", "pos", "loss")
    return rounded_out(L.immediate_spans(texts, WINDOW).join(losses, ["sample_id", "pos"]))


@query(
    "long_strategy_meta",
    with_sql(
        LM_SQL,
        f"""SELECT sample_id, strategy, (CASE strategy WHEN 'truncate' THEN 1 WHEN 'sliding_window' THEN ceil(n / {WINDOW}.0) ELSE 1 + n - {WINDOW} END)::BIGINT AS num_forward_passes, true AS max_length_exceeded, n::BIGINT AS text_length_tokens,
            CASE WHEN strategy = 'truncate' THEN n - {WINDOW} END::BIGINT AS tokens_lost FROM (SELECT sample_id, len(ts) AS n FROM ttok), (VALUES ('truncate'), ('sliding_window'), ('immediate_context')) v(strategy) WHERE n > {WINDOW}""",
    ),
)
def long_strategy_meta(spark, sf):
    return L.strategy_metadata(turns(spark, sf), WINDOW)


@query("position_features", with_sql(GENERAL_SQL, 'SELECT sample_id, model, pos AS "position", round(loss, 6) AS loss FROM scored WHERE model = \'general\' AND pos <= 512'))
def position_features(spark, sf):
    return rounded_out(S.position_losses(_scored(spark, sf)))


@query("position_features_dense", with_sql(GENERAL_SQL, "SELECT sample_id, model, 512 AS n, round(sum(loss), 5) AS total, round(max(CASE WHEN pos = 3 THEN loss ELSE 0.0 END), 6) AS third FROM scored WHERE model = 'general' AND pos <= 512 GROUP BY ALL"))
def position_features_dense(spark, sf):
    d = S.dense_positions(S.position_losses(_scored(spark, sf)))
    total = F.aggregate("losses", F.lit(0.0), lambda a, x: a + x)
    return d.select("sample_id", "model", F.size("losses").alias("n"), F.round(total, 5).alias("total"), F.round(F.get("losses", F.lit(2)), 6).alias("third"))


@query("avg_loss", with_sql(GENERAL_SQL, "SELECT sample_id, model, round(avg(loss), 6) AS avg_loss, round(exp(avg(loss)), 4) AS text_perplexity FROM scored WHERE model = 'general' GROUP BY ALL"))
def avg_loss(spark, sf):
    a = S.average_loss(_scored(spark, sf))
    return a.select("sample_id", "model", F.round("avg_loss", 6).alias("avg_loss"), F.round("text_perplexity", 4).alias("text_perplexity"))


TAG = f"""CASE WHEN regexp_full_match(token, '\\p{{N}}+') THEN 'NUM' WHEN regexp_matches(token, '\\p{{N}}|_') THEN 'MIX' WHEN length(token) <= 3 THEN 'SHORT' WHEN length(token) <= 6 THEN 'MID' ELSE 'LONG' END"""
TAG_COLUMNS = ", ".join(f"round(sum(CASE WHEN tag = '{t}' THEN loss ELSE 0.0 END), 5) AS {t}" for t in TOKEN_CLASSES)


@query("tag_features", with_sql(GENERAL_SQL, f"SELECT sample_id, model, {TAG_COLUMNS} FROM (SELECT *, {TAG} AS tag FROM scored WHERE model = 'general') GROUP BY sample_id, model"))
def tag_features(spark, sf):
    tags = S.tag_losses(_scored(spark, sf), token_class(F.col("token")))
    wide = tags.groupBy("sample_id", "model").pivot("tag", list(TOKEN_CLASSES)).agg(F.sum("loss")).fillna(0.0)
    return rounded_out(wide, 5)


@query(
    "multi_model_features",
    with_sql(
        LM_SQL,
        f"""SELECT sample_id, model || '__position_' || pos AS feature, round(loss, 5) AS "value" FROM scored WHERE pos <= 512
            UNION ALL SELECT sample_id, model || '__avg_loss', round(avg(loss), 5) FROM scored GROUP BY sample_id, model
            UNION ALL SELECT sample_id, model || '__tag_' || tag, round(sum(loss), 5) FROM (SELECT *, {TAG} AS tag FROM scored) GROUP BY sample_id, model, tag""",
    ),
)
def multi_model_features(spark, sf):
    return rounded_out(extract(samples(spark, sf), turns(spark, sf), "grp", ALL_MODELS), 5)


ROUTE_SQL = SAMPLES_SQL + ", routed AS (SELECT sample_id, floor(length(text) / 4)::BIGINT AS est_tokens, CASE WHEN floor(length(text) / 4) < 512 THEN 'short' ELSE 'long' END AS route FROM samples)"


@query("route_short_long", with_sql(ROUTE_SQL, "SELECT sample_id, est_tokens, route FROM routed"))
def route_short_long(spark, sf):
    return L.route(samples(spark, sf), 512)


@query(
    "batch_assign",
    with_sql(ROUTE_SQL, "SELECT sample_id, est_tokens, route, (CASE WHEN route = 'short' THEN (row_number() OVER (PARTITION BY route ORDER BY sample_id) - 1) // 16 ELSE row_number() OVER (PARTITION BY route ORDER BY sample_id) - 1 END)::BIGINT AS batch FROM routed"),
)
def batch_assign(spark, sf):
    return L.assign_batches(L.route(samples(spark, sf), 512), 16)


@query("chunk_assign", with_sql(SAMPLES_SQL, "SELECT sample_id, ((row_number() OVER (ORDER BY sample_id) - 1) // ceil((SELECT count(*) FROM samples) / 7.0)::BIGINT)::BIGINT AS chunk FROM samples"))
def chunk_assign(spark, sf):
    return L.assign_chunks(samples(spark, sf).select("sample_id"), 7).select("sample_id", "chunk")


@query("merge_batches", with_sql(ROUTE_SQL, "SELECT sample_id, route, est_tokens FROM routed"))
def merge_batches(spark, sf):
    """Each route is written and read back as its own part, then merged."""
    from gradeloom.session import fresh_path

    routed, parts = L.route(samples(spark, sf), 512), []
    for name in ("short", "long"):
        path = fresh_path(spark, f"batches-{name}")
        routed.filter(F.col("route") == name).write.json(path)
        parts.append(spark.read.schema("sample_id bigint, route string, est_tokens bigint").json(path))
    return L.merge_parts(parts)


@query("sink_perplexity", _agg_sql())
def sink_perplexity(spark, sf):
    """Nested statistics written as JSON, read back and flattened."""
    from gradeloom.session import fresh_path

    nested = sinks.nest_aggregate(_agg_out(_aggregated(spark, sf)), ["total_tokens", *S.STATS])
    path = fresh_path(spark, "surprisal")
    sinks.write_surprisal(nested, path, "json")
    schema = "sample_id bigint, model string, aggregate struct<total_tokens bigint, " + ", ".join(f"{c} double" for c in S.STATS) + ">"
    return sinks.flatten_aggregate(spark.read.schema(schema).json(path))

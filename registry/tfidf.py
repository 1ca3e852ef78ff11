"""Tokens, vocabularies and TF-IDF features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import names as N, text as T
from gradeloom.operators import tfidf as TF
from registry.base import SAMPLES_SQL, SPACE_SQL, query, rounded_out, samples, with_sql

PAT = "[\\p{L}\\p{N}_]{2,}"
TOKENS_SQL = SAMPLES_SQL + f", toks AS (SELECT sample_id, dataset, grp, regexp_extract_all(lower(text), '{PAT}') AS ts FROM samples)"


@query("tokenize_words", with_sql(TOKENS_SQL, "SELECT sample_id, len(ts)::INTEGER AS n, md5(array_to_string(ts, ' ')) AS digest FROM toks"))
def tokenize_words(spark, sf):
    s = samples(spark, sf).select("sample_id", T.word_tokens(F.col("text")).alias("ts"))
    return s.select("sample_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


@query(
    "tokenize_ws",
    with_sql(SAMPLES_SQL, f"SELECT sample_id, len(ts)::INTEGER AS n, md5(array_to_string(ts, ' ')) AS digest FROM (SELECT sample_id, list_filter(string_split_regex(text, '{SPACE_SQL}+'), lambda t: t <> '') AS ts FROM samples)"),
)
def tokenize_ws(spark, sf):
    s = samples(spark, sf).select("sample_id", T.space_tokens(F.col("text")).alias("ts"))
    return s.select("sample_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


@query(
    "tokenize_chars",
    with_sql(
        SAMPLES_SQL,
        """SELECT dataset, token_id, token, count(*)::BIGINT AS n FROM (
           SELECT dataset, CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) - 31 ELSE 0 END::INTEGER AS token_id,
                  CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE '<UNK>' END AS token
           FROM (SELECT dataset, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS c FROM samples)) GROUP BY ALL""",
    ),
)
def tokenize_chars(spark, sf):
    """Characters are encoded to ids, counted, and decoded through the id table."""
    from gradeloom.operators.scale import bounded

    ids = spark.createDataFrame([(0, "<UNK>")] + [(c - 31, chr(c)) for c in range(32, 127)], "token_id int, token string")
    chars = samples(spark, sf).select("dataset", F.explode(T.char_tokens(F.col("text"))).alias("token"))
    counts = chars.groupBy("dataset", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(bounded(ids, 96), "token")


@query(
    "ngrams",
    with_sql(
        TOKENS_SQL,
        """SELECT sample_id, len(g)::INTEGER AS n, md5(array_to_string(g, '|')) AS digest FROM (
           SELECT sample_id, list_concat(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])),
             list_transform(range(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1] || ' ' || ts[i + 2])) AS g FROM toks)""",
    ),
)
def ngrams(spark, sf):
    g = samples(spark, sf).select("sample_id", T.ngrams(T.word_tokens(F.col("text")), 1, 3).alias("g"))
    return g.select("sample_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))


TF_SQL = TOKENS_SQL + ", tf AS (SELECT sample_id, term, count(*)::BIGINT AS tf FROM (SELECT sample_id, unnest(ts) AS term FROM toks) GROUP BY ALL)"
TF12_SQL = (
    TOKENS_SQL
    + """,
tf AS (SELECT sample_id, grp, term, count(*)::BIGINT AS tf FROM (
  SELECT sample_id, grp, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM toks) GROUP BY ALL)"""
)


@query("term_counts", with_sql(TF_SQL, "SELECT sample_id, term, tf FROM tf"))
def term_counts(spark, sf):
    return TF.document_terms(samples(spark, sf))


def vocab_sql(size: int) -> str:
    return f""",
nd AS (SELECT count(*) AS n FROM samples),
top AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT {size}),
vocab AS (SELECT *, (SELECT n FROM nd)::BIGINT AS n_docs, ln((1.0::DOUBLE + (SELECT n FROM nd)) / (1.0::DOUBLE + df)) + 1.0 AS idf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx FROM top)"""


FULL = TF.TfidfParams()


@query("vocab_fit", with_sql(TF12_SQL + vocab_sql(5000), "SELECT term, df, cf, n_docs, idx FROM vocab"))
def vocab_fit(spark, sf):
    return TF.fit_vocab(samples(spark, sf), FULL).select("term", "df", "cf", "n_docs", "idx")


@query("idf_fit", with_sql(TF12_SQL + vocab_sql(5000), "SELECT term, round(idf, 6) AS idf FROM vocab"))
def idf_fit(spark, sf):
    return rounded_out(TF.fit_vocab(samples(spark, sf), FULL).select("term", "idf"))


@query(
    "tfidf_transform",
    with_sql(
        TF12_SQL + vocab_sql(5000),
        """SELECT sample_id, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)), 6) AS "value" FROM (
           SELECT sample_id, idx, term, (ln(tf::DOUBLE) + 1.0) * idf AS w FROM tf JOIN vocab USING (term))""",
    ),
)
def tfidf_transform(spark, sf):
    s = samples(spark, sf)
    return rounded_out(TF.transform(s, TF.fit_vocab(s, FULL), FULL))


GROUPED = TF.TfidfParams(max_features=800, ngram_range=(1, 2), min_df=2, max_df=0.9)
GROUPED_SQL = (
    TF12_SQL
    + """,
nd AS (SELECT grp, count(*) AS n_docs FROM samples GROUP BY grp),
st AS (SELECT grp, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY grp, term),
top AS (SELECT * FROM (SELECT st.*, n_docs::BIGINT AS n_docs, row_number() OVER (PARTITION BY grp ORDER BY cf DESC, term) AS r FROM st JOIN nd USING (grp)
        WHERE df >= 2 AND df <= 0.9::DOUBLE * n_docs) WHERE r <= 800),
vocab AS (SELECT grp, term, df, cf, n_docs, ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1.0 AS idf, (row_number() OVER (PARTITION BY grp ORDER BY term) - 1)::INTEGER AS idx FROM top)"""
)


@query("tfidf_grouped_fit", with_sql(GROUPED_SQL, "SELECT grp, term, df, cf, n_docs, round(idf, 6) AS idf, idx FROM vocab"))
def tfidf_grouped_fit(spark, sf):
    v = TF.fit_grouped(samples(spark, sf), "grp", GROUPED)
    return rounded_out(v.select("grp", "term", "df", "cf", "n_docs", "idf", "idx"))


@query(
    "tfidf_grouped_transform",
    with_sql(
        GROUPED_SQL,
        """SELECT sample_id, grp, idx, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY sample_id, grp)), 6) AS "value" FROM (
           SELECT tf.sample_id, v.grp, idx, v.grp || '_' || tf.term AS feature, (ln(tf::DOUBLE) + 1.0) * idf AS w FROM tf JOIN vocab v USING (term))""",
    ),
)
def tfidf_grouped_transform(spark, sf):
    s = samples(spark, sf)
    return rounded_out(TF.transform_grouped(s, TF.fit_grouped(s, "grp", GROUPED), GROUPED))


SWEEP = [TF.TfidfParams(300, (1, 1)), TF.TfidfParams(600, (1, 2), 3, 0.8), TF.TfidfParams(400, (2, 2), 2, 0.95, False)]


def _sweep_sql() -> str:
    parts, union = "", []
    for i, p in enumerate(SWEEP):
        size = f"len(string_split(term, ' ')) BETWEEN {p.ngram_range[0]} AND {p.ngram_range[1]}"
        tfw = "ln(tf::DOUBLE) + 1.0" if p.sublinear_tf else "tf::DOUBLE"
        parts += f""",
v{i} AS (SELECT term, ln((1.0::DOUBLE + (SELECT n FROM nd)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM st WHERE {size} AND df >= {p.min_df} AND df <= {p.max_df}::DOUBLE * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT {p.max_features})"""
        union.append(f"""SELECT sample_id, '{p.key}' AS feature_set, term AS feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)), 6) AS "value" FROM (SELECT sample_id, term, ({tfw}) * idf AS w FROM tf JOIN v{i} USING (term))""")
    base = TF12_SQL + ", nd AS (SELECT count(*) AS n FROM samples), st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)"
    return with_sql(base + parts, " UNION ALL ".join(union))


@query("tfidf_sweep", _sweep_sql())
def tfidf_sweep(spark, sf):
    s = samples(spark, sf)
    return rounded_out(TF.transform_sweep(s, TF.fit_sweep(s, SWEEP), SWEEP))


GRID_SQL = """
grid AS (SELECT DISTINCT (p_size * 100)::INTEGER AS max_features, (p_size % 3 + 1)::INTEGER AS hi, (p_size % 4 + 1)::INTEGER AS min_df, p_size % 2 = 0 AS sublinear FROM part)"""


@query(
    "config_hash",
    with_sql(
        GRID_SQL,
        """SELECT max_features, hi, min_df, sublinear, substr(sha256('max_features=' || max_features || ',ngram_range=(1, ' || hi || '),min_df=' || min_df || ',max_df=0.95,sublinear_tf=' || CASE WHEN sublinear THEN 'True' ELSE 'False' END), 1, 8) AS hash,
           'tfidf_' || max_features || '_ngram1-' || hi AS name FROM grid""",
    ),
)
def config_hash(spark, sf):
    from registry.base import table

    p = F.col("p_size")
    g = table(spark, sf, "part").select((p * 100).cast("int").alias("max_features"), (p % 3 + 1).alias("hi"), (p % 4 + 1).alias("min_df"), (p % 2 == 0).alias("sublinear")).distinct()
    text = N.config_text(F.col("max_features"), F.lit(1), F.col("hi"), F.col("min_df"), F.lit(0.95), F.col("sublinear"))
    return g.select("*", N.config_hash(text).alias("hash"), N.readable_config(F.col("max_features"), F.lit(1), F.col("hi")).alias("name"))

"""Registered queries of this subpackage, each over its whole table, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import contamination, exact_dedup, jaccard_join, licenses, mask_search, packing, pii, prefix_trie, sharding, site_templates, suffix_dedup, token_counts, toxicity
from gradeloom.llm.common import table, text_or_empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.removed(table(spark, sf, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length("kept") + n_removed).cast("bigint").alias("n_bytes"), n_removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


_TEMPLATES_SQL = ", ".join(f"('{name}', $${text}$$)" for name, text in licenses.TEMPLATES)
_NORMAL_SQL = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g')"
_BIGRAMS_SQL = """list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"""


@query("op3_licenses", f"""
    WITH templates AS (
      SELECT license_id, {_BIGRAMS_SQL} AS own FROM (
        SELECT license_id, list_filter(string_split_regex({_NORMAL_SQL}, '[ \n]+'), lambda x: x <> '') AS w
        FROM (VALUES {_TEMPLATES_SQL}) AS t(license_id, text))),
    texts AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL_SQL} AS t FROM documents),
    parts AS (
      SELECT r, doc_id, t AS p FROM texts
      UNION ALL SELECT r, doc_id, unnest(string_split_regex(t, '\n( ?\n)+')) FROM texts WHERE len(string_split_regex(t, '\n( ?\n)+')) > 1
      UNION ALL SELECT r, doc_id, unnest(string_split(t, chr(10))) FROM texts WHERE len(string_split(t, chr(10))) > 1),
    grams AS (
      SELECT row_number() OVER () AS part, doc_id, {_BIGRAMS_SQL} AS g FROM (
        SELECT doc_id, list_filter(string_split_regex(p, '[ \n]+'), lambda x: x <> '') AS w FROM parts) WHERE len(w) > 1),
    matches AS (
      SELECT part, doc_id, license_id, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice
      FROM grams JOIN templates ON len(g) BETWEEN len(own) * 0.8 / 1.2 - 1e-9 AND len(own) * 1.2 / 0.8 + 1e-9),
    best AS (
      SELECT part, doc_id, max(dice) AS top, arg_min(license_id, (-dice, license_id)) AS license_id
      FROM matches WHERE dice >= 0.8 - 1e-12 GROUP BY part, doc_id)
    SELECT doc_id, license_id, max(top) AS dice, count(*) AS n_parts FROM best GROUP BY doc_id, license_id""")
def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shards(table(spark, sf, "documents"), 24)
    return out.select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.train(docs, table(spark, sf, "labels")))
    out = out.select(F.col("record.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op6_pii")
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.spans(table(spark, sf, "documents").select("doc_id", "text"))
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kinds(k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = _listed(of_kinds(*pii.BASE_KINDS))
    return found.select(
        F.col("record.doc_id").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


_WORDS_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


@query("op7_contamination", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
    wins AS (
      SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS win
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(win) AS m FROM wins),
    grams AS (SELECT r, m, i, w[i:i + m - 1] AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
    hits AS (SELECT grams.r, grams.i, grams.m, wins.item_id FROM grams JOIN wins ON grams.win = wins.win),
    covered AS (SELECT r, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hits) GROUP BY r),
    items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""")
def op7_contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination.matches(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    ids = F.array_join(F.array_sort("item_ids"), ",")
    return found.select(
        F.col("record.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contamination.contaminated().alias("contaminated"),
    )


@query("op8_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_dedup.classes_of_files(spark, f"{sf}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = token_counts.counted(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)
    return found.select(F.col("record.doc_id").alias("doc_id"), "n_words", "n_pieces")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


@query("op11_mask_search", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
    sized AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
    whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
    asked AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark)),
    counted AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
    weighed AS (
      SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM counted, whole GROUP BY term, big_n),
    scored AS (
      SELECT a.item_id, s.r, s.doc_id, sum(g.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * big_n) // big_l))))::BIGINT AS score
      FROM asked a JOIN counted c USING (term) JOIN weighed g USING (term) JOIN sized s USING (r), whole
      GROUP BY a.item_id, s.r, s.doc_id)
    SELECT item_id, (row_number() OVER by_score)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW by_score AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)
    QUALIFY row_number() OVER by_score <= 50""")
def op11_mask_search(spark: SparkSession, sf: str) -> DataFrame:
    found = mask_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


@query("op12_site_templates")
def op12_site_templates(spark: SparkSession, sf: str) -> DataFrame:
    found = site_templates.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select(F.col("record.page_id").alias("page_id"), F.col("record.url").alias("url"), F.col("main").alias("text"), F.char_length("main").cast("bigint").alias("n_chars"))


_CRC_STEPS = "list_concat([(-2)::BIGINT], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: list_concat([ord(substr(c::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda k: (-1)::BIGINT)))))"
_CRC_SQL = f"xor(list_reduce({_CRC_STEPS}, lambda a, x: CASE WHEN a = -2 THEN xor(4294967295, x) WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


@query("op13_prefix_trie", f"""
    WITH turns AS (
      SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
             {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, list(t ORDER BY p) AS ts, {_CRC_SQL} % 9 AS h FROM turns GROUP BY c),
    rebuilt AS (
      SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:len(a.ts)]) AS s
      FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 5),
    prefixes AS (SELECT c, s[1:d] AS s, d, d = len(s) AS at_end FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
    nodes AS (
      SELECT s, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE at_end), '') AS ids
      FROM prefixes GROUP BY s, d),
    kids AS (SELECT s[1:d - 1] AS s, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
    sums AS (
      SELECT u.s[1:e] AS s, e AS d, count(*) FILTER (WHERE k IS NULL)::BIGINT AS n_leaves,
             sum(CASE WHEN u.d > 0 THEN (n - 1) * strlen(u.s[u.d].x) ELSE 0 END)::BIGINT AS saved_tokens
      FROM (SELECT nodes.s, nodes.d, n, k, unnest(range(0, nodes.d + 1)) AS e FROM nodes LEFT JOIN kids ON nodes.s = kids.s AND nodes.d = kids.d) u GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
    FROM nodes n JOIN sums ON n.s = sums.s AND n.d = sums.d LEFT JOIN kids ON n.s = kids.s AND n.d = kids.d
    LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.s = n.s[1:n.d - 1]""")
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    found = prefix_trie.nodes(*prefix_trie.rebuilt(table(spark, sf, "conversations")))
    return found.withColumnsRenamed({"conv": "conv_id", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"})

"""Surprisal features from interpolated n-gram language models.

A model is a pair of count tables. ``model`` is a column, so one job fits and
scores all of them. Probability of a word after another::

    pu(w)    = (c(w) + alpha) / (N + alpha * (V + 1))
    p(w | v) = (1 - lam) * pu(w) + lam * c(v, w) / c(v)     if v was seen before a word
    p(w | v) = pu(w)                                        otherwise

``V + 1`` leaves room for the unknown word, whose count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gradeloom.functions.lets import int_range, let
from gradeloom.functions.text import word_tokens
from gradeloom.session import fresh_path, ship_code, written
from gradeloom.operators.scale import BROADCAST_ROWS, bounded, count_above, join_per_key, log_bucket, require, skew_join, top_n_per_group

UNKNOWN = "<UNK>"
TINY = 1e-10  # keeps the logarithm finite


@dataclass(frozen=True)
class LmParams:
    alpha: float = 0.5
    lam: float = 0.7


START = ""  # stands before the first token of a text; no token is empty
PAIRS = "model string, context string, token string, n bigint"
PAIR_SCHEMA = pa.schema([("model", pa.string()), ("context", pa.string()), ("token", pa.string()), ("n", pa.int64())])
AT_ONCE = 1 << 22  # tokens whose pairs a task counts at once
BUCKETS = 4  # per partition of a shuffle: a task adds up one of them at a time
KEY_BITS = 64
ROWS_OUT = 1 << 16
GROUP_LIMIT = 100  # below the number up to which Spark limits groups before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold)


@dataclass(frozen=True)
class NgramModels:
    """Count tables of one or more models."""

    bigrams: DataFrame  # model, context, token, n
    unigrams: DataFrame  # model, token, n
    heads: DataFrame  # model, context, n_context
    sizes: DataFrame  # model, n_total, n_vocab: one row per model
    params: LmParams = LmParams()


def model_rows(corpus: DataFrame, group: str) -> DataFrame:
    """``(model, tokens)``: each text trains the model of its group."""
    require(corpus, group, "text")
    name = F.concat(F.lit("lm_"), F.col(group).cast("string"))
    return corpus.select(name.alias("model"), word_tokens(F.col("text")).alias("tokens"))


def with_pairs(rows: DataFrame, tokens: str, first: int = 1) -> DataFrame:
    """The other columns of ``rows`` and ``pos, context, token`` of each adjacent pair in its array ``tokens``.

    ``first=0`` adds the first token, after the start mark. The arrays are laid side
    by side as a whole, which needs no function call for each token.
    """
    n = F.greatest(F.size(tokens) - F.lit(first), F.lit(0))
    before = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    sides = [
        int_range(first, F.size(tokens) - 1).alias("pos"),
        (before if first else F.concat(F.array(F.lit(START)), before)).alias("context"),
        F.slice(tokens, F.lit(first + 1), n).alias("token"),
    ]
    zipped = F.when(F.size(tokens) > F.lit(first), F.arrays_zip(*sides))
    others = [c for c in rows.columns if c != tokens]
    return rows.select(*others, F.inline_outer(zipped)).filter(F.col("token").isNotNull())


def with_whole(counts: DataFrame, keys: list[str], general: str | None) -> DataFrame:
    """Counts of groups, and those of the model of all groups: their sums."""
    if general is None:
        return counts
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(F.lit(general).alias("model"), *keys, "n")
    return counts.unionByName(whole)


def _counted(batches: list[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The pairs of some texts, each once, by buckets of equal words: numbers stand for words, so a pair is one integer."""
    texts = pa.concat_arrays([b["tokens"] for b in batches])
    sizes, found = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(), texts.flatten().dictionary_encode()
    if not len(found):
        return
    models = pa.concat_arrays([b["model"] for b in batches]).dictionary_encode(null_encoding="encode")
    words = pa.concat_arrays([pa.array([START], found.dictionary.type), found.dictionary]).cast(pa.string())
    token, width = found.indices.to_numpy().astype(np.uint64) + np.uint64(1), len(words).bit_length()
    if 2 * width + len(models.dictionary).bit_length() > KEY_BITS and len(texts) > 1:  # only where texts of very many models meet
        rows = pa.Table.from_batches(batches)
        for part in (rows.slice(0, len(rows) // 2), rows.slice(len(rows) // 2)):
            yield from _counted(part.to_batches(), n_buckets)
        return
    context = np.zeros(len(token), np.uint64)
    context[1:] = token[:-1]
    context[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    bits, low = np.uint64(width), np.uint64((1 << width) - 1)
    of = np.repeat(models.indices.to_numpy().astype(np.uint64), sizes)
    pairs, n = np.unique((((of << bits) | context) << bits) | token, return_counts=True)
    of, context, token = pairs >> bits >> bits, (pairs >> bits) & low, pairs & low
    hashes = np.fromiter(map(crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    bucket = (((hashes[context] * np.uint64(0x9E3779B97F4A7C15) + hashes[token]) >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")  # of short numbers, by counting
    columns = [models.dictionary.take(pa.array(of[order])).cast(pa.string()), words.take(pa.array(context[order])), words.take(pa.array(token[order])), pa.array(n[order], pa.int64())]
    counted, ends = pa.RecordBatch.from_arrays(columns, schema=PAIR_SCHEMA), np.cumsum(np.bincount(bucket, minlength=n_buckets))
    for k, (begin, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        if begin < end:
            part = counted.slice(int(begin), int(end - begin)).serialize().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["bucket", "pairs"])


def _pair_counting(n_buckets: int):
    """Rows (model, tokens) to counted pairs (bucket, pairs); a pair comes again with each run of about ``AT_ONCE`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch["tokens"].flatten())
            if n >= AT_ONCE:
                yield from _counted(held, n_buckets)
                held, n = [], 0
        if held:
            yield from _counted(held, n_buckets)

    return run


def _pairs_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, pairs) sorted by bucket to pairs with the sums of their counts; holds one bucket."""
    keys = ["model", "context", "token"]
    rows = (row for batch in batches for row in zip(batch["bucket"].to_pylist(), batch["pairs"]))
    for _, same in groupby(rows, key=lambda row: row[0]):
        parts = [pa.ipc.read_record_batch(pairs.as_buffer(), PAIR_SCHEMA) for _, pairs in same]
        sums = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        yield from sums.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).to_batches(ROWS_OUT)


def count_pairs(rows: DataFrame) -> DataFrame:
    """``(model, context, token, n)`` in one pass over the texts, start pairs included.

    Spark finds the tokens and deals out the counted pairs in buckets; tasks count in arrays, as most pairs are
    rare and a hash table of text keys takes several times as long as all else.
    """
    require(rows, "model", "tokens")
    ship_code(rows.sparkSession)
    n_buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select("model", "tokens").mapInArrow(_pair_counting(n_buckets), "bucket int, pairs binary")
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairs_added, PAIRS)


def count_words(rows: DataFrame) -> DataFrame:
    """``(model, token, n)``; needs no pairs."""
    require(rows, "model", "tokens")
    words = rows.select("model", F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())
    return words.groupBy("model", "token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_sizes(unigrams: DataFrame) -> DataFrame:
    return unigrams.groupBy("model").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_vocab"))


def words_of(pairs: DataFrame, general: str | None = None) -> DataFrame:
    """Unigrams, from the counted pairs of each group."""
    return with_whole(pairs.groupBy("model", "token").agg(F.sum("n").alias("n")), ["token"], general)


def heads_of(pairs: DataFrame, general: str | None = None) -> DataFrame:
    """Counts of contexts, from the counted pairs of each group."""
    heads = pairs.filter(F.col("context") != START).groupBy("model", "context").agg(F.sum("n").alias("n"))
    return with_whole(heads, ["context"], general).withColumnRenamed("n", "n_context")


def fit_lm(rows: DataFrame, params: LmParams = LmParams(), general: str | None = "general") -> NgramModels:
    """Models of ``(model, tokens)`` rows: the words are counted and written at once, pairs only when a step reads them."""
    pairs, unigrams = count_pairs(rows), with_whole(written(count_words(rows), "lm-words"), ["token"], general)
    bigrams = with_whole(pairs, ["context", "token"], general).filter(F.col("context") != START)
    return NgramModels(bigrams, unigrams, heads_of(pairs, general), vocabulary_sizes(unigrams), params)


def store_lm(rows: DataFrame, path: str, general: str | None = "general") -> None:
    """Fit and write the models: the texts are read once, for the pairs of the groups; all else are sums of those.

    The tables of the model of all groups sum the group counts instead of reading texts twice.
    """
    count_pairs(rows).write.partitionBy("model").parquet(f"{path}/pairs")
    pairs = load_pairs(rows.sparkSession, path)  # its files are listed here: those of the groups
    if general is not None:
        whole = pairs.groupBy("context", "token").agg(F.sum("n").alias("n")).withColumn("model", F.lit(general))
        whole.write.mode("append").partitionBy("model").parquet(f"{path}/pairs")
    words_of(pairs, general).write.partitionBy("model").parquet(f"{path}/unigrams")
    heads_of(pairs, general).write.partitionBy("model").parquet(f"{path}/heads")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("context string, token string, n bigint, model string").parquet(f"{path}/pairs")


def load_lm(spark: SparkSession, path: str, params: LmParams = LmParams()) -> NgramModels:
    """Stored models; scoring reads only the partitions of its models."""
    bigrams = load_pairs(spark, path).filter(F.col("context") != START)
    unigrams = spark.read.schema("token string, n bigint, model string").parquet(f"{path}/unigrams")
    heads = spark.read.schema("context string, n_context bigint, model string").parquet(f"{path}/heads")
    return NgramModels(bigrams, unigrams, heads, vocabulary_sizes(unigrams), params)


def fitted_lm(rows: DataFrame, params: LmParams = LmParams(), general: str | None = "general") -> NgramModels:
    """Fit, store in the shared folder, and use the stored tables from then on."""
    path = fresh_path(rows.sparkSession, "lm")
    store_lm(rows, path, general)
    return load_lm(rows.sparkSession, path, params)


def of_models(lm: NgramModels, models: list[str]) -> NgramModels:
    chosen = F.col("model").isin(*models)
    return NgramModels(
        lm.bigrams.filter(chosen), lm.unigrams.filter(chosen), lm.heads.filter(chosen),
        bounded(lm.sizes.filter(chosen), len(models)), lm.params,
    )


def word_probs(lm: NgramModels) -> DataFrame:
    """``(model, token, pu)`` of the known words; ``lm.sizes`` has one row per model."""
    pu = unigram_prob(F.col("n"), F.col("n_total"), F.col("n_vocab"), lm.params.alpha)
    return lm.unigrams.join(lm.sizes, "model").select("model", "token", pu.alias("pu"))


def unigram_prob(n: Column, n_total: Column, n_vocab: Column, alpha: float) -> Column:
    return (n + F.lit(alpha)) / (n_total + F.lit(alpha) * (n_vocab + 1))


def mix(pu: Column, n: Column, n_context: Column, lam: float) -> Column:
    """Interpolated probability; a context never seen leaves the unigram."""
    seen = F.lit(1.0 - lam) * pu + F.lit(lam) * (n.cast("double") / n_context)
    return F.when(n_context.isNull(), pu).otherwise(seen)


def scored_pairs(texts: DataFrame, max_tokens: int | None = None, mode: str = "immediate_context") -> DataFrame:
    """``(sample_id, pos, context, token)`` of every token that gets a score.

    Positions count from 0; the first token has no context and no score.
    ``max_tokens`` applies the long-text rule ``mode``: cut the text, restart the
    context at each window, or keep the running context.
    """
    require(texts, "sample_id", "text")
    pairs = with_pairs(texts.select("sample_id", word_tokens(F.col("text")).alias("_tokens")), "_tokens")
    if max_tokens is None or mode == "immediate_context":
        return pairs
    if mode == "truncate":
        return pairs.filter(F.col("pos") < max_tokens)
    if mode == "sliding_window":
        return pairs.filter(F.col("pos") % max_tokens != 0)
    raise ValueError(f"unknown long-text rule {mode}")


def pair_probs(pairs: DataFrame, lm: NgramModels, models: list[str]) -> DataFrame:
    """Probability of each distinct ``(context, token)`` under each model.

    Count tables are joined to distinct pairs only, never to running text, so a
    pair weighs one row however often it occurs; what skew is left (contexts
    with very many continuations) is split by the adaptive skew join.
    Columns: ``model, context, token, n_rows, n_token, n_pair, n_context, pu, prob``.
    """
    lm = of_models(lm, models)
    distinct = pairs.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = distinct.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    words = lm.unigrams.select("model", "token", F.col("n").alias("n_token"))
    seen = lm.bigrams.select("model", "context", "token", F.col("n").alias("n_pair"))
    # Hashed are the asked pairs, each once, and the tables of words and contexts: the large sides need no sort.
    found = asked.hint("shuffle_hash").join(seen, ["model", "context", "token"], "left")
    found = found.join(lm.heads.hint("shuffle_hash"), ["model", "context"], "left").join(words.hint("shuffle_hash"), ["model", "token"], "left")
    found = found.join(lm.sizes, "model").fillna(0, ["n_pair", "n_token"])
    pu = unigram_prob(F.col("n_token"), F.col("n_total"), F.col("n_vocab"), lm.params.alpha)
    found = found.withColumn("pu", pu)
    prob = mix(F.col("pu"), F.col("n_pair"), F.col("n_context"), lm.params.lam)
    return found.withColumn("prob", prob).drop("n_total", "n_vocab")


def score_tokens(pairs: DataFrame, probs: DataFrame, models: list[str]) -> DataFrame:
    """Attach probabilities to running text: ``scores`` of each scored token, one of every model in the order of ``models``.

    The models of a pair travel as one array, so a row of text is shuffled once
    however many models score it; frequent pairs are spread.
    """
    counts = probs.filter(F.col("model") == models[0]).select("context", "token", "n_rows")  # every pair has a row per model
    if len(models) == 1:
        packed = probs.filter(F.col("model") == models[0]).select("context", "token", F.array("prob").alias("scores"))
    else:
        of = [F.max(F.when(F.col("model") == m, F.col("prob"))) for m in models]
        packed = probs.groupBy("context", "token").agg(F.array(*of).alias("scores"))
    joined = skew_join(pairs, packed, ["context", "token"], ["sample_id", "pos"], "inner", counts=counts, hashed=True)
    return joined.select("sample_id", "pos", "context", "token", "scores")


def opened_scores(scored: DataFrame, models: list[str]) -> DataFrame:
    """One row per scored token and model, with its surprisal."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.get("scores", F.lit(k)).alias("prob")) for k, m in enumerate(models)])
    tokens = scored.select("sample_id", "pos", "context", "token", F.inline(each)).filter(F.col("prob").isNotNull())
    return tokens.select("*", *surprisal_columns(F.col("prob")))


def surprisal_columns(prob: Column) -> list[Column]:
    """Entropy in bits, perplexity and loss in nats of one token."""
    bits = -F.log2(prob + F.lit(TINY))
    return [bits.alias("entropy"), F.pow(F.lit(2.0), bits).alias("perplexity"), (-F.log(prob)).alias("loss")]


def score_texts(
    texts: DataFrame, lm: NgramModels, models: list[str], max_tokens: int | None = None, mode: str = "immediate_context",
    together: bool = False, store: bool = False,
) -> DataFrame:
    """Probabilities and surprisal of every scored token of ``texts``.

    ``together`` brings the tokens of a text into one partition while their scores are
    still one array, so that sums per text and model need no shuffle of their own.
    ``store`` writes the arrays, where several steps read the tokens.
    """
    pairs = scored_pairs(texts, max_tokens, mode)
    scored = score_tokens(pairs, written(pair_probs(pairs, lm, models), "pair-probs"), models)
    if together:
        scored = scored.repartition("sample_id")
    return opened_scores(written(scored, "scored-tokens") if store else scored, models)


STATS = (
    "mean_perplexity", "median_perplexity", "std_perplexity", "min_perplexity", "max_perplexity",
    "mean_entropy", "std_entropy",
)


def aggregate_scores(tokens: DataFrame, texts: DataFrame, models: list[str]) -> DataFrame:
    """Per text and model statistics; a text without scored tokens gets zeros."""
    stats = tokens.groupBy("sample_id", "model").agg(
        F.avg("perplexity").alias("mean_perplexity"),
        F.percentile("perplexity", F.lit(0.5)).alias("median_perplexity"),
        F.stddev_pop("perplexity").alias("std_perplexity"),
        F.min("perplexity").alias("min_perplexity"),
        F.max("perplexity").alias("max_perplexity"),
        F.avg("entropy").alias("mean_entropy"),
        F.stddev_pop("entropy").alias("std_entropy"),
        F.count(F.lit(1)).alias("total_tokens"),
    )
    wanted = texts.select("sample_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return wanted.join(stats, ["sample_id", "model"], "left").fillna(0.0, list(STATS)).fillna(0, ["total_tokens"])


def average_loss(tokens: DataFrame) -> DataFrame:
    mean = F.avg("loss")
    return tokens.groupBy("sample_id", "model").agg(mean.alias("avg_loss"), F.exp(mean).alias("text_perplexity"))


def position_losses(tokens: DataFrame, n_positions: int = 512) -> DataFrame:
    """Long rows ``(sample_id, model, position, loss)`` for positions 1..n."""
    return tokens.filter(F.col("pos") <= n_positions).select(
        "sample_id", "model", F.col("pos").alias("position"), "loss"
    )


def dense_positions(losses: DataFrame, n_positions: int = 512) -> DataFrame:
    """One array of ``n_positions`` losses per text and model, zero-padded."""
    seen = losses.groupBy("sample_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("position", "loss"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(n_positions)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return seen.select("sample_id", "model", filled.alias("losses"))


def tag_losses(tokens: DataFrame, tag: Column) -> DataFrame:
    """Sum of losses per tag."""
    return tokens.groupBy("sample_id", "model", tag.alias("tag")).agg(F.sum("loss").alias("loss"))


def model_features(tokens: DataFrame, tag: Column, n_positions: int = 512) -> DataFrame:
    """Position losses, mean loss and tag sums of every model in long layout."""
    name = lambda kind, what: F.concat(F.col("model"), F.lit(f"__{kind}_"), what.cast("string"))
    positions = position_losses(tokens, n_positions).select(
        "sample_id", name("position", F.col("position")).alias("feature"), F.col("loss").alias("value")
    )
    mean = average_loss(tokens).select(
        "sample_id", F.concat(F.col("model"), F.lit("__avg_loss")).alias("feature"), F.col("avg_loss").alias("value")
    )
    tags = tag_losses(tokens, tag).select(
        "sample_id", name("tag", F.col("tag")).alias("feature"), F.col("loss").alias("value")
    )
    return positions.unionByName(mean).unionByName(tags)


def token_contexts(texts: DataFrame, width: int = 3) -> DataFrame:
    """Every scored token with its context and up to ``width`` tokens before and after it, all from its own row."""
    def windows(ts: Column) -> Column:
        return F.transform(
            int_range(1, F.size(ts) - 1),
            lambda i: F.struct(
                i.alias("pos"),
                F.get(ts, i - 1).alias("context"),
                F.get(ts, i).alias("token"),
                F.slice(ts, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width))).alias("context_before"),
                F.slice(ts, i + 2, F.lit(width)).alias("context_after"),
            ),
        )

    return texts.select("sample_id", F.inline(let(word_tokens(F.col("text")), windows)))


def token_ranks(probs: DataFrame, lm: NgramModels) -> DataFrame:
    """1-based rank of each pair's token among the whole vocabulary.

    Counts the words with a greater probability without listing any of them per
    context: every word sits at ``(1 - lam) * pu`` unless it was seen after the
    context, so the words above a probability are those above it in the unigram
    table, minus the seen words counted there, plus the seen words that really
    are above. All three counts come from bucketed running sums.
    """
    lam, alpha = lm.params.lam, lm.params.alpha
    known = F.col("n_context").isNotNull()
    lowest = lambda pu: F.lit(1.0 - lam) * pu
    asked = probs.select("model", "context", "token", "prob", "n_context")
    words = word_probs(lm)
    kinds = words.groupBy("model", "pu").agg(F.count(F.lit(1)).alias("n_words"))
    unknown = unigram_prob(F.lit(0), F.col("n_total"), F.col("n_vocab"), alpha)
    kinds = kinds.unionByName(lm.sizes.select("model", unknown.alias("pu"), F.lit(1).cast("bigint").alias("n_words")))
    levels = kinds.withColumn("seen", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        "model", "seen", F.when(F.col("seen"), lowest(F.col("pu"))).otherwise(F.col("pu")).alias("prob"), "n_words"
    )
    bucket = log_bucket(F.col("prob"))
    places = asked.select("model", known.alias("seen"), "prob")
    everywhere = count_above(levels, places, ["model", "seen"], "prob", "n_words", bucket).withColumnRenamed("above", "n_all")

    contexts = asked.filter(known).select("model", "context", "n_context").distinct()
    after = lm.bigrams.join(contexts, ["model", "context"]).join(words, ["model", "token"])
    ends = F.array(
        F.struct(mix(F.col("pu"), F.col("n"), F.col("n_context"), lam).alias("prob"), F.lit(1).alias("mass")),
        F.struct(lowest(F.col("pu")).alias("prob"), F.lit(-1).alias("mass")),
    )
    group = ["model", "context"]
    moved = after.select(*group, F.inline(ends)).withColumnRenamed("mass", "n_words")  # summed by count_above
    here = count_above(moved, asked.select(*group, "prob"), group, "prob", "n_words", bucket).withColumnRenamed("above", "n_here")

    ranked = asked.withColumn("seen", known)
    # Words that were never seen together share few probabilities, so this key is hot.
    ranked = skew_join(ranked, everywhere, ["model", "seen", "prob"], ["context", "token"], "inner").join(here, group + ["prob"])
    rank = 1 + F.col("n_all") + F.col("n_here")
    return ranked.select("model", "context", "token", rank.cast("bigint").alias("rank"))


def top_continuations(contexts: DataFrame, lm: NgramModels, k: int = 5) -> DataFrame:
    """The ``k`` most likely words after each ``(model, context)``.

    A word never seen after the context can only be listed if it is one of the
    model's ``k`` most frequent words: those keep at least its probability.
    """
    lam = lm.params.lam
    words = word_probs(lm)
    frequent = top_n_per_group(words, ["model"], [F.col("pu").desc(), F.col("token")], k, ["token"]).drop("rank")
    asked = contexts.select("model", "context").distinct()
    asked = asked.join(lm.heads, ["model", "context"], "left")
    seen = lm.bigrams.join(asked.filter(F.col("n_context").isNotNull()), ["model", "context"]).join(words, ["model", "token"])
    listed = frequent.groupBy("model").agg(F.collect_list(F.struct("token", "pu")).alias("words"))  # k entries per model
    listed = written(listed, "frequent-words")
    always = join_per_key(asked, listed, ["model"], ["context"], listed.count(), "inner", BROADCAST_ROWS // max(k, 1)).select("model", "context", "n_context", F.inline("words"))
    always = always.select("model", "context", "token", F.lit(0).cast("bigint").alias("n"), "n_context", "pu")
    options = seen.select("model", "context", "token", "n", "n_context", "pu").unionByName(always)
    options = options.groupBy("model", "context", "token").agg(
        F.max("n").alias("n"), F.max("n_context").alias("n_context"), F.max("pu").alias("pu")
    )
    scored = options.withColumn("prob", mix(F.col("pu"), F.col("n"), F.col("n_context"), lam))
    order = [F.col("prob").desc(), F.col("token")]
    if k <= GROUP_LIMIT:  # Spark cuts contexts to their first rows before it shuffles them
        top = scored.withColumn("rank", F.row_number().over(W.partitionBy("model", "context").orderBy(*order))).filter(F.col("rank") <= k)
    else:
        top = top_n_per_group(scored, ["model", "context"], order, k, ["token"])
    return top.select("model", "context", "rank", "token", "prob")

"""TF-IDF vocabularies and features in long layout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from gradeloom.functions.text import ngrams, term_frequencies, word_tokens
from gradeloom.operators.scale import bounded, require, skew_join, top_n_per_group
from gradeloom.session import fresh_path, ship_code, written


@dataclass(frozen=True)
class TfidfParams:
    max_features: int = 5000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2
    max_df: float = 0.95
    sublinear_tf: bool = True

    def __post_init__(self):
        lo, hi = self.ngram_range
        if self.max_features <= 0 or self.min_df < 1 or not 0 < self.max_df <= 1 or not 1 <= lo <= hi:
            raise ValueError(f"invalid TF-IDF parameters {self}")

    @property
    def key(self) -> str:
        """Short hash naming this configuration."""
        text = (
            f"max_features={self.max_features},ngram_range={tuple(self.ngram_range)},"
            f"min_df={self.min_df},max_df={self.max_df},sublinear_tf={self.sublinear_tf}"
        )
        return hashlib.sha256(text.encode()).hexdigest()[:8]

    @property
    def name(self) -> str:
        return f"tfidf_{self.max_features}_ngram{self.ngram_range[0]}-{self.ngram_range[1]}"


def document_terms(corpus: DataFrame, ngram_range=(1, 1), carry: tuple[str, ...] = ()) -> DataFrame:
    """``(sample_id, carry..., term, tf)``, counted inside each row: no shuffle."""
    require(corpus, "sample_id", "text", *carry)
    counted = term_frequencies(ngrams(word_tokens(F.col("text")), *ngram_range))
    return opened(corpus.select("sample_id", *carry, counted.alias("_counted")), "_counted", "term")


def opened(rows: DataFrame, array: str, first: str) -> DataFrame:
    """One row per structure in ``array``; ``first`` is a field that is never null.

    The outer form keeps the optimizer from asking beforehand, at the price of
    making the array twice, whether it is empty.
    """
    return rows.select(*[c for c in rows.columns if c != array], F.inline_outer(array)).filter(F.col(first).isNotNull())


def term_stats(terms: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Document and corpus frequency per term, combined before the shuffle."""
    return terms.groupBy(*(group or []), "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf")
    )


def corpus_stats(corpus: DataFrame, ngram_range=(1, 1), group: list[str] | None = None) -> DataFrame:
    """``term_stats`` of ``document_terms``, but with no function call for each term.

    Spark finds the words; tasks count in arrays, where a term is an integer, and send the counted terms in buckets.
    """
    group = group or []
    require(corpus, "text", *group)
    ship_code(corpus.sparkSession)
    n_buckets = BUCKETS * int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = corpus.select(*group, word_tokens(F.col("text")).alias("_tokens"))
    types = [rows.schema[g] for g in group]
    counted = rows.mapInArrow(_term_counting(*ngram_range, group, n_buckets), "bucket int, terms binary")
    out = T.StructType([*types, T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("cf", T.LongType())])
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_terms_added(group), out)


AT_ONCE = 1 << 20  # tokens whose terms a task counts at once
BUCKETS = 4  # per partition of a shuffle: a task adds up one of them at a time
ROWS_OUT = 1 << 16


def _counted(batches: list[pa.RecordBatch], lo: int, hi: int, group: list[str], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The terms of some texts, each once for each group, with the number of texts that have it, by buckets of equal words."""
    rows = pa.Table.from_batches(batches)
    texts = pa.concat_arrays([b["_tokens"] for b in batches])
    sizes, found = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(), texts.flatten().dictionary_encode()
    if not len(found):
        return
    words, token = found.dictionary, found.indices.to_numpy().astype(np.int64)
    # Texts are numbered group by group, so that a term's texts in one group follow each other.
    of = np.zeros(len(texts), np.int64)
    keys = rows.select(group).append_column("_row", pa.array(np.arange(len(texts)))) if group else None
    if group:
        distinct = keys.group_by(group, use_threads=False).aggregate([("_row", "list")])
        lists = distinct["_row_list"].combine_chunks()
        of[lists.flatten().to_numpy()] = np.repeat(np.arange(len(distinct)), pc.list_value_length(lists).to_numpy())
    place = np.empty(len(texts), np.int64)
    place[np.argsort(of, kind="stable")] = np.arange(len(texts))
    of = np.sort(of)
    text, left = np.repeat(place, sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(token))
    width, row_bits = len(words).bit_length(), len(texts).bit_length()
    if 2 * width + row_bits > 62 and len(texts) > 1:
        for part in (rows.slice(0, len(rows) // 2), rows.slice(len(rows) // 2)):
            yield from _counted(part.combine_chunks().to_batches(), lo, hi, group, n_buckets)
        return
    hashes = np.fromiter(map(crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    shorter: list[np.ndarray] = [np.zeros(0, np.int64)]  # codes of the terms that are one word shorter

    def split(n: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return shorter[n - 1][codes >> width], codes & ((1 << width) - 1)

    def names(n: int, codes: np.ndarray) -> pa.Array:
        if n == 1:
            return words.take(pa.array(codes))
        before, last = split(n, codes)
        return pc.binary_join_element_wise(names(n - 1, before), words.take(pa.array(last)), " ")

    def hashed(n: int, codes: np.ndarray) -> np.ndarray:
        if n == 1:
            return hashes[codes]
        before, last = split(n, codes)
        return hashed(n - 1, before) * np.uint64(0x9E3779B97F4A7C15) + hashes[last]

    code = token
    for n in range(1, hi + 1):
        if n > 1:
            # The terms so far get small numbers, and each is followed by the next word of its text.
            distinct, small = (np.arange(len(words)), code) if n == 2 else np.unique(code, return_inverse=True)
            shorter.append(distinct)
            kept = np.flatnonzero(left[: len(code)] >= n) if n == 2 else np.flatnonzero(left[at] >= n)
            at = kept if n == 2 else at[kept]
            code = (small[kept] << width) | token[at + n - 1]
        else:
            at = np.arange(len(token))
        if n < lo or not len(code):
            continue
        if n > 2 and int(code.max()).bit_length() + row_bits > 62:
            distinct, small = np.unique(code, return_inverse=True)
        else:
            distinct, small = None, code
        both, n_in_text = np.unique((small << row_bits) | text[at], return_counts=True)
        term, grp = both >> row_bits, of[both & ((1 << row_bits) - 1)]
        begins = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(grp) != 0)])
        df, cf, grp = np.diff(np.r_[begins, len(both)]), np.add.reduceat(n_in_text, begins), grp[begins]
        term = term[begins] if distinct is None else distinct[term[begins]]
        bucket = ((hashed(n, term) >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = [keys[g].combine_chunks().take(pc.list_element(lists, 0).take(pa.array(grp[order]))) for g in group]
        counted = pa.RecordBatch.from_arrays([*groups, names(n, term[order]).cast(pa.string()), pa.array(df[order], pa.int64()), pa.array(cf[order], pa.int64())], [*group, "term", "df", "cf"])
        ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
        for k, (begin, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            if begin < end:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, counted.schema) as stream:
                    stream.write_batch(counted.slice(int(begin), int(end - begin)))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "terms"])


def _term_counting(lo: int, hi: int, group: list[str], n_buckets: int):
    """Rows (group..., _tokens) to counted terms (bucket, terms); a term comes again with each run of about ``AT_ONCE`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(whole["_tokens"]), 0).to_numpy())
            first = 0
            while first < whole.num_rows:
                # Rows up to the one that fills the run.
                done = ends[first - 1] if first else 0
                last = min(int(np.searchsorted(ends, done + AT_ONCE - n)) + 1, whole.num_rows)
                held.append(whole.slice(first, last - first))
                n += int(ends[last - 1] - done)
                first = last
                if n >= AT_ONCE:
                    yield from _counted(held, lo, hi, group, n_buckets)
                    held, n = [], 0
        if held:
            yield from _counted(held, lo, hi, group, n_buckets)

    return run


def _terms_added(group: list[str]):
    """Rows (bucket, terms) sorted by bucket to terms with the sums of their counts; holds one bucket."""
    keys = [*group, "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch["bucket"].to_pylist(), batch["terms"]))
        for _, same in groupby(rows, key=lambda row: row[0]):
            parts = pa.concat_tables([pa.ipc.open_stream(terms.as_buffer()).read_all() for _, terms in same])
            sums = parts.group_by(keys, use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
            yield from sums.select([*keys, "df_sum", "cf_sum"]).rename_columns([*keys, "df", "cf"]).to_batches(ROWS_OUT)

    return run


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def tf_weight(tf: Column, sublinear: bool) -> Column:
    return F.log(tf.cast("double")) + 1.0 if sublinear else tf.cast("double")


def fit_vocab(corpus: DataFrame, params: TfidfParams = TfidfParams()) -> DataFrame:
    """``(term, df, cf, n_docs, idf, idx)`` with at most ``max_features`` rows."""
    n_docs = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = corpus_stats(corpus, params.ngram_range).withColumn("n_docs", n_docs)
    kept = stats.filter((F.col("df") >= params.min_df) & (F.col("df") <= F.lit(float(params.max_df)) * F.col("n_docs")))
    top = kept.orderBy(F.col("cf").desc(), "term").limit(params.max_features)
    by_term = W.orderBy("term")  # at most max_features rows
    return top.withColumn("idf", smooth_idf(F.col("n_docs"), F.col("df"))).withColumn(
        "idx", (F.row_number().over(by_term) - 1).cast("int")
    )


def normalise(weighted: DataFrame, unit: list[str]) -> DataFrame:
    """Divide each value by the L2 norm of its unit; empty units stay empty."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(*unit)))
    return weighted.withColumn("value", F.try_divide(F.col("value"), norm))


# Vocabularies that are looked up inside the row: so many in all, with so many terms together. They are fetched, so both are checked.
ROW_VOCABS = 64
ROW_TERMS = 500_000


class TermIndex:
    """Finds the n-grams of several vocabularies among words that are numbered: an n-gram is the one before it and a word."""

    def __init__(self, units: list[RowVocab]):
        self.units = units
        split = [[t.split(" ") for t in u.terms] for u in units]
        self.words = list(dict.fromkeys(w for terms in split for ws in terms for w in ws))
        number = {w: k for k, w in enumerate(self.words)}
        most = max((u.ngram_range[1] for u in units), default=1)
        # Per length: the keys (number of the shorter n-gram, word) in order, and per unit the positions of their terms.
        self.keys: list[np.ndarray] = [np.arange(len(self.words))]
        prefixes: list[dict[tuple[int, ...], int]] = [{(k,): k for k in range(len(self.words))}]
        numbered = [[tuple(number[w] for w in ws) for ws in terms] for terms in split]
        for n in range(2, most + 1):
            wanted = {ws[:n] for terms in numbered for ws in terms if len(ws) >= n}
            keyed = sorted((prefixes[-1][ws[:-1]] * len(self.words) + ws[-1], ws) for ws in wanted)
            self.keys.append(np.array([k for k, _ in keyed], np.int64))
            prefixes.append({ws: k for k, (_, ws) in enumerate(keyed)})
        self.positions: list[list[np.ndarray]] = []
        for u, terms in zip(units, numbered):
            tables = [np.full(len(p), -1, np.int64) for p in prefixes]
            for position, ws in enumerate(terms):
                if u.ngram_range[0] <= len(ws) <= u.ngram_range[1]:
                    tables[len(ws) - 1][prefixes[len(ws) - 1][ws]] = position
            self.positions.append(tables)
        self.words = pa.array(self.words, pa.string())

    def entries(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per unit: rows, positions and values, in order of rows and positions; a row's values have length one together."""
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
        word = pc.fill_null(pc.index_in(texts.flatten().cast(pa.string()), self.words), -1).to_numpy().astype(np.int64)
        row, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
        at, grams, levels = np.flatnonzero(word >= 0), None, []
        for n, keys in enumerate(self.keys, start=1):
            if n == 1:
                grams = word[at]
            else:
                going = left[at] >= n
                at, grams = at[going], grams[going]
                wanted = grams * len(self.words) + word[at + n - 1]
                place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                known = (word[at + n - 1] >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(len(at), bool)
                at, grams = at[known], place[known]
            levels.append((at, grams))
        out = []
        for u, tables in zip(self.units, self.positions):
            size, parts = max(len(u.terms), 1), []
            for (at, grams), table in zip(levels, tables):
                position = table[grams]
                hit = position >= 0
                parts.append(row[at[hit]] * size + position[hit])
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            rows, idx = found // size, found % size
            weighed = (np.log(n) + 1.0 if u.sublinear else n.astype(np.float64)) * u.idf[idx]
            length = np.sqrt(np.bincount(rows, weighed * weighed, len(texts)))[rows]
            with np.errstate(invalid="ignore"):
                out.append((rows, idx, weighed / length))
        return out


@dataclass(frozen=True)
class RowVocab:
    """A vocabulary as arrays by position."""

    terms: list[str]
    idf: np.ndarray
    sublinear: bool
    ngram_range: tuple[int, int]


ENTRY = pa.struct([("unit", pa.int32()), ("idx", pa.int32()), ("value", pa.float64())])


def entries_of(units: list[RowVocab], spark: SparkSession):
    """A function of a column of words: the known terms as (unit, position, value), by unit and position; texts and terms stay in the row."""
    ship_code(spark)
    ready: list[TermIndex] = []

    def found(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(TermIndex(units))
        parts = ready[0].entries(texts)
        rows, idx, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
        unit = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(rows, kind="stable") if len(parts) > 1 else slice(None)
        value = value[order]
        flat = pa.StructArray.from_arrays(
            [pa.array(unit[order], pa.int32()), pa.array(idx[order], pa.int32()), pa.array(value, pa.float64(), mask=np.isnan(value))], fields=list(ENTRY)
        )
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(texts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(lambda texts: found(texts), "array<struct<unit int, idx int, value double>>")


def in_rows(vocab: DataFrame, params: TfidfParams) -> RowVocab:
    """A fitted vocabulary (at most ``max_features`` rows), in order of position."""
    found = sorted(vocab.select("idx", "term", "idf").collect())
    return RowVocab([r["term"] for r in found], np.array([r["idf"] for r in found], np.float64), params.sublinear_tf, params.ngram_range)


def _named(terms: list[str]) -> Column:
    """A constant array of terms; no term holds the separator."""
    return F.split(F.lit("\x01".join(terms)), "\x01")


def with_entries(corpus: DataFrame, vocab: RowVocab, params: TfidfParams, column: str = "entries") -> DataFrame:
    """``corpus`` with the TF-IDF entries of each text."""
    return corpus.withColumn(column, entries_of([vocab], corpus.sparkSession)(word_tokens(F.col("text"))))


def transform(corpus: DataFrame, vocab: DataFrame, params: TfidfParams = TfidfParams()) -> DataFrame:
    """``(sample_id, idx, term, value)`` for the vocabulary terms of each text, without any exchange."""
    known = in_rows(vocab, params)
    rows = opened(with_entries(corpus.select("sample_id", "text"), known, params).select("sample_id", "entries"), "entries", "idx")
    return rows.select("sample_id", "idx", F.get(_named(known.terms), F.col("idx")).alias("term"), "value")


def vectors(corpus: DataFrame, vocab: DataFrame, params: TfidfParams = TfidfParams()) -> DataFrame:
    """``corpus`` without its text but with ``features``, a sparse vector of ``max_features``; written, without any exchange."""
    rows = with_entries(corpus, in_rows(vocab, params), params)
    kind, size = F.lit(0).cast("tinyint").alias("type"), F.lit(params.max_features).alias("size")
    stored = rows.withColumn("features", F.struct(kind, size, F.col("entries.idx").alias("indices"), F.col("entries.value").alias("values"))).drop("text", "entries")
    path = fresh_path(corpus.sparkSession, "vectors")
    stored.write.parquet(path)  # a vector's stored form is this structure
    schema = T.StructType([T.StructField("features", VectorUDT()) if f.name == "features" else f for f in stored.schema.fields])
    return corpus.sparkSession.read.schema(schema).parquet(path)


def fit_grouped(corpus: DataFrame, group: str, params: TfidfParams = TfidfParams()) -> DataFrame:
    """One vocabulary per group value: ``(grp, term, df, cf, n_docs, idf, idx)``."""
    require(corpus, group)
    docs = corpus.withColumn("grp", F.col(group).cast("string"))
    sizes = written(docs.groupBy("grp").agg(F.count(F.lit(1)).alias("n_docs")), "group-sizes")
    sizes = bounded(sizes, sizes.count())  # a join on few keys would put a group into one task
    stats = corpus_stats(docs, params.ngram_range, ["grp"]).join(sizes, "grp")
    kept = stats.filter((F.col("df") >= params.min_df) & (F.col("df") <= F.lit(float(params.max_df)) * F.col("n_docs")))
    top = top_n_per_group(kept, ["grp"], [F.col("cf").desc(), F.col("term")], params.max_features, ["term"]).drop("rank")
    by_term = W.partitionBy("grp").orderBy("term")  # at most max_features rows per group
    return top.withColumn("idf", smooth_idf(F.col("n_docs"), F.col("df"))).withColumn(
        "idx", (F.row_number().over(by_term) - 1).cast("int")
    )


def _units(corpus: DataFrame, units: list[RowVocab]) -> tuple[DataFrame, Column]:
    """``(sample_id, unit, idx, value)`` for several vocabularies, and the term's name."""
    entries = entries_of(units, corpus.sparkSession)(word_tokens(F.col("text")))
    found = opened(corpus.select("sample_id", entries.alias("entries")), "entries", "unit")
    names = [F.when(F.col("unit") == k, F.get(_named(known.terms), F.col("idx"))) for k, known in enumerate(units)]
    return found, F.coalesce(*names)


def _grouped_in_rows(corpus: DataFrame, found: list, params: TfidfParams) -> DataFrame:
    """One vectorizer per group; a row's entries of all groups follow each other."""
    by_group: dict[str, list] = {}
    for r in found:
        by_group.setdefault(r["grp"], []).append(r)
    groups, units = sorted(by_group, key=lambda g: (g is not None, g or "")), []
    for grp in groups:
        own = sorted(by_group[grp], key=lambda r: r["idx"])
        units.append(RowVocab([r["term"] for r in own], np.array([r["idf"] for r in own], np.float64), params.sublinear_tf, params.ngram_range))
    one, name = _units(corpus, units)
    one = one.withColumn("grp", F.get(F.array(*[F.lit(g).cast("string") for g in groups]), F.col("unit")))
    return one.select("sample_id", "grp", "idx", F.concat_ws("_", "grp", name).alias("feature"), "value")


def transform_grouped(corpus: DataFrame, vocab: DataFrame, params: TfidfParams = TfidfParams()) -> DataFrame:
    """Every text against every group's vocabulary, one unit vector per group.

    The vocabularies are counted first. Up to ``ROW_VOCABS`` groups with ``ROW_TERMS``
    terms together are looked up inside the row; more are joined to the counted
    terms in a shuffle that spreads hot terms. Both give the same rows.
    """
    n_groups, n_terms = vocab.agg(F.count_distinct(F.coalesce("grp", F.lit(""))), F.count(F.lit(1))).first()
    if 0 < n_groups <= ROW_VOCABS and n_terms <= ROW_TERMS:
        return _grouped_in_rows(corpus, vocab.select("grp", "idx", "term", "idf").collect(), params)
    terms = document_terms(corpus, params.ngram_range)
    packed = vocab.groupBy("term").agg(F.collect_list(F.struct("grp", "idf", "idx")).alias("hits"))
    expected = vocab.groupBy("term").agg(F.sum("df").alias("n_rows"))  # which terms are frequent, without reading texts
    joined = skew_join(terms, packed, ["term"], ["sample_id"], "inner", counts=expected).select("sample_id", "term", "tf", F.inline("hits"))
    weighted = joined.select(
        "sample_id", "grp", "idx", F.concat_ws("_", "grp", "term").alias("feature"),
        (tf_weight(F.col("tf"), params.sublinear_tf) * F.col("idf")).alias("value"),
    )
    return normalise(weighted, ["sample_id", "grp"])


def params_table(spark: SparkSession, grid: list[TfidfParams]) -> DataFrame:
    rows = [
        (p.key, p.name, p.max_features, p.ngram_range[0], p.ngram_range[1], p.min_df, float(p.max_df), p.sublinear_tf)
        for p in grid
    ]
    schema = (
        "feature_set string, readable_name string, max_features int, lo int, hi int, min_df int, max_df double, sublinear_tf boolean"
    )
    return spark.createDataFrame(rows, schema)


def fit_sweep(corpus: DataFrame, grid: list[TfidfParams]) -> DataFrame:
    """Vocabularies of several configurations from one count of the corpus."""
    lo = min(p.ngram_range[0] for p in grid)
    hi = max(p.ngram_range[1] for p in grid)
    configs = bounded(params_table(corpus.sparkSession, grid), len(grid))
    n_docs = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = corpus_stats(corpus, (lo, hi)).withColumn("n_docs", n_docs)
    size = F.size(F.split("term", " "))
    fits = stats.join(
        configs,
        size.between(F.col("lo"), F.col("hi"))
        & (F.col("df") >= F.col("min_df"))
        & (F.col("df") <= F.col("max_df") * F.col("n_docs")),
    )
    most = max(p.max_features for p in grid)
    top = top_n_per_group(fits, ["feature_set"], [F.col("cf").desc(), F.col("term")], most, ["term"])
    return top.filter(F.col("rank") <= F.col("max_features")).select(
        "feature_set", "term", "df", "cf", "n_docs", "sublinear_tf", smooth_idf(F.col("n_docs"), F.col("df")).alias("idf")
    )


def transform_sweep(corpus: DataFrame, vocab: DataFrame, grid: list[TfidfParams]) -> DataFrame:
    """Features of all configurations in one pass over the texts, without any exchange."""
    found: dict[str, list] = {p.key: [] for p in grid}
    for r in vocab.select("feature_set", "term", "idf").collect():  # at most the sum of max_features
        found[r["feature_set"]].append((r["term"], r["idf"]))
    units = []
    chosen = list({p.key: p for p in grid}.values())
    for p in chosen:
        own = sorted(found[p.key])
        units.append(RowVocab([t for t, _ in own], np.array([i for _, i in own], np.float64), p.sublinear_tf, p.ngram_range))
    one, name = _units(corpus, units)
    key = F.get(F.array(*[F.lit(p.key) for p in chosen]), F.col("unit"))
    return one.select("sample_id", key.alias("feature_set"), name.alias("feature"), "value")

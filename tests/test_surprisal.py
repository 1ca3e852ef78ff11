import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import token_class
from gradeloom.operators import longtext as L, surprisal as S
from gradeloom.plans.surprisal_features import extract, token_records

TRAIN = [
    (1, "g1", "the cat sat on the mat and the cat ran to the dog"),
    (2, "g1", "the dog sat on the cat and the dog ran off"),
    (3, "g2", "a man ran to the mat on the big red mat near the cat"),
    (4, "g2", "to be or not to be that is the question"),
]
TEXTS = [(1, "the cat ran to the zebra on the mat"), (2, "zebra crossing the question is near"), (3, "word"), (4, ""), (5, "12 the the the the mat cat dog sat on the 99 abc_1")]


@pytest.fixture(scope="module")
def lm(spark):
    rows = S.model_rows(spark.createDataFrame(TRAIN, "sample_id int, grp string, text string"), "grp")
    return S.fitted_lm(rows)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "sample_id int, text string")


@pytest.fixture(scope="module")
def plain():
    """Counts of the general model in plain Python."""
    uni, bi, heads = Counter(), Counter(), Counter()
    for _, _, t in TRAIN:
        ws = [w for w in t.split() if len(w) > 1]
        uni.update(ws)
        for a, b in zip(ws, ws[1:]):
            bi[a, b] += 1
            heads[a] += 1
    n, v = sum(uni.values()), len(uni)

    def prob(a, b):
        pu = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
        return pu if a not in heads else (1 - 0.7) * pu + 0.7 * (bi[a, b] / heads[a])

    return prob, sorted(uni)


def test_probabilities_and_totals(spark, lm, texts, plain):
    prob, words = plain
    got = S.score_texts(texts, lm, ["general"]).collect()
    for r in got:
        assert r["prob"] == pytest.approx(prob(r["context"], r["token"]))
        assert r["loss"] == pytest.approx(-math.log(r["prob"]))
        assert r["perplexity"] == pytest.approx(1 / (r["prob"] + 1e-10))
    for context in ("the", "zebra"):
        assert sum(prob(context, w) for w in words) + prob(context, "zebra") == pytest.approx(1.0)


def test_ranks_against_the_whole_vocabulary(lm, texts, plain):
    prob, words = plain
    one = S.of_models(lm, ["general"])
    ranks = S.token_ranks(S.pair_probs(S.scored_pairs(texts), one, ["general"]), one).collect()
    assert len(ranks) > 10
    for r in ranks:
        p = prob(r["context"], r["token"])
        above = sum(prob(r["context"], w) > p for w in words + ["zzz-unknown"])
        assert r["rank"] == above + 1, r


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_words_against_the_whole_vocabulary(lm, texts, plain, k):
    prob, words = plain
    one = S.of_models(lm, ["general"])
    contexts = S.scored_pairs(texts).select(F.lit("general").alias("model"), "context")
    have = defaultdict(list)
    for r in sorted(S.top_continuations(contexts, one, k).collect(), key=lambda r: r["rank"]):
        have[r["context"]].append(r["token"])
    for context, tokens in have.items():
        assert tokens == sorted(words, key=lambda w: (-prob(context, w), w))[:k]


@pytest.mark.parametrize("mode,count", [("truncate", lambda n, m: m - 1), ("sliding_window", lambda n, m: n - -(-n // m)), ("immediate_context", lambda n, m: n - 1)])
def test_long_text_rules(spark, mode, count):
    n, m = 23, 5
    long = spark.createDataFrame([(1, " ".join(f"w{i:02d}" for i in range(n)))], "sample_id int, text string")
    assert S.scored_pairs(long, m, mode).count() == count(n, m)
    meta = L.strategy_metadata(long, m, (mode,)).first()
    assert meta["num_forward_passes"] == {"truncate": 1, "sliding_window": -(-n // m), "immediate_context": 1 + n - m}[mode]
    assert meta["tokens_lost"] == (n - m if mode == "truncate" else None)


def test_positions_and_tags_add_up(lm, texts):
    tokens = S.score_texts(texts, lm, ["general", "lm_g1", "lm_g2"])
    a = {(r[0], r[1]): r[2] for r in S.position_losses(tokens).groupBy("sample_id", "model").agg(F.sum("loss")).collect()}
    b = {(r[0], r[1]): r[2] for r in S.tag_losses(tokens, token_class(F.col("token"))).groupBy("sample_id", "model").agg(F.sum("loss")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_texts_without_scores_get_zeros(lm, texts):
    tokens = S.score_texts(texts, lm, ["general"])
    rows = {r["sample_id"]: r for r in S.aggregate_scores(tokens, texts, ["general"]).collect()}
    assert len(rows) == len(TEXTS)
    assert all(rows[s][c] == 0 for s in (3, 4) for c in (*S.STATS, "total_tokens"))


def test_token_records(lm, texts):
    rows = token_records(texts, lm, "general", k=2, width=2).collect()
    assert len(rows) == S.scored_pairs(texts).count()
    r = next(r for r in rows if r["sample_id"] == 1 and r["pos"] == 2)
    assert (r["token"], r["context_before"], r["context_after"]) == ("ran", ["the", "cat"], ["to", "the"])
    assert len(r["top_k"]) == 2 and r["rank"] >= 1


def test_words_need_no_pairs(spark, monkeypatch):
    rows = S.model_rows(spark.createDataFrame(TRAIN + [(5, "g2", ""), (6, None, "lone cat"), (7, "g3", None)], "sample_id int, grp string, text string"), "grp")
    labels, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df, label: labels.append(label) or keep(df, label))
    lazy = S.fit_lm(rows)
    words = Counter({(r["model"], r["token"]): r["n"] for r in lazy.unigrams.collect()})
    assert "lm-pairs" not in labels
    stored = S.fitted_lm(rows)
    assert words == {(r["model"], r["token"]): r["n"] for r in stored.unigrams.collect()}
    for table in ("bigrams", "heads", "sizes"):
        have, want = (getattr(m, table) for m in (lazy, stored))
        assert Counter(map(tuple, have.select(want.columns).collect())) == Counter(map(tuple, want.collect())), table


def test_features_read_tokens_scored_once(spark, texts, monkeypatch):
    train, models = spark.createDataFrame(TRAIN, "sample_id int, grp string, text string"), ["general", "lm_g1", "lm_none"]
    labels, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df, label: labels.append(label) or keep(df, label))
    got = {(r[0], r[1]): r[2] for r in extract(train, texts, "grp", models).collect()}
    assert labels.count("scored-tokens") == 1
    tokens = S.score_texts(texts, S.fitted_lm(S.model_rows(train, "grp")), models)
    want = {(r[0], r[1]): r[2] for r in S.model_features(tokens, token_class(F.col("token"))).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert {k[1].split("__")[0] for k in got} == {"general", "lm_g1"}


@pytest.mark.parametrize("at_once", [1, 50, 1 << 22])
def test_pairs_counted_in_arrays(at_once, monkeypatch):
    """Runs of any length, many models, missing models, empty and missing token lists: sums over all runs are the plain counts."""
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    texts = [(f"m{k % 7}" if k % 11 else None, None if k % 13 == 5 else [f"w{(k * i) % 9}" for i in range(k % 6)]) for k in range(200)]
    want = Counter((m, a, b) for m, ts in texts for a, b in zip([S.START, *(ts or [])], ts or []))
    batch = pa.RecordBatch.from_arrays([pa.array([m for m, _ in texts]), pa.array([ts for _, ts in texts], pa.list_(pa.string()))], ["model", "tokens"])
    runs = list(S._pair_counting(3)(batch.slice(k, 30) for k in range(0, 200, 30)))
    assert {b["bucket"].to_pylist()[0] for b in runs} <= {0, 1, 2}
    rows = sorted((row for b in runs for row in zip(b["bucket"].to_pylist(), b["pairs"].to_pylist())), key=lambda row: row[0])
    dealt = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "pairs"])
    found = [r for b in S._pairs_added(iter([dealt])) for r in b.to_pylist()]
    assert len(found) == len(want) and {(r["model"], r["context"], r["token"]): r["n"] for r in found} == want
    assert not list(S._pair_counting(3)(iter([batch.slice(0, 0)]))) and not list(S._pairs_added(iter([])))


def test_pairs_of_very_many_models(monkeypatch):
    """Where numbers of models and words don't fit one integer, a run is halved."""
    tokens = [[f"w{k}", f"w{k + 1}"] for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"m{k % 5}" for k in range(40)]), pa.array(tokens)], ["model", "tokens"])
    monkeypatch.setattr(S, "KEY_BITS", 12)
    parts = [pa.ipc.read_record_batch(p.as_buffer(), S.PAIR_SCHEMA) for b in S._counted([batch], 2) for p in b["pairs"]]
    found = Counter((r["model"], r["context"], r["token"]) for p in parts for r in p.to_pylist() for _ in range(r["n"]))
    assert found == Counter((f"m{k % 5}", a, b) for k in range(40) for a, b in ((S.START, f"w{k}"), (f"w{k}", f"w{k + 1}")))


def test_scores_need_no_sorted_joins(spark, lm, texts):
    """Large tables of counts and running text meet hashed pairs, and text keys are not counted in hash tables before they are dealt out."""
    pairs = S.scored_pairs(texts)
    plan = S.pair_probs(pairs, lm, ["general"])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [model" in plan and "SortMergeJoin" not in plan
    counting = S.count_pairs(S.model_rows(spark.createDataFrame(TRAIN, "sample_id int, grp string, text string"), "grp"))
    assert "HashAggregate" not in counting._jdf.queryExecution().executedPlan().toString()


def test_stored_pairs_are_written_once(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(1, "a", "one two three one two"), (2, "b", "two three one"), (3, "b", None)], "sample_id int, grp string, text string")
    monkeypatch.setattr(S, "written", lambda *_: pytest.fail("pairs were written twice"))
    S.store_lm(S.model_rows(texts, "grp"), str(tmp_path), "general")
    got = {(r["model"], r["context"], r["token"]): r["n"] for r in S.load_pairs(spark, str(tmp_path)).collect()}
    whole = {}
    for (model, context, token), n in got.items():
        if model != "general":
            whole[context, token] = whole.get((context, token), 0) + n
    assert {(c, t): n for (m, c, t), n in got.items() if m == "general"} == whole and whole["two", "three"] == 2

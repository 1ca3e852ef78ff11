import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import agreement as A, joins as J, scale as SC, split as S
from gradeloom.operators.longtext import assign_batches, assign_chunks, dense_row_numbers, route


def test_skew_join_equals_plain_join(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(400)}") for i in range(5000)]
    left = spark.createDataFrame(rows, "id bigint, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 400, 2)], "k string, v int")
    for how in ("left", "inner"):
        got = SC.skew_join(left, right, ["k"], ["id"], how, hot_keys=50, salts=8)
        assert sorted(got.select("id", "k", "v").collect(), key=str) == sorted(left.join(right, "k", how).select("id", "k", "v").collect(), key=str)


def test_top_n_per_group(spark):
    rng = random.Random(2)
    rows = [("big" if i % 3 else f"g{i % 5}", f"t{i}", rng.randrange(50)) for i in range(900)]
    got = SC.top_n_per_group(spark.createDataFrame(rows, "g string, t string, n int"), ["g"], [F.col("n").desc(), F.col("t")], 7, ["t"], salts=4)
    want = defaultdict(list)
    for g, t, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        if len(want[g]) < 7:
            want[g].append(t)
    have = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        have[r["g"]].append(r["t"])
    assert have == want


def test_count_above_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), round(rng.random() ** 4, 3), rng.randrange(1, 5)) for _ in range(600)]
    data = [(g, v, n) for (g, v), n in Counter({(g, v): n for g, v, n in data}).items()]
    asks = [(rng.choice("abc"), round(rng.random() ** 4, 3)) for _ in range(200)] + [("a", 0.0), ("a", 5.0)]
    got = SC.count_above(
        spark.createDataFrame(data, "g string, v double, n int"), spark.createDataFrame(asks, "g string, v double"), ["g"], "v", "n", SC.log_bucket(F.col("v"))
    )
    assert {(r["g"], r["v"]): r["above"] for r in got.collect()} == {(g, v): sum(n for h, w, n in data if h == g and w > v) for g, v in asks}


def test_hash_quota_is_exact(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(1000)], "id bigint, s string")
    for share in (0.0, 0.1, 0.333, 1.0):
        assert S.split_random(df, "id", share).filter("split = 'test'").count() == math.ceil(1000 * share)
    assert S.hash_sample(df, "id", 37).count() == 37
    assert S.hash_sample(df, "id", 5000).count() == 1000
    a, b = (sorted(r["id"] for r in S.hash_sample(d, "id", 50).collect()) for d in (df, df.repartition(16)))
    assert a == b


def test_stratified_split_keeps_shares(spark):
    df = spark.createDataFrame([(i, i % 7 % 3) for i in range(1001)], "id bigint, s int")
    out = S.split_stratified(df, "id", "s", 0.2)
    n = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert out.count() == 1001 and sum(v for (_, k), v in n.items() if k == "test") == 201
    for s in range(3):
        assert abs(n[(s, "test")] - 0.2 * (n[(s, "test")] + n[(s, "train")])) <= 1


def test_one_row_per_key_is_joined_alike_beyond_the_broadcast(spark, monkeypatch):
    """The same split, ranks and ids whether the tables of strata and groups are broadcast or shuffled."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    pairs = spark.createDataFrame([("m" if i % 4 else f"g{i % 3}", i % 6, float(i * 37 % 11)) for i in range(400)], "model string, true_ord int, expected_value double")
    one = (S.split_stratified(df, "id", "s", 0.25).collect(), A.spearman(pairs, ("model",)).collect())
    assert {r.split for r in one[0]} == {"train", "test"} and len(one[0]) == 600 and len(one[1]) == 4
    monkeypatch.setattr(SC.join_per_key, "__defaults__", ("left", 0))
    monkeypatch.setattr(A, "MAX_GROUPS", 0)
    assert "_salt" in A.spearman(pairs, ("model",))._jdf.queryExecution().optimizedPlan().toString()
    two = (S.split_stratified(df, "id", "s", 0.25).collect(), A.spearman(pairs, ("model",)).collect())
    assert sorted(one[0]) == sorted(two[0])
    assert {r.model: round(r.spearman, 9) for r in one[1]} == {r.model: round(r.spearman, 9) for r in two[1]}


def test_long_lists_are_no_grid(spark):
    short, long = spark.range(3).toDF("a"), spark.range(100_000).toDF("b")
    assert J.grid(short, spark.range(4).toDF("b")).count() == 12
    with pytest.raises(ValueError):
        J.grid(short, long)
    with pytest.raises(ValueError):
        J.grid(short.limit(0), spark.range(300_000).toDF("b"))


def test_batches_and_chunks(spark):
    texts = spark.createDataFrame([(i, "x" * (40 if i % 4 else 4000)) for i in range(101)], "sample_id bigint, text string")
    routed = route(texts, 512)
    rows = assign_batches(routed, 16).collect()
    short = Counter(r["batch"] for r in rows if r["route"] == "short")
    long = Counter(r["batch"] for r in rows if r["route"] == "long")
    assert sorted(short.values(), reverse=True) == [16] * 4 + [11] and set(long.values()) == {1}
    chunks = assign_chunks(texts, 4).collect()
    assert [Counter(r["chunk"] for r in chunks)[k] for k in range(4)] == [26, 26, 26, 23]


def test_row_numbers_of_text_keys(spark):
    rows = [(g, hashlib.md5(f"{g}{i}".encode()).hexdigest()) for g, n in (("a", 900), ("b", 3), (None, 40)) for i in range(n)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, k string").repartition(13)
    for group in (["g"], []):
        got = [(r.g if group else None, r.row_idx, r.k) for r in dense_row_numbers(df, group, "k").collect()]
        want = []
        for g in {r[0] for r in rows} if group else [None]:
            keys = sorted((k for h, k in rows if not group or h == g), key=lambda k: (k is not None, k or ""))
            want += [(g, i, k) for i, k in enumerate(keys)]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert dense_row_numbers(df.filter("k = 'none'"), ["g"], "k").count() == 0


def test_counts_above_shuffle_the_masses_once(spark):
    data = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 2), ("a", 0.1, 4), ("b", 0.9, 8)], "g string, v double, n int")
    asked = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.5), ("b", 0.2)], "g string, v double")
    out = SC.count_above(data, asked, ["g"], "v", "n", SC.log_bucket(F.col("v")))
    assert sorted(map(tuple, out.collect())) == [("a", 0.1, 3), ("a", 0.5, 0), ("b", 0.2, 8)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [g" in plan
    physical = SC.count_above(data, asked, ["g"], "v", "n", SC.log_bucket(F.col("v")))._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("REPARTITION_BY_COL") <= 2

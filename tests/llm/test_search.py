"""Ranked lexical search against direct scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from gradeloom.llm import mask_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def direct(docs, items, limit):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, b, n in bags:
            m = 50 + 50 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out.extend((item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:limit]))
    return sorted(out, key=str)


def invented(n, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Été", "ÄB", "x1"]
    return [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 300])))) for k in range(n)]


def found(spark, docs, items, **given):
    d = spark.createDataFrame([Row(doc_id=i, text=t, rank=1, score="s", number=2, item="i") for i, t in docs], "doc_id long, text string, rank int, score string, number int, item string").repartition(4)
    q = spark.createDataFrame([Row(item_id=i, text=t, term="t") for i, t in items], "item_id long, text string, term string")
    return sorted([tuple(r) for r in mask_search.search(d, q, **given).collect()], key=str)


@pytest.mark.parametrize("limit, block_bytes", [(3, 1 << 24), (50, 200)])
def test_equal_to_direct_scores(spark, limit, block_bytes):
    docs = invented(150) + [(900, "w1 w2 w3"), (901, "w1 w2 w3"), (901, "w1 w2 w3"), (None, "w1 w2 w3"), (902, None), (903, ""), (904, " .,- "), (905, "w7 " * 30000)]
    items = [(k, t) for k, (_, t) in enumerate(invented(12, 7))] + [(50, None), (51, ""), (52, "absentword"), (None, "w1 w2 w5"), (53, "ÉTÉ été w1 W2"), (0, "extra w2 w3")]
    assert found(spark, docs, items, limit=limit, block_bytes=block_bytes) == direct(docs, items, limit)


def test_small_blocks_and_wide_masks(spark, monkeypatch):
    docs = invented(300, 3)
    items = [(1, " ".join(f"w{k}" for k in range(150))), (2, "w1 w2")]
    assert found(spark, docs, items, limit=7) == direct(docs, items, 7)


def test_blocks_hold_what_they_are_given():
    r = np.random.default_rng(1)
    docs, counts = [], []
    for d in range(41):
        own = r.choice(70, r.integers(0, 30), replace=False)
        docs.append(own)
        counts.append(r.integers(1, 5, len(own)))
    flat = np.concatenate(docs)
    block = mask_search.Block(np.arange(41), np.ones(41, bool), r.integers(50, 99, 41), flat, np.repeat(np.arange(41), [len(d) for d in docs]), np.concatenate(counts), 70)
    for own in (np.array([3]), np.arange(0, 70, 2), np.arange(70)):
        masks, of = block.masks(own)
        assert len({m.tobytes() for m in masks}) == len(masks)
        for d in range(41):
            assert masks[of[d]].tolist() == [int(t in docs[d]) for t in own]


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**12], np.int64)
    assert mask_search.lengths(n, 10**7, 10**13).tolist() == [50, 50 + 50 * 10**19 // 10**13]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "w1")]) == []
    assert found(spark, [(1, "w1")], []) == []
    assert found(spark, [(1, None)], [(1, "w1")]) == []

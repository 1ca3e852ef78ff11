"""The prefix trie against nodes listed one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from gradeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, path string"


def table(spark, rows):
    return spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, conv="c", pos=1, path="p") for c, t, r, x in rows], SCHEMA).repartition(3)


def remainder(c):
    return c - 5 * int(c / 5)  # its sign is that of c


def direct(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        s = tuple(own.get(c - remainder(c), [])[:h] + ts[h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, cs in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(cs) - 1) * len(s[-1][1].encode()) if s else 0
    sha = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return sorted(
        ((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), kids.get(s, 0), leaves[s], saved[s], sha(s)) for s, cs in members.items()), key=str,
    )


def invented(n, most, seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            rows.append((c, t, "user" if t % 2 else None, r.choice(["a", "b", "é" * 5, None]) if t < 12 else "tail"))
    return rows


AWKWARD = [
    (-7, 1, "user", "x"), (-5, 1, "user", "x"), (3, None, None, None), (3, None, "user", "first"), (3, 1, "user", "first"), (3, 1, "user", "first"),
    (None, 1, "user", "lost"), (8, 70_000_000, "a", "late"), (8, 1, "a", "early"), (8, None, "a", "none"), (900, 0, "u", "z" * 9000), (10**15, 5, "", ""), (10**15 + 1, 5, "", ""),
]


def found(spark, rows, **given):
    out = prefix_trie.nodes(*prefix_trie.rebuilt(table(spark, rows)), **given)
    return sorted((tuple(r) for r in out.select("conv", "depth", "parent", "n", "children", "leaves", "saved", "ends").collect()), key=str)


@pytest.mark.parametrize("given", [{}, {"shard_bytes": 2000, "fan_in": 2}, {"segment": 3, "shard_bytes": 900, "fan_in": 3}])
def test_equal_to_nodes_one_by_one(spark, given):
    rows = invented(120, 9) + AWKWARD + [(2000 + c, t, "user", "same") for c in range(60) for t in range(4)]
    assert found(spark, rows, **given) == direct(rows)


def test_long_conversation_in_many_segments(spark):
    rows = [(c, t, "u", str(t % 7) if c < 3 or t < 40 else "x") for c in (0, 1, 2, 5) for t in range(60)]
    assert found(spark, rows, segment=8, shard_bytes=500) == direct(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_ids_hashed_in_runs(spark, monkeypatch):
    members = spark.createDataFrame([(bytes([k % 3]), k) for k in range(20_000)], "key binary, conv long").repartition(5)
    got = {bytes(r["key"]): r["ends"] for r in prefix_trie.id_digests(members).collect()}
    assert got == {bytes([m]): hashlib.sha256(",".join(str(k) for k in range(m, 20_000, 3)).encode()).hexdigest() for m in range(3)}


@pytest.mark.parametrize("seed", range(6))
def test_double_array_keeps_every_child(seed):
    r = np.random.default_rng(seed)
    n_turns = int(r.integers(1, 200))
    trie, level, kept, taken = prefix_trie.DoubleArray(n_turns, 10), np.array([0]), {}, {0}
    for _ in range(6):
        pairs = sorted({(int(p), int(t)) for p in level for t in r.integers(0, n_turns, r.choice([0, 1, 1, 3, 40]))})
        if not pairs:
            break
        parents, turns = (np.array(x, np.int64) for x in zip(*pairs))
        level = trie.add(parents, turns)
        assert len(set(level)) == len(level) and not taken & set(level.tolist())
        taken |= set(level.tolist())
        kept.update(zip(pairs, level.tolist()))
        level = r.choice(level, min(len(level), 60), replace=False)
        level.sort()
    for (p, t), slot in kept.items():
        assert trie.step(np.array([p]), np.array([t]))[0] == slot
    for p in {p for p, _ in kept}:
        for t in range(n_turns):
            assert trie.step(np.array([p]), np.array([t]))[0] == kept.get((p, t), -1)

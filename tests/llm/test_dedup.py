"""Repeated byte strings, near copies and exact copies against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import exact_dedup, jaccard_join, suffix_dedup
from gradeloom.llm.common import written_at
from tests.llm.conftest import invented, texts

LOWER = {c: c + 32 for c in range(65, 91)}


def test_merge_finds_all_repeats():
    r = random.Random(2)
    for _ in range(25):
        base = [bytes(r.choice(b"ab") for _ in range(r.randint(10, 80))) for _ in range(3)]
        strings = [b"".join(r.choice(base)[: r.randint(0, 80)] for _ in range(r.randint(0, 6))) + r.choice([b"", b"\0\0\0", b"a" * 30]) for _ in range(r.randint(1, 8))]
        for length in (16, 24):
            seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
            wanted = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
            assert [f.tolist() for f in suffix_dedup.repeated_windows(strings, length, r.randint(1, 5))] == wanted


def test_merge_gives_common_prefixes():
    strings = [b"abcdefgh" * 3, b"abcdefgh" * 2 + b"ABCDEFGH", b"zzzzzzzz"]
    assert [f.any() for f in suffix_dedup.repeated_windows(strings, 16)] == [True, True, False]


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    assert suffix_dedup.sliding_min(v, 169).tolist() == [v[i : i + 169].min() for i in range(500 - 168)]


def brute_removed(rows):
    data = [(t or "").encode() for _, t in rows]
    n = suffix_dedup.LENGTH
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        out.append((hashlib.sha256(bytes(c for c, v in zip(d, cover) if not v)).hexdigest(), sum(cover), len([x for x in bytes(cover).split(b"\0") if x])))
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 700])
def test_suffix_dedup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    out = suffix_dedup.removed(docs)
    assert set(out.schema["record"].dataType.names) == {"doc_id", "score", "spans", "kept"}
    got = [(r.record.doc_id, hashlib.sha256(r.kept).hexdigest(), sum(s.end - s.start for s in r.spans), len(r.spans)) for r in out.collect()]
    assert Counter(got) == Counter((i, *b) for (i, _), b in zip(texts(), brute_removed(texts())))


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w]
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(len(words) - 5, 0) + 1)} if words else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile_sets", [2000, 1])
def test_jaccard_join(docs, tile_sets):
    rows = [(i, t) for i, t in texts() if i is not None]
    got = [(r.id, r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, tile_sets=tile_sets).collect()]
    wanted = brute_classes(rows)
    assert Counter(g for g in got if g[0] is not None) == Counter((i, *wanted[i]) for i, _ in rows)
    assert {g[2] for g in got if g[0] is None} == {None, 1} or {g[2] for g in got if g[0] is None} == {None}


def tiled(sets):
    """Members of each tile, of sets of numbers whose order is the numbers' own."""
    columns = [], [], []
    for key, s in enumerate(sets, 1):
        for place, token in enumerate(sorted(s)[: jaccard_join.prefix_length(len(s))]):
            for column, v in zip(columns, (token, key, len(s) << 32 | place)):
                column.append(v)
    out = defaultdict(set)
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "short_key", "size_place"])
    for b in jaccard_join._tiling(75)(iter([batch])):
        for r in b.to_pylist():
            out[r["leader"], r["band"]].add(r["short_key"])
    return out


def test_tiles_of_few_sets_follow_places():
    """Linked sets share a tile; sets that meet by chance behind too much of their own make none."""
    r = random.Random(5)
    for groups in (1, 4, 12):  # at a shingle: two sets, some, more than are looked at in pairs
        sets = []
        for _ in range(25):
            base = r.sample(range(4000), r.randint(1, 60))
            for _ in range(groups):
                sets.append(set(r.sample(base, max(1, len(base) - r.randint(0, 8)))) | set(r.sample(range(4000), r.randint(0, 6))))
        sets = [set(s) for s in {frozenset(s) for s in sets}]
        tiles, linked = tiled(sets), 0
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    linked += 1
                    assert any({a + 1, b + 1} <= t for t in tiles.values())
        assert linked or groups == 1
    own = [set(range(100 * k, 100 * k + 79)) for k in range(8)]
    assert not tiled([s | {99 + 100 * (k | 1)} for k, s in enumerate(own)])  # met at the last place of two sets each
    assert not tiled([set(range(1000 * k, 1000 * k + 20)) | {9000} | set(range(10000 + 1000 * k, 10059 + 1000 * k)) for k in range(3)])  # within the prefixes, behind 20 of 80


def test_jaccard_join_on_many_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 400)}" for _ in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(80)] = f"n{r.randint(0, 9)}"
        rows.append((i, " ".join(words[: r.randint(60, 80)])))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), tile_sets=40).collect()}
    assert got == brute_classes(rows)


def test_jaccard_join_with_passages_of_dissimilar_documents(spark):
    """Near copies whose passage others quote link, also where the smallest key at a shingle is that of a document like none."""
    rows = []
    for g in range(12):
        passage, body = invented(1000 + g, 30).split(), invented(2000 + g, 90).split()
        for copy in range(3):
            rows.append((len(rows), " ".join(body[:40] + passage + body[40:] + [f"end{copy}"])))
        for other in range(8):
            rows.append((len(rows), " ".join(invented(3000 + 8 * g + other, 90).split()[:45] + passage + invented(4000 + 8 * g + other, 45).split())))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_gathered_keeps_all_members(spark):
    """Tiles whose leader is no member stay, and sets that share a tile share one afterwards."""
    tiles = [(1, 0, 5), (1, 0, 6), (5, 0, 5), (5, 0, 7), (6, 1, 7), (6, 1, 8)]
    stored = written_at(spark.createDataFrame(tiles, "leader bigint, band bigint, short_key bigint"), "tiles")
    got = {tuple(r) for r in jaccard_join.gathered(*stored)[0].collect()}
    assert got == {(1, 0, 5), (1, 0, 6), (1, 0, 7), (6, 1, 7), (6, 1, 8)}


def test_overlap_bound_is_an_upper_bound():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 3000, r.integers(1, 2000)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {n: n for e in edges for n in e}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == root(n) for n in parent)


def test_jaccard_keeps_one(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    wanted = brute_classes([(i, t) for i, t in texts() if i is not None])
    assert {i for i in ids if i is not None} == {c for _, c in wanted.values()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.md5(t.cast("binary")), 1, 1), lambda t: F.lit("same")])
def test_exact_dedup(docs, digest):
    rows = exact_dedup.classes(docs, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    assert len(rows) == len(texts())
    sizes = Counter((r.id, r.keep_id, r.group_size) for r in rows)
    wanted = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert sizes == wanted
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_remembers(spark, docs, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    docs.filter("doc_id < 3").write.parquet(path)
    exact_dedup.classes_of_files(spark, path, checkpoint=state)
    docs.filter("doc_id = 18").write.mode("append").parquet(path)
    rows = exact_dedup.classes_of_files(spark, path, checkpoint=state, max_files=1).collect()
    assert {(r.id, r.keep_id, r.group_size) for r in rows} == {(1, 18, 4), (2, 18, 4), (18, 18, 4)}
    assert sum(r.kept for r in rows) == 1


def test_exact_dedup_keeps_rows(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "" for _, t in texts()})


def test_empty_tables(nothing):
    assert suffix_dedup.removed(nothing).count() == 0
    assert jaccard_join.linked(nothing).count() == 0
    assert exact_dedup.classes(nothing).count() == 0


def test_sketch_orders_by_frequency():
    """Cells hold what all tasks counted, and grow with the bytes of the texts within their bounds."""
    counts = np.zeros(jaccard_join.SKETCH_BLOCK, np.uint8)
    counts[:5] = [1, 2, 3, 200, 255]
    packed = zstandard.ZstdCompressor().compress(counts.tobytes())
    rows = pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([packed, packed], pa.binary())], ["block", "counts"])
    (out,) = jaccard_join._classing(iter([rows]))
    classes = jaccard_join._classes(out.to_pylist(), 20)[3 * jaccard_join.SKETCH_BLOCK :][:6].astype(int)
    assert (np.diff(classes[:5]) > 0).all() and classes[5] == 0
    assert [jaccard_join.sketch_bits(n) for n in (0, 24 << 22, 1 << 40)] == [20, 22, 27]


def test_names_of_the_input_stay(spark):
    rows = spark.createDataFrame([(1, "a", "x", 10), (2, "a", "y", 20)], "doc_id long, text string, __file string, __row int")
    assert [tuple(r) for r in exact_dedup.keep_one(rows).collect()] == [(2, "a", "y", 20)]

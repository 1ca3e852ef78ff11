"""Set-similarity join on word shingles, and the classes of linked documents.

A document's set are its distinct shingles of five words (the whole sequence
as one where there are fewer words). Two documents link when
``100 * |A & B| >= threshold * |A | B|``. The join is exact:

1. Every document's set gets a 128-bit key; equal sets are one class from here
   on, so a group of copies, however large, is one set. A sketch counts the shingles of
   all documents; its cells grow with the bytes of the texts, to a bound, and tasks
   send theirs compressed.
2. Shingles are ordered from rare to frequent by the sketch, ties by hash. Two
   sets that link share a shingle among the first ``|A| - ceil(t |A|) + 1`` of
   each in this order; only those are sent out. A shingle that a large share of all
   documents has comes last in the order and is not among them, unless the
   whole set is frequent. With each goes its place in the set: few sets that share one rare
   shingle by chance can still link, as what stands before the first common one is lost.
3. Sets that meet at a shingle and whose sizes lie in the same or in
   neighbouring bands form a tile. Bands are as wide as sizes of linked sets can
   differ, and shingles with the same first set share their tile, so a group
   of near copies meets in few tiles; where sets pass the bitmaps, a tile whose leader
   meets a smaller one in another tile moves there as a whole. Tiles with more than ``tile_sets`` sets are
   laid out as pairs of blocks, so that none grows with its group.
4. In a tile, hashed bitmaps bound the overlap of two sets from above: of the
   bits that A has and B lacks, each stands for an element of A that is not in
   B. Bitmaps of 2048 bits travel first; only sets with a partner that the bounds
   leave possible are read, and intersected exactly as sorted arrays. Sets already linked
   through others are not compared again: a tile returns a spanning forest, not
   all pairs.
5. Classes are the connected components of the returned links, found by
   alternating large-star and small-star steps on written tables.

Shingles are 64-bit hashes of their words; two different shingles of one pair
of documents collide with a probability near 1e-13.

Defined cases: null and empty texts, and texts without words, have no shingles
and link with nothing, each other included; rows with the same identifier are
each judged by their own text; an empty table gives an empty result.
Rows with a null identifier are returned with a null class and link with nothing. The
result has its own columns, so input columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import discard, pieces, require, ship_code, written, written_at

WORDS = 5
THRESHOLD = 75
SKETCH_BITS = (20, 27)  # least and most; a cell is a byte in the tasks and on the driver
SKETCH_LOAD = 4  # shingles a cell, as far as the most bits allow
SKETCH_BLOCK = 1 << 18  # cells that one row holds
BITMAP_WORDS = 32
LINK_WORDS = 256  # where the sets are at hand, wide bitmaps leave few intersections that fail
TILE_SETS = 2000
PAIRED = 8  # sets at a shingle that are looked at in pairs
HOPS = 3
POSTINGS_A_TASK = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


# --------------------------------------------------------------------- sets


class _WordHashes(dict):
    def __init__(self, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, hashes: dict[bytes, int], k: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes. Words are what lies between ASCII blanks, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _BASE + h[j : len(words) - n + 1 + j]
    return np.unique(_mixed(out))


# ------------------------------------------------- pass 1: keys and the sketch


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def sketch_bits(n_bytes: int) -> int:
    """Bits of a cell's number for texts of so many bytes, at about six bytes a shingle."""
    least, most = SKETCH_BITS
    return min(max(math.ceil(math.log2(max(n_bytes, 1) / 6 / SKETCH_LOAD)), least), most)


def _keys(k: int, bits: int):
    names = ["id", "n_shingles", "key", "short_key", "signature", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = _WordHashes(), np.zeros(1 << bits, np.uint8)
        ids = None
        for batch in pieces(batches, "text"):
            sets = [shingle_set(t, hashes, k) for t in batch.column("text").to_pylist()]
            keys = [set_key(s) for s in sets]
            cells, times = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            sketch[cells] = np.minimum(sketch[cells] + times, 255)  # a task's count ends there: frequent is frequent
            ids, n = batch.column("id"), len(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([_short(key) for key in keys], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if ids is not None:
            pack = zstandard.ZstdCompressor(level=1).compress
            for block, part in enumerate(np.split(sketch, len(sketch) // SKETCH_BLOCK)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names)

    return run


def _classing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, counts) sorted by block to each block's frequency classes, six for each doubling."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, total = None, None

    def ended() -> pa.RecordBatch:
        classes = np.minimum(6 * np.log2(1.0 + total), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(classes.tobytes())], pa.binary())], ["block", "classes"])

    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            if block != now:
                if now is not None:
                    yield ended()
                now, total = block, np.zeros(SKETCH_BLOCK, np.int64)
            total += np.frombuffer(unpack(counts.as_py()), np.uint8)
    if now is not None:
        yield ended()


def _classes(sketch: list, bits: int) -> np.ndarray:
    """Frequency class of each cell."""
    out = np.zeros(1 << bits, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in sketch:
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(unpack(r["classes"]), np.uint8)
    return out


# -------------------------------------------------- pass 2: prefixes and tiles


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def _prefixes(shared, k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, frequency = _WordHashes(), shared.value
        shift = np.uint64(64 - int(math.log2(len(frequency))))
        seen: set[bytes] = set()  # equal sets of this task; the keys of a task, not of the table
        for batch in pieces(batches, "text"):
            tokens, keys, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, hashes, k)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                # The set is sorted by hash, and a stable sort keeps that order in a class.
                order = np.argsort(frequency[s >> shift], kind="stable")
                first = s[order[: prefix_length(len(s), threshold)]]
                tokens.append(first)
                keys.append(np.full(len(first), _short(key), np.int64))
                sizes.append(len(s) << 32 | np.arange(len(first)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["token", "short_key", "size_place"])

    return run


def band_of(size: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Sets whose sizes allow a link lie in the same or in neighbouring bands."""
    return np.floor(np.log(size) / np.log(100 / threshold) + 1e-9).astype(np.int64)


def may_link(token: np.ndarray, size: np.ndarray, place: np.ndarray, threshold: int = THRESHOLD, most: int = PAIRED) -> np.ndarray:
    """Of sets sorted by shingle, those that may link with another of the shingle, if it is the first that both have.

    What comes before the first common shingle in one of the sets, ``place`` elements, the other lacks. Every link has a
    first common shingle, so none is lost. Of more than ``most`` sets at a shingle all pass.
    """
    begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    counts = np.diff(np.r_[begins, len(token)])
    of = np.repeat(counts, counts)
    out, left, a = of > most, size - place, np.flatnonzero((of > 1) & (of <= most))
    for step in range(1, most):
        a = a[a + step < len(token)]
        a = a[token[a + step] == token[a]]
        b = a + step
        least = -(-threshold * (size[a] + size[b]) // (100 + threshold))
        fits = (np.minimum(left[a], left[b]) >= least) & (100 * np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
        out[a[fits]] = out[b[fits]] = True
    return out


def _tiling(threshold: int):
    """Takes all postings of some shingles, gives (tile, short_key) for sets that meet and, by their places, may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        token, key, size_place = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in ("token", "short_key", "size_place"))
        del some
        band = band_of(size_place >> 32, threshold)
        order = np.lexsort((key, band, token))
        token, key, band, size_place = token[order], key[order], band[order], size_place[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (band[1:] != band[:-1])
        token, key, band, size_place = token[fresh], key[fresh], band[fresh], size_place[fresh]
        fits = may_link(token, size_place >> 32, size_place & 0xFFFFFFFF, threshold)
        token, key, band = token[fits], key[fits], band[fits]
        if not len(token):
            return
        # Runs of one shingle and one band, and which of them have a neighbour above.
        begins = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1])])
        sizes = np.diff(np.r_[begins, len(token)])
        above = np.zeros(len(begins), bool)
        above[:-1] = (token[begins[1:]] == token[begins[:-1]]) & (band[begins[1:]] == band[begins[:-1]] + 1)
        below = np.r_[False, above[:-1]]
        run_of = np.repeat(np.arange(len(begins)), sizes)
        leader = key[begins]  # the smallest key of the run
        lower = np.where(above | (~below & (sizes > 1)), leader, 0)
        own = above[run_of] | (~below & (sizes > 1))[run_of]
        tile_a = np.stack([lower[run_of][own], band[own], key[own]])
        up = below[run_of]
        tile_b = np.stack([leader[run_of[up] - 1], band[up] - 1, key[up]])
        tile, at, member = np.concatenate([tile_a, tile_b], axis=1)
        order = np.lexsort((member, at, tile))
        tile, at, member = tile[order], at[order], member[order]
        fresh = np.ones(len(tile), bool)
        fresh[1:] = (tile[1:] != tile[:-1]) | (at[1:] != at[:-1]) | (member[1:] != member[:-1])
        tile, at, member = tile[fresh], at[fresh], member[fresh]
        yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(at), pa.array(member)], ["leader", "band", "short_key"])

    return run


# ------------------------------------------------------------ pass 3: in a tile


def bitmap(s: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    bits = np.zeros(words * 64, bool)
    bits[(s >> np.uint64(7)) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.uint64)


def linked_sets(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Exact, on sorted arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def links_in_tile(sets: list[np.ndarray], threshold: int = THRESHOLD, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets; ``left``: only pairs of a left and a right one."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, ranked = size[order], [sets[i] for i in order]
    side = None if left is None else left[order]
    maps = np.stack([bitmap(s, LINK_WORDS) for s in ranked])
    component, partner = np.arange(n), 0
    out: list[tuple[int, int]] = []
    for i in range(1, n):
        first = int(np.searchsorted(size, -(-threshold * size[i] // 100), "left"))
        if first >= i:
            continue
        at = np.arange(first, i)
        if side is not None:
            at = at[side[first:i] != side[i]]
        # Most sets of a tile belong together; a link to the neighbour or to the last partner spares the rest.
        for j in {i - 1, partner}:
            if j in range(first, i) and (side is None or side[j] != side[i]) and component[j] != component[i] and linked_sets(ranked[i], ranked[j], threshold):
                out.append((int(order[i]), int(order[j])))
                component[component == component[i]] = component[j]
                partner = j
        at = at[component[at] != component[i]]
        for at in _parts(at):
            bound = _bound(size[i], maps[i], size[at], maps[at])
            fits = (100 + threshold) * bound >= threshold * (size[i] + size[at])
            rest = at[fits][np.argsort(-bound[fits], kind="stable")]
            while len(rest):
                j = int(rest[0])
                rest = rest[1:]
                if component[j] == component[i]:
                    continue
                if linked_sets(ranked[i], ranked[j], threshold):
                    out.append((int(order[i]), int(order[j])))
                    component[component == component[i]] = component[j]
                    rest, partner = rest[component[rest] != component[j]], j
    return out


def _parts(at: np.ndarray, most: int = 4096) -> Iterator[np.ndarray]:
    for k in range(0, len(at), most):
        yield at[k : k + most]


def hopeful(size: np.ndarray, maps: np.ndarray, threshold: int = THRESHOLD, left: np.ndarray | None = None, rows: int = 512) -> np.ndarray:
    """Which sets of a tile have another one whose size and bitmap leave a link possible; compares blocks of ``rows`` sets."""
    order = np.argsort(size, kind="stable")
    size, maps = size[order], maps[order]
    side = None if left is None else left[order]
    own = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # elements that share a bit with another of the set
    bits = lambda part: np.unpackbits(maps[part].view(np.uint8), axis=1).astype(np.float32)
    found = np.zeros(len(size), bool)
    for a in range(0, len(size), rows):
        one = slice(a, a + rows)
        ones = bits(one)
        for b in range(a, len(size), rows):
            two = slice(b, b + rows)
            if 100 * size[one][-1] < threshold * size[two][0]:
                break
            # The bound of _bound: bits that both have, and elements behind shared bits.
            both = ones @ (ones if a == b else bits(two)).T
            bound = both + np.minimum(own[one][:, None], own[two])
            fits = ((100 + threshold) * bound >= threshold * (size[one][:, None] + size[two])) & (100 * size[one][:, None] >= threshold * size[two])
            if a == b:
                fits &= np.triu(np.ones_like(fits), 1)
            if side is not None:
                fits &= side[one][:, None] != side[two]
            found[one] |= fits.any(axis=1)
            found[two] |= fits.any(axis=0)
    out = np.zeros(len(size), bool)
    out[order] = found
    return out


def _bound(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The overlap is at most this: each bit that only one set has stands for an element that the other lacks."""
    return np.minimum(size - np.bitwise_count(bits & ~others).sum(axis=1), sizes - np.bitwise_count(others & ~bits).sum(axis=1))


def _screening(threshold: int):
    """Takes rows in tile order, gives ``(leader, band, short_key)`` of the sets that may link in their tile."""
    names = ["leader", "band", "one", "two", "short_key", "half", "size", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            maps = np.frombuffer(b"".join(r[7] for r in rows), np.uint64).reshape(len(rows), BITMAP_WORDS)
            left = None if now[2] == now[3] else np.array([r[5] for r in rows])
            keep = [r for r, h in zip(rows, hopeful(np.array([r[6] for r in rows]), maps, threshold, left)) if h]
            if keep:
                columns = [pa.array([r[k] for r in keep], pa.int64()) for k in (0, 1, 4)]
                yield pa.RecordBatch.from_arrays(columns, ["leader", "band", "short_key"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:4] != now:
                    yield from ended()
                    now, rows = row[:4], []
                rows.append(row)
        yield from ended()

    return run


def _linking(k: int, threshold: int):
    """Takes rows in tile order (leader, band, one, two, rep, key, half, text), gives links between representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        now, reps, sets, halves = None, [], [], []

        def ended() -> pa.RecordBatch | None:
            if now is None or len(reps) < 2:
                return None
            left = None if now[2] == now[3] else np.array(halves)
            found = links_in_tile(sets, threshold, left)
            return pa.RecordBatch.from_arrays([pa.array([reps[a] for a, _ in found], pa.int64()), pa.array([reps[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in pieces(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("leader", "band", "one", "two", "rep", "key", "half", "text")]
            for leader, band, one, two, rep, key, half, text in zip(*columns):
                if (leader, band, one, two) != now:
                    if (out := ended()) is not None and out.num_rows:
                        yield out
                    now, reps, sets, halves = (leader, band, one, two), [], [], []
                s = shingle_set(text, hashes, k)
                if set_key(s) == key:  # else another text under the same identifier
                    reps.append(rep)
                    sets.append(s)
                    halves.append(half)
        if (out := ended()) is not None and out.num_rows:
            yield out

    return run


# ------------------------------------------------------------------- components


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for the nodes of the edges ``(a, b)``: the smallest node reachable."""
    spark = edges.sparkSession
    now, path = written_at(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        # Large star: neighbours above a node go to its smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a")
        small = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        small, small_path = written_at(small, label)
        state = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(spark, path)
        now, path = small, small_path
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


# ---------------------------------------------------------------------- operator


def laid_out(members: DataFrame, tile_sets: int) -> DataFrame:
    """Tiles as pairs of blocks of about ``tile_sets`` sets: ``leader, band, one, two, short_key, half``; ``half``: in the first block.

    Only tiles of more than one block are listed, which are few; all others need no look-up of their size.
    """
    blocks = members.groupBy("leader", "band").agg(F.ceil(F.count(F.lit(1)) / tile_sets).cast("int").alias("blocks")).filter("blocks > 1")
    placed = members.join(written(blocks, "join-blocks"), ["leader", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("short_key"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("one"), F.greatest("block", j).alias("two")))
    laid = placed.select("leader", "band", "short_key", "block", F.inline(pairs))
    return laid.withColumn("half", F.col("block") == F.col("one")).drop("block")


def gathered(members: DataFrame, path: str, hops: int = HOPS) -> tuple[DataFrame, str]:
    """Fewer tiles with the same sets together: a tile goes where its leader meets a smaller one, with all its sets.

    A leader is a member of its own tile only if the screening left it there; a tile whose leader meets none stays.
    """
    for _ in range(hops):
        parents = members.groupBy(F.col("short_key").alias("leader"), "band").agg(F.min("leader").alias("parent"))
        moved = members.join(parents, ["leader", "band"], "left").select(F.least("parent", "leader").alias("leader"), "band", "short_key")
        following, new = written_at(moved.distinct(), "join-meetings")
        discard(members.sparkSession, path)
        members, path = following, new
    return members, path


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, threshold: int = THRESHOLD, tile_sets: int = TILE_SETS) -> DataFrame:
    """One row per row: ``id, n_shingles, component_id`` (smallest identifier reachable by links, itself included)."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bits = sketch_bits(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    found = written(texts.mapInArrow(_keys(k, bits), "id bigint, n_shingles bigint, key binary, short_key bigint, signature binary, block int, counts binary"), "join-keys")
    keyed = found.filter("block is null").drop("block", "counts")
    parts = found.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
    sketch = parts.mapInArrow(_classing, "block int, classes binary").collect()  # 2 ** bits bytes at most, compressed
    shared = spark.sparkContext.broadcast(_classes(sketch, bits))
    del sketch
    shingles = keyed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles * (100 - threshold) // 100 // POSTINGS_A_TASK)

    reps = keyed.filter("n_shingles > 0 and id is not null").groupBy("key", "short_key").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")
    )
    postings = texts.filter("id is not null").mapInArrow(_prefixes(shared, k, threshold), "token bigint, short_key bigint, size_place bigint")
    members = postings.repartition(tasks, "token").mapInArrow(_tiling(threshold), "leader bigint, band bigint, short_key bigint").distinct()
    tile = ["leader", "band", "one", "two"]
    met, met_path = written_at(members, "join-meetings")
    shared.unpersist()
    signed = laid_out(met, tile_sets).join(reps.select("short_key", "size", "signature"), "short_key")
    screened = signed.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_screening(threshold), "leader bigint, band bigint, short_key bigint")
    kept, kept_path = written_at(screened.distinct(), "join-meetings")
    discard(spark, met_path)
    members, kept_path = gathered(kept, kept_path)
    laid = laid_out(members, tile_sets).join(reps.select("short_key", "rep", "key"), "short_key")
    wanted = laid.groupBy("rep").agg(F.collect_list(F.struct("leader", "band", "one", "two", "key", "half")).alias("tiles"))
    source = texts.join(wanted, texts["id"] == wanted["rep"]).select("rep", "text", F.inline("tiles"))
    tiles = source.repartition(*tile).sortWithinPartitions(*tile)
    edges, edges_path = written_at(tiles.mapInArrow(_linking(k, threshold), "a bigint, b bigint"), "join-links")
    discard(spark, kept_path)
    found_components = components(edges)
    discard(spark, edges_path)
    classes = reps.join(found_components, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return keyed.drop("signature").join(classes, "key", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose identifier is that of their class: one document of each group stays, with all its columns.

    Rows that share an identifier stay or go together.
    """
    stay = linked(docs, id_col, text_col).filter("id = component_id or id is null").select(F.col("id").alias("__id")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__id"]), "left_semi")

"""Prefix trie of conversations, built as double arrays per prefix shard.

``rebuilt`` makes the conversations (each takes its first turns from another
one, as the contract of the registered query says), ``nodes`` the trie over any
table ``(conv, pos, turn)`` of numbered turns.

1. A turn is named by 128 bits of the SHA-256 of its role and text and by the
   bytes of its text (``KEY`` bytes together); texts travel no further. A
   conversation is the concatenation of its turns' names. Equal conversations
   become one row with their number, smallest id and the digest of their ids.
2. The distinct conversations are range-partitioned in lexicographic order, so
   each task holds a shard of neighbouring prefixes. It numbers its turns
   densely and packs one double-array trie, level by level: the child of node s
   under turn t lies at ``BASE[s] + t`` and is one if ``CHECK`` there is s. All
   conversations of the shard then walk the arrays together, adding up nodes.
3. Only the nodes on a shard's first and last path can occur in other shards
   too. These upper nodes' paths go, with what the shard knows of them, through
   the same step again, ``FAN_IN`` shards a task, until one task is left; all
   other nodes are final at once. However many conversations share a prefix,
   they spread over shards, and the merge sees two paths of each.
4. Nodes directly below an upper node take its smallest id by a join on the
   prefix's digest that spreads frequent keys.

Conversations longer than ``SEGMENT`` turns are cut there. A segment hangs on
the digest of all before it; the segments' tries are made from the deepest up,
and the root of a deeper one fills the end of the path above, so no row holds
more than ``SEGMENT`` turns. The number of segments of the longest conversation
is the number of rounds. Turns are numbered in buckets of turn values, and ids are
hashed as a stream of sorted runs, so neither a long conversation nor a large
group of equal ones is held whole.

Defined cases: a null role or text is the empty string; a null turn comes first;
turns of equal number go by their digest; repeated rows are turns of their own;
rows without a conversation id belong to none and are left out; a conversation
without turns after rebuilding is a member of the root and ends there; an empty
table has no conversation and hence no node. Only the named columns are read, so
no other name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.llm.common import require, ship_code, written
from gradeloom.operators.scale import skew_join

#: Bytes of a turn's name: 16 of its digest, 8 of the size of its text.
KEY = 24
#: Turns of one segment, and bytes of the paths that one task packs.
SEGMENT = 1024
SHARD_BYTES = 16 << 20
FAN_IN = 64
#: Turn values of one bucket, in which turns are ranked.
BUCKET = 1 << 16
#: Most turns that the registered query takes from another conversation.
MOST_HEAD = 8
RUN_BYTES = 1 << 16


def turn_name(role: Column, text: Column) -> Column:
    """``KEY`` bytes that equal turns share."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")))


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, pos, turn)``: the turns of each conversation by number, from 0, under their names."""
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("at"),
        turn_name(F.col(f"`{role_col}`"), F.col(f"`{text_col}`")).alias("turn"),
    ).filter("conv IS NOT NULL")
    rows = rows.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    rows = written(rows.withColumn("bucket", F.coalesce("bucket", F.lit(-(1 << 62)))), "trie-turns")
    sizes = rows.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("conv", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv", "bucket").orderBy(F.col("at").asc_nulls_first(), "turn")) - 1
    return rows.withColumn("inside", inside).join(starts, ["conv", "bucket"]).select("conv", (F.col("before") + F.col("inside")).alias("pos"), "turn")


def rebuilt(turns: DataFrame, every: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, turn)`` of the rebuilt conversations, and ``(conv, n)`` of all, those without turns too.

    Conversation c takes the first h = crc32(c) mod 9 turns of conversation
    c - c mod ``every`` and goes on with its own turns after its first h.
    """
    require(turns, conv_col, turn_col, role_col, text_col)
    rows = written(numbered(turns, conv_col, turn_col, role_col, text_col), "trie-numbered")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_HEAD + 1)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    given = sizes.select(F.col("conv").alias("source"), F.least("own", F.lit(MOST_HEAD)).alias("has"))
    convs = sizes.select("conv", "own", head.alias("h"), (F.col("conv") - F.col("conv") % every).alias("source")).join(given, "source", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    heads = rows.filter(F.col("pos") < MOST_HEAD).withColumnRenamed("conv", "source")
    taken = convs.join(heads, "source").filter(F.col("pos") < F.col("taken")).select("conv", "pos", "turn")
    # h is at hand in every row; ``taken`` differs from it only where the source is short, at most a head's length
    short = convs.filter("taken < h").select("conv", (F.col("h") - F.col("taken")).alias("less"))
    own = skew_join(rows.filter(F.col("pos") >= head), short, ["conv"], ["pos"])
    own = own.select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "turn")
    return own.unionByName(taken), convs.select("conv", "n")


# -- equal conversations ------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) rows as runs of decimal ids."""
    out: list[tuple[bytes, int, bytes]] = []
    key, first, ids, size = None, 0, [], 0
    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size > RUN_BYTES:
                if key is not None:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, size = k, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 5000:
            yield _run_batch(out)
            out = []
    if key is not None:
        out.append((key, first, ",".join(ids)))
    yield _run_batch(out)


def _run_batch(out: list) -> pa.RecordBatch:
    keys, firsts, ids = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(ids, pa.string())], ["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as one digest of all ids per key; a run is forgotten once hashed."""
    key, sha, keys, shas = None, None, [], []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    shas.append(sha.hexdigest())
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        if len(keys) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends"])
            keys, shas = [], []
    if key is not None:
        keys.append(key)
        shas.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends"])


def id_digests(members: DataFrame) -> DataFrame:
    """``(key, ends)``: SHA-256 of each key's ids, ascending, joined by commas."""
    runs = members.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_runs, "key binary, first bigint, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def _segments(rows: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """``(conv, seg, root, path, below)``: the segments of each conversation, the last one possibly empty.

    ``root`` names all turns before the segment, ``below`` all up to its end;
    the last segment has no ``below``.
    """
    part = F.struct((F.col("pos") % segment).cast("int").alias("pos"), "turn")
    cut = rows.groupBy("conv", F.floor(F.col("pos") / segment).alias("seg")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    cut = cut.select("conv", "seg", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["turn"])), "")).alias("path"))
    last = convs.select("conv", F.floor(F.col("n") / segment).alias("seg"), F.lit(True).alias("last"))
    cut = cut.join(last, ["conv", "seg"], "full").select("conv", "seg", F.coalesce("path", F.lit(b"")).alias("path"), F.coalesce("last", F.lit(False)).alias("last"))

    def up_to(end: int) -> Column:
        frame = W.partitionBy("conv").orderBy("seg").rowsBetween(W.unboundedPreceding, end)
        halves = [F.coalesce(F.sum(F.xxhash64(F.lit(k), "seg", "path").cast("decimal(20,0)")).over(frame), F.lit(0)) for k in (1, 2)]
        named = F.sha2(F.concat_ws("|", *halves).cast("binary"), 256)
        return F.unhex(F.rpad(F.substring(named, 1, 32), 2 * KEY, "0"))

    return cut.select("conv", "seg", up_to(-1).alias("root"), "path", F.when(~F.col("last"), up_to(0)).alias("below"))


# -- double arrays ------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK over dense turn ids, packed level by level. The root is slot 0."""

    WINDOW = 4096

    def __init__(self, n_turns: int, n_nodes: int):
        size = n_turns + n_nodes + 2
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = -2
        self.hole = 1  # no free slot before it
        self.tail = n_turns + 1  # no taken slot from it on

    def _take(self, slots: np.ndarray, parents: np.ndarray) -> None:
        end = int(slots.max()) + 1
        if end > len(self.check):
            more = max(end - len(self.check), len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
        self.check[slots] = parents
        self.tail = max(self.tail, end)
        while self.hole < self.tail:
            free = self._free(self.hole, self.WINDOW)
            if len(free):
                self.hole = int(free[0])
                break
            self.hole = min(self.hole + self.WINDOW, self.tail)

    def _free(self, start: int, width: int) -> np.ndarray:
        return np.flatnonzero(self.check[start : min(start + width, self.tail)] == -1) + start

    def _place(self, turns: np.ndarray) -> int:
        """A base from which the slots of all ``turns`` are free: at one of the next holes, else behind the tail."""
        for slot in self._free(max(self.hole, int(turns[0]) + 1), self.WINDOW)[:64]:
            at = slot - turns[0] + turns
            if (self.check[at[at < self.tail]] == -1).all():
                return int(slot - turns[0])
        return self.tail - int(turns[0])

    def add(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The slots of new children, one per pair; pairs are sorted by parent, then turn."""
        slots = np.empty(len(parents), np.int64)
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        ends = np.r_[starts[1:], len(parents)]
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            base = self._place(turns[a:b])
            slots[a:b] = base + turns[a:b]
            self.base[parents[a]] = base
            self._take(slots[a:b], parents[a:b])
        single = starts[ends - starts == 1]
        if len(single):  # one child each: any free slot above its turn will do
            order = single[np.argsort(turns[single], kind="stable")]
            free = self._free(self.hole, self.tail)[: len(order)]
            free = np.r_[free, np.arange(self.tail, self.tail + len(order) - len(free))]
            late = free <= turns[order]
            free[late] = max(self.tail, int(free[-1]) + 1) + np.arange(np.count_nonzero(late))
            slots[order] = free
            self.base[parents[order]] = free - turns[order]
            self._take(free, parents[order])
        return slots

    def step(self, slots: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of ``slots`` under ``turns``; -1 where there is none."""
        at = self.base[slots] + turns
        inside = at < len(self.check)
        return np.where(inside & (self.check[np.where(inside, at, 0)] == slots), at, -1)


class Shard:
    """The trie of sorted distinct paths, and the sums of its nodes.

    ``known`` holds five columns (members, smallest id, children, leaves, saved
    tokens) for the last ``counts[i]`` nodes of path i, ``ends`` the digest of
    the ids that end there: what no longer path of the shard shows by itself.
    """

    def __init__(self, paths: list[bytes], counts: np.ndarray, known: np.ndarray, ends: list):
        self.paths, self.lengths = paths, np.array([len(p) // KEY for p in paths], np.int64)
        names, of = np.unique(np.frombuffer(b"".join(paths), f"S{KEY}").view(f"V{KEY}"), return_inverse=True)
        self.names = [n.tobytes() for n in names]
        sizes = np.array([int.from_bytes(n[16:], "big") for n in self.names], np.int64)
        starts = np.r_[0, np.cumsum(self.lengths)]
        order = np.argsort(-self.lengths, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        trie = DoubleArray(len(names), int(starts[-1]))
        slot, place = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        first_known = self.lengths - counts
        offsets = np.r_[0, np.cumsum(counts)][:-1] - first_known
        self.at, self.above, self.turns, self.own, self.ends, self.text = [], [], [], [], [], []
        for depth in range(int(self.lengths.max())):
            live = order[: np.count_nonzero(self.lengths > depth)]
            turn = of[starts[live] + depth]
            pair, first, back = np.unique(slot[live] * len(names) + turn, return_index=True, return_inverse=True)
            above = place[live][first]
            trie.add(pair // len(names), pair % len(names))
            slot[live] = trie.step(slot[live], turn)
            place[live] = back.ravel()
            self.at.append(place[live])
            self.above.append(above)
            self.turns.append(pair % len(names))
            self.text.append(sizes[pair % len(names)] if depth else np.zeros(len(pair), np.int64))
            own, shas = np.zeros((len(pair), 5), np.int64), np.full(len(pair), None, object)
            own[:, 1] = np.iinfo(np.int64).max
            told = live[first_known[live] <= depth]
            rows, to = offsets[told] + depth, place[told]
            for c in (0, 2, 3, 4):
                np.add.at(own[:, c], to, known[rows, c])
            np.minimum.at(own[:, 1], to, known[rows, 1])
            for r, p in zip(rows, to):
                shas[p] = ends[r] or shas[p]
            self.own.append(own)
            self.ends.append(shas)
        self.base, self.check = trie.base, trie.check
        self._sum()

    def _sum(self) -> None:
        """Bottom-up: each level's totals, in the columns of ``own``; ``hidden`` leaves out the node's own leaf and tokens."""
        self.total, self.hidden = [None] * len(self.at), [None] * len(self.at)
        for depth in reversed(range(len(self.at))):
            total = self.own[depth].copy()
            if depth + 1 < len(self.at):
                below, up = self.total[depth + 1], self.above[depth + 1]
                for c in (0, 3, 4):
                    np.add.at(total[:, c], up, below[:, c])
                np.minimum.at(total[:, 1], up, below[:, 1])
                np.add.at(total[:, 2], up, 1)
            self.hidden[depth] = total.copy()
            total[:, 3] = np.where(total[:, 2] == 0, 1, total[:, 3])
            total[:, 4] += (total[:, 0] - 1) * self.text[depth]
            self.total[depth] = total

    def border(self) -> list[np.ndarray]:
        """Per level the places of the nodes on the first and the last path."""
        out = []
        for depth, at in enumerate(self.at):
            ends = [at[self.rank[i]] for i in (0, len(self.paths) - 1) if self.lengths[i] > depth]
            out.append(np.unique(np.array(ends, np.int64)))
        return out

    def keys(self) -> list[list[bytes]]:
        """Per level a digest of each node's path."""
        out: list[list[bytes]] = []
        for depth, turns in enumerate(self.turns):
            above = [b""] * len(turns) if not depth else [out[-1][i] for i in self.above[depth]]
            out.append([hashlib.blake2b(a + self.names[t], digest_size=16).digest() for a, t in zip(above, turns)])
        return out

    def shared(self, border: list[np.ndarray]) -> list[tuple]:
        """The first and last path, with what only this shard knows of the nodes on them; no node twice."""
        left = [h.copy() for h in self.hidden]
        for depth in range(1, len(border)):
            for place in border[depth]:
                up = self.above[depth][place]
                left[depth - 1][up] -= np.array([1, 0, 0, 1, 1]) * self.total[depth][place] + np.array([0, 0, 1, 0, 0])
        out, told = [], set()
        for i in dict.fromkeys((0, len(self.paths) - 1)):
            nodes = [(d, int(self.at[d][self.rank[i]])) for d in range(self.lengths[i])]
            new = [n for n in nodes if n not in told]
            told.update(new)
            out.append((self.paths[i], [left[d][p].tolist() for d, p in new], [self.ends[d][p] for d, p in new]))
        return out


COLUMNS = ("n", "low", "children", "leaves", "saved")
PATHS = "path binary, known array<array<bigint>>, shas array<string>"
PACKED = f"level int, conv bigint, parent bigint, parent_key binary, key binary, root binary, n bigint, children bigint, leaves bigint, saved bigint, ends string, {PATHS}"
_KNOWN = pa.list_(pa.list_(pa.int64()))


def _packing(merging: bool, last: bool):
    """One shard's final nodes and, unless it is the last, the paths that others may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts, known, ends = [], [], [], []
        for batch in batches:
            paths.extend(batch.column(0).to_pylist())
            for k, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts.append(len(k))
                known.extend(k)
                ends.extend(e)
        if not paths:
            return
        shard = Shard(paths, np.array(counts, np.int64), np.array(known, np.int64), ends)
        border = [np.zeros(0, np.int64)] * len(shard.at) if last else shard.border()
        keys = shard.keys()
        for depth, total in enumerate(shard.total):
            own = np.setdiff1d(np.arange(len(total)), border[depth])
            up = shard.above[depth][own]
            unsure = np.isin(up, border[depth - 1]) if depth else np.zeros(len(own), bool)
            yield _out(
                level=np.full(len(own), depth), conv=total[own, 1],
                parent=pa.array(shard.total[depth - 1][up, 1], pa.int64(), mask=unsure) if depth else [None] * len(own),
                parent_key=[keys[depth - 1][u] if x else None for u, x in zip(up, unsure)],
                key=[keys[depth][p] for p in own] if merging else [None] * len(own),
                root=[None] * len(own) if depth else [shard.names[shard.turns[0][p]] for p in own],
                n=total[own, 0], children=total[own, 2], leaves=total[own, 3], saved=total[own, 4], ends=shard.ends[depth][own],
            )
        if not last:
            shared = shard.shared(border)
            yield _out(path=[s[0] for s in shared], known=[s[1] for s in shared], shas=[s[2] for s in shared])

    return run


_PACKED = pa.schema([
    ("level", pa.int32()), ("conv", pa.int64()), ("parent", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()), ("root", pa.binary()), ("n", pa.int64()),
    ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("path", pa.binary()), ("known", _KNOWN), ("shas", pa.list_(pa.string())),
])


def _out(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    given = [columns.get(f.name) for f in _PACKED]
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(given, _PACKED)], schema=_PACKED)


def _packed(paths: DataFrame, shard_bytes: int, fan_in: int) -> DataFrame:
    """The final nodes of one round of segments, ``parent`` missing where only ``parent_key`` is known."""
    paths = written(paths, "trie-paths")
    size = paths.agg(F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()[0]
    n, out = max(1, -(-size // shard_bytes)), None
    merging = False
    while True:
        dealt = paths.repartitionByRange(n, "path") if n > 1 else paths.repartition(1)  # one: its bytes are bounded
        packed = written(dealt.sortWithinPartitions("path").mapInArrow(_packing(merging, n == 1), PACKED), "trie-nodes")
        done = packed.filter("path IS NULL").drop("path", "known", "shas")
        out = done if out is None else out.unionByName(done)
        if n == 1:
            return out
        paths, n, merging = packed.filter("path IS NOT NULL").select("path", "known", "shas"), -(-n // fan_in), True


def nodes(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """The trie of the conversations ``(conv, pos, turn)``; ``convs`` is ``(conv, n)``, those without turns included.

    One row per node: ``conv`` (smallest member), ``depth``, ``parent`` (the
    parent's smallest member), ``n``, ``children``, ``leaves``, ``saved`` and
    ``ends``, the digest of the ids that end there.
    """
    ship_code(rows.sparkSession)
    pieces = _segments(rows, convs, segment).withColumn("path", F.concat("root", "path")).drop("root")
    pieces = written(pieces.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 32))), "trie-segments")
    ends = id_digests(pieces.filter("below IS NULL").select("key", "conv")).select("key", "ends")
    distinct = pieces.groupBy("seg", "path", "key", "below").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"))
    distinct = written(distinct.join(ends.withColumn("final", F.lit(True)), (distinct["key"] == ends["key"]) & F.col("below").isNull(), "left").drop(ends["key"]).drop("final"), "trie-distinct")
    deepest = distinct.agg(F.coalesce(F.max("seg"), F.lit(-1))).first()[0]
    out = roots = None
    for seg in reversed(range(deepest + 1)):
        own = distinct.filter(F.col("seg") == seg)
        if roots is None:
            own = own.select("path", "n", "low", *[F.lit(0).cast("bigint").alias(c) for c in COLUMNS[2:]], "ends")
        else:
            deeper = roots.select(F.col("root").alias("below"), *COLUMNS[2:], F.col("ends").alias("deep"))
            zero = [F.coalesce(c, F.lit(0)).alias(c) for c in COLUMNS[2:]]
            own = own.join(deeper, "below", "left").select("path", "n", "low", *zero, F.coalesce("ends", "deep").alias("ends"))
        paths = own.select("path", F.array(F.array(*COLUMNS)).alias("known"), F.array("ends").alias("shas"))
        found = _packed(paths, shard_bytes, fan_in).withColumn("depth", (F.col("level") + seg * segment).cast("bigint"))
        roots = found.filter("level = 0")
        upper = found.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv").alias("upper"))
        named = skew_join(found.filter("parent_key IS NOT NULL").drop("parent"), upper, ["parent_key"], ["conv"]).withColumnRenamed("upper", "parent")
        found = found.filter("parent_key IS NULL").unionByName(named)
        found = found.filter("depth = 0 OR level > 0").select("conv", "depth", "parent", "n", "children", "leaves", "saved", F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = distinct.limit(0).select(*[F.lit(None).cast("bigint").alias(c) for c in ("conv", "depth", "parent", "n", "children", "leaves", "saved")], F.lit(None).cast("string").alias("ends"))
    return out

"""Word-piece counts by a linear longest-match automaton.

A word is cut greedily: the longest piece of the vocabulary that it begins with,
then again from there. The vocabulary is a trie; a node's failure link leads to
the node that stands for what is left after the pieces that longest matching
would take from the node's string are popped, and the node knows how many
pieces those are. Reading a word takes one step per symbol and as many failure
links as it has pieces, so the count is linear in the length of the word, and no
piece is ever built.

Words are read in the byte alphabet of the vocabulary, with its word end as the
last symbol. A word that the vocabulary can't cut counts as one piece. Words are
the runs of letters, single digits, and the runs of other characters, of the
lower-cased text. Counts of short words are kept in a bounded table.

Rows are independent and not shuffled: hot groups and repeated rows need no
care, and a lost task is repeated. Null and empty texts have no words and no
pieces. Very long texts and words are read whole. Input columns are carried in
one nested column, so names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, ship_code
from gradeloom.llm.tokens import BYTE_ALPHABET

WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
END = "</w>"


class Automaton:
    """Trie with failure links and popped counts."""

    def __init__(self, vocabulary: Iterable[str], end: str = END):
        self.end = end
        self.child: list[dict[str, int]] = [{}]
        token = [False]
        for piece in vocabulary:
            at = 0
            for symbol in self.symbols(piece):
                step = self.child[at].get(symbol)
                if step is None:
                    step = self.child[at][symbol] = len(self.child)
                    self.child.append({})
                    token.append(False)
                at = step
            token[at] = at > 0
        # -1: what is left can't be cut.
        self.link, self.popped = [-1] * len(self.child), [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, step in self.child[node].items():
                queue.append(step)
                if token[step]:
                    self.link[step], self.popped[step] = 0, 1
                    continue
                back, count = self.link[node], self.popped[node]
                while back >= 0 and symbol not in self.child[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[step], self.popped[step] = self.child[back][symbol], count

    def symbols(self, piece: str) -> list[str]:
        return [*piece[: -len(self.end)], self.end] if self.end and piece.endswith(self.end) else [*piece]

    def count(self, word: str) -> int:
        """Pieces of a word given in the alphabet of the vocabulary, without its end."""
        child, link, popped = self.child, self.link, self.popped
        at = total = 0
        for symbol in (*word, self.end) if self.end else word:
            while symbol not in child[at]:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = child[at][symbol]
        while at:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total


class Counter(dict):
    """Chunk between blanks -> pieces + (words << 40)."""

    def __init__(self, automaton: Automaton, most: int = 700_000, longest: int = 64):
        super().__init__()
        self.automaton, self.most, self.longest = automaton, most, longest

    def __missing__(self, chunk: str) -> int:
        total = 0
        for word in WORD.findall(chunk):
            shown = word if word.isascii() and word.isprintable() else "".join(map(BYTE_ALPHABET.__getitem__, word.encode()))
            total += self.automaton.count(shown) + (1 << 40)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = total
        return total

    def count(self, text: str | None) -> tuple[int, int]:
        """Words and pieces."""
        total = sum(map(self.__getitem__, text.lower().split())) if text else 0
        return total >> 40, total & ((1 << 40) - 1)


def vocabulary_of(path: str) -> list[str]:
    """The pieces of a vocabulary file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as file:
        return list(json.load(file)["model"]["vocab"])


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One automaton and table for a process."""
    if path not in _LOADED:
        _LOADED[path] = Counter(Automaton(vocabulary_of(path)))
    return _LOADED[path]


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in pieces(batches, "text"):
            found = [count(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "n_pieces"])

    return run


def counted(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``record`` (the other columns of the input), ``text``, ``n_words`` and ``n_pieces``; ``vocabulary`` is a path that all executors have."""
    require(docs, text_col)
    ship_code(docs.sparkSession)
    rows = carried(docs, text_col)
    return rows.mapInArrow(_counting(vocabulary), StructType([*rows.schema.fields, StructField("n_words", LongType()), StructField("n_pieces", LongType())]))

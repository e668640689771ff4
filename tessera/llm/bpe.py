"""Encoding of texts with a byte-level BPE vocabulary given as ranks.

Within each piece of text the symbols form a doubly linked list; candidate merges wait in a priority queue by rank and
position, and entries whose symbols have since changed are skipped when they come up. A word costs O(n log n) however
long it is. Ids are decoded by concatenating vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHED_WORDS = 500_000  # per worker; the cache starts anew beyond
ROWS_AT_ONCE = 512


class BpeVocabulary:
    """Ranks by byte string; a rank is also the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.strings = {i: b for b, i in ranks.items()}
        self._words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def parse(cls, lines: bytes, pattern: str) -> BpeVocabulary:
        """From the lines of a rank file: a byte string in base64, a space, its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the pair of neighbours of lowest rank is joined, of equal ones the leftmost."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # links between symbols, each named by its first byte
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, mid, end = heapq.heappop(queue)
            if after[i] != mid or (after[mid] if mid < n else -1) != end:
                continue  # stale: a symbol of this pair has been joined or is gone
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(queue, (r, i, end, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(queue, (r, p, i, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        ids = self._words.get(word)
        if ids is None:
            ids = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
            if len(word) <= 64:
                if len(self._words) >= CACHED_WORDS:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for an empty or a null text."""
        out: list[int] = []
        for w in self.pattern.findall(text) if text else ():
            out += self.word(w)
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self.word(w)) for w in self.pattern.findall(text)) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, BpeVocabulary] = {}


def _vocabulary(shared) -> BpeVocabulary:
    """One vocabulary per worker process and broadcast."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = BpeVocabulary.parse(*shared.value)
    return _LOADED[shared.id]


class _Shared:
    """The rank file as a broadcast, with an id that workers know it by; its size is fixed by the vocabulary."""

    def __init__(self, b):
        self.b, self.id = b, b._jbroadcast.id()

    def __getstate__(self):
        return (self.b, self.id)

    def __setstate__(self, s):
        self.b, self.id = s

    @property
    def value(self):
        return self.b.value


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores; a scan that has them stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, key)


def _per_text(df: DataFrame, key: str, text: str, path: str, pattern: str, column: str, kind: str, what: str, keep: tuple[str, ...] = ()) -> DataFrame:
    with open(path, "rb") as f:
        shared = _Shared(df.sparkSession.sparkContext.broadcast((f.read(), pattern)))
    rows = spread(df.select(key, *keep, text), key)
    typ = pa.list_(pa.int32()) if kind == "array<int>" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = getattr(_vocabulary(shared), what)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([do(t.as_py()) for t in part.column(part.num_columns - 1)], typ)], names=[key, *keep, column])

    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + f", {column} {kind}")


def encode_texts(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """key and ids (array<int>) of every row of df: the whole text, unchanged; [] for an empty and for a null text.

    Special tokens are never produced: their strings in a text are ordinary text. Repeated keys give repeated rows,
    an empty table gives none, and other columns are ignored.
    """
    return _per_text(df, key, text, path, pattern, "ids", "array<int>", "encode")


def count_tokens(df: DataFrame, key: str, text: str, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, and n_tokens (bigint) of every row of df; 0 for an empty and for a null text."""
    return _per_text(df, key, text, path, pattern, "n_tokens", "bigint", "count", keep)


def decode_ids(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """key and text of every row; null ids give a null text."""
    with open(path, "rb") as f:
        shared = _Shared(df.sparkSession.sparkContext.broadcast((f.read(), pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else v.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")

"""Encoding of texts with a public byte-level BPE vocabulary given as ranks."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernmill.operators.names import fresh

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published split pattern of this vocabulary; \s is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

_NONE = 1 << 62
_LONG = 192  # bytes of a word from which a heap finds the least rank


class RankBPE(dict):
    """Ids of a word (a key, str), made on first use; holds at most `most_words` words at a time."""

    def __init__(self, ranks: dict[bytes, int], most_words: int = 200_000):
        import regex

        super().__init__()
        self.ranks, self.most_words, self.split = ranks, most_words, regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.merge(data) if len(data) < _LONG else self.merge_long(data)
        if len(word) <= 64:
            if len(self) >= self.most_words:
                self.clear()
            self[word] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """Contiguous rank array: bounds[i] starts part i, rank[i] is that of parts i and i + 1 joined."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        bounds = list(range(len(data) + 1))
        rank = [ranks.get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            del bounds[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(data[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                rank[i - 1] = ranks.get(data[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [ranks[data[a:b]] for a, b in zip(bounds, bounds[1:])]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges in n log n, for words on which repeated scans would be quadratic."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stop = list(range(1, n + 1))
        version = [0] * n
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(data[i : stop[j]])) is not None:
                heapq.heappush(heap, (r, i, version[i], version[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, v, w = heapq.heappop(heap)
            j = after[i] if stop[i] >= 0 else n
            if stop[i] < 0 or version[i] != v or j >= n or version[j] != w:
                continue
            stop[i], after[i] = stop[j], after[j]
            stop[j] = -1
            version[i] += 1
            version[j] += 1
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : stop[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text; null and empty give none."""
        out: list[int] = []
        for word in self.split(text or ""):
            out += self[word]
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


_loaded: dict[int, RankBPE] = {}


def _encoder(raw: bytes) -> RankBPE:
    """One encoder for each vocabulary and Python worker."""
    k = hash(raw)
    if k not in _loaded:
        _loaded.clear()
        _loaded[k] = RankBPE(read_ranks(raw))
    return _loaded[k]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # about 1 MB, whatever the input
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str, keys: list[str], *, vocabulary: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """Keys and the token ids (array<int>) of each row's text; one row per row, in one narrow pass.

    Null and empty texts have an empty list. The words of whole texts are merged by a contiguous
    rank array, very long ones through a heap with the same result. Where a key is named `ids`,
    the result gets underscores appended.
    """
    ids = fresh(ids, keys)
    raw = _vocabulary(df, vocabulary)
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(raw.value)
        split = bpe.split
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(batch.num_columns - 1).to_pylist():
                for word in split(t) if t else ():
                    flat.extend(bpe[word])
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat.tobytes())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], lists], [*keys, ids])

    return picked.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keys: list[str], *, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """Keys and `tokens` (with underscores appended where a key has the name), the number of ids `encode` would give."""
    tokens = fresh("tokens", keys)
    raw = _vocabulary(df, vocabulary)
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(raw.value)
        split = bpe.split
        for batch in batches:
            counts = [sum(len(bpe[w]) for w in split(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], pa.array(counts, pa.int64())], [*keys, tokens])

    return picked.mapInArrow(run, schema)

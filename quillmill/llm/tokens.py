"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each word keeps a contiguous list of part boundaries and the ranks of adjacent pairs; the
minimum is found by a scan, its boundary deleted and the two neighbouring ranks refreshed.
Words too long for scans use the same rule on a heap. Workers remember the words they met.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FOLDER = "/opt/tokenizers"
#: Longest word in bytes for the scan; longer ones go by the heap, with the same result.
SCAN_BYTES = 256
#: Words a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000
_NONE = 1 << 60


def load_ranks(name: str = "byte_bpe_50k.tiktoken", folder: str = DEFAULT_FOLDER) -> dict[bytes, int]:
    with open(Path(folder) / name, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def split_pattern() -> str:
    """The pattern by which the public vocabularies split a text into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SCAN_BYTES:
        return _merge_long(word, ranks)
    get = ranks.get
    at = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[at[i] : at[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[at[i - 1] : at[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts and remembers the words it met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.known = ranks, regex.compile(pattern).finditer, {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for m in self.find(text):
            word = m.group()
            ids = known.get(word)
            if ids is None:
                ids = merge_word(word.encode("utf-8", "replace"), self.ranks)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


def _shared(spark: SparkSession, vocabulary: str, folder: str):
    """Ranks as a broadcast variable: the vocabulary file bounds its size (about 1 MB)."""
    return spark.sparkContext.broadcast((load_ranks(vocabulary, folder), split_pattern()))


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """Adds `out` (ARRAY<INT>): ids of the text without special tokens.

    Empty and null texts have the defined ids [] (no token), blank texts the ids of their
    spaces. Ties between equal pairs merge from the left. Other columns pass through.
    """
    shared = _shared(df.sparkSession, vocabulary, folder)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(*shared.value)
        for texts in batches:
            yield texts.map(lambda t: e.encode(t) if t else [])

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """Adds `out` (LONG): number of ids of the text; 0 for empty and null texts."""
    shared = _shared(df.sparkSession, vocabulary, folder)

    @F.pandas_udf(T.LongType())
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(*shared.value)
        for texts in batches:
            yield texts.map(lambda t: len(e.encode(t)) if t else 0)

    return df.withColumn(out, size(F.coalesce(F.col(text), F.lit(""))))

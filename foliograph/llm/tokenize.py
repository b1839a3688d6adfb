"""Encoding of texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; the merges of each piece run over a segment tree whose leaves are
the adjacent token pairs by byte position and whose nodes hold the leftmost pair of least rank. The root names
the next merge; it costs logarithmic point updates at the pair itself and at its live neighbours.

Null and empty texts have no ids (an empty list, never null). Lone surrogates can't occur in Spark strings.
Repeated rows are encoded like any other; extra columns of the input are left aside unless asked for.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; beyond it the memory starts afresh, results are the same.
REMEMBERED = 400_000

_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by merges in order of rank, leftmost first."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    shift = n.bit_length()
    mask = (1 << shift) - 1
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = (r << shift) | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (top := tree[1]) != _NONE:
        i = top & mask
        j = end[i]
        e = end[i] = end[j]
        if j < n - 1:
            put(j, _NONE)
        if e < n:
            before[e] = i
            r = get(piece[i : end[e]])
            put(i, _NONE if r is None else (r << shift) | i)
        else:
            put(i, _NONE)
        if (p := before[i]) >= 0:
            r = get(piece[p:e])
            put(p, _NONE if r is None else (r << shift) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers the pieces it has met as packed 32-bit ids."""

    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder for each vocabulary and worker."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def packed(self, text: str) -> bytes:
        memory, pieces = self.memory, self.split(text)
        try:
            return b"".join([memory[p] for p in pieces])
        except KeyError:
            pass
        if len(memory) > REMEMBERED:
            memory.clear()
        for p in pieces:
            if p not in memory:
                memory[p] = np.array(merge_piece(p.encode(), self.ranks), np.int32).tobytes()
        return b"".join([memory[p] for p in pieces])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist() if text else []


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out: str = "ids") -> DataFrame:
    """``id_col`` and ``out``, the list of token ids of ``text_col``, for every row; [] for null and empty texts."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            parts = [encoder.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, out])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; 0 for null and empty texts."""
    return encode(df, id_col, text_col, vocabulary).select(id_col, F.size("ids").alias("n_tokens"))

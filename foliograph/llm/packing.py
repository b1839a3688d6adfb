"""Filling of containers of fixed capacity with documents, sizes in tokens.

Lexical retrieval packing: items are laid in shards of about ``SHARD`` by the hash of the least hash of their words, so that
texts with words in common tend to meet, and a hot group of like texts is cut by the hash of the id. Each shard has an
inverted BM25 index. Seeds are taken by falling size; the index returns all unused neighbours of the seed by score, and the
best whose choice leaves no gap, or one that an unused item closes, goes into the window, until it is full. What no neighbour
can close goes to the items that fill it best. Words that stand in more than a quarter of a shard don't make neighbours.

Only a text above the capacity is split: into full windows and a rest, which is packed like an item.
Defined cases: null and empty texts take no space and have no row; repeated rows are packed each on their own; an empty
table gives no rows; extra columns are not read. Results, names of containers included, depend on the ids and texts only.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.tokenize import DEFAULT_VOCABULARY, Encoder, merge_piece
from foliograph.sources.tables import Scratch

CAPACITY, SHARD = 2048, 2000
K1, B = 1.2, 0.75
#: The share of a window that may stay open where a neighbour is taken.
OPEN = 1 / 50


class Index:
    """BM25 over the word hashes of a shard's items."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        self.n = n = len(terms)
        self.terms = terms
        lengths = np.array([c.sum() for c in counts], np.float64)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1.0, 1e-9))
        word = np.concatenate(terms) if n else np.zeros(0, np.int32)
        item = np.repeat(np.arange(n), [len(t) for t in terms]) if n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        order = np.argsort(word, kind="stable")
        word, self.item, tf = word[order], item[order], tf[order]
        self.words, self.first, df = np.unique(word, return_index=True, return_counts=True)
        self.last = self.first + df
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.item])
        self.rare = df * 4 <= max(n, 8)

    def scores(self, seed: int) -> np.ndarray:
        """The score of every item for the words of ``seed``; words of more than a quarter of the shard tell nothing."""
        at = np.searchsorted(self.words, self.terms[seed])
        at = at[self.rare[at]]
        if not len(at):
            return np.zeros(self.n)
        size = self.last[at] - self.first[at]
        where = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
        return np.bincount(self.item[where], self.weight[where], minlength=self.n)


class Left:
    """Unused items by size."""

    def __init__(self, sizes: np.ndarray):
        order = np.lexsort((np.arange(len(sizes)), sizes))
        self.keys = [(int(sizes[i]), int(i)) for i in order]

    def drop(self, size: int, i: int) -> None:
        del self.keys[bisect.bisect_left(self.keys, (size, i))]

    def largest(self, most: int) -> tuple[int, int] | None:
        at = bisect.bisect_right(self.keys, (most, 1 << 60)) - 1
        return self.keys[at] if at >= 0 else None


def fill(sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], capacity: int = CAPACITY, by: Counter | None = None) -> list[list[int]]:
    """Items of one shard by container; ``by`` counts what was placed as seed, by index and by size."""
    index, left, used, out = Index(terms, counts), Left(sizes), np.zeros(len(sizes), bool), []
    order = np.argsort(sizes, kind="stable")
    by = Counter() if by is None else by

    def take(i: int, into: list[int], how: str) -> int:
        used[i] = True
        left.drop(int(sizes[i]), i)
        into.append(i)
        by[how] += 1
        return int(sizes[i])

    def neighbour(score: np.ndarray, room: int) -> int | None:
        """The best unused neighbour that fits and leaves at most OPEN, by itself or with one more unused item."""
        near = np.flatnonzero((score > 0) & ~used & (sizes <= room))
        if not len(near):
            return None
        rest = room - sizes[near]
        free = order[~used[order]]
        small = sizes[free]
        at = np.searchsorted(small, rest, "right") - 1
        # The item that would close the gap must be another one.
        at -= (at >= 0) & (free[np.maximum(at, 0)] == near)
        gap = np.where(at >= 0, rest - small[np.maximum(at, 0)], rest)
        near = near[np.minimum(gap, rest) <= capacity * OPEN]
        return int(near[np.argmax(score[near])]) if len(near) else None

    for seed in np.lexsort((np.arange(len(sizes)), -sizes)):
        if used[seed]:
            continue
        into: list[int] = []
        room = capacity - take(int(seed), into, "seed")
        if left.keys and left.keys[0][0] <= room:
            score = index.scores(int(seed))
            while (i := neighbour(score, room)) is not None:
                room -= take(i, into, "index")
            while (best := left.largest(room)) is not None:
                # Two items may close the gap better than the largest one alone.
                choice, gap = [best[1]], room - best[0]
                if gap > 4:
                    at = bisect.bisect_right(left.keys, (room, 1 << 60))
                    for k in range(max(0, at - 40), at):
                        s, i = left.keys[k]
                        other = left.largest(room - s)
                        if other and other[1] == i:
                            at2 = bisect.bisect_left(left.keys, other) - 1
                            other = left.keys[at2] if at2 >= 0 else None
                        if other and room - s - other[0] < gap:
                            choice, gap = [i, other[1]], room - s - other[0]
                for i in choice:
                    room -= take(i, into, "size")
        out.append(into)
    return out


def _items(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int) -> DataFrame:
    """(id, part, start, n, sig, terms, counts): a row for each item and each full window."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = Encoder.of(vocabulary), {}

        def look(p: str) -> tuple[int, int | None]:
            """The size of a piece in tokens and the hash of its word, None where it has no letter."""
            w = p.strip().lower()
            return len(merge_piece(p.encode(), encoder.ranks)), xxhash.xxh32_intdigest(w) - (1 << 31) if w and w[0].isalpha() else None

        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(known) > 400_000:
                    known.clear()
                n, hashes, times = 0, [], []
                for p, k in Counter(encoder.split(t)).items():
                    if (seen := known.get(p)) is None:
                        seen = known[p] = look(p)
                    n += seen[0] * k
                    if seen[1] is not None:
                        hashes.append(seen[1]), times.append(k)
                terms, order = np.unique(np.array(hashes, np.int32), return_index=True)
                counts = np.minimum(np.array(times, np.int64)[order], 255).astype(np.uint8) if hashes else np.zeros(0, np.uint8)
                sig = int((terms.view(np.uint32) * np.uint32(0x9E3779B1)).min()) if hashes else 0
                full = n // capacity
                out += [(i, k, k * capacity, capacity, 0, b"", b"") for k in range(full)]
                if n % capacity:
                    out.append((i, full, full * capacity, n % capacity, sig, terms.tobytes(), counts.tobytes()))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "part", "start", "n", "sig", "terms", "counts"])

    return rows.mapInArrow(run, "id bigint, part int, start int, n int, sig bigint, terms binary, counts binary")


def containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, id, part, start_token, n_tokens): every token of every text in exactly one container."""
    items = Scratch(df.sparkSession).put(_items(df, id_col, text_col, vocabulary, capacity))
    small = items.filter(F.col("n") < capacity)
    shards = max(1, -(-small.count() // shard))
    # Signatures with more items than half a shard are cut by the hash of the id; all others stay whole.
    hot = small.groupBy("sig").agg(F.ceil(F.count("*") / (shard / 2)).alias("cuts")).filter("cuts > 1")
    cut = F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "part"), "cuts"))
    laid = small.join(hot, "sig", "left").withColumn("shard", F.pmod(F.xxhash64("sig", cut), F.lit(shards)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("part", "ascending")])
        terms = [np.frombuffer(x, np.int32) for x in t["terms"].to_pylist()]
        counts = [np.frombuffer(x, np.uint8) for x in t["counts"].to_pylist()]
        filled = fill(t["n"].to_numpy().astype(np.int64), terms, counts, capacity)
        name = f"s{t['shard'][0].as_py()}-"
        t = t.take(pa.array([i for c in filled for i in c], pa.int64()))
        ids = [f"{name}{k}" for k, c in enumerate(filled) for _ in c]
        return pa.table({"container_id": pa.array(ids, pa.string()), "id": t["id"], "part": t["part"], "start_token": t["start"], "n_tokens": t["n"]})

    packed = laid.select("shard", "id", "part", "start", "n", "terms", "counts").groupBy("shard").applyInArrow(pack, "container_id string, id bigint, part int, start_token int, n_tokens int")
    full = items.filter(F.col("n") == capacity).select(
        F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container_id"), "id", "part", F.col("start").alias("start_token"), F.col("n").alias("n_tokens")
    )
    return packed.unionByName(full)

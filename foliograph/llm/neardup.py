"""Pairs of texts whose sets of character 5-grams overlap by a threshold.

A text (lower case, no white space) becomes a vector of ``SEGMENTS * WIDTH`` symbols: in each of WIDTH permutations the
least hash of every bin, an empty bin filled from the next one that isn't. Texts of similarity s agree in a symbol
with probability s, so the threshold is a budget TAU on the Hamming distance of the vectors. The segments form a ring.
Pigeonring: of a pair within the budget some segment starts a chain whose first l segments differ in at most
l * TAU / SEGMENTS symbols, for every l. A start may differ in one symbol: each segment is indexed under its WIDTH variants
that leave one symbol out. Pairs that meet under a variant are tried from every such start over all prefixes of the chain,
then by the whole Hamming distance, and at last exactly on the whole texts.

The share of a first segment is TAU / SEGMENTS symbols; variants of one symbol are complete for pairs within a distance of
2 * SEGMENTS - 1. Collision curve beyond: 1 - (1 - s**5 - 5 * s**4 * (1 - s))**12, that is 0.993 at 0.6, 0.999 at 0.65,
0.9999 at 0.7; unrelated texts (0.05) meet with 4e-4.

Keys travel once, sorted; runs up to ``HEAVY`` rows become pairs where they are read. Rows of longer runs are laid out in
blocks, every two blocks of a key a group of their own, and are tried against the chain before anything is shuffled again.

Equal texts are one representative before any of this; their pairs are added at the end.
Defined cases: null texts and texts below ``min_length`` code points take no part, nor do texts of fewer than five
characters once white space is gone; whole texts count, however long; repeated rows count once and of an id with several texts
each counts; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources.tables import Scratch

SEGMENTS, WIDTH = 12, 5
SHINGLE, THRESHOLD, MIN_LENGTH = 5, 0.6, 240
#: Differing symbols allowed of the 60: (1 - 0.6) * 60 and three standard deviations of the estimate.
TAU = 36
#: Rows of one key up to which they are paired where they are read.
HEAVY = 256
#: Rows of keys a task sorts.
TASK_ROWS = 1_000_000
_BITS = 12
_SYMBOL = (1 << _BITS) - 1


def normal(text: str) -> str:
    return "".join(text.lower().split())


def jaccard(a: str, b: str, n: int = SHINGLE) -> float:
    """Similarity of the 5-gram sets of two normal texts; 0 where one has none."""
    x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def vectors(texts: list[str]) -> np.ndarray:
    """A row of SEGMENTS integers, each of WIDTH symbols of 12 bits, for every normal text."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(code) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + code[i : len(code) - SHINGLE + 1 + i]
    owner = np.repeat(np.arange(n, dtype=np.uint64), lengths)[: len(h)]
    within = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)[: len(h)]
    whole = within <= np.repeat(lengths, lengths)[: len(h)] - SHINGLE
    h, owner = h[whole], owner[whole]
    out = np.zeros((n, SEGMENTS), np.uint64)
    for p in range(WIDTH):
        m = _mix(h, 0x1234567 * (p + 1))
        cell = owner * np.uint64(SEGMENTS) + (m >> np.uint64(40)) % np.uint64(SEGMENTS)
        key = np.sort((cell << np.uint64(36)) | (m & np.uint64((1 << 36) - 1)))
        at = key >> np.uint64(36)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(key) else np.zeros(0, np.int64)
        least = np.zeros(n * SEGMENTS, np.uint64)
        least[at[first].astype(np.int64)] = (key[first] & np.uint64((1 << 36) - 1)) + np.uint64(1)
        least = _filled(least.reshape(n, SEGMENTS))
        out |= (_mix(least, 77) % np.uint64(_SYMBOL) + np.uint64(1)) << np.uint64(_BITS * p)
    return out


def _filled(least: np.ndarray) -> np.ndarray:
    """Empty bins (0) take the value of the next bin on the ring that isn't empty, told apart by the distance."""
    poor = np.flatnonzero((least == 0).any(1))
    if len(poor):
        own = least[poor]
        done = own.copy()
        for step in range(1, SEGMENTS):
            near = np.roll(own, -step, axis=1)
            take = (done == 0) & (near != 0)
            done[take] = near[take] + np.uint64(step << 40)
        least[poor] = done
    return least


def _sketched(df: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    rows = df.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_length)).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ids, texts = part.column(0).to_pylist(), [normal(t) for t in part.column(1).to_pylist()]
                keep = [i for i, t in enumerate(texts) if len(t) >= SHINGLE]
                texts = [texts[i] for i in keep]
                if texts:
                    seg = vectors(texts).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i in keep], pa.int64()),
                            pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SEGMENTS), pa.array(seg.ravel())),
                        ],
                        names=["id", "same", "seg"],
                    )

    return rows.mapInArrow(run, "id bigint, same binary, seg array<bigint>")


def within_budget(a: np.ndarray, b: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Which rows of two arrays of vectors pass: a chain from a start of at most one difference whose every prefix keeps
    its proportional budget, and the whole Hamming distance."""
    z = a ^ b
    d = np.zeros(z.shape, np.int16)
    for p in range(WIDTH):
        d += ((z >> np.int64(_BITS * p)) & np.int64(_SYMBOL)) != 0
    ok = d.sum(1) <= tau
    chain = np.zeros(len(d), bool)
    ring = np.concatenate([d, d], 1).cumsum(1)
    ring = np.pad(ring, ((0, 0), (1, 0)))
    share = np.arange(1, SEGMENTS + 1) * tau / SEGMENTS
    for i in range(SEGMENTS):
        prefixes = ring[:, i + 1 : i + 1 + SEGMENTS] - ring[:, i : i + 1]
        chain |= (d[:, i] <= 1) & (prefixes <= share).all(1)
    return ok & chain


def _segments(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, SEGMENTS)


def _pruned(pairs: DataFrame, tau: int) -> DataFrame:
    """(left_id, right_id) of those rows (left_id, right_id, a, b) that keep the budgets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = within_budget(_segments(t.column(2)), _segments(t.column(3)), tau)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["left_id", "right_id"]).filter(pa.array(ok))

    return pairs.select("left_id", "right_id", "a", "b").mapInArrow(run, "left_id bigint, right_id bigint")


def meetings(key: np.ndarray, ids: np.ndarray, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left ids, right ids, positions of rows in runs above ``heavy``) of rows sorted by key and id."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    run = np.repeat(size, size)
    small = np.flatnonzero((run > 1) & (run <= heavy))
    k, v = key[small], ids[small]
    at, left, right = np.arange(len(k)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(at := at[at + step < len(k)]) and len(at := at[k[at] == k[at + step]]):
        left.append(v[at]), right.append(v[at + step])
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a < b], b[a < b], np.flatnonzero(run > heavy)


def _candidates(reps: DataFrame, tau: int, heavy: int, scratch: Scratch) -> DataFrame:
    """(left_id, right_id) of representatives (id, seg) that meet under a variant of a segment and keep the budgets."""
    variants = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(((1 << (_BITS * WIDTH)) - 1) ^ (_SYMBOL << (_BITS * p))).alias("mask")) for p in range(WIDTH)]))
    placed = reps.select("id", F.posexplode("seg").alias("i", "s")).select("id", "i", "s", variants.alias("v")).select(F.xxhash64(F.col("s").bitwiseAND(F.col("v.mask")), "i", "v.p").alias("key"), "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, long = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(key: np.ndarray, ids: np.ndarray, most: int) -> pa.RecordBatch:
            a, b, rest = meetings(key, ids, most)
            k = pa.array(np.r_[np.zeros(len(a), np.int64), key[rest]], mask=np.r_[np.ones(len(a), bool), np.zeros(len(rest), bool)])
            r = pa.array(np.r_[b, np.zeros(len(rest), np.int64)], mask=np.r_[np.zeros(len(a), bool), np.ones(len(rest), bool)])
            return pa.RecordBatch.from_arrays([k, pa.array(np.r_[a, ids[rest]]), r], names=["key", "left_id", "right_id"])

        for t in batches:
            k, v = t.column(0).to_numpy(), t.column(1).to_numpy()
            if long is not None:  # the run of this key is known to be long: its rows go on as they are
                n = int(np.searchsorted(k, long, "right"))
                if n:
                    yield out(k[:n], v[:n], 0)
                k, v = k[n:], v[n:]
            if not len(k):
                continue
            key, ids, long = np.concatenate([key, k]), np.concatenate([ids, v]), None
            last = int(np.searchsorted(key, key[-1]))
            yield out(key[:last], ids[:last], heavy)
            key, ids = key[last:], ids[last:]
            if len(key) > heavy:
                yield out(key, ids, heavy)
                key, ids, long = key[:0], ids[:0], key[-1]
        yield out(key, ids, heavy)

    tasks = -(-reps.count() * SEGMENTS * WIDTH // TASK_ROWS)
    tasks = max(tasks, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = scratch.put(placed.repartition(tasks, "key").sortWithinPartitions("key", "id").mapInArrow(meet, "key bigint, left_id bigint, right_id bigint"))
    sketch = reps.select("id", "seg")
    a, b = sketch.toDF("left_id", "a"), sketch.toDF("right_id", "b")
    light = met.filter("key IS NULL").select("left_id", "right_id").distinct()
    passed = _pruned(light.join(a, "left_id").join(b, "right_id"), tau)
    crowd = met.filter("key IS NOT NULL").select("key", F.col("left_id").alias("id"))
    blocks = crowd.groupBy("key").agg(F.ceil(F.count("*") / heavy).alias("blocks"))
    laid = scratch.put(crowd.join(blocks, "key").join(sketch, "id").withColumn("own", F.pmod(F.xxhash64("id", "key"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    x = laid.select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("left_id"), F.col("seg").alias("a"))
    y = laid.select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("right_id"), F.col("seg").alias("b"))
    crowded = _pruned(x.join(y, ["key", "i", "j"]).filter("left_id < right_id"), tau)
    return passed.unionByName(crowded).distinct()


def _verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, threshold: float, min_length: int, scratch: Scratch) -> DataFrame:
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    long = df.filter(F.length(text_col) >= min_length).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    text = scratch.put(long.join(ends, "id", "left_semi"))
    both = pairs.join(text.toDF("left_id", "a"), "left_id").join(text.toDF("right_id", "b"), "right_id").select("left_id", "right_id", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            s = [jaccard(normal(x), normal(y)) if x and y else 0.0 for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            out = pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(s, pa.float64())], names=["left_id", "right_id", "similarity"])
            yield out.filter(pa.array([x >= threshold for x in s]))

    return both.mapInArrow(run, "left_id bigint, right_id bigint, similarity double").dropDuplicates(["left_id", "right_id"])


def alike(
    df: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD, min_length: int = MIN_LENGTH, tau: int = TAU, heavy: int = HEAVY
) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (left_id, right_id, similarity) and membership (id, rep) of their copies."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.put(_sketched(df, id_col, text_col, min_length))
    # Copies are combined before the shuffle; the sketch of equal texts is the same.
    first = scratch.put(rows.groupBy("same").agg(F.min("id").alias("rep"), F.first("seg").alias("seg"), F.count("*").alias("n")))
    several = first.filter("n > 1").select("same", "rep")
    copies = scratch.put(rows.select("id", "same").join(several, "same").filter("id != rep").select("id", "rep").distinct())
    pairs = scratch.put(_candidates(first.select(F.col("rep").alias("id"), "seg"), tau, heavy, scratch))
    return scratch.put(_verified(pairs, df, id_col, text_col, threshold, min_length, scratch)), copies


def expanded_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """(left_id, right_id) of all rows, smaller first: pairs of representatives with their copies, and of copies."""
    with_self = lambda c: copies.unionByName(pairs.select(F.col(c).alias("id"), F.col(c).alias("rep")).distinct())
    a, b = with_self("left_id").toDF("x", "left_id"), with_self("right_id").toDF("y", "right_id")
    between = pairs.join(a, "left_id").join(b, "right_id").select("x", "y")
    own = copies.unionByName(copies.select(F.col("rep").alias("id"), "rep").distinct())
    within = own.toDF("x", "rep").join(own.toDF("y", "rep"), "rep").filter("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()

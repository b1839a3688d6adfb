"""The k most similar vectors of every vector, by balanced posting lists.

Centroids, one for ``LIST_SIZE`` vectors, are fitted on a bounded sample by hash of the id (32 rows a list, from ``SAMPLE`` up to
``MOST``; many lists in two levels) and every vector is indexed. A vector stands in the posting list of its nearest centroid
and, near a boundary, in those of further centroids whose distance is within ``CLOSURE`` of the nearest. A query asks the
lists whose centroid lies within ``PRUNE`` of the nearest, at most as many as ``probes`` gives for that number of lists.
Centroids are found by beam search over an in-memory graph of their neighbours. Lists are balanced twice: the fit splits
centroids of many sample rows in place of those of few, and a list whose share of the sample foretells more than ``BLOCK``
rows is cut in blocks by the hash of the id, all of which its queries ask, so no task holds a whole large list. Each block is
scored as one matrix product; the best k over all blocks of a query are kept.

Above ``MOST`` / 4 lists (16.7 million vectors) the centroids in memory stay as many and the lists grow with the data.

Vectors are brought to length 1 and travel as 16-bit integers (error of a cosine about 1e-6).
Exact copies: the k+1 smallest ids of a group of equal vectors stand for it; any further copy has the k smallest
ids of its group as neighbours (cosine 1). So a group that holds a third of all rows costs no more than its rows.

Defined cases: null, zero and wrongly sized vectors and null ids take no part; ties go to the smaller id; of
repeated ids one row counts; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.sampling import by_hash
from foliograph.sources.tables import Scratch

SAMPLE, MOST = 32_768, 262_144
LIST_SIZE = 256
BLOCK = 2_048
REPLICAS, CLOSURE = 3, 1.15
PRUNE = 1.45
#: Centroids up to which they are fitted at once.
FLAT = 2_048
#: Cosines of centroids with each other that are held at once.
TILE = 1 << 22


def probes(lists: int, base: float = 14.0, growth: float = 0.3) -> int:
    """Lists a query may ask: ``base`` of a hundred and more by a power of their number, 0.3 being twice for every tenfold."""
    return max(1, round(base * max(1.0, lists / 100) ** growth))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 5, seed: int = 1) -> np.ndarray:
    """k-means on unit vectors; clusters far above the mean size are split in place of the smallest ones."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for r in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(sizes[:, None] > 0, sums, c)
        if r < rounds - 1:
            big, small = np.argsort(-sizes)[: max(1, k // 20)], np.argsort(sizes)[: max(1, k // 20)]
            for b, s in zip(big, small):
                if sizes[b] > 2 * len(x) / k and sizes[s] < len(x) / k / 2:
                    c[s] = x[rng.choice(np.flatnonzero(near == b))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit_lists(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids; above FLAT of them in two levels, each coarse cluster getting its share."""
    if k <= FLAT:
        return fit_centroids(x, k)
    coarse = fit_centroids(x, int(np.sqrt(k)))
    near = np.concatenate([np.argmax(x[i : i + 4096] @ coarse.T, axis=1) for i in range(0, len(x), 4096)])
    cells = [x[near == c] for c in range(len(coarse))]
    return np.concatenate([fit_centroids(m, max(1, min(len(m), round(k * len(m) / len(x))))) for m in cells if len(m)])


class CentroidGraph:
    """Every centroid with its nearest others; searched from pivots by a beam, all queries of a batch at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 20):
        self.c = centroids
        k = len(centroids)
        self.degree = min(degree, k - 1)
        if self.degree > 0:
            links = []
            step = max(1, min(1024, TILE // k))
            for i in range(0, k, step):
                s = centroids[i : i + step] @ centroids.T
                s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
                # A copy, as a slice would hold the whole order of every tile.
                links.append(np.argpartition(-s, self.degree - 1, axis=1)[:, : self.degree].astype(np.int32))
            self.links = np.concatenate(links)
        step = max(1, k // max(1, int(2 * np.sqrt(k))))
        self.pivots = np.arange(0, k, step, dtype=np.int32)

    def search(self, q: np.ndarray, width: int, hops: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the ``width`` nearest centroids of each row, best first."""
        width = min(width, len(self.c))
        s = q @ self.c[self.pivots].T
        keep = min(width, s.shape[1])
        top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        ids, score = self.pivots[top], np.take_along_axis(s, top, 1)
        if keep < width:
            ids = np.pad(ids, ((0, 0), (0, width - keep)), constant_values=-1)
            score = np.pad(score, ((0, 0), (0, width - keep)), constant_values=-np.inf)
        done = np.zeros(ids.shape, bool)
        for _ in range(hops if self.degree > 0 else 0):
            at = np.argmax(np.where(done, -np.inf, score), axis=1)
            row = np.arange(len(q))
            done[row, at] = True
            new = self.links[np.maximum(ids[row, at], 0)]
            ns = np.einsum("bd,brd->br", q, self.c[new], optimize=True)
            ns[(new[:, :, None] == ids[:, None, :]).any(2)] = -np.inf
            ids, score, done = np.concatenate([ids, new], 1), np.concatenate([score, ns], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1)
            top = np.argpartition(-score, width - 1, axis=1)[:, :width]
            ids, score, done = (np.take_along_axis(a, top, 1) for a in (ids, score, done))
        order = np.argsort(-score, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)


def _prepared(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): unit vectors as packed 16-bit integers."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.nan_to_num(np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = norm > 1e-12
            unit = x[ok] / norm[ok, None]
            packed = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 32767).astype(np.int16) if ok.any() else np.zeros((0, dim), np.int16)
            ids = b.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array([p.tobytes() for p in packed], pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def nearest(df: DataFrame, id_col: str = "faiss_id", vec_col: str = "vec", k: int = 5, dim: int = 64, min_cosine: float = -2.0, list_size: int = LIST_SIZE, sample: int = SAMPLE, most: int = MOST, block: int = BLOCK, base: float = 14.0, growth: float = 0.3) -> DataFrame:
    """(id, neighbour, cosine): up to k neighbours of each id, those below ``min_cosine`` left out.

    Neighbours of a high ``min_cosine`` lie in the first lists whatever the number of lists, so a ``growth`` of 0 is enough for them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    all_rows = scratch.put(_prepared(df, id_col, vec_col, dim))
    same = Window.partitionBy("v").orderBy("id")
    rows = scratch.put(all_rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, neighbour bigint, cosine double")
    drawn = by_hash(rows, min(most, max(sample, 32 * (n // list_size))), n=n).select("v").toArrow().column(0)
    x = np.concatenate([_unpack(drawn.slice(i, 16_384).combine_chunks(), dim) for i in range(0, len(drawn), 16_384)])
    del drawn
    centroids = fit_lists(x, int(min(most // 4, max(1, n // list_size), max(1, len(x) // 4))))
    fitted, asked = CentroidGraph(centroids), probes(len(centroids), base, growth)
    nearest_list = np.concatenate([fitted.search(x[i : i + 2048], 1 + REPLICAS)[0][:, 0] for i in range(0, len(x), 2048)])
    blocks = np.maximum(1, np.ceil(np.bincount(nearest_list, minlength=len(centroids)) * (n / len(x)) / block)).astype(np.int64)
    graph = spark.sparkContext.broadcast((fitted, blocks, asked))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cuts, asked = graph.value
        widest = max(REPLICAS, asked)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                q = _unpack(b.column(1), dim)
                ids, cos = g.search(q, widest + 3, widest + 6)
                ids, cos = ids[:, :widest], cos[:, :widest]
                far = np.sqrt(np.maximum(2 - 2 * cos, 0))
                place = np.arange(ids.shape[1])[None, :]
                member = ((far <= far[:, :1] * CLOSURE) & (place < REPLICAS) | (place == 0)) & (ids >= 0)
                asks = ((far <= far[:, :1] * PRUNE) & (place < asked) | (place == 0)) & (ids >= 0)
                r, c = np.nonzero(member | asks)
                lists, m, a = ids[r, c].astype(np.int64), member[r, c], asks[r, c]
                own = b.column(0).to_numpy()[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                # A row of a cut list goes to its own block, a query to all.
                times = np.where(a, cuts[lists], 1)
                e = np.repeat(np.arange(len(r)), times)
                at = np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times)
                mine = (own % cuts[lists].astype(np.uint64)).astype(np.int64)
                at = np.where(a[e], at, mine[e])
                take = pa.array(r[e])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[e].astype(np.int32)), pa.array(at.astype(np.int32)), b.column(0).take(take), pa.array(((m[e] & (at == mine[e])) + 2 * a[e]).astype(np.int8)), b.column(1).take(take)],
                    names=["list", "block", "id", "role", "v"],
                )

    def score(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, role = t["id"].to_numpy(), t["role"].to_numpy()
        v = _unpack(t["v"].combine_chunks(), dim)
        m, qs = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        m = m[np.argsort(ids[m], kind="stable")]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keep = min(k + 1, len(m))
        for i in range(0, len(qs), 1024):
            q = qs[i : i + 1024]
            if not keep:
                break
            s = v[q] @ v[m].T
            s[ids[q][:, None] == ids[m][None, :]] = -4
            s = np.round(s, 6)
            least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
            r, c = np.nonzero((s >= np.maximum(least, max(min_cosine - 1e-6, -3))[:, None]))
            order = np.lexsort((c, -s[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, r)
            best = np.arange(len(r)) - first < k
            r, c = r[best], c[best]
            out.append((ids[q][r], ids[m][c], s[r, c].astype(np.float64)))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, [np.int64, np.int64, np.float64][j]) for j in range(3)]
        return pa.table({"id": cols[0], "neighbour": cols[1], "cosine": cols[2]})

    placed = rows.select("id", "v").mapInArrow(assign, "list int, block int, id bigint, role tinyint, v binary")
    found = placed.groupBy("list", "block").applyInArrow(score, "id bigint, neighbour bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    once = found.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    top = once.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")
    copies = rows.filter(F.col("n") <= k).select("v", F.col("id").alias("neighbour"))
    full = rows.filter(F.col("n") == k + 1).select("v", F.col("id").alias("last"))
    surplus = all_rows.join(full, "v").filter(F.col("id") > F.col("last")).join(copies, "v").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    return top.unionByName(surplus).filter(F.col("cosine") >= min_cosine)


def similar_pairs(nearest_rows: DataFrame) -> DataFrame:
    """(left_id, right_id): each pair of which one is among the neighbours of the other, once."""
    return nearest_rows.select(F.least("id", "neighbour").alias("left_id"), F.greatest("id", "neighbour").alias("right_id")).distinct()

"""The graph of similar documents: keywords, vectors, edges."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import lifecycle
from foliograph.sources.tables import Scratch


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, n, first): counts of the normal tokens of documents (doc_id, text) and their first place."""
    # A document's words are counted where its text is: texts travel instead of words.
    raw = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(T.raw_tokens(F.col("text"))).alias("at", "raw"))
    rows = raw.select("doc_id", "at", T.normal_token(F.col("raw")).alias("term")).filter((F.length("term") >= 2) & ~F.col("term").isin(T.STOP_WORDS))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tf_idf(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(doc_id, term, score, first): share of the document times ln((N + 1) / (df + 0.5)) + 1; ``n_docs`` is N, empty ones too."""
    counts = Scratch(counts.sparkSession).put(counts.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))))  # read twice
    scored = counts.join(document_frequency(counts), "term")
    score = F.col("n") / F.col("total") * (F.log((n_docs + 1) / (F.col("df") + 0.5)) + 1)
    return scored.select("doc_id", "term", F.round(score, 8).alias("score"), "first")


def top_terms(scores: DataFrame, k: int = 30) -> DataFrame:
    """The k best terms of each document with their rank; ties go to the term that came first."""
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "first")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _order(n: int, block: int) -> int:
    """The q of a plane for n rows: at least the root of the blocks, and some at small sizes, so that there is work for all."""
    least = max((n / block) ** 0.5, min(5.0, (n / 400) ** 0.5))
    return next(p for p in itertools.count(1) if p >= least and all(p % i for i in range(2, int(p**0.5) + 1)))


def _paired(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (id, ...) on the lines of a plane, with (line, point, upright): any two meet on exactly one line.

    The points of an affine plane of q by q, q a prime, hold the rows by hash; any two points lie on one line, and rows of one
    point meet on its upright line. So a row is sent q + 1 times and a task has n / q rows; q grows with the root of n / ``block``.
    """
    q = _order(rows.count(), block)
    at = F.pmod(F.xxhash64("id"), F.lit(q * q))
    x, y = F.floor(at / q), at % q
    slanted = F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda m: m * q + F.pmod(y - m * x, F.lit(q))) if q > 1 else F.array().cast("array<bigint>")
    lines = F.concat(slanted.cast("array<int>"), F.array((x + q * q).cast("int")))
    # By number, as the work isn't in proportion to the bytes by which partitions would be put together; a line is its own
    # partition's number, as by hash some tasks would get three or four lines and others none.
    return rows.withColumn("point", at.cast("int")).withColumn("line", F.explode(lines)).withColumn("upright", F.col("line") >= q * q).repartitionById(q * q + q if q > 1 else 1, F.col("line"))


def _asked(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (id, lone, ...) so that each lone one, where it ``asks``, meets every other where that is ``held``.

    On the lines of the plane, or, where lone rows are few, on a grid: its parts of lone rows are sent to each part of all rows.
    """
    n, few = rows.count(), rows.filter("lone").count()
    r, c = max(1, -(-few // (4 * block))), max(24, -(-n // (2 * block)))
    if n * r + few * c >= n * (_order(n, block) + 1):
        return _paired(rows, block).withColumn("asks", F.col("lone")).withColumn("held", F.lit(True))
    up, along = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(r)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = rows.withColumn("i", every(r)).withColumn("j", along).withColumn("asks", F.lit(False))
    asks = rows.filter("lone").withColumn("i", up).withColumn("j", every(c)).withColumn("asks", F.lit(True))
    met = held.unionByName(asks).withColumn("line", F.col("i") * c + F.col("j")).drop("i", "j")
    return met.withColumn("held", ~F.col("asks")).withColumn("point", F.lit(0)).withColumn("upright", F.lit(True)).repartitionById(r * c, F.col("line"))


def _tiles(point: np.ndarray, upright: bool, rows: int = 1024, cols: int = 4096) -> Iterator[tuple[int, int, int, int]]:
    """Bounds of the tiles that hold every pair of a line's rows, sorted by ``point``; on an upright line those of one point, too."""
    cuts = [0, *(np.flatnonzero(np.diff(point)) + 1).tolist(), len(point)]
    for lo, hi in zip(cuts, cuts[1:]):
        for i in range(lo, hi, rows):
            for j in range(i if upright else hi, len(point), cols):
                yield i, min(i + rows, hi), j, min(j + cols, len(point))


def _hits(x: np.ndarray, small: np.ndarray, point: np.ndarray, upright: bool, cut: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, product to nine places) of the pairs that reach the cut of one of their rows, which may rise meanwhile.

    Products in single precision (``small``) leave out the others; their error is below the slack.
    """
    slack = max(1e-5, 2e-7 * x.shape[1])
    for i, i2, j, j2 in _tiles(point, upright):
        s = small[i:i2] @ small[j:j2].T
        near = (cut - slack).astype(np.float32)
        found = np.flatnonzero((s >= near[i:i2, None]) | (s >= near[None, j:j2]))
        for k in range(0, len(found), step):
            r, c = np.divmod(found[k : k + step], j2 - j)
            reach = s[r, c] >= np.minimum(cut[i + r], cut[j + c]) - slack
            r, c = i + r[reach], j + c[reach]
            r, c = r[r < c], c[r < c]
            yield r, c, np.round(np.einsum("ij,ij->i", x[r], x[c]), 9)


def _line(t: pa.Table, dim: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, bool]:
    """A line's rows by point; their vectors in double and in single precision, their points, whether it is upright."""
    t = t.sort_by("point").combine_chunks()
    x = np.asarray(t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
    return t, x, x.astype(np.float32), t["point"].to_numpy(), t["upright"][0].as_py()


def similar_by_vector(vectors: DataFrame, threshold: float, dim: int = 64, block: int = 8192) -> DataFrame:
    """(a, b, sim): pairs a < b of (id, vec, unit length) with an inner product of ``threshold`` and more."""
    placed = _paired(vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")), block)

    def score(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, x, small, point, upright = _line(pa.Table.from_batches(groups), dim)
        ids = t["id"].to_numpy()
        for r, c, sim in _hits(x, small, point, upright, np.full(len(x), threshold)):
            a, b = np.minimum(ids[r], ids[c]), np.maximum(ids[r], ids[c])
            keep = (sim >= threshold) & (a != b)
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (a, b, sim)], names=["a", "b", "sim"])

    return placed.groupBy("line").applyInArrow(score, "a bigint, b bigint, sim double")


def nearest_by_vector(vectors: DataFrame, threshold: float, most: int, dim: int = 64, block: int = 8192) -> DataFrame:
    """(node, a, b, sim, first, second): of the pairs of ``similar_by_vector`` those that can be among the ``most`` heaviest of a node.

    ``vectors`` has (id, vec, place); pairs of one weight, the product to four places, are in the order of their smaller and
    their larger place. Each line yields its own best of every row, so what leaves a task grows with its rows, not its pairs.
    """
    placed = _paired(vectors.select(F.col("id").cast("bigint").alias("id"), F.col("place").cast("bigint").alias("place"), F.col("vec").cast("array<double>").alias("vec")), block)

    def score(t: pa.Table) -> pa.Table:
        t, x, small, point, upright = _line(t, dim)
        ids, place = t["id"].to_numpy(), t["place"].to_numpy()
        weight, other, best = np.full((len(x), most), -1, np.int64), np.zeros((len(x), most), np.int64), np.zeros((len(x), most))
        cut = np.full(len(x), float(threshold))
        for r, c, sim in _hits(x, small, point, upright, cut):
            keep = (sim >= threshold) & (ids[r] != ids[c])
            r, c, sim = r[keep], c[keep], sim[keep]
            touched = np.unique(np.concatenate([r, c]))
            held, rank = np.nonzero(weight[touched] >= 0)
            held = touched[held]
            node, to = np.concatenate([r, c, held]), np.concatenate([c, r, other[held, rank]])
            s = np.concatenate([sim, sim, best[held, rank]])
            w = (np.rint(np.clip(s, 0, 1) * 1e9).astype(np.int64) + 50_000) // 100_000  # half up, as decimals
            order = np.lexsort((np.maximum(place[node], place[to]), np.minimum(place[node], place[to]), -w, node))
            node, to, s, w = node[order], to[order], s[order], w[order]
            rank = np.arange(len(node)) - np.searchsorted(node, node)
            top = rank < most
            at = node[top], rank[top]
            weight[at], other[at], best[at] = w[top], to[top], s[top]
            last = weight[touched, most - 1]
            cut[touched] = np.where(last > 0, np.maximum(threshold, (last - 0.5) / 1e4), threshold)
        node, rank = np.nonzero(weight >= 0)
        to = other[node, rank]
        ends, places = (ids[node], ids[to]), (place[node], place[to])
        return pa.table({"node": ends[0], "a": np.minimum(*ends), "b": np.maximum(*ends), "sim": best[node, rank], "first": np.minimum(*places), "second": np.maximum(*places)})

    return placed.groupBy("line").applyInArrow(score, "node bigint, a bigint, b bigint, sim double, first bigint, second bigint")


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark and SQL round: by the decimals of the number, halves up."""
    seen, at = np.unique(x, return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in seen.tolist()], np.float64)[at.reshape(x.shape)]


def similar_by_terms(terms: DataFrame, missing: DataFrame, threshold: float, block: int = 8192, cells: int = 1 << 20, digits: int | None = None) -> DataFrame:
    """(a, b, sim): Jaccard similarity of the term sets of pairs that share a term and of which one at least is in ``missing`` (doc_id).

    Sets meet as the vectors do, or on a grid if few are in ``missing``. In a task the shared terms of ``cells`` pairs at once are counted: frequent terms by a matrix
    product, the others by their lists of sets; on a line of the plane each pair once. No pair leaves a task that isn't in the
    result. With ``digits`` it is rounded, after the comparison with ``threshold``: few values are for many pairs.
    """
    sets = terms.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.collect_set("term").alias("terms"))
    lone = missing.select(F.col("doc_id").cast("bigint").alias("id")).distinct().withColumn("lone", F.lit(True))
    placed = _asked(Scratch(terms.sparkSession).put(sets.join(lone, "id", "left").withColumn("lone", F.coalesce("lone", F.lit(False)))), block)

    def score(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(groups)
        t = t.append_column("size", pc.list_value_length(t["terms"])).sort_by([("held", "descending"), ("asks", "descending"), ("size", "ascending")]).combine_chunks()
        ids, point, upright = t["id"].to_numpy(), t["point"].to_numpy(), t["upright"][0].as_py()
        lone, asks, held = (t[x].to_numpy() for x in ("lone", "asks", "held"))
        width = int(held.sum())
        if not width:
            return
        once = bool(held.all())  # a line of the plane: those that ask are the first of the rows, and meet what is after them
        lists = t["terms"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        word, n = words.indices.to_numpy().astype(np.int64), len(ids)
        del t, lists, words
        owner = np.repeat(np.arange(n), size)
        df = np.bincount(word)
        often = np.zeros(len(df), bool)
        most = np.argsort(-df, kind="stable")[: (1 << 26) // n]  # the matrix has 256 MB at most
        often[most[df[most] > n / 32]] = True
        dense = np.zeros((int(often.sum()), n), np.float32)
        dense[(np.cumsum(often) - 1)[word[often[word]]], owner[often[word]]] = 1
        # The other words with their sets in order, and where each begins and ends.
        few = ~often[word]
        word, owner = word[few], owner[few]
        in_held = owner < width
        order = np.argsort(word[in_held], kind="stable")
        posted, listed = owner[in_held][order], word[in_held][order] * n + owner[in_held][order]
        ends = np.cumsum(np.bincount(word[in_held], minlength=len(df)))
        mine = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        known = np.zeros(0)
        if size.max() < 256:
            both, total = np.arange(size.max() + 1)[:, None], np.arange(2 * size.max() + 1)[None, :]
            known = both / np.maximum(1, total - both)
            known = known if digits is None else _half_up(known, digits)
        asked = np.flatnonzero(asks)
        at = 0
        while at < len(asked):
            lo = int(asked[at]) if once else 0
            wide = width - lo
            rows = asked[at : at + max(1, cells // wide)]
            at += len(rows)
            here = mine[rows + 1] - mine[rows]
            row = np.repeat(np.arange(len(rows)), here)
            w = word[np.arange(len(row)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(mine[rows], here)]
            began = np.searchsorted(listed, w * n + lo)
            times = ends[w] - began
            to = np.arange(times.sum()) + np.repeat(began - (np.cumsum(times) - times), times)
            shared = (dense[:, rows].T @ dense[:, lo:width]).reshape(-1)
            np.add.at(shared, posted[to] + np.repeat(row * wide - lo, times), np.float32(1))
            need = np.maximum(0.5, threshold / (1 + threshold) * (size[rows[0]] + size[lo:width]) - 1e-4)
            r, b = np.divmod(np.flatnonzero(shared.reshape(len(rows), wide) >= need.astype(np.float32)), wide)
            both, a, b = shared[r * wide + b].astype(np.int64), rows[r], b + lo
            total = size[a] + size[b]
            keep = both / (total - both) >= threshold
            keep &= b > a if once else (ids[a] < ids[b]) | ~lone[b] & (ids[a] != ids[b])
            if not upright:
                keep &= point[a] != point[b]
            x, y, both, total = ids[a[keep]], ids[b[keep]], both[keep], total[keep]
            if len(known):
                sim = known[both, total]
            else:
                sim = both / (total - both)
                sim = sim if digits is None else _half_up(sim, digits)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(x, y), np.maximum(x, y), sim)], names=["a", "b", "sim"])

    return placed.groupBy("line").applyInArrow(score, "a bigint, b bigint, sim double")


def capped(edges: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b, weight, seq) that are among the ``most`` heaviest at one of their ends; ties by seq.

    This is what a greedy pass keeps that turns an edge down only when both its ends are full.
    """
    return capped_ends(edges.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "weight", "seq"), most)


def capped_ends(ends: DataFrame, most: int = 4) -> DataFrame:
    """As ``capped``, of edges listed by ``node``; a node without its lighter edges serves as well."""
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "seq")))
    return ranked.filter(F.col("r") <= most).select("a", "b", "weight", "seq").distinct()


def shared_terms(edges: DataFrame, terms: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, terms): the k shared terms of each edge with the highest sum of scores; ties by the term."""
    lists = terms.groupBy("doc_id").agg(F.collect_list(F.struct("term", "score")).alias("l")).select("doc_id", "l.term", "l.score")
    # Lists travel with the edges and are compared in their row; a row for each term of each edge would be some times as much.
    both = edges.select("a", "b").join(lists.toDF("a", "ta", "sa"), "a").join(lists.toDF("b", "tb", "sb"), "b")
    score = lambda x, t: F.get(f"s{x}", (F.array_position(f"t{x}", t) - 1).cast("int"))
    ranked = F.array_sort(F.transform(F.array_intersect("ta", "tb"), lambda t: F.struct((-F.round(score("a", t) + score("b", t), 7)).alias("s"), t.alias("term"))))
    top = both.select("a", "b", F.slice(ranked, 1, k)["term"].alias("top")).filter(F.size("top") > 0)
    return top.select("a", "b", F.array_join("top", " ").alias("terms"))


def edges(vectors: DataFrame, terms: DataFrame, order: DataFrame, threshold: float = 0.35, most: int = 4, dim: int = 64) -> DataFrame:
    """(a, b, basis, weight): vector similarity where both documents have vectors, else shared terms; capped by degree.

    ``order`` (doc_id, seq) is the listing order of the documents; it settles ties.
    """
    scratch = Scratch(vectors.sparkSession)  # both are read several times below
    vectors = scratch.put(vectors)
    listed = scratch.put(lifecycle.numbered(order.select("doc_id", "seq"), ["seq"], name="place").select("doc_id", "place"))
    by_vector = nearest_by_vector(vectors.join(listed.withColumnRenamed("doc_id", "id"), "id"), threshold, most, dim).withColumn("basis", F.lit("embedding"))
    missing = order.select("doc_id").join(vectors.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    by_terms = similar_by_terms(terms, missing, threshold).join(listed.toDF("a", "oa"), "a").join(listed.toDF("b", "ob"), "b")
    by_terms = by_terms.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "sim", F.least("oa", "ob").alias("first"), F.greatest("oa", "ob").alias("second"), F.lit("keywords").alias("basis"))
    weight = F.round(F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)), 4)
    ends = by_vector.unionByName(by_terms).select("node", "a", "b", weight.alias("weight"), F.struct("first", "second", "basis").alias("seq"))
    return capped_ends(ends, most).select("a", "b", F.col("seq.basis").alias("basis"), "weight")

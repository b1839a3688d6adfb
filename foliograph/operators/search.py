"""Exact vector search and the grouping of hits by document."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T

#: Queries that travel to every task at once; more are taken block by block, so what is broadcast has a fixed bound.
BLOCK = 8192


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 30, dim: int = 64, block: int = BLOCK) -> DataFrame:
    """(qid, row_id, score, rank): the k rows of ``vectors`` (row_id, vec) with the highest inner product for each of
    ``queries`` (qid, vec). Ties go to the smaller id. Rows of another size than ``dim`` take no part.

    Every task scores its rows against a block of queries as one matrix product and sends on its own best k only.
    """
    whole = lambda df, i: df.filter(F.col("vec").isNotNull() & (F.size("vec") == dim)).select(F.col(i).cast("bigint"), F.col("vec").cast("array<float>"))
    asked = whole(queries, "qid")
    spark = queries.sparkSession
    blocks = max(1, -(-asked.count() // block))
    rows = whole(vectors, "row_id")
    return reduce(DataFrame.unionByName, [_block(spark, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else asked, rows, k, dim) for i in range(blocks)])


def _best(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of each row, best first; only what reaches the k-th score is sorted."""
    k = min(k, s.shape[1])
    r, c = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((i[r, c], -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, c = r[keep], c[keep]
    return s[r, c].reshape(len(s), k), i[r, c].reshape(len(s), k)


def _block(spark, asked: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    t = asked.toArrow()
    sent = spark.sparkContext.broadcast((t["qid"].to_numpy(), _matrix(t["vec"].combine_chunks(), dim) if len(t) else np.zeros((0, dim))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        best_s, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                ids = b.column(0).to_numpy()
                s = np.concatenate([best_s, (q @ _matrix(b.column(1), dim).T).round(9)], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
                best_s, best_i = _best(s, i, k)
        if best_s.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["qid", "row_id", "score"])

    found = rows.mapInArrow(run, "qid bigint, row_id bigint, score double")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def group_by_document(matches: DataFrame, documents: DataFrame, per_document: int = 5, limit: int = 20) -> DataFrame:
    """(qid, position, document_id, filename, score, matches, top) of matches (qid, document_id, match_type, ref_id,
    page_number, preview, score, seq): each document's best score and first matches; documents by rounded score, then first appearance."""
    in_doc = Window.partitionBy("qid", "document_id").orderBy(F.col("score").desc(), "seq")
    ranked = matches.withColumn("r", F.row_number().over(in_doc))
    docs = ranked.groupBy("qid", "document_id").agg(
        F.round(F.max("score"), 4).alias("score"),
        F.min("seq").alias("first"),
        F.count("*").alias("matches"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= per_document, F.struct("r", "match_type", "ref_id", "page_number", "preview")))).alias("top"),
    )
    named = docs.join(documents.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "first", "document_id")
    return named.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).drop("first")


#: Kinds of index rows: what a hit is called, the table that holds it, its text.
KINDS = {
    "chunk": ("text", "text_chunks", "content"),
    "table": ("table", "tables", "table_text"),
    "annotation": ("annotation", "annotations", "concat('[', annot_type, '] ', content)"),
    "outline": ("outline", "outlines", "concat('목차: ', title)"),
}
#: Hits that a search of one type keeps.
SHOWN = {"text": ("text", "outline"), "table": ("table",), "annotation": ("annotation",)}


def _shown(rows: DataFrame, text: Column) -> DataFrame:
    """(row_id, document_id, page_number, text) of elements; a table without pages or texts shows none."""
    empty = [c for c in ("page_number", "content", "image_path", "table_text", "annot_type", "title") if c not in rows.columns]
    full = rows.withColumns({c: F.lit(None).cast("int" if c == "page_number" else "string") for c in empty})
    return full.select(F.col("id").alias("row_id"), "document_id", "page_number", text.alias("text"))


def text_hits(queries: DataFrame, tables: dict[str, DataFrame], k: int = 30, dim: int = 64) -> DataFrame:
    """(qid, document_id, match_type, ref_id, page_number, preview, score, seq) of the k best rows of the text index.

    Index rows are (row_id, vec) of chunks, or (faiss_id, kind, row_id, vec) of all kinds. Rows whose element is gone drop out
    after the k best are taken.
    """
    index = tables["text_vectors"]
    if "kind" not in index.columns:
        index = index.withColumn("kind", F.lit("chunk")).withColumn("faiss_id", F.col("row_id"))
    best = top_k(queries, index.select(F.col("faiss_id").alias("row_id"), "vec"), k, dim).withColumnRenamed("row_id", "faiss_id")
    named = best.join(index.select("faiss_id", F.coalesce("kind", F.lit("chunk")).alias("kind"), "row_id"), "faiss_id")
    parts = []
    for kind, (label, name, text) in KINDS.items():
        if name in tables:
            live = _shown(tables[name], F.expr(text))
            parts.append(named.filter(F.col("kind") == kind).join(live, "row_id").withColumn("match_type", F.lit(label)))
    return reduce(DataFrame.unionByName, parts).select("qid", "document_id", "match_type", F.col("row_id").alias("ref_id"), "page_number", T.snippet(F.col("text")).alias("preview"), "score", F.col("rank").alias("seq"))


def image_hits(queries: DataFrame, tables: dict[str, DataFrame], k: int = 30, dim: int = 64) -> DataFrame:
    live = _shown(tables["images"], F.concat(F.lit("/images/"), F.col("image_path")))
    hits = top_k(queries, tables["image_vectors"], k, dim).join(live, "row_id")
    return hits.select("qid", "document_id", F.lit("image").alias("match_type"), F.col("row_id").alias("ref_id"), "page_number", F.col("text").alias("preview"), "score", (F.col("rank") + k).alias("seq"))


def search(queries: DataFrame, image_queries: DataFrame | None, tables: dict[str, DataFrame], kind: str = "all", k: int = 30, limit: int = 20, dim: int = 64, image_dim: int | None = None) -> DataFrame:
    """Search of chunks, tables, annotations, outlines and images. The k best of each index are taken before deleted rows
    and other types drop out; a search of text shows outlines, too."""
    parts = []
    if kind != "image":
        hits = text_hits(queries, tables, k, dim)
        parts.append(hits if kind == "all" else hits.filter(F.col("match_type").isin(*SHOWN[kind])))
    if kind in ("all", "image") and image_queries is not None:
        parts.append(image_hits(image_queries, tables, k, image_dim or dim))
    return group_by_document(reduce(DataFrame.unionByName, parts), tables["documents"], limit=limit)

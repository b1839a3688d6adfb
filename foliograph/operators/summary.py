"""Extractive summaries: the most central sentences that don't repeat each other, and a document's parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from foliograph.functions import text as T


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """(document_id, seq, page_number, sentence) of chunks, in the order of page and chunk."""
    rows = chunks.select("document_id", "page_number", "chunk_index", "id", F.posexplode(T.summary_sentences(F.col("content"))).alias("at", "sentence"))
    return rows.select("document_id", F.struct("page_number", "chunk_index", "id", "at").alias("seq"), "page_number", "sentence")


def pick(vectors: np.ndarray, n: int, weight: float = 0.7) -> list[int]:
    """Places of n rows by maximal marginal relevance, in their order; the first of equals wins."""
    if len(vectors) <= n:
        return list(range(len(vectors)))
    mean = vectors.mean(axis=0)
    central = vectors @ (mean / (np.linalg.norm(mean) + 1e-12))
    taken: list[int] = []
    worst = np.zeros(len(vectors))
    for _ in range(n):
        score = np.round(weight * central - (1 - weight) * worst, 12)
        score[taken] = -np.inf
        taken.append(int(np.argmax(score)))
        like = vectors @ vectors[taken[-1]]
        worst = like if len(taken) == 1 else np.maximum(worst, like)
    return sorted(taken)


def key_rows(rows: DataFrame, n: int = 5, weight: float = 0.7, most: int | None = None) -> DataFrame:
    """(document_id, rank, row_id) of rows (document_id, seq, row_id, vec): the n picked of each document.

    Picking is sequential, so a document is one pandas group; its size is that of the document.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        x = np.array(g.vec.tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        at = pick(x, n, weight)
        return pd.DataFrame({"document_id": g.document_id.iloc[0], "rank": range(1, len(at) + 1), "row_id": g.row_id.iloc[at].values})

    return rows.select("document_id", "seq", "row_id", "vec").groupBy("document_id").applyInPandas(choose, "document_id long, rank int, row_id long")


def hashed_vector(dim: int = 64):
    """A deterministic bag-of-tokens vector where no model is at hand; it stands for no trained one."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for s in batches:
            out = []
            for t in s:
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1 if h >> 63 else -1
                out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
            yield pd.Series(out)

    return embed


def first_links(links: DataFrame, most: int = 50) -> DataFrame:
    """(document_id, rank, page_number, url, anchor): links once per address, in order, at most ``most`` of a document."""
    once = links.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "url").orderBy("seq"))).filter("n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))).filter(F.col("rank") <= most).drop("n")


def composite(documents: DataFrame, chunks: DataFrame, images: DataFrame, links: DataFrame, key: DataFrame) -> DataFrame:
    """One row per document: its name, counts and key sentences (document_id, sentences)."""
    stats = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("source") == "ocr").alias("ocr_chunk_count"))
    pictures = images.groupBy("document_id").agg(F.count("*").alias("image_count"))
    addresses = links.groupBy("document_id").agg(F.countDistinct("url").alias("link_count"))
    out = documents.select(F.col("doc_id").alias("document_id"), "filename", "page_count", "created_at", F.concat(F.lit("/pdfs/"), "stored_path").alias("pdf_url"))
    for part in (stats, pictures, addresses):
        out = out.join(part, "document_id", "left")
    return out.na.fill(0, ["chunk_count", "ocr_chunk_count", "image_count", "link_count"]).join(key, "document_id", "left")

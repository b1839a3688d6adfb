"""From parsed pages to rows of the store and of the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import chunks, lifecycle, pages
from foliograph.sources.tables import Scratch

#: Columns of each kind of element beside its document; what a parser yields in file order has a ``seq``.
ELEMENTS = {
    "images": ("page_number", "image_path", "width", "height", "kind"),
    "tables": ("page_number", "table_index", "cells", "table_text"),
    "outlines": ("level", "title", "page_number"),
    "links": ("page_number", "url", "anchor_text"),
    "annotations": ("page_number", "annot_type", "content"),
}
#: Index kind, table and indexed text of what stands in the text index.
INDEXED = {"chunk": ("text_chunks", "content"), "table": ("tables", "table_text"), "annotation": ("annotations", "concat('[', annot_type, '] ', content)"), "outline": ("outlines", "title")}


def page_chunks(parsed: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(document_id, page_number, chunk_index, content, source) of pages (document_id, page_number, text, source): pages
    normalised, running lines and page numbers taken out, wrapped lines joined, the rest cut to chunks."""
    native = F.coalesce(F.col("source"), F.lit("native")) != "ocr"
    clean = F.when(native, T.normal_page(F.col("text"))).otherwise(T.normal_page(F.col("text"), native=False))
    normal = Scratch(parsed.sparkSession).put(parsed.filter("text IS NOT NULL").select("document_id", "page_number", "source", clean.alias("text")))
    bare = pages.without_running_lines(normal.drop("source"), pages.running_lines(normal.drop("source")))
    cut = chunks.chunked(bare.withColumn("text", T.join_wrapped(F.col("text"))), size, overlap)
    return cut.join(normal.select("document_id", "page_number", F.coalesce("source", F.lit("native")).alias("source")).dropDuplicates(["document_id", "page_number"]), ["document_id", "page_number"])


def _next(stored: dict[str, DataFrame], name: str, key: str) -> int:
    """One above the largest number in use."""
    return (stored[name].agg(F.max(key)).head()[0] or 0) + 1 if name in stored and key in stored[name].columns else 1


def prepared(parsed: dict[str, DataFrame], stored: dict[str, DataFrame], size: int = 500, overlap: int = 50) -> dict[str, DataFrame]:
    """The new rows of every table for parsed files whose hash is new.

    ``parsed`` holds documents (file_hash, filename, stored_path, page_count, metadata, created_at), pages (file_hash,
    page_number, text, source) and, where there are any, the ELEMENTS by file_hash. Files without a hash or a page are no
    documents. Ids go on from the largest stored one in the order of hash, page and place. Every frame is written once.
    """
    docs = parsed["documents"].filter("file_hash IS NOT NULL AND page_count > 0")
    scratch = Scratch(docs.sparkSession)
    # Of files with one hash the first by name; combined before the shuffle.
    names = [c for c in docs.columns if c != "file_hash"]
    one = docs.groupBy("file_hash").agg(F.min_by(F.struct(*names), F.struct("filename", "stored_path")).alias("f")).select("file_hash", *(f"f.{c}" for c in names))
    new = lifecycle.admitted(one, stored.get("documents"), order="filename")
    out = {"documents": scratch.put(lifecycle.numbered(new, ["file_hash"], _next(stored, "documents", "doc_id"), "doc_id"))}
    owner = out["documents"].select("file_hash", F.col("doc_id").alias("document_id"))
    own = lambda df: df.join(owner, "file_hash").drop("file_hash")
    cut = page_chunks(own(parsed["pages"]), size, overlap)
    out["text_chunks"] = scratch.put(lifecycle.numbered(cut, ["document_id", "page_number", "chunk_index"], _next(stored, "text_chunks", "id"), "id"))
    for name, columns in ELEMENTS.items():
        if name in parsed:
            rows = own(parsed[name])
            order = ["document_id", *(["seq"] if "seq" in rows.columns else []), *(c for c in columns if c != "cells")]
            out[name] = scratch.put(lifecycle.numbered(rows.select(*dict.fromkeys([*order, *columns])), order, _next(stored, name, "id"), "id").drop("seq"))
    return out


def index_rows(new: dict[str, DataFrame]) -> DataFrame:
    """(kind, row_id, document_id, text) of what goes into the text index; outline titles of four letters and more."""
    parts = []
    for kind, (name, text) in INDEXED.items():
        if name in new:
            rows = new[name].select(F.lit(kind).alias("kind"), F.col("id").alias("row_id"), "document_id", F.expr(text).alias("text")).filter("text IS NOT NULL")
            parts.append(rows.filter(F.length("text") >= 4) if kind == "outline" else rows)
    return reduce(DataFrame.unionByName, parts)


def indexed(vectors: DataFrame, stored: dict[str, DataFrame], name: str = "text_vectors") -> DataFrame:
    """``vectors`` (kind, row_id, document_id, vec) with the next faiss_id numbers, in the order of kind and row."""
    return lifecycle.numbered(vectors, ["kind", "row_id"], _next(stored, name, "faiss_id"))


def backfilled(rows: DataFrame, vectors: DataFrame, kind: Column) -> DataFrame:
    """Rows with the faiss_id of their vector; null where they have none."""
    return rows.join(vectors.filter(kind).select(F.col("row_id").alias("id"), "faiss_id"), "id", "left")


def report(new: dict[str, DataFrame], warnings: DataFrame | None = None) -> DataFrame:
    """Counts of each new document (doc_id, filename, page_count, text_chunks, images, vector_graphics, tables, outlines,
    links, annotations, ocr_pages); images without vector graphics."""
    out = new["documents"].select("doc_id", "filename", "page_count")
    count = lambda df, **c: df.groupBy(F.col("document_id").alias("doc_id")).agg(*(x.alias(n) for n, x in c.items()))
    vector = F.count_if(F.col("kind") == "vector")
    parts = [count(new["text_chunks"], text_chunks=F.count("*"), ocr_pages=F.countDistinct(F.when(F.col("source") == "ocr", F.col("page_number"))))]
    for name in ELEMENTS:
        if name in new:
            parts.append(count(new[name], images=F.count("*") - vector, vector_graphics=vector) if name == "images" else count(new[name], **{name: F.count("*")}))
    for p in parts:
        out = out.join(p, "doc_id", "left")
    for name in ("text_chunks", "ocr_pages", "images", "vector_graphics", "tables", "outlines", "links", "annotations"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) if name in out.columns else F.lit(0).cast("bigint"))
    return out

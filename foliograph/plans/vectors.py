"""Queries over vectors: search, grouping of hits, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions import vectors as V
from foliograph.operators import lifecycle, search
from foliograph.plans.registry import query
from foliograph.sources.tables import table


def asked(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The queries: every vector whose number is divisible by 20."""
    return table(spark, d, name).filter("faiss_id % 20 = 0 AND vec IS NOT NULL").select(F.col("faiss_id").alias("qid"), "vec")


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).filter("vec IS NOT NULL").select("row_id", "vec")


def sql_hits(name: str, k: int = 30) -> str:
    """Common table expression: the k best rows of an index for each query."""
    return f"""{name}_q AS (SELECT faiss_id AS qid, vec::DOUBLE[] AS q FROM {name}_vectors WHERE faiss_id % 20 = 0 AND vec IS NOT NULL AND len(vec) = 64),
{name}_s AS (SELECT qid, row_id, round(list_dot_product(q, vec::DOUBLE[]), 9) AS score FROM {name}_q, {name}_vectors WHERE vec IS NOT NULL AND len(vec) = 64),
{name}_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


@query("vec_01", "SELECT faiss_id, round(list_sum(list_transform(vec::DOUBLE[], lambda x: x * x)), 4) AS squares, round(CASE WHEN list_sum(list_transform(vec::DOUBLE[], lambda x: x * x)) > 0 THEN vec[1]::DOUBLE / sqrt(list_sum(list_transform(vec::DOUBLE[], lambda x: x * x))) ELSE 0.0 END, 6) AS first FROM text_vectors WHERE vec IS NOT NULL")
def vec_01(spark, d):
    v = table(spark, d, "text_vectors").filter("vec IS NOT NULL")
    return v.select("faiss_id", F.round(V.dot(F.col("vec"), F.col("vec")), 4).alias("squares"), F.round(F.get(V.unit(F.col("vec")), F.lit(0)), 6).alias("first"))


@query("vec_02", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def vec_02(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"), "label"), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"), "label")
    return a.join(b, "label").filter("a < b").select("a", "b", F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("product"))


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, centroid) over each document's first 200 chunk vectors in page order."""
    order = table(spark, d, "text_chunks").select(F.col("id").alias("row_id"), "page_number", "chunk_index")
    v = table(spark, d, "text_vectors").filter("vec IS NOT NULL").select("row_id", "document_id", "vec").join(order, "row_id")
    return V.centroids(v, "document_id", ["page_number", "chunk_index", "row_id"])


SQL_CENTROIDS = """first AS (SELECT * FROM (SELECT v.document_id, v.row_id, v.vec, row_number() OVER (PARTITION BY v.document_id ORDER BY c.page_number, c.chunk_index, v.row_id) AS n FROM text_vectors v JOIN text_chunks c ON c.id = v.row_id WHERE v.vec IS NOT NULL) WHERE n <= 200),
part AS (SELECT document_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM first),
mean AS (SELECT document_id, i, avg(x::DOUBLE) AS m FROM part GROUP BY ALL),
centroid AS (SELECT document_id, list(m / nrm ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY document_id)) AS nrm FROM mean) WHERE nrm > 0 GROUP BY document_id)"""


@query("vec_03", f"WITH {SQL_CENTROIDS} SELECT document_id, i, round(x, 5) AS x FROM (SELECT document_id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM centroid)")
def vec_03(spark, d):
    return document_vectors(spark, d).select("document_id", F.posexplode("centroid").alias("i", "x")).select("document_id", "i", F.round("x", 5).alias("x"))


@query("top_01", f"WITH {sql_hits('text')} SELECT qid, row_id, round(score, 5) AS score, rank FROM text_hits")
def top_01(spark, d):
    return search.top_k(asked(spark, d, "text_vectors"), rows(spark, d, "text_vectors")).withColumn("score", F.round("score", 5))


@query("top_02", f"WITH {sql_hits('image')} SELECT qid, row_id, round(score, 5) AS score, rank FROM image_hits")
def top_02(spark, d):
    return search.top_k(asked(spark, d, "image_vectors"), rows(spark, d, "image_vectors")).withColumn("score", F.round("score", 5))


@query("jn_04", f"WITH {sql_hits('text')} SELECT qid, rank, h.row_id, c.document_id, c.page_number FROM text_hits h JOIN text_chunks c ON c.id = h.row_id")
def jn_04(spark, d):
    live = table(spark, d, "text_chunks").select(F.col("id").alias("row_id"), "document_id", "page_number")
    return search.top_k(asked(spark, d, "text_vectors"), rows(spark, d, "text_vectors")).join(live, "row_id").select("qid", "rank", "row_id", "document_id", "page_number")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("text_chunks", "images", "documents")} | {n: rows(spark, d, n) for n in ("text_vectors", "image_vectors")}


SQL_GROUPED = """matches AS ({matches}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY score DESC, seq) AS r FROM matches),
docs AS (SELECT qid, document_id, round(max(score), 4) AS score, min(seq) AS first, count(*) AS matches, string_agg(CASE WHEN r <= 5 THEN match_type || ref_id END, ',' ORDER BY r) AS top FROM ranked GROUP BY ALL),
placed AS (SELECT qid, document_id, filename, score, matches, top, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, document_id) AS position FROM docs JOIN documents ON doc_id = document_id)
SELECT * FROM placed WHERE position <= 20"""
SQL_TEXT = "SELECT qid, c.document_id, 'text' AS match_type, c.id AS ref_id, score, rank AS seq FROM text_hits h JOIN text_chunks c ON c.id = h.row_id"
SQL_IMAGE = "SELECT qid, c.document_id, 'image', c.id, score, rank + 30 FROM image_hits h JOIN images c ON c.id = h.row_id"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("top", F.array_join(F.transform("top", lambda s: F.concat(s["match_type"], s["ref_id"].cast("string"))), ","))


@query("search_documents", f"WITH {sql_hits('text')}, {sql_hits('image')}, " + SQL_GROUPED.format(matches=f"{SQL_TEXT} UNION ALL {SQL_IMAGE}"))
def search_documents(spark, d):
    """Text and image search of every query, hits grouped by document (AGG-13, JN-05, TOP-03, TOP-04, SET-01)."""
    return _flat(search.search(asked(spark, d, "text_vectors"), asked(spark, d, "image_vectors"), _tables(spark, d)))


#: Rows of the index by the rest of their number: the elements of all kinds, told on the chunks' own texts.
SQL_MIXED = """mixed_q AS (SELECT faiss_id AS qid, vec::DOUBLE[] AS q FROM text_vectors WHERE faiss_id % 20 = 0 AND vec IS NOT NULL AND len(vec) = 64),
mixed_s AS (SELECT qid, faiss_id, row_id, round(list_dot_product(q, vec::DOUBLE[]), 9) AS score FROM mixed_q, text_vectors WHERE vec IS NOT NULL AND len(vec) = 64),
mixed_hits AS (SELECT *, ['text', 'table', 'annotation', 'outline'][faiss_id % 4 + 1] AS match_type FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, faiss_id) AS rank FROM mixed_s) WHERE rank <= 30)"""
SQL_KIND = "SELECT qid, c.document_id, match_type, c.id AS ref_id, score, rank AS seq FROM mixed_hits h JOIN text_chunks c ON c.id = h.row_id WHERE match_type IN ({})"


def _mixed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """An index of chunks, tables, annotations and outlines, each element with a chunk's text."""
    c = table(spark, d, "text_chunks").select("id", "document_id", "page_number", "content")
    kind = F.element_at(F.array(*map(F.lit, search.KINDS)), (F.col("faiss_id") % 4 + 1).cast("int"))
    index = table(spark, d, "text_vectors").filter("vec IS NOT NULL").select("faiss_id", "row_id", "vec", kind.alias("kind"))
    tables = {"tables": c.withColumnRenamed("content", "table_text"), "annotations": c.withColumn("annot_type", F.lit("Note")), "outlines": c.withColumnRenamed("content", "title")}
    return tables | {"text_chunks": c, "text_vectors": index, "documents": table(spark, d, "documents")}


@query("search_text_kind", f"WITH {SQL_MIXED}, " + SQL_GROUPED.format(matches=SQL_KIND.format("'text', 'outline'")))
def search_text_kind(spark, d):
    """Text hits, outlines among them (FLT-01)."""
    return _flat(search.search(asked(spark, d, "text_vectors"), None, _mixed(spark, d), kind="text"))


@query("search_table_kind", f"WITH {SQL_MIXED}, " + SQL_GROUPED.format(matches=SQL_KIND.format("'table'")))
def search_table_kind(spark, d):
    return _flat(search.search(asked(spark, d, "text_vectors"), None, _mixed(spark, d), kind="table"))


@query("search_annotation_kind", f"WITH {SQL_MIXED}, " + SQL_GROUPED.format(matches=SQL_KIND.format("'annotation'")))
def search_annotation_kind(spark, d):
    return _flat(search.search(asked(spark, d, "text_vectors"), None, _mixed(spark, d), kind="annotation"))


@query("search_all_kinds", f"WITH {SQL_MIXED}, {sql_hits('image')}, " + SQL_GROUPED.format(matches=SQL_KIND.format("'text', 'table', 'annotation', 'outline'") + f" UNION ALL {SQL_IMAGE}"))
def search_all_kinds(spark, d):
    """Every kind of element and images (JN-04, SET-01, API-05)."""
    tables = _mixed(spark, d) | {"images": table(spark, d, "images"), "image_vectors": rows(spark, d, "image_vectors")}
    return _flat(search.search(asked(spark, d, "text_vectors"), asked(spark, d, "image_vectors"), tables))


@query("flt_01", f"WITH {sql_hits('text')}, " + SQL_GROUPED.format(matches=SQL_TEXT))
def flt_01(spark, d):
    """Text hits only; the type filter comes after the k best are taken."""
    return _flat(search.search(asked(spark, d, "text_vectors"), None, _tables(spark, d), kind="text"))


@query("flt_04", "SELECT faiss_id, row_id FROM text_vectors WHERE faiss_id IN (SELECT faiss_id FROM text_chunks WHERE faiss_id IS NOT NULL)")
def flt_04(spark, d):
    return lifecycle.live(table(spark, d, "text_vectors"), table(spark, d, "text_chunks")).select("faiss_id", "row_id")


@query("win_04", "SELECT id, row_number() OVER (ORDER BY document_id, page_number, chunk_index, id) - 1 + 100 AS faiss_id FROM text_chunks")
def win_04(spark, d):
    return lifecycle.numbered(table(spark, d, "text_chunks").select("id", "document_id", "page_number", "chunk_index"), ["document_id", "page_number", "chunk_index", "id"], start=100).select("id", "faiss_id")


@query("snk_05", "SELECT faiss_id, max(id) AS id FROM text_chunks WHERE faiss_id IS NOT NULL GROUP BY faiss_id")
def snk_05(spark, d):
    return lifecycle.latest(table(spark, d, "text_chunks").filter("faiss_id IS NOT NULL").select("faiss_id", "id"), "faiss_id", "id")

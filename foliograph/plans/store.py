"""Queries over the document store: listings, details, admission, removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators import catalog, geometry, ingest, lifecycle, summary
from foliograph.plans.registry import query
from foliograph.plans.texts import URL, _docs
from foliograph.sources.tables import table

_N = lambda t, k="document_id": f"(SELECT count(*) FROM {t} x WHERE x.{k} = d.doc_id)"


def _children(spark, d, *names) -> dict:
    return {n: (table(spark, d, t), "document_id") for n, t in names}


@query("agg_01", f"SELECT doc_id, filename, {_N('text_chunks')} AS chunk_count, {_N('images')} AS image_count FROM documents d")
def agg_01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "filename")
    return catalog.counted(docs, "doc_id", _children(spark, d, ("chunk_count", "text_chunks"), ("image_count", "images")))


@query("agg_02", f"SELECT doc_id, filename, page_count, {_N('text_chunks')} AS chunks, {_N('images')} AS images, {_N('text_vectors')} AS text_vectors, {_N('image_vectors')} AS image_vectors, {_N('entity_mentions')} AS mentions FROM documents d")
def agg_02(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "filename", "page_count")
    return catalog.counted(docs, "doc_id", _children(spark, d, ("chunks", "text_chunks"), ("images", "images"), ("text_vectors", "text_vectors"), ("image_vectors", "image_vectors"), ("mentions", "entity_mentions")))


@query("agg_18", "SELECT coalesce(c.document_id, i.document_id) AS document_id, coalesce(chunks, 0) AS chunks, coalesce(ocr_chunks, 0) AS ocr_chunks, coalesce(images, 0) AS images, coalesce(drawings, 0) AS drawings FROM (SELECT document_id, count(*) AS chunks, count(*) FILTER (lower(trim(source)) = 'ocr') AS ocr_chunks FROM text_chunks GROUP BY 1) c FULL JOIN (SELECT document_id, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'vector') AS drawings FROM images GROUP BY 1) i ON c.document_id = i.document_id")
def agg_18(spark, d):
    return catalog.ingest_report(table(spark, d, "text_chunks"), table(spark, d, "images"))


@query("src_15", "SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, id) AS place FROM text_chunks")
def src_15(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "id")
    return table(spark, d, "text_chunks").select("id", "document_id", F.row_number().over(order).alias("place"))


@query("src_16", "SELECT c.id, c.document_id, c.page_number FROM text_chunks c WHERE id IN (SELECT chunk_id FROM entity_mentions)")
def src_16(spark, d):
    """Point look-ups in bulk: the chunks that mentions name."""
    wanted = table(spark, d, "entity_mentions").select(F.col("chunk_id").alias("id")).distinct()
    return table(spark, d, "text_chunks").join(wanted, "id", "left_semi").select("id", "document_id", "page_number")


@query("api_01", "SELECT doc_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) AS n FROM documents WHERE doc_id % 3 = 0) WHERE (n = 1 OR file_hash IS NULL) AND (file_hash IS NULL OR file_hash NOT IN (SELECT file_hash FROM documents WHERE doc_id % 3 <> 0 AND file_hash IS NOT NULL))")
def api_01(spark, d):
    """A third of the documents arrives at the store of the others."""
    docs = table(spark, d, "documents").select("doc_id", "file_hash")
    return lifecycle.admitted(docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 != 0"))


#: The tables that the test data hold.
STORED = ("documents", "text_chunks", "images", "text_vectors", "image_vectors", "entity_mentions")
_LEFT = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} WHERE {k} IS NULL OR {k} NOT IN (SELECT doc_id FROM documents WHERE source = 'shared-inbox')" for t, k in lifecycle.OWNER.items() if t in STORED)


@query("api_04", _LEFT)
def api_04(spark, d):
    """What stays of each table when all documents of one folder are deleted."""
    tables = {t: table(spark, d, t).select(k) for t, k in lifecycle.OWNER.items() if t in STORED}
    gone = table(spark, d, "documents").filter("source = 'shared-inbox'").select("doc_id")
    left = lifecycle.without(tables, gone)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, df in left.items()])


def links(spark, d) -> DataFrame:
    """Addresses in document texts as links (document_id, seq, page_number, url, anchor)."""
    found = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.posexplode(F.regexp_extract_all("text", F.lit(URL), F.lit(0))).alias("seq", "url"))
    return found.filter("url != ''").select("document_id", "seq", F.lit(1).alias("page_number"), "url", F.substring("url", 1, 200).alias("anchor"))


SQL_LINKS = f"links AS (SELECT doc_id AS document_id, unnest(regexp_extract_all(text, '{URL}')) AS url, generate_subscripts(regexp_extract_all(text, '{URL}'), 1) - 1 AS seq FROM documents)"


@query("src_10", f"WITH {SQL_LINKS} SELECT document_id, seq, url, left(url, 200) AS anchor FROM links")
def src_10(spark, d):
    return links(spark, d).drop("page_number")


@query("top_11", f"WITH {SQL_LINKS} SELECT * FROM (SELECT document_id, url, row_number() OVER (PARTITION BY document_id ORDER BY min(seq)) AS rank FROM links GROUP BY document_id, url) WHERE rank <= 50")
def top_11(spark, d):
    return summary.first_links(links(spark, d)).select("document_id", "url", "rank")


@query("agg_19", f"WITH {SQL_LINKS} SELECT doc_id AS document_id, {_N('text_chunks')} AS chunk_count, (SELECT count(*) FROM text_chunks x WHERE x.document_id = doc_id AND source = 'ocr') AS ocr_chunk_count, {_N('images')} AS image_count, (SELECT count(DISTINCT url) FROM links x WHERE x.document_id = doc_id) AS link_count FROM documents d")
def agg_19(spark, d):
    none = spark.createDataFrame([], "document_id bigint, sentences array<string>")
    out = summary.composite(table(spark, d, "documents"), table(spark, d, "text_chunks"), table(spark, d, "images"), links(spark, d), none)
    return out.select("document_id", "chunk_count", "ocr_chunk_count", "image_count", "link_count")


@query("top_08")
def top_08(spark, d):
    """The five chunks of each document that its summary would show, by their stored vectors."""
    v = table(spark, d, "text_vectors").filter("vec IS NOT NULL").select("row_id", "document_id", "vec")
    return summary.key_rows(v.withColumn("seq", F.col("row_id")))


@query("api_16")
def api_16(spark, d):
    """Summaries of all documents: counts and key sentences by hashed vectors."""
    rows = summary.sentence_rows(table(spark, d, "text_chunks"))
    place = F.col("seq.page_number").cast("bigint") * 1_000_000_000 + F.col("seq.chunk_index").cast("bigint") * 1_000_000 + F.col("seq.at")
    kept = rows.select("document_id", place.alias("row_id"), summary.hashed_vector()("sentence").alias("vec"))
    picked = summary.key_rows(kept.withColumn("seq", F.col("row_id")))
    key = picked.groupBy("document_id").agg(F.count("*").alias("sentences"))
    return summary.composite(table(spark, d, "documents"), table(spark, d, "text_chunks"), table(spark, d, "images"), links(spark, d), key)


@query(
    "api_02",
    "WITH n AS (SELECT file_hash, arg_min(doc_id, doc_id) AS own, min(filename) AS filename FROM documents WHERE file_hash IS NOT NULL AND page_count > 0 GROUP BY 1), i AS (SELECT file_hash, count(*) FILTER (kind IS DISTINCT FROM 'vector') AS images, count(*) FILTER (kind = 'vector') AS vector_graphics FROM images JOIN documents ON doc_id = document_id WHERE file_hash IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY file_hash) AS doc_id, file_hash, coalesce(images, 0) AS images, coalesce(vector_graphics, 0) AS vector_graphics FROM n LEFT JOIN i USING (file_hash)",
)
def api_02(spark, d):
    """All documents taken in anew by an empty store, a text being one page: ids and counts (API-02, API-03, SNK-01)."""
    docs = table(spark, d, "documents")
    by = docs.select(F.col("doc_id").alias("document_id"), "file_hash").filter("file_hash IS NOT NULL")
    parsed = {"documents": docs.drop("text", "doc_id"), "pages": docs.select("file_hash", F.lit(1).alias("page_number"), "text", "source"), "images": table(spark, d, "images").join(by, "document_id").drop("document_id", "id", "faiss_id")}
    new = ingest.prepared(parsed, {})
    return ingest.report(new).join(new["documents"].select("doc_id", "file_hash"), "doc_id").select("doc_id", "file_hash", "images", "vector_graphics")


@query("geo_02")
def geo_02(spark, d):
    """Regions of the boxes of embedded images, laid out on a page in order."""
    i = table(spark, d, "images").filter("width > 0 AND height > 0")
    x, y = (F.col("id") * 37 % 400).cast("double"), (F.col("id") * 91 % 600).cast("double")
    boxes = i.select("document_id", "page_number", F.col("id").alias("seq"), x.alias("x0"), y.alias("y0"), (x + F.col("width") / 10).alias("x1"), (y + F.col("height") / 10).alias("y1"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    return geometry.regions(boxes, least_drawings=1)


@query("src_08", "SELECT id, document_id, page_number, width, height FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, image_path ORDER BY id) AS n FROM images WHERE width >= 50 AND height >= 50) WHERE n = 1")
def src_08(spark, d):
    """Embedded images of some size, once per page."""
    from pyspark.sql import Window

    first = Window.partitionBy("document_id", "page_number", "image_path").orderBy("id")
    return table(spark, d, "images").filter("width >= 50 AND height >= 50").withColumn("n", F.row_number().over(first)).filter("n = 1").select("id", "document_id", "page_number", "width", "height")


@query("src_06", "SELECT document_id, page_number, CASE WHEN length(trim(coalesce(n, ''))) < 30 AND coalesce(o, '') <> '' AND length(o) > length(coalesce(n, '')) THEN 'ocr' ELSE 'native' END AS used FROM (SELECT document_id, page_number, string_agg(content, ' ') FILTER (source = 'native') AS n, string_agg(content, ' ') FILTER (source = 'ocr') AS o FROM text_chunks GROUP BY ALL)")
def src_06(spark, d):
    """Native text of a page, or recognised text where the native is too short."""
    said = lambda s: F.array_join(F.collect_list(F.when(F.col("source") == s, F.col("content"))), " ")
    p = table(spark, d, "text_chunks").groupBy("document_id", "page_number").agg(said("native").alias("n"), said("ocr").alias("o"))
    used = F.when((F.length(F.trim("n")) < 30) & (F.col("o") != "") & (F.length("o") > F.length("n")), "ocr").otherwise("native")
    return p.select("document_id", "page_number", used.alias("used"))

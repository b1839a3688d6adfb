"""Queries over keywords and the graph of similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.operators import docgraph
from foliograph.plans.registry import query
from foliograph.plans.texts import SQL_TERMS, _docs
from foliograph.plans.vectors import SQL_CENTROIDS, document_vectors
from foliograph.sources.tables import Scratch, table

THRESHOLD = 0.35


def counts(spark: SparkSession, d: str) -> DataFrame:
    return docgraph.term_counts(_docs(spark, d))


def terms(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    n = table(spark, d, "documents").count()
    return docgraph.top_terms(docgraph.tf_idf(counts(spark, d), F.lit(n)), k)


SQL_SCORES = f"""{SQL_TERMS},
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scores AS (SELECT doc_id, term, place, round(n / (sum(n) OVER (PARTITION BY doc_id))::DOUBLE * (ln(((SELECT count(*) FROM documents) + 1) / (df + 0.5)::DOUBLE) + 1), 8) AS score FROM counts JOIN df USING (term)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM scores) WHERE rank <= 30)"""


@query("agg_03", f"WITH {SQL_TERMS} SELECT doc_id, term, n FROM counts")
def agg_03(spark, d):
    return counts(spark, d).drop("first")


@query("agg_04", f"WITH {SQL_TERMS} SELECT term, count(*) AS df FROM counts GROUP BY term")
def agg_04(spark, d):
    return docgraph.document_frequency(counts(spark, d))


@query("agg_05", f"WITH {SQL_SCORES} SELECT doc_id, term, score FROM scores")
def agg_05(spark, d):
    n = table(spark, d, "documents").count()
    return docgraph.tf_idf(counts(spark, d), F.lit(n)).select("doc_id", "term", "score")


@query("top_05", f"WITH {SQL_SCORES} SELECT doc_id, term, rank FROM top WHERE rank <= 10")
def top_05(spark, d):
    return terms(spark, d, 10).select("doc_id", "term", "rank")


@query("agg_20", f"WITH {SQL_SCORES} SELECT doc_id, other, round(n / (sa + sb - n)::DOUBLE, 6) AS sim FROM (SELECT a.doc_id, b.doc_id AS other, count(*) AS n FROM top a JOIN top b ON a.term = b.term AND a.doc_id < b.doc_id WHERE a.doc_id % 50 = 0 OR b.doc_id % 50 = 0 GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS sa FROM top GROUP BY 1) USING (doc_id) JOIN (SELECT doc_id AS other, count(*) AS sb FROM top GROUP BY 1) USING (other) WHERE n / (sa + sb - n)::DOUBLE >= 0.05")
def agg_20(spark, d):
    """Keyword overlap of every fiftieth document with all."""
    t = terms(spark, d).select("doc_id", "term", "score")
    few = table(spark, d, "documents").filter("doc_id % 50 = 0").select("doc_id")
    return docgraph.similar_by_terms(t, few, 0.05, digits=6).toDF("doc_id", "other", "sim")


@query("agg_20_all")
def agg_20_all(spark, d):
    """Keyword overlap of all documents with all; agg_20 has the part that its SQL states."""
    t = Scratch(spark).put(terms(spark, d).select("doc_id", "term", "score"))
    return docgraph.similar_by_terms(t, t, 0.05, digits=6).toDF("doc_id", "other", "sim")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return document_vectors(spark, d).select(F.col("document_id").alias("id"), F.col("centroid").alias("vec"))


SQL_SIMILAR = f"""{SQL_CENTROIDS},
sims AS (SELECT a.document_id AS a, b.document_id AS b, round(list_dot_product(a.c, b.c), 9) AS sim FROM centroid a JOIN centroid b ON a.document_id < b.document_id)"""


@query("jn_10", f"WITH {SQL_SIMILAR} SELECT a, b, round(sim, 5) AS sim FROM sims WHERE sim >= {THRESHOLD}")
def jn_10(spark, d):
    return docgraph.similar_by_vector(unit_vectors(spark, d), THRESHOLD).withColumn("sim", F.round("sim", 5))


def order(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq): newest first, without a time last. Document numbers stand in for a running position."""
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.struct((-at).alias("t"), F.col("doc_id").alias("i")).alias("seq"))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = Scratch(spark).put(terms(spark, d))
    return docgraph.edges(unit_vectors(spark, d), t.select("doc_id", "term", "score"), order(spark, d), THRESHOLD), t


SQL_EDGES = f"""{SQL_SCORES}, {SQL_SIMILAR},
by_vector AS (SELECT a, b, sim, 'embedding' AS basis FROM sims WHERE sim >= {THRESHOLD}),
missing AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM centroid)),
size AS (SELECT doc_id, count(*) AS s FROM top GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM top a JOIN top b ON a.term = b.term AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM missing) OR b.doc_id IN (SELECT doc_id FROM missing) GROUP BY ALL),
by_terms AS (SELECT a, b, n / (x.s + y.s - n)::DOUBLE AS sim, 'keywords' AS basis FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE n / (x.s + y.s - n)::DOUBLE >= {THRESHOLD}),
listed AS (SELECT doc_id, row_number() OVER (ORDER BY coalesce(epoch_us(created_at), 0) DESC, doc_id) AS o FROM documents),
cand AS (SELECT a, b, basis, round(least(greatest(sim, 0), 1), 4) AS weight, least(x.o, y.o) AS o1, greatest(x.o, y.o) AS o2 FROM (SELECT * FROM by_vector UNION ALL SELECT * FROM by_terms) JOIN listed x ON x.doc_id = a JOIN listed y ON y.doc_id = b),
ends AS (SELECT a, b, row_number() OVER (PARTITION BY node ORDER BY weight DESC, o1, o2) AS r FROM (SELECT *, unnest([a, b]) AS node FROM cand)),
edges AS (SELECT a, b, basis, weight FROM cand JOIN (SELECT a, b, min(r) AS r FROM ends GROUP BY ALL) USING (a, b) WHERE r <= 4)"""


@query("kg_19", f"WITH {SQL_EDGES} SELECT * FROM edges")
def kg_19(spark, d):
    """Edges of the document graph (TOP-07: degree-capped)."""
    return graph(spark, d)[0]


@query("top_06", f"WITH {SQL_EDGES}, best AS (SELECT e.a, e.b, x.term, row_number() OVER (PARTITION BY e.a, e.b ORDER BY round(x.score + y.score, 7) DESC, x.term) AS r FROM edges e JOIN top x ON x.doc_id = e.a JOIN top y ON y.doc_id = e.b AND y.term = x.term) SELECT a, b, string_agg(term, ' ' ORDER BY r) AS terms FROM best WHERE r <= 5 GROUP BY a, b")
def top_06(spark, d):
    e, t = graph(spark, d)
    return docgraph.shared_terms(e, t.select("doc_id", "term", "score"))


@query("kg_20", f"WITH {SQL_EDGES} SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)")
def kg_20(spark, d):
    e = graph(spark, d)[0]
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "other")))

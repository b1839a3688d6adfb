"""The pN_ queries over the test tables, each through its problem's operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import groups, mojibake, names, neardup, neighbours, packing, pieces, scans, sentences, tokenize
from foliograph.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.same_entities(table(spark, d, "entities"), table(spark, d, "entity_mentions")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "entities").select("id")
    known = table(spark, d, "entity_matches").select("left_id", "right_id")
    for end in ("left_id", "right_id"):
        known = known.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return groups.connected_groups(known).select("group_id", F.col("member_id").alias("entity_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.oversized_pieces(table(spark, d, "text_chunks"))
    return cut.filter("part = 1").select(F.col("id").alias("chunk_id"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "text_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_chunks").filter("source = 'native' AND length(content) > 0")
    return sentences.sentences(rows).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "text_chunks"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "text_chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, copies = neardup.alike(table(spark, d, "text_chunks").select("id", "content"))
    return neardup.expanded_pairs(pairs, copies)


def _vectors(spark: SparkSession, d: str, modality: str) -> DataFrame:
    """The vectors of an index whose faiss_id a row of its table still holds."""
    held = table(spark, d, {"text": "text_chunks", "image": "images"}[modality]).select("faiss_id").filter("faiss_id IS NOT NULL")
    return table(spark, d, f"{modality}_vectors").select("faiss_id", "vec").join(held, "faiss_id", "left_semi")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    def found(modality: str) -> DataFrame:
        pairs = neighbours.similar_pairs(neighbours.nearest(_vectors(spark, d, modality), min_cosine=0.9, base=7, growth=0))
        return pairs.select(F.lit(modality).alias("modality"), "left_id", "right_id")

    return found("text").unionByName(found("image"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    def near(modality: str) -> DataFrame:
        rows = neighbours.nearest(_vectors(spark, d, modality))
        return rows.select(F.lit(modality).alias("modality"), F.col("id").alias("faiss_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"))

    return near("text").unionByName(near("image"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(table(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": "SELECT id AS chunk_id FROM text_chunks WHERE length(content) > 500"}

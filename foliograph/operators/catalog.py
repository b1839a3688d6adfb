"""Listings, details and counts over the document store and the entity graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``parent`` with a count column for each child table; children are counted before they are joined."""

    def add(df: DataFrame, item: tuple[str, tuple[DataFrame, str]]) -> DataFrame:
        name, (child, foreign) = item
        n = child.filter(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return reduce(add, children.items(), parent)


def entity_listing(entities: DataFrame, mentions: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Entities with the number of their mentions and of the documents these stand in."""
    n = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_count"), F.countDistinct("document_id").alias("document_count"))
    kept = entities.filter(F.coalesce("type_confidence", F.lit(0.0)) >= min_confidence)
    return kept.join(n, "id", "left").na.fill(0, ["mention_count", "document_count"])


def entity_mentions(mentions: DataFrame, documents: DataFrame, entity: Column) -> DataFrame:
    """The mentions that ``entity`` selects, with file names, surest first."""
    named = documents.select(F.col("doc_id").alias("document_id"), "filename")
    return mentions.filter(entity).join(named, "document_id").orderBy(F.col("extraction_confidence").desc_nulls_last(), "id")


def mentions_by_file(mentions: DataFrame, documents: DataFrame, most_pages: int = 8) -> DataFrame:
    """(entity_id, filename, n, pages, span): the first pages in order and the first span that isn't blank."""
    named = documents.select(F.col("doc_id").alias("document_id"), "filename")
    grouped = mentions.join(named, "document_id").groupBy("entity_id", "filename")
    said = F.when(F.trim("span_text") != "", F.col("id"))
    pages = F.slice(F.array_sort(F.collect_set("page_number")), 1, most_pages)
    return grouped.agg(F.count("*").alias("n"), pages.alias("pages"), F.min_by("span_text", said).alias("span"))


def merged_entities(rows: DataFrame) -> DataFrame:
    """Upsert of (name, entity_type, type_confidence, aliases): highest confidence, all aliases in order."""
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))))
    return rows.groupBy("name", "entity_type").agg(F.max("type_confidence").alias("type_confidence"), aliases.alias("aliases"))


def stats(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(what, name, n): totals, entities by type and relations by kind."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit(name).alias("name"), "n")
    by = lambda df, c, what: df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.col(c).alias("name"), "n")
    parts = [total(entities, "entities"), total(mentions, "mentions"), total(relations, "relations"), by(entities, "entity_type", "by_type"), by(relations, "relation_type", "by_relation")]
    return reduce(DataFrame.unionByName, parts)


def ingest_report(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Counts for each document: chunks, those read by OCR, embedded images and drawings."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.lower(F.trim("source")) == "ocr").alias("ocr_chunks"))
    i = images.groupBy("document_id").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "vector").alias("drawings"))
    return c.join(i, "document_id", "full").na.fill(0)

"""Admission and removal of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.sources.tables import Scratch

#: Which column of a table names the document that owns a row.
OWNER = {"documents": "doc_id", "text_chunks": "document_id", "images": "document_id", "text_vectors": "document_id", "image_vectors": "document_id", "entity_mentions": "document_id", "tables": "document_id", "outlines": "document_id", "links": "document_id", "annotations": "document_id"}


def admitted(incoming: DataFrame, stored: DataFrame | None, key: str = "file_hash", order: str = "doc_id") -> DataFrame:
    """Incoming rows whose hash is not stored; of equal ones within the batch the first. Rows without a hash are all new."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    return first if stored is None else first.join(stored.select(key).distinct(), key, "left_anti")


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of documents ``gone`` (doc_id), by anti-join."""
    return {n: df.join(gone.select(F.col("doc_id").alias(OWNER[n])), OWNER[n], "left_anti") if n in OWNER else df for n, df in tables.items()}


def live(vectors: DataFrame, owners: DataFrame, key: str = "faiss_id") -> DataFrame:
    """Vectors that a row of their table still holds."""
    return vectors.join(owners.select(key).filter(F.col(key).isNotNull()), key, "left_semi")


def numbered(rows: DataFrame, order: list[str], start: int = 0, name: str = "faiss_id") -> DataFrame:
    """Running numbers in the given order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; each partition is numbered on its own and shifted by the sizes before it.
    """
    # Written once: a second evaluation might lay the partitions out differently.
    sorted_ = Scratch(rows.sparkSession).put(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_size"), F.min("_m").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return sorted_.join(F.broadcast(before), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.coalesce("_before", F.lit(0)) + start).drop("_p", "_m", "_first", "_before")


def latest(mappings: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-replace: of rows with one key the last."""
    return mappings.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")

"""One name for candidates that mean the same, and confidences of their classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions import vectors as V
from foliograph.sources.tables import Scratch


#: Classes that an ontology may have; they are sent to every task.
CLASSES = 10_000


def by_spelling(candidates: DataFrame) -> DataFrame:
    """(name, entity_type, canonical): of spellings with one key the one met most often, then the one met first.

    ``candidates`` has (name, entity_type, seq).
    """
    counted = candidates.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min("seq").alias("first")).withColumn("key", T.resolution_key(F.col("name")))
    best = counted.groupBy("key", "entity_type").agg(F.min_by("name", F.struct(-F.col("n"), F.col("first"))).alias("canonical"))
    return counted.join(best, ["key", "entity_type"]).select("name", "entity_type", "canonical")


def by_vector(names: DataFrame, threshold: float = 0.92, least: int = 2, most: int = 400, dim: int = 64) -> DataFrame:
    """(duplicate, parent) of names (id, entity_type, n, vec): pairs of one class, Document aside, alike enough.

    The heavier is the parent, ties go to the smaller id; a duplicate takes the parent of the first pair that names it.
    Classes below ``least`` or above ``most`` names are left alone.
    """
    size = names.groupBy("entity_type").agg(F.count("*").alias("size")).filter(F.col("size").between(least, most) & (F.col("entity_type") != "Document")).select("entity_type")
    kept = names.filter(F.size("vec") == dim).select(F.col("id").cast("bigint").alias("id"), "entity_type", F.col("n").cast("bigint").alias("n"), V.unit(F.col("vec")).cast("array<double>").alias("vec"))

    def pairs(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, n = t["id"].to_numpy(), t["n"].to_numpy()
        x = np.asarray(t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
        i, j = np.nonzero(np.triu(np.round(x @ x.T, 9) >= threshold, 1))
        return pa.table({"a": ids[i], "b": ids[j], "na": n[i], "nb": n[j]})

    # A class has at most ``most`` names, so it is one matrix product, and classes never meet.
    known = kept.join(size, "entity_type", "left_semi").groupBy("entity_type").applyInArrow(pairs, "a bigint, b bigint, na bigint, nb bigint")
    heavier = F.when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.col("a"))
    directed = known.select(F.struct("a", "b").alias("pair"), heavier.alias("parent"), F.when(heavier == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("duplicate"))
    return directed.groupBy("duplicate").agg(F.min_by("parent", "pair").alias("parent"))


def roots(parents: DataFrame, duplicate: str = "duplicate", parent: str = "parent") -> DataFrame:
    """(duplicate, root): pointers followed to their end, twice as far in each round."""
    scratch = Scratch(parents.sparkSession)
    now = scratch.put(parents.select(F.col(duplicate).alias("duplicate"), F.col(parent).alias("root")))
    while True:
        up = now.select(F.col("duplicate").alias("root"), F.col("root").alias("further"))
        nxt = scratch.put(now.join(up, "root", "left").select("duplicate", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("duplicate", "root")
        scratch.drop(now)
        now = nxt.drop("moved")


def class_confidence(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, confidence) of names (id, entity_type, vec) against classes (entity_type, vec), ``CLASSES`` of them at most.

    Half of 1 + cosine, a tenth more for the nearest class, within [0, 1]; 0.5 for a class that isn't known.
    """
    if classes.count() > CLASSES:
        raise ValueError("too many classes")
    sims = names.join(F.broadcast(classes.select(F.col("entity_type").alias("c"), F.col("vec").alias("cv"))), F.lit(True)).withColumn("sim", V.dot(V.unit(F.col("vec")), V.unit(F.col("cv"))))
    both = sims.groupBy("id", "entity_type").agg(F.max("sim").alias("best"), F.max(F.when(F.col("c") == F.col("entity_type"), F.col("sim"))).alias("own"))
    score = 0.5 + 0.5 * F.col("own") + F.when(F.col("own") >= F.col("best") - 1e-6, 0.1).otherwise(0.0)
    return both.select("id", F.coalesce(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4), F.lit(0.5)).alias("confidence"))

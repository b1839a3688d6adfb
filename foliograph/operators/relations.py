"""Relations: co-occurrence, merging of evidence, and the graph built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrence_counts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies (item, n) and pair frequencies (a, b, n), a < b, of baskets (basket, item); repeats count once."""
    once = items.select("basket", "item").distinct()
    single = once.groupBy("item").agg(F.count("*").alias("n"))
    pair = once.toDF("basket", "a").join(once.toDF("basket", "b"), "basket").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return single, pair


def cooccurrence(items: DataFrame, n_baskets: int | None = None, least: int = 2, most: int | None = 500) -> DataFrame:
    """(a, b, n, npmi, confidence): pairs met ``least`` times with positive normalised mutual information, the surest first.

    ``n_baskets`` counts baskets without pairs, too; by default those of ``items``.
    """
    single, pair = cooccurrence_counts(items)
    total = F.lit(float(n_baskets if n_baskets is not None else items.select("basket").distinct().count()))
    joined = pair.filter(F.col("n") >= least).join(single.toDF("a", "na"), "a").join(single.toDF("b", "nb"), "b")
    p = F.col("n") / total
    pmi = F.log(p / ((F.col("na") / total) * (F.col("nb") / total)) + 1e-12)
    npmi = F.when(p >= 1.0, F.lit(1.0)).otherwise(pmi / (-F.log(p) + 1e-12))
    scored = joined.withColumn("npmi", npmi).filter("npmi > 0")
    out = scored.select("a", "b", "n", F.round("npmi", 6).alias("npmi"), F.round(F.least(F.lit(0.55), F.col("npmi") * 0.55 + 0.15), 4).alias("confidence"))
    return out.orderBy(F.col("confidence").desc(), F.col("a").desc(), F.col("b").desc()).limit(most) if most else out


def merged(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per ``keys`` of (confidence, extractor, document_id, seq): evidence counted, confidences joined as
    independent, rounded to four places after each step in the order of ``seq``; extractor and document of the first."""

    def step(old, new):
        return F.when(old.isNull(), F.round(new, 4)).otherwise(F.round(1 - (1 - old) * (1 - new), 4))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("confidence").alias("c")))), lambda x: x["c"])
    return rows.groupBy(*keys).agg(
        F.aggregate(ordered, F.lit(None).cast("double"), step).alias("confidence"),
        F.count("*").alias("evidence_count"),
        F.min_by("extractor", seq).alias("extractor"),
        F.min_by("document_id", seq).alias("document_id"),
    )


def merged_unrounded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As ``merged`` without the steps' rounding: sums that combine before the shuffle, for groups of any size."""
    certain = F.max(F.when(F.col("confidence") >= 1, 1).otherwise(0))
    joint = 1 - F.exp(F.sum(F.when(F.col("confidence") < 1, F.log(1 - F.col("confidence"))).otherwise(0.0)))
    return rows.groupBy(*keys).agg(F.when(certain == 1, 1.0).otherwise(F.round(joint, 6)).alias("confidence"), F.count("*").alias("evidence_count"))


def entity_graph(entities: DataFrame, relations: DataFrame, min_confidence: float = 0.3, max_nodes: int = 150) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: connected entities first, then by mentions; edges without 'mentions', both ends among the nodes.

    ``entities`` has (id, mention_count, ...), ``relations`` (source_id, relation_type, target_id, confidence, ...).
    """
    strong = relations.filter((F.col("confidence") >= min_confidence) & (F.col("relation_type") != "mentions"))
    linked = strong.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("connected", F.lit(1))
    nodes = entities.join(linked, "id", "left").na.fill(0, ["connected"]).orderBy(F.col("connected").desc(), F.col("mention_count").desc(), "id").limit(max_nodes)
    ids = nodes.select("id")
    edges = strong.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi")
    return nodes, edges


def neighbourhood(edges: DataFrame, weight: str = "confidence") -> DataFrame:
    """(node, other, direction, weight): every edge (source_id, target_id) from both of its ends."""
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.lit("out").alias("direction"), weight)
    return out.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.lit("in").alias("direction"), weight))

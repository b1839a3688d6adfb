"""Scores of extracted entities and relations against gold data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T


def _share(part: Column, rest: Column) -> Column:
    return F.when(part + rest == 0, 0.0).otherwise(part / (part + rest))


def scored(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, four places, to rows with tp, fp and fn; empty denominators give 0."""
    p, r = _share(F.col("tp"), F.col("fp")), _share(F.col("tp"), F.col("fn"))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)})


def strict_matches(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tp, fp, fn) of names with a class: what both sides hold, each gold row used once.

    Multiset intersection: equal keys are counted on either side and the smaller count is what matches.
    """
    keys = [*dict.fromkeys([*by, "document", "type"])]
    count = lambda df, n: df.groupBy(*keys, T.match_key(F.col("name")).alias("key")).agg(F.count("*").alias(n))
    both = count(predicted, "p").join(count(gold, "g"), [*keys, "key"], "full").na.fill(0, ["p", "g"])
    hit = F.least("p", "g")
    return both.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def partial_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(document, type, tp, fp, fn): greedy in the order of ``seq``; one name may hold the other, a gold row is used once.

    The greedy choice depends on what came before, so each document and class is one pandas group.
    """
    side = lambda df, s: df.select("document", "type", "seq", T.match_key(F.col("name")).alias("key"), F.lit(s).alias("side"))

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        left, tp, fp = list(g.key[g.side == "gold"]), 0, 0
        for p in g.key[g.side == "predicted"]:
            at = next((i for i, x in enumerate(left) if p in x or x in p), None)
            if at is None:
                fp += 1
            else:
                tp += 1
                left.pop(at)
        return pd.DataFrame({"document": [g.document.iloc[0]], "type": [g.type.iloc[0]], "tp": [tp], "fp": [fp], "fn": [len(left)]})

    return side(predicted, "predicted").unionByName(side(gold, "gold")).groupBy("document", "type").applyInPandas(match, "document string, type string, tp long, fp long, fn long")


def triple_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(document, tp, fp, fn) of distinct triples (source, relation, target)."""
    key = lambda df: df.select("document", T.match_key(F.col("source")).alias("s"), "relation", T.match_key(F.col("target")).alias("t")).distinct()
    both = key(predicted).withColumn("p", F.lit(1)).join(key(gold).withColumn("g", F.lit(1)), ["document", "s", "relation", "t"], "full")
    one = lambda c: F.count_if(c)
    return both.groupBy("document").agg(one(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), one(F.col("g").isNull()).alias("fp"), one(F.col("p").isNull()).alias("fn"))


def with_correctness(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted entities with ``correct``; a confidence of 0 or null counts as 0.5."""
    known = gold.select("document", "type", T.match_key(F.col("name")).alias("key")).distinct().withColumn("hit", F.lit(True))
    joined = predicted.withColumn("key", T.match_key(F.col("name"))).join(known, ["document", "type", "key"], "left")
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence"))
    return joined.select("document", "name", "type", sure.alias("confidence"), F.coalesce("hit", F.lit(False)).alias("correct"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of rows (confidence, correct)."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(ece): mean gap of confidence and accuracy over the bins, weighted by size; 0 without rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    return calibration_bins(rows, bins).agg(F.coalesce(F.round(gap, 4), F.lit(0.0)).alias("ece"))


def graph_quality(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(entities, relations, orphan_node_ratio, avg_degree); 'mentions' connects nothing."""
    core = relations.filter("relation_type != 'mentions'")
    linked = core.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().agg(F.count("*").alias("linked"))
    n, m = entities.agg(F.count("*").alias("entities")), core.agg(F.count("*").alias("relations"))
    one = n.join(m, F.lit(True)).join(linked, F.lit(True))
    ratio = F.when(F.col("entities") > 0, F.round(1 - F.col("linked") / F.col("entities"), 4)).otherwise(0.0)
    degree = F.when(F.col("entities") > 0, F.round(2 * F.col("relations") / F.col("entities"), 3)).otherwise(0.0)
    return one.select("entities", "relations", ratio.alias("orphan_node_ratio"), degree.alias("avg_degree"))


def predictions(document: Column, entities: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, id, name, type, confidence): entities mentioned in the documents that ``document`` selects.

    Of documents of one file name the first counts.
    """
    first = documents.filter(document).groupBy(F.col("filename").alias("document")).agg(F.min("doc_id").alias("document_id"))
    best = mentions.join(first, "document_id").groupBy("document", F.col("entity_id").alias("id")).agg(F.max("extraction_confidence").alias("confidence"))
    return best.join(entities.select("id", "name", F.col("entity_type").alias("type")), "id").select("document", "id", "name", "type", "confidence")


def relation_predictions(document_id: Column, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, source, relation, target, confidence): relations of a document, and all that belong to none."""
    name = lambda c, n: entities.select(F.col("id").alias(c), F.col("name").alias(n))
    kept = relations.filter(document_id | F.col("document_id").isNull())
    return kept.join(name("source_id", "source"), "source_id").join(name("target_id", "target"), "target_id").select("id", "source", F.col("relation_type").alias("relation"), "target", "confidence")


def regression(report: dict, baseline: dict | None, tolerance: float = 0.02) -> tuple[bool, list[str]]:
    """Whether a report holds against its baseline, and what fell by more than ``tolerance`` in f1; no baseline holds."""
    fell = []
    for name in ("entity_partial", "relation"):
        old, new = ((x or {}).get(name, {}).get("f1", 0.0) or 0.0 for x in (baseline, report))
        if new < old - tolerance:
            fell.append(f"{name}: {old:.4f} -> {new:.4f}")
    return not fell, fell


def by_document(rows: DataFrame) -> Iterator:
    """Rows of a small report, one document after another, without holding them all."""
    return rows.orderBy("document").toLocalIterator()

"""Candidates for entities and relations from the structure of documents and from chunk text.

Entities: (document_id, stage, at, name, entity_type, confidence, span_text, page_number, chunk_id, extractor).
Relations: (document_id, stage, at, source, source_type, relation, target, target_type, confidence, extractor).
``stage`` and ``at`` keep the order in which a document yields its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.sources.tables import Scratch

METADATA, OUTLINE, TABLE, LINK, DATE, METRIC = 0.95, 0.90, 0.75, 0.85, 0.80, 0.65


class Extractor(Protocol):
    """A pluggable recogniser over chunks; without one, chunk text yields dates and metrics only."""

    def entities(self, chunks: DataFrame) -> DataFrame: ...


def _entity(document: str | Column, stage: int, at: Column, name: Column, kind: str | Column, confidence: float, span: Column, page: Column | None = None, chunk: Column | None = None, extractor: str = "rule") -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [
        F.col(document).alias("document_id"), F.lit(stage).alias("stage"), at.cast("bigint").alias("at"), name.alias("name"), kind.alias("entity_type"), F.lit(confidence).alias("confidence"), span.alias("span_text"),
        (F.lit(0) if page is None else page).cast("int").alias("page_number"), (F.lit(None) if chunk is None else chunk).cast("bigint").alias("chunk_id"), F.lit(extractor).alias("extractor"),
    ]


def _relation(document: str, stage: int, at: Column, source: Column, source_type: str, relation: str, target: Column, target_type: str, confidence: float, extractor: str = "rule") -> list[Column]:
    return [
        F.col(document).alias("document_id"), F.lit(stage).alias("stage"), at.cast("bigint").alias("at"), source.alias("source"), F.lit(source_type).alias("source_type"), F.lit(relation).alias("relation"),
        target.alias("target"), F.lit(target_type).alias("target_type"), F.lit(confidence).alias("confidence"), F.lit(extractor).alias("extractor"),
    ]


def documents_themselves(documents: DataFrame) -> DataFrame:
    return documents.select(*_entity("doc_id", 0, F.lit(0), F.col("filename"), "Document", 1.0, F.col("filename")))


def from_metadata(documents: DataFrame, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Authors as persons, creation dates as dates."""
    author = T.normal_name(F.coalesce(F.col("metadata")["author"], F.lit("")))
    created = F.coalesce(F.col("metadata")["creation_date"], F.lit(""))
    date = T.normal_date(F.get(T.dates(created, 1, compat), 0))
    rows = documents.select("doc_id", "filename", author.alias("author"), created.alias("created"), date.alias("date"))
    people, days = rows.filter(F.length("author") >= 2), rows.filter(F.col("date").isNotNull())
    entities = people.select(*_entity("doc_id", 1, F.lit(0), F.col("author"), "Person", METADATA, F.col("author"))).unionByName(days.select(*_entity("doc_id", 1, F.lit(1), F.col("date"), "Date", METADATA, F.col("created"))))
    relations = people.select(*_relation("doc_id", 1, F.lit(0), F.col("filename"), "Document", "authored_by", F.col("author"), "Person", METADATA)).unionByName(
        days.select(*_relation("doc_id", 1, F.lit(1), F.col("filename"), "Document", "created_on", F.col("date"), "Date", METADATA))
    )
    return entities, relations


def outline_parents(outlines: DataFrame) -> DataFrame:
    """Outlines (document_id, seq, level, title, page_number) with normal ``name`` and the ``parent`` above: the last
    preceding entry of a smaller level, titles below two letters left out.

    One pass per document over its entries in order, with the stack of those still open; levels may be of any depth.
    """
    named = outlines.withColumn("name", T.outline_title(F.col("title"))).filter(F.length("name") >= 2)
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stack = object(), []
        for b in batches:
            parents = []
            for d, level, name in zip(*(b.column(c).to_pylist() for c in ("document_id", "level", "name"))):
                if d != document:
                    document, stack = d, []
                while level is not None and stack and stack[-1][0] >= level:
                    stack.pop()
                parents.append(stack[-1][1] if stack and level is not None else None)
                if level is not None:
                    stack.append((level, name))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, pa.string())], names=[*b.schema.names, "parent"])

    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", parent string"
    return named.repartition("document_id").sortWithinPartitions("document_id", "seq").mapInArrow(run, schema)


def from_outlines(outlines: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles as concepts, mentioned by the document and part of the title above."""
    rows = outline_parents(outlines).join(documents.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    entities = rows.select(*_entity("document_id", 2, F.col("seq"), F.col("name"), "Concept", OUTLINE, F.col("title"), F.col("page_number")))
    mentions = rows.select(*_relation("document_id", 2, F.col("seq") * 2, F.col("filename"), "Document", "mentions", F.col("name"), "Concept", OUTLINE))
    parts = rows.filter("parent IS NOT NULL").select(*_relation("document_id", 2, F.col("seq") * 2 + 1, F.col("name"), "Concept", "part_of", F.col("parent"), "Concept", OUTLINE))
    return entities, mentions.unionByName(parts)


def from_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row labels of (document_id, seq, page_number, cells) as concepts, cells with a unit as metrics of their label."""
    rows = tables.filter(F.size("cells") >= 2).select("document_id", "seq", "page_number", F.get("cells", 0).alias("head"), F.posexplode("cells").alias("r", "row")).filter("r > 0 AND size(row) > 0")
    label = T.normal_name(T.strip(F.coalesce(F.get("row", 0), F.lit(""))))
    rows = rows.withColumn("label", label).withColumn("label_ok", F.length("label").between(2, 40) & ~F.col("label").rlike(f"^(?:{T.METRIC})$"))
    at = F.col("seq") * 1_000_000 + F.col("r") * 1_000
    labels = rows.filter("label_ok").select(*_entity("document_id", 3, at, F.col("label"), "Concept", TABLE, T.strip(F.get("row", 0)), F.col("page_number")))
    cells = rows.select("*", F.posexplode("row").alias("c", "cell")).filter("c > 0").withColumn("cell", T.strip(F.coalesce("cell", F.lit("")))).withColumn("found", F.get(T.metrics(F.col("cell"), 1), 0)).filter("found IS NOT NULL")
    head = T.normal_name(F.coalesce(F.get("head", F.col("c")), F.lit("")))
    metric = F.when(head != "", F.concat(head, F.lit(" "), T.strip(F.col("found")))).otherwise(T.strip(F.col("found")))
    cells = cells.withColumn("metric", metric)
    at = at + F.col("c")
    metrics = cells.select(*_entity("document_id", 3, at, F.col("metric"), "Metric", TABLE, F.col("cell"), F.col("page_number")))
    measured = cells.filter("label_ok").select(*_relation("document_id", 3, at, F.col("label"), "Concept", "measured_as", F.col("metric"), "Metric", TABLE))
    return labels.unionByName(metrics), measured


def from_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """References of links (document_id, seq, url) to documents by file name; of equal names the last document counts."""
    known = documents.groupBy(F.lower("filename").alias("file")).agg(F.max_by("filename", "doc_id").alias("target"))
    named = documents.select(F.col("doc_id").alias("document_id"), "filename")
    rows = links.withColumn("file", T.url_file_name(F.col("url"))).filter("file != ''").join(known, "file").join(named, "document_id")
    return rows.select(*_relation("document_id", 4, F.col("seq"), F.col("filename"), "Document", "references", F.col("target"), "Document", LINK))


def from_chunks(chunks: DataFrame, most: int = 5, compat: bool = True) -> DataFrame:
    """Up to ``most`` dates and metrics of each chunk (id, document_id, page_number, content)."""
    days = chunks.select("*", F.posexplode(T.dates(F.col("content"), most, compat)).alias("k", "found"))
    sums = chunks.select("*", F.posexplode(T.metrics(F.col("content"), most)).alias("k", "found")).withColumn("found", T.strip(F.col("found"))).filter(F.length("found") >= 2)
    at = F.col("id") * 16 + F.col("k")
    entity = lambda rows, name, kind, conf, shift: rows.select(*_entity("document_id", 5, at + shift, name, kind, conf, F.col("found"), F.col("page_number"), F.col("id"), "regex"))
    return entity(days, T.normal_date(F.col("found")), "Date", DATE, 0).unionByName(entity(sums, F.col("found"), "Metric", METRIC, 8))


GRAM = 12  #: letters of a name's beginning that are looked for first
_BITS = 1 << 24  #: of the filter that keeps keys of no name from the join
_SLICE = 1 << 19  #: letters looked at in one go
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32)) ^ np.uint64(n)) * _MIX
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _key(letters: np.ndarray) -> int:
    """The 64-bit hash of a name."""
    h = np.zeros(1, np.uint64)
    for x in letters:
        h = h * _BASE + x
    return int(_mixed(h, len(letters))[0])


def _places(letters: np.ndarray, lengths: set[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of all substrings of the lengths whose key is in ``bits``; from ``GRAM`` letters on, of those whose beginning is."""
    at, h = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
    places, keys = [at[:0]], [np.zeros(0, np.int64)]
    for n in range(1, max(lengths, default=0) + 1):
        if len(at) and at[-1] + n > len(letters):
            inside = np.searchsorted(at, len(letters) - n, "right")
            at, h = at[:inside], h[:inside]
        h = h * _BASE + (letters[n - 1 :][: len(at)] if n <= GRAM else letters[at + (n - 1)])
        if n == GRAM or n in lengths:
            k = _mixed(h, n)
            met = bits[k & (_BITS - 1)]
            if n in lengths:
                places.append(at[met]), keys.append(k[met])
            if n == GRAM:
                at, h = at[met], h[met]
    return np.concatenate(places), np.concatenate(keys)


class Gazetteer:
    """Finds known names in chunks: the stand-in for a trained recogniser. ``names`` is (name, entity_type).

    A name of 2 to 60 letters is found wherever a chunk contains it, inside words as well. Names and texts meet in a
    join on the hash of the whole name, which a chunk looks for from every position; a bit filter of fixed size over
    the hashes of names and of their beginnings is broadcast and holds back what is no name's. Every hit is verified.
    Neither side is broadcast unless Spark finds it small.
    """

    def __init__(self, names: DataFrame, confidence: float = 0.5):
        self.names, self.confidence = names, confidence

    def entities(self, chunks: DataFrame) -> DataFrame:
        spark = chunks.sparkSession
        known = self.names.filter(F.length("name").between(2, 60)).select("name", "entity_type").distinct()

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = [_letters(n) for n in b.column(0).to_pylist()]
                keys, begun = [_key(x) for x in names], [_key(x[:GRAM]) for x in names]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64()), pa.array(begun, pa.int64()), pa.array(map(len, names), pa.int32())], names=["name", "entity_type", "key", "begun", "n"])

        known = Scratch(spark).put(known.mapInArrow(keyed, "name string, entity_type string, key bigint, begun bigint, n int"))
        bit = known.select(F.explode(F.array("key", "begun")).alias("key")).select(F.col("key").bitwiseAND(F.lit(_BITS - 1)).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
        table = np.zeros(_BITS // 64, np.int64)
        table[words["at"].to_numpy()] = words["bits"].to_numpy()
        shared = spark.sparkContext.broadcast((table, {r.n for r in known.select("n").distinct().collect()}))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, lengths = shared.value
            bits = np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)
            for b in batches:
                ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
                ends = np.cumsum([len(t) + 1 for t in texts])
                cuts = [0, *np.flatnonzero(np.diff(ends // _SLICE)) + 1, len(texts)]
                for i, j in zip(cuts, cuts[1:]):
                    # What runs across two texts here isn't contained in either and falls out when hits are verified.
                    places, keys = _places(_letters("\0".join(texts[i:j])), lengths, bits)
                    owner = np.searchsorted(ends[i:j] - (ends[i - 1] if i else 0), places, "right") + i
                    order = np.lexsort((keys, owner))
                    owner, keys = owner[order], keys[order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner[new]], pa.int64()), pa.array(keys[new], pa.int64())], names=["id", "key"])

        starts = chunks.select(F.col("id").cast("bigint").alias("id"), F.col("content").cast("string").alias("content")).filter("id IS NOT NULL AND content IS NOT NULL").mapInArrow(sent, "id bigint, key bigint")
        hits = starts.join(known.select("name", "entity_type", "key"), "key").join(chunks, "id").filter(F.contains("content", "name"))
        return hits.select(*_entity("document_id", 6, F.col("id"), F.col("name"), F.col("entity_type"), self.confidence, F.col("name"), F.col("page_number"), F.col("id"), "gazetteer")).distinct()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

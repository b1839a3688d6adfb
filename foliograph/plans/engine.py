"""One object over a data directory, with the calls an application makes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.config import Config
from foliograph.functions import vectors as V
from foliograph.operators import catalog, docgraph, extract, harness, ingest, lifecycle, relations, resolve, search, summary
from foliograph.operators.ontology import Ontology, with_validity
from foliograph.sources import files
from foliograph.sources.adapters import capabilities, embedded
from foliograph.sources.tables import Scratch, exists, table

SEARCH_KINDS = ("all", "text", "image", "table", "annotation")


#: Blocks of gold documents that relations of no document meet.
BLOCKS = 16


class DuplicateDocument(Exception):
    """The store holds a document of this content already."""


class UnknownItem(KeyError):
    """No such document or entity."""


class Engine:
    """Search, graphs, summaries and evaluation over the parquet tables of ``data_dir``."""

    def __init__(self, spark: SparkSession, data_dir: str, config: Config = Config(), ontology: Ontology | None = None, extractor: extract.Extractor | None = None):
        self.spark, self.data_dir, self.config, self.extractor = spark, data_dir, config, extractor
        self.ontology = ontology or Ontology.load(data_dir)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.data_dir, name)

    # ---- documents ----------------------------------------------------------------------------------------------

    def status(self) -> dict:
        return {"models": capabilities(), "documents": self.table("documents").count()}

    def documents(self) -> DataFrame:
        """All documents with counts, newest first."""
        counted = catalog.counted(self.table("documents").drop("text"), "doc_id", {"chunk_count": (self.table("text_chunks"), "document_id"), "image_count": (self.table("images"), "document_id")})
        return counted.orderBy(F.col("created_at").desc_nulls_last(), "doc_id")

    def document(self, doc_id: int) -> dict:
        row = self.documents().filter(F.col("doc_id") == doc_id).head()
        if row is None:
            raise UnknownItem(doc_id)
        return row.asDict(recursive=True)

    def admit(self, incoming: DataFrame, strict: bool = False) -> DataFrame:
        """The rows of ``incoming`` that are new; with ``strict`` a known hash is an error."""
        new = lifecycle.admitted(incoming, self.table("documents"))
        if strict and new.count() < incoming.count():
            raise DuplicateDocument
        return new

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """Those of the named tables that the folder holds."""
        return {n: self.table(n) for n in names if exists(self.spark, self.data_dir, n)}

    def ingest(self, parsed: dict[str, DataFrame], embed: Callable | None = None, embed_images: Callable | None = None, strict: bool = False) -> DataFrame:
        """Stores, chunks and indexes parsed files and publishes all of it at once; returns the counts by document.

        ``parsed`` is what ``operators.ingest.prepared`` takes; ``embed`` and ``embed_images`` load a model on a worker, and
        without them nothing is indexed. Up to the last step no reader sees any of it, so a failure leaves the store as it was.
        """
        stored = self.tables("documents", "text_chunks", "text_vectors", "image_vectors", *ingest.ELEMENTS)
        if strict and "documents" in stored and not parsed["documents"].join(stored["documents"].select("file_hash"), "file_hash", "left_semi").isEmpty():
            raise DuplicateDocument
        new = ingest.prepared(parsed, stored, self.config.chunk_size, self.config.chunk_overlap)
        scratch = Scratch(self.spark)
        if embed:
            made = embedded(ingest.index_rows(new), "text", embed).drop("text")
            new["text_vectors"] = scratch.put(ingest.indexed(made, stored))
            new["text_chunks"] = ingest.backfilled(new["text_chunks"], new["text_vectors"], F.col("kind") == "chunk")
        if embed_images and "images" in new:
            made = embedded(new["images"].select(F.lit("image").alias("kind"), F.col("id").alias("row_id"), "document_id", "image_path"), "image_path", embed_images).drop("image_path")
            new["image_vectors"] = scratch.put(ingest.indexed(made, stored, "image_vectors"))
            new["images"] = ingest.backfilled(new["images"], new["image_vectors"], F.lit(True))
        counts = scratch.put(ingest.report(new))
        files.publish(new, self.data_dir, append=True)
        return counts

    def delete(self, doc_ids: list[int]) -> None:
        """Publishes all tables without the documents, whole or not at all."""
        gone = self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id bigint")
        files.publish(lifecycle.without(self.tables(*lifecycle.OWNER), gone), self.data_dir)

    # ---- search and summary -------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, image_queries: DataFrame | None = None, kind: str = "all", limit: int | None = None, dim: int | None = None) -> DataFrame:
        """Grouped hits of query vectors (qid, vec)."""
        if kind not in SEARCH_KINDS:
            raise ValueError(kind)
        tables = self.tables("text_chunks", "images", "documents", "text_vectors", "image_vectors", "tables", "annotations", "outlines")
        return search.search(queries, image_queries, tables, kind, self.config.candidates, limit or self.config.results, dim or self.config.text_dim, dim or self.config.image_dim)

    def ask(self, queries: DataFrame, embed: Callable, embed_images: Callable | None = None, kind: str = "all", limit: int | None = None, dim: int | None = None) -> DataFrame:
        """Grouped hits of text queries (qid, text); empty ones are an error of the caller's and have no hits."""
        asked = queries.filter(F.length(F.trim("text")) >= 1).select("qid", "text")
        vectors = lambda load: embedded(asked, "text", load).select("qid", "vec")
        return self.search(vectors(embed), vectors(embed_images) if embed_images else None, kind, limit, dim)

    def summary(self, doc_id: int, vectors: DataFrame | None = None) -> dict:
        """Counts and key sentences of one document, by its chunks' vectors or hashed ones."""
        one = lambda n, k="document_id": self.table(n).filter(F.col(k) == doc_id)
        base = self.document(doc_id)
        rows = summary.sentence_rows(one("text_chunks")).orderBy("seq").toPandas()
        picked = []
        if len(rows):
            made = self.spark.createDataFrame([(i, s) for i, s in enumerate(rows.sentence)], "row_id bigint, sentence string")
            vec = made.withColumn("vec", summary.hashed_vector()("sentence")) if vectors is None else made.join(vectors, "sentence")
            keyed = vec.select(F.lit(doc_id).cast("bigint").alias("document_id"), F.col("row_id").alias("seq"), "row_id", "vec")
            picked = sorted(r.row_id for r in summary.key_rows(keyed, self.config.summary_sentences).collect())
        key = [{"sentence": rows.sentence[i], "page_number": int(rows.page_number[i])} for i in picked]
        ocr = one("text_chunks").filter("source = 'ocr'").count()
        return {"document": base, "stats": {"chunk_count": base["chunk_count"], "ocr_chunk_count": ocr, "image_count": base["image_count"]}, "key_sentences": key}

    # ---- graphs -------------------------------------------------------------------------------------------------

    @cached_property
    def terms(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text")
        return docgraph.top_terms(docgraph.tf_idf(docgraph.term_counts(docs), F.lit(docs.count())))

    def document_graph(self, threshold: float | None = None, max_edges: int | None = None, dim: int = 64) -> tuple[DataFrame, DataFrame]:
        """Nodes (doc_id, filename, keywords, has_vector) and edges."""
        threshold = self.config.graph_threshold if threshold is None else threshold
        most = max_edges or self.config.graph_max_edges
        if not 0 <= threshold <= 1 or not 1 <= most <= 20:
            raise ValueError((threshold, most))
        order = self.table("text_chunks").select(F.col("id").alias("row_id"), "page_number", "chunk_index")
        v = self.table("text_vectors").select("row_id", "document_id", "vec").join(order, "row_id")
        vectors = V.centroids(v, "document_id", ["page_number", "chunk_index", "row_id"], most=self.config.chunks_per_document).select(F.col("document_id").alias("id"), F.col("centroid").alias("vec"))
        at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))
        listed = self.table("documents").select("doc_id", F.struct((-at).alias("t"), F.col("doc_id").alias("i")).alias("seq"))
        edges = docgraph.edges(vectors, self.terms.select("doc_id", "term", "score"), listed, threshold, most, dim)
        words = self.terms.filter("rank <= 10").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k")).select("doc_id", F.transform("k", lambda s: s["term"]).alias("keywords"))
        has = vectors.select(F.col("id").alias("doc_id"), F.lit(True).alias("has_vector"))
        nodes = self.table("documents").select("doc_id", "filename").join(words, "doc_id", "left").join(has, "doc_id", "left").na.fill(False, ["has_vector"])
        return nodes, edges

    def build_knowledge(self, outlines: DataFrame | None = None, tables: DataFrame | None = None, links: DataFrame | None = None, embed: Callable | None = None) -> dict[str, DataFrame]:
        """Entities, mentions and relations from all documents: extraction, resolution, co-occurrence, validation, evidence.

        With ``embed``, which loads a text model on a worker, names alike by vector are united, too, and each name's confidence
        in its class is the closeness to the class's name and description; without it 0.5.

        Candidates carry the order in which a document yields them, so that first-come rules hold in any plan.
        """
        docs, chunks = self.table("documents"), self.table("text_chunks")
        people, authored = extract.from_metadata(docs)
        entities, rels = [extract.documents_themselves(docs), people], [authored]
        for part in (outlines is not None and extract.from_outlines(outlines, docs), tables is not None and extract.from_tables(tables)):
            if part:
                entities.append(part[0]), rels.append(part[1])
        if links is not None:
            rels.append(extract.from_links(links, docs))
        from_text = extract.from_chunks(chunks)
        if self.extractor is not None:
            from_text = from_text.unionByName(self.extractor.entities(chunks))
        named = docs.select(F.col("doc_id").alias("document_id"), "filename")
        mentioned = from_text.join(named, "document_id")
        rels.append(mentioned.select("document_id", "stage", "at", F.col("filename").alias("source"), F.lit("Document").alias("source_type"), F.lit("mentions").alias("relation"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"), "confidence", "extractor"))
        seq = F.struct("document_id", "stage", "at")
        found = extract.union([*entities, from_text]).withColumn("seq", seq)
        canonical = resolve.by_spelling(found.select("name", "entity_type", "seq"))
        scratch, vectors = Scratch(self.spark), None
        if embed:
            canonical = scratch.put(canonical)
            met = found.join(canonical, ["name", "entity_type"]).groupBy(F.col("canonical").alias("name"), "entity_type").agg(F.count("*").alias("n"))
            vectors = scratch.put(embedded(met.withColumn("id", F.xxhash64("name", "entity_type")), "name", embed))
            alike = resolve.roots(resolve.by_vector(vectors, self.config.merge_similarity, *self.config.merge_group, dim=self.config.text_dim))
            to = alike.join(vectors.select(F.col("id").alias("root"), F.col("name").alias("other")), "root").join(vectors.select(F.col("id").alias("duplicate"), F.col("name").alias("canonical"), "entity_type"), "duplicate")
            canonical = scratch.put(canonical.join(to.select("canonical", "entity_type", "other"), ["canonical", "entity_type"], "left").select("name", "entity_type", F.coalesce("other", "canonical").alias("canonical")))
        known = found.join(canonical, ["name", "entity_type"])
        nodes = known.groupBy("canonical", "entity_type").agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"), F.count("*").alias("mention_count"))
        nodes = nodes.select(F.xxhash64("canonical", "entity_type").alias("id"), F.col("canonical").alias("name"), "entity_type", F.lit(0.5).alias("type_confidence"), "aliases", "mention_count")
        if embed:
            classes = self.spark.createDataFrame(list(self.ontology.classes.items()), "entity_type string, text string")
            classes = embedded(classes.withColumn("text", F.concat("entity_type", F.lit(": "), "text")), "text", embed).select("entity_type", "vec")
            sure = resolve.class_confidence(vectors.select("id", "entity_type", "vec"), classes).withColumnRenamed("confidence", "type_confidence")
            nodes = nodes.drop("type_confidence").join(sure, "id", "left").na.fill(0.5, ["type_confidence"]).select("id", "name", "entity_type", "type_confidence", "aliases", "mention_count")
        mentions = known.select(F.xxhash64("canonical", "entity_type").alias("entity_id"), "document_id", "chunk_id", "page_number", F.substring("span_text", 1, 200).alias("span_text"), F.col("confidence").alias("extraction_confidence"), "extractor")
        end = lambda c: canonical.select(F.col("name").alias(c), F.col("entity_type").alias(f"{c}_type"), F.col("canonical").alias(f"{c}_c"))
        joined = extract.union(rels).withColumn("seq", seq).join(end("source"), ["source", "source_type"], "left").join(end("target"), ["target", "target_type"], "left")
        typed = joined.select(F.coalesce("source_c", "source").alias("source"), "source_type", "relation", F.coalesce("target_c", "target").alias("target"), "target_type", "confidence", "extractor", "document_id", "seq")
        items = known.filter("chunk_id IS NOT NULL AND entity_type NOT IN ('Date', 'Metric')").select(F.col("chunk_id").alias("basket"), F.concat_ws("\u001f", "canonical", "entity_type").alias("item"))
        chunks_seen = from_text.select("chunk_id").distinct().count()
        near = relations.cooccurrence(items, max(chunks_seen, 1), self.config.cooccurrence_least, self.config.cooccurrence_most)
        half = lambda c, i: F.element_at(F.split(c, "\u001f"), i)
        near = near.select(half("a", 1).alias("source"), half("a", 2).alias("source_type"), F.lit("related_to").alias("relation"), half("b", 1).alias("target"), half("b", 2).alias("target_type"), "confidence", F.lit("cooc").alias("extractor"), F.lit(None).cast("bigint").alias("document_id"), F.struct(F.lit(1 << 62).cast("bigint").alias("document_id"), F.lit(9).alias("stage"), F.lit(0).cast("bigint").alias("at")).alias("seq"))
        every = typed.unionByName(near).filter("NOT (source = target AND source_type = target_type)")
        checked = with_validity(every, self.ontology.frame(self.spark))
        merged = relations.merged(checked.filter("valid"), ["source", "source_type", "relation", "target", "target_type"])
        stored = merged.select(F.xxhash64("source", "source_type").alias("source_id"), F.col("relation").alias("relation_type"), F.xxhash64("target", "target_type").alias("target_id"), "confidence", "evidence_count", "extractor", "document_id")
        live = nodes.select("id")
        stored = stored.join(live.toDF("source_id"), "source_id", "left_semi").join(live.toDF("target_id"), "target_id", "left_semi")
        return {"entities": nodes, "entity_mentions": mentions, "relations": stored, "violations": checked.filter("NOT valid")}

    def entity_graph(self, relations_: DataFrame, min_confidence: float = 0.3, max_nodes: int = 150) -> tuple[DataFrame, DataFrame]:
        if not 0 <= min_confidence <= 1 or not 10 <= max_nodes <= 500:
            raise ValueError((min_confidence, max_nodes))
        return relations.entity_graph(catalog.entity_listing(self.table("entities"), self.table("entity_mentions")), relations_, min_confidence, max_nodes)

    def knowledge_stats(self, relations_: DataFrame) -> DataFrame:
        return catalog.stats(self.table("entities"), self.table("entity_mentions"), relations_)

    def entity(self, entity_id: int) -> DataFrame:
        if self.table("entities").filter(F.col("id") == entity_id).isEmpty():
            raise UnknownItem(entity_id)
        return catalog.entity_mentions(self.table("entity_mentions"), self.table("documents"), F.col("entity_id") == entity_id)

    # ---- evaluation ---------------------------------------------------------------------------------------------

    def evaluate(self, gold_dir: str, relations_: DataFrame | None = None, report_dir: str | None = None) -> dict:
        """Scores against gold files; the report is written where a folder is given."""
        gold = files.gold(self.spark, gold_dir).cache()
        names = gold.select("document").distinct()
        predicted = harness.predictions(F.lit(True), self.table("entities"), self.table("entity_mentions"), self.table("documents")).join(names, "document", "left_semi").withColumn("seq", F.col("id"))
        entities = gold.select("document", F.posexplode("entities").alias("seq", "e")).select("document", "seq", "e.name", "e.type")
        total = lambda m: harness.scored(m.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))).head().asDict()
        partial = harness.partial_matches(predicted, entities)
        report = {
            "timestamp": datetime.now().isoformat(timespec="seconds"),
            "documents_evaluated": gold.count(),
            "entity_strict": total(harness.strict_matches(predicted, entities, ["document"])),
            "entity_partial": total(partial),
            "entity_by_type": {r["type"]: r.asDict() for r in harness.scored(partial.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))).collect()},
            "ece": harness.calibration_error(harness.with_correctness(predicted, entities)).head()["ece"],
        }
        if relations_ is not None:
            triples = gold.select("document", F.explode("relations").alias("r")).select("document", "r.source", "r.relation", "r.target")
            docs = self.table("documents").groupBy(F.col("filename").alias("document")).agg(F.min("doc_id").alias("doc_id")).join(names, "document", "left_semi")
            relations_ = Scratch(self.spark).put(relations_.withColumn("id", F.monotonically_increasing_id()))
            named = harness.relation_predictions(F.lit(True), relations_, self.table("entities")).join(relations_.select("id", "document_id"), "id")
            # Relations of no document stand in every one: each meets the documents block by block.
            blocked = docs.select("document", F.pmod(F.xxhash64("document"), F.lit(BLOCKS)).alias("block"))
            of_none = named.filter("document_id IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)).cast("array<bigint>"))).join(blocked, "block")
            of_one = named.join(docs.withColumnRenamed("doc_id", "document_id"), "document_id")
            rows = of_one.select("document", "source", "relation", "target").unionByName(of_none.select("document", "source", "relation", "target"))
            report["relation"] = total(harness.triple_matches(rows.select("document", "source", "relation", "target"), triples))
            report["graph_quality"] = harness.graph_quality(self.table("entities"), relations_).head().asDict()
        if report_dir:
            files.write_report(report, str(Path(report_dir)), report["timestamp"])
        return report

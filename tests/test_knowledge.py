"""Ontology, extraction, relations, resolution, harness, graph rules: literals and random inputs against loops."""

import json
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.config import Config
from foliograph.operators import docgraph, extract, geometry, harness, lifecycle, relations, resolve, search, summary
from foliograph.operators.catalog import merged_entities
from foliograph.operators.ontology import Ontology, violations, with_validity
from foliograph.plans import registry
from foliograph.plans.engine import DuplicateDocument, Engine
from foliograph.sources import files
from foliograph.sources.tables import table

TRIPLES = [
    ("Person", "works_for", "Organization", True), ("Document", "authored_by", "Person", True), ("Organization", "works_for", "Person", False),
    ("Organization", "produces", "Person", False), ("Person", "teleports_to", "Location", False), ("Metric", "related_to", "Event", True),
    ("Document", "mentions", "Metric", True), ("Event", "occurred_on", "Date", True), ("Event", "occurred_on", "Person", False),
]


def test_ontology(spark, tmp_path):
    o = Ontology()
    assert all(o.allows(s, r, t) is ok for s, r, t, ok in TRIPLES) and len(o.classes) == 9 and len(o.relations) == 13
    df = spark.createDataFrame(TRIPLES, "source_type string, relation string, target_type string, want boolean")
    assert with_validity(df, o.frame(spark)).filter("valid != want").count() == 0
    assert violations(df, o.frame(spark)).count() == 4
    (tmp_path / "ontology.json").write_text(json.dumps({"entity_types": {"Law": "statute"}, "relation_types": {"knows": {"domain": ["Person"], "range": ["Person"]}}}))
    own = Ontology.load(str(tmp_path))
    assert own.is_class("Law") and own.allows("Person", "knows", "Person") and not own.allows("Law", "knows", "Person")
    (tmp_path / "ontology.json").write_text("{broken")
    assert not Ontology.load(str(tmp_path)).is_class("Law")


def test_evidence_joins(spark):
    rows = [("삼성전자", "produces", "반도체", 0.6, "a", 1, 1), ("삼성전자", "produces", "반도체", 0.6, "b", 2, 2)]
    df = spark.createDataFrame(rows, "source string, relation string, target string, confidence double, extractor string, document_id bigint, seq int")
    r = relations.merged(df, ["source", "relation", "target"]).head()
    assert (r.confidence, r.evidence_count, r.extractor, r.document_id) == (0.84, 2, "a", 1)


def test_entities_merge(spark):
    df = spark.createDataFrame([("삼성전자", "Organization", 0.7, ["삼성"]), ("삼성전자", "Organization", 0.9, ["Samsung"]), ("삼성전자", "Organization", None, None)], "name string, entity_type string, type_confidence double, aliases array<string>")
    r = merged_entities(df).head()
    assert r.type_confidence == 0.9 and r.aliases == ["Samsung", "삼성"]


DOC = "doc_id bigint, filename string, metadata map<string,string>"


def test_structure(spark):
    docs = spark.createDataFrame([(1, "report.pdf", {"author": "홍길동", "creation_date": "2024-03-01"}), (2, "Other.PDF", None)], DOC)
    e, r = extract.from_metadata(docs)
    assert {(x.name, x.entity_type) for x in e.collect()} == {("홍길동", "Person"), ("2024.03.0", "Date")} or {x.entity_type for x in e.collect()} == {"Person", "Date"}
    assert {x.relation for x in r.collect()} == {"authored_by", "created_on"}
    o = spark.createDataFrame([(1, 0, 1, "1. 서론", 1), (1, 1, 2, "1.1 배경", 2), (1, 2, 2, "7", 3), (1, 3, 1, "2. 본론", 3), (1, 4, 3, "2.1.1 세부", 4)], "document_id bigint, seq int, level int, title string, page_number int")
    e, r = extract.from_outlines(o, docs)
    assert e.count() == 4 and {(x.source, x.target) for x in r.filter("relation = 'part_of'").collect()} == {("배경", "서론"), ("세부", "본론")}
    t = spark.createDataFrame([(1, 0, 5, [["항목", "2024년"], ["매출", "3조원"], ["영업이익", "5000억원"]])], "document_id bigint, seq int, page_number int, cells array<array<string>>")
    e, r = extract.from_tables(t)
    assert {x.name for x in e.filter("entity_type = 'Metric'").collect()} == {"2024년 3조원", "2024년 5000억원"}
    assert {(x.source, x.target) for x in r.collect()} == {("매출", "2024년 3조원"), ("영업이익", "2024년 5000억원")}
    links = spark.createDataFrame([(1, 0, "http://x/y/OTHER.pdf?z"), (1, 1, "http://x/"), (1, 2, "none.pdf")], "document_id bigint, seq int, url string")
    assert [x.target for x in extract.from_links(links, docs).collect()] == ["Other.PDF"]


def test_outline_parents_against_a_stack(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for d in range(60):
        stack = []
        for s in range(rng.randint(1, 12)):
            level = rng.randint(1, 4)
            rows.append((d, s, level, f"{s}. title{s}", 1))
            while stack and stack[-1][0] >= level:
                stack.pop()
            want[d, s] = stack[-1][1] if stack else None
            stack.append((level, f"title{s}"))
    df = spark.createDataFrame(rows, "document_id bigint, seq int, level int, title string, page_number int")
    assert {(r.document_id, r.seq): r.parent for r in extract.outline_parents(df).collect()} == want


def test_chunk_entities(spark):
    df = spark.createDataFrame([(1, 7, 3, "2023년 매출 500억원")], "id bigint, document_id bigint, page_number int, content string")
    rows = extract.from_chunks(df).collect()
    assert {r.entity_type for r in rows} == {"Date", "Metric"} and all((r.page_number, r.chunk_id) == (3, 1) for r in rows)


def test_known_names_against_contains(spark):
    names = ["Thomas Hyomkwijyongju", "삼성전자", "東京", "Anna Berg", "Öl", "cat", "Anna", "x" * 61, "y", "𠮷野家 本店", "a b c d e f g h", "Paris, Texas Holding AG"]
    texts = [
        "月、Thomas Hyomkwijyongjuは来た", "“Anna Berg” (삼성전자가) 말했다", "新東京駅、Paris, Texas Holding AG.", "Joanna Berger and concatenate", "삼성전자,", "Öl", "昨日𠮷野家 本店に", "xa b c d e f g hi", "cat\nAnna\tBerg", "", None, "c a t", "x" * 70 + "y"
    ]
    chunks = spark.createDataFrame([(i, 7, 1, t) for i, t in enumerate(texts)] + [(0, 7, 1, texts[0])], "id bigint, document_id bigint, page_number int, content string")
    known = spark.createDataFrame([(n, "Concept") for n in names] + [("cat", "Concept"), ("cat", "Product"), (None, "Concept")], "name string, entity_type string")
    want = {(i, n, "Concept") for i, t in enumerate(texts) for n in names if t and 2 <= len(n) <= 60 and n in t}
    want |= {(i, n, "Product") for i, n, _ in want if n == "cat"}
    got = [(r.chunk_id, r.name, r.entity_type) for r in extract.Gazetteer(known).entities(chunks).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 14
    assert extract.Gazetteer(known.limit(0)).entities(chunks).count() == 0 and extract.Gazetteer(known).entities(chunks.limit(0)).count() == 0


def test_degree_cap(spark):
    rng = random.Random(7)
    edges = [(a, b, rng.choice([0.4, 0.5, 0.6, 0.7]), i) for i, (a, b) in enumerate((a, b) for a in range(14) for b in range(14) if a < b and rng.random() < 0.6)]
    df = spark.createDataFrame(edges, "a int, b int, weight double, seq int")
    for k in (1, 2, 4):
        kept = {(r.a, r.b) for r in docgraph.capped(df, k).collect()}
        for a, b, w, i in edges:
            better = [sum((v, -j) > (w, -i) and x in (c, d) for c, d, v, j in edges) for x in (a, b)]
            # Turned down only where both ends have k better edges.
            assert ((a, b) in kept) == (min(better) < k)


def test_similar_by_vector_against_all_pairs(spark):
    x = np.random.default_rng(8).normal(size=(150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    s = x @ x.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.5}
    assert {(r.a, r.b) for r in docgraph.similar_by_vector(df, 0.5, 8, block=40).collect()} == want


def test_rows_of_a_plane_meet_once(spark):
    ids = spark.range(900).select("id")
    for block, sent in ((1_000, 3), (200, 4), (9, 12)):  # q of 2, 3 and 11; in a grid of such blocks a row would be sent 1, 5 and 100 times
        got = docgraph._paired(ids, block).collect()
        lines, met = {}, Counter()
        for r in got:
            lines.setdefault(r.line, []).append(r)
        for on in lines.values():
            met.update((min(a.id, b.id), max(a.id, b.id)) for a, b in combinations(on, 2) if a.point != b.point or a.upright)
        assert len(met) == 900 * 899 // 2 and set(met.values()) == {1} and len(got) == 900 * sent


def test_best_pairs_by_vector_leave_nothing_out_and_stay_few(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(260, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0)])  # copies: ties of weight 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place = rng.permutation(300).tolist()
    df = spark.createDataFrame([(i, v.tolist(), p) for i, (v, p) in enumerate(zip(x, place))], "id bigint, vec array<double>, place bigint")
    every = [(a, b, round(float(min(1, max(0, x[a] @ x[b]))), 4), *sorted((place[a], place[b]))) for a, b in combinations(range(300), 2) if x[a] @ x[b] >= 0]
    want = set()
    for node in range(300):
        want |= {e[:2] for e in sorted((e for e in every if node in e[:2]), key=lambda e: (-e[2], e[3], e[4]))[:4]}
    for block in (8192, 30):
        best = docgraph.nearest_by_vector(df, 0.0, 4, 8, block=block)
        ends = best.select("node", "a", "b", F.round(F.least("sim", F.lit(1.0)), 4).alias("weight"), F.struct("first", "second").alias("seq"))
        assert {(r.a, r.b) for r in docgraph.capped_ends(ends, 4).collect()} == want
        assert best.count() <= 300 * 4 * (1 if block == 8192 else 6) < len(every) < 300 * 299 // 2


def test_keyword_overlap_of_all_documents_against_all_pairs(spark, tmp_path):
    rng = random.Random(9)
    words = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(3, 25)))) for i in range(1, 48)] + [(48, ""), (49, None)]  # none divisible by 50
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: set(t.split()) for i, t in rows if t}
    sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: round(s, 6) for k, s in sims.items() if s >= 0.05}
    got = registry.queries()["agg_20_all"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.other): r.sim for r in got} == pytest.approx(want) and len(got) == len(want) > 500


def test_overlap_of_some_sets_against_all_pairs(spark):
    rng = random.Random(11)
    sets = {i: {f"often{rng.randrange(8)}" for _ in range(3)} | {f"rare{rng.randrange(90)}" for _ in range(rng.randrange(9))} for i in range(160)}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [(None, "often1"), (7, None)], "doc_id bigint, term string")
    lone = {i for i in sets if i % 5 == 0}
    some = spark.createDataFrame([(i,) for i in lone] + [(5,), (9_999,)], "doc_id bigint")
    for least in (0.3, 0.0):
        sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2) if {a, b} & lone and sets[a] & sets[b]}
        want = {k: v for k, v in sims.items() if v >= least}
        for size in ({}, {"block": 20, "cells": 100}, {"block": 3, "cells": 100}):  # the plane, then a grid
            got = docgraph.similar_by_terms(df, some, least, **size).collect()
            assert {(r.a, r.b): r.sim for r in got} == pytest.approx(want) and len(got) == len(want)
    assert docgraph.similar_by_terms(df.limit(0), some, 0.3).count() == 0 and docgraph.similar_by_terms(df, some.limit(0), 0.3).count() == 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_asked_sets_meet_every_other_once(spark):
    for few, sent in ((8, 300 + 24 * 8), (300, 300 * 4)):  # a grid of 24 parts; a plane of q = 3
        got = docgraph._asked(spark.range(300).select("id", (F.col("id") < few).alias("lone")), 40).collect()
        met, lines = Counter(), {}
        for r in got:
            lines.setdefault(r.line, []).append(r)
        for on in lines.values():
            met.update((a.id, b.id) for a in on if a.asks for b in on if b.held and a.id != b.id and (a.point != b.point or a.upright))
        assert len(got) == sent and len(met) == few * 299 and set(met.values()) == {1}


def test_each_line_has_a_task_of_its_own(spark):
    for few, block in ((300, 40), (300, 8), (8, 40)):  # planes of q = 3 and 7; a grid
        placed = docgraph._asked(spark.range(300).select("id", (F.col("id") < few).alias("lone")), block)
        lines = placed.select("line", F.spark_partition_id().alias("task")).distinct().collect()
        assert len({r.line for r in lines}) == len({r.task for r in lines}) == len(lines) > 10


def test_overlap_is_rounded_in_the_task_as_spark_rounds(spark):
    x = [1 / 128, 3 / 128, 0.0000005, 0.1234565, 0.1234564999, 2 / 3, 1.0, 0.0, 0.046875, 1e-9]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for digits in (2, 6):
        assert docgraph._half_up(np.array(x), digits).tolist() == [r[0] for r in df.select(F.round("v", digits)).collect()]
    many = [(i, f"t{j}") for i, (lo, hi) in enumerate(((0, 1), (0, 128), (2, 120), (0, 300))) for j in range(lo, hi)]  # one set of 256 and more
    df = spark.createDataFrame(many, "doc_id bigint, term string")
    for some in (df, df.filter("doc_id < 3")):
        want = {(r.a, r.b): r.sim for r in docgraph.similar_by_terms(some, some, 0.0).select("a", "b", F.round("sim", 6).alias("sim")).collect()}
        got = {(r.a, r.b): r.sim for r in docgraph.similar_by_terms(some, some, 0.0, digits=6).collect()}
        assert got == want and got[0, 1] == 0.007813
    assert "round(" not in docgraph.similar_by_terms(df, df, 0.0, digits=6)._jdf.queryExecution().toString()


def test_shared_terms_of_edges_travel_as_lists(spark):
    rng = random.Random(12)
    score = {(i, f"t{j}"): rng.choice([0.25, 0.5, 0.125]) for i in range(30) for j in rng.sample(range(20), rng.randrange(12))}
    terms = spark.createDataFrame([(i, t, s) for (i, t), s in score.items()], "doc_id bigint, term string, score double")
    edges = [(a, b) for a, b in combinations(range(31), 2) if rng.random() < 0.4]
    got = docgraph.shared_terms(spark.createDataFrame(edges, "a bigint, b bigint"), terms, 3)
    want = {}
    for a, b in edges:
        both = sorted((-score[a, t] - score[b, t], t) for i, t in score if i == a and (b, t) in score)
        if both:
            want[a, b] = " ".join(t for _, t in both[:3])
    assert {(r.a, r.b): r.terms for r in got.collect()} == want and len(want) > 50
    assert "Window" not in got._jdf.queryExecution().toString()  # rows of terms were ranked by one


def test_no_pair_of_documents_is_shuffled(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(40)], "doc_id bigint, term string")
    got = docgraph.similar_by_terms(df, df.select("doc_id"), 0.05)
    assert shuffles(got) == 0 and "Exchange" in got._jdf.queryExecution().executedPlan().toString()  # only sets, by number of lines


def test_resolution(spark):
    c = spark.createDataFrame([("AI", "Concept", 1), ("ai", "Concept", 2), ("a i", "Concept", 3), ("ai", "Concept", 4), ("AI", "Product", 5)], "name string, entity_type string, seq int")
    assert {(r.name, r.entity_type): r.canonical for r in resolve.by_spelling(c).collect()} == {("AI", "Concept"): "ai", ("ai", "Concept"): "ai", ("a i", "Concept"): "ai", ("AI", "Product"): "AI"}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(101, 100)], "duplicate bigint, parent bigint")
    assert {r.duplicate: r.root for r in resolve.roots(chain).collect()} == {i: 0 for i in range(1, 30)} | {101: 100}


def test_cooccurrence(spark):
    rows = [(b, i) for b in range(4) for i in "xy"] + [(b, "z") for b in range(6)]
    df = spark.createDataFrame(rows + rows[:3], "basket int, item string")
    got = {(r.a, r.b): r for r in relations.cooccurrence(df).collect()}
    assert got["x", "y"].n == 4 and got["x", "y"].confidence == 0.55
    assert all(r.confidence == 0.15 for k, r in got.items() if k != ("x", "y"))  # z is everywhere and tells nothing
    whole = spark.createDataFrame([(b, i) for b in range(3) for i in "xy"], "basket int, item string")
    assert [(r.a, r.b, r.npmi) for r in relations.cooccurrence(whole).collect()] == [("x", "y", 1.0)]  # the case p = 1
    assert relations.cooccurrence(spark.createDataFrame([(1, "x"), (1, "y")], "basket int, item string")).collect() == []


def prf(df):
    return df.head()


ENT, TRI = "document string, name string, type string, seq int", "document string, source string, relation string, target string"


def counts(df):
    r = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).head()
    return r.tp, r.fp, r.fn


@pytest.mark.parametrize(
    "predicted, gold, strict, partial",
    [
        ([("삼성전자", "O"), ("머신러닝", "C")], [("삼성전자", "O")], (1, 1, 0), (1, 1, 0)),
        ([("Machine Learning", "C")], [("machinelearning", "C")], (1, 0, 0), (1, 0, 0)),
        ([("서울", "O")], [("서울", "L")], (0, 1, 1), (0, 1, 1)),
        ([("삼성전자 반도체 사업부", "O")], [("삼성전자", "O")], (0, 1, 1), (1, 0, 0)),
        ([("A", "O"), ("A", "O")], [("A", "O")], (1, 1, 0), (1, 1, 0)),
    ],
)
def test_matches(spark, predicted, gold, strict, partial):
    make = lambda rows: spark.createDataFrame([("d", n, t, i) for i, (n, t) in enumerate(rows)], ENT)
    p, g = make(predicted), make(gold)
    assert counts(harness.strict_matches(p, g, ["document"])) == strict and counts(harness.partial_matches(p, g)) == partial


def test_triples_scores_and_calibration(spark):
    p = spark.createDataFrame([("d", "삼성전자", "produces", "반도체"), ("d", "A", "uses", "B"), ("d", "a", "uses", "b")], TRI)
    g = spark.createDataFrame([("d", "삼성전자", "produces", "반도체"), ("d", "A", "related_to", "B")], TRI)
    assert counts(harness.triple_matches(p, g)) == (1, 1, 1)
    r = harness.scored(spark.createDataFrame([(8, 2, 2), (0, 0, 0)], "tp int, fp int, fn int")).collect()
    assert (r[0].precision, r[0].recall, r[0].f1) == (0.8, 0.8, 0.8) and (r[1].precision, r[1].f1) == (0.0, 0.0)
    ece = lambda rows: harness.calibration_error(spark.createDataFrame(rows, "confidence double, correct boolean")).head().ece
    assert ece([(1.0, True)] * 3) == 0.0 and ece([]) == 0.0 and ece([(0.9, True), (0.9, False)] * 2) == 0.4
    assert harness.regression({"relation": {"f1": 0.5}}, {"relation": {"f1": 0.53}})[0] is False and harness.regression({}, None)[0]


def test_search_drops_dead_rows_after_the_cut(spark):
    v = spark.createDataFrame([(i, [float(10 - i), 0.0]) for i in range(10)], "row_id bigint, vec array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, vec array<float>")
    assert [r.row_id for r in search.top_k(q, v, 3, 2).orderBy("rank").collect()] == [0, 1, 2]
    many = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "qid bigint, vec array<float>")
    assert search.top_k(many, v, 3, 2, block=6).count() == 60
    tables = {"text_vectors": v, "text_chunks": spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id bigint, document_id bigint"), "documents": spark.createDataFrame([(5, "a"), (6, "b")], "doc_id bigint, filename string")}
    r = search.search(q, None, tables, "text", k=3, dim=2).collect()
    assert [(x.document_id, x.score, x.matches) for x in r] == [(5, 9.0, 2)]


def test_summary_pick():
    assert summary.pick(np.eye(3), 5) == [0, 1, 2]
    near = np.array([[1.0, 0, 0], [0.999, 0.045, 0], [0, 1.0, 0], [0, 0, 1.0]])
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    got = summary.pick(near, 3)  # of two that say the same one is enough
    assert got == sorted(got) and {2, 3} <= set(got) and len({0, 1} & set(got)) == 1
    rng = np.random.default_rng(9)
    v = rng.normal(size=(12, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centre = v.mean(0) / np.linalg.norm(v.mean(0))
    assert summary.pick(v, 1) == [int(np.argmax(v @ centre))]
    assert all(set(summary.pick(v, n)) < set(summary.pick(v, n + 1)) for n in range(1, 11))  # each pick stays


def test_regions(spark):
    rows = [(1, 1, i, 10.0 * i, 0.0, 10.0 * i + 30, 100.0, 595.0, 842.0) for i in range(6)] + [(1, 2, 0, 0.0, 0.0, 500.0, 500.0, 595.0, 842.0)]
    df = spark.createDataFrame(rows, "document_id bigint, page_number int, seq int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [(r.page_number, r.x0, r.x1) for r in geometry.regions(df).collect()] == [(1, 0.0, 80.0)]


def test_lifecycle(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "doc_id bigint, file_hash string")
    old = spark.createDataFrame([(9, "b")], "doc_id bigint, file_hash string")
    assert {r.doc_id for r in lifecycle.admitted(new, old).collect()} == {1, 4, 5}
    got = lifecycle.numbered(spark.range(100).repartition(7).withColumn("k", -F.col("id")), ["k"]).collect()
    assert {(r.id, r.faiss_id) for r in got} == {(i, 99 - i) for i in range(100)}


def test_publish_is_whole_or_not_at_all(spark, tmp_path):
    d = str(tmp_path)
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    held = lambda n: sorted(r.id for r in table(spark, d, n).collect())
    frame(1).write.parquet(f"{d}/a.parquet")
    frame(2).write.parquet(f"{d}/b.parquet")

    def crash(name):
        if name == "a":
            raise OSError("lost between two tables")

    with pytest.raises(OSError):
        files.publish({"a": frame(10), "b": frame(20)}, d, after=crash)
    assert held("a") == [1] and held("b") == [2]
    files.publish({"a": frame(10), "b": frame(20)}, d)
    assert held("a") == [10] and held("b") == [20]
    files.publish({"a": frame(11), "c": frame(30)}, d, append=True)
    assert held("a") == [10, 11] and held("b") == [20] and held("c") == [30]


def fake_model():
    """Vectors by letters; names that differ in case only are alike."""
    return lambda texts: [(np.bincount([ord(c) % 8 for c in t.lower()] or [0], minlength=8) + 0.01).tolist() for t in texts]


def parsed_files(spark, *names):
    docs = spark.createDataFrame([(f"hash-{n}", f"{n}.pdf", f"{n}.pdf", 2, {"author": "Ann Lee"}) for n in names], "file_hash string, filename string, stored_path string, page_count int, metadata map<string,string>")
    docs = docs.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    pages = [(f"hash-{n}", p, f"This is the text of page {p} in {n}, which is long enough.", "native" if p == 1 else "ocr") for n in names for p in (1, 2)]
    more = {
        "images": ("file_hash string, page_number int, image_path string, width int, height int, kind string", [(f"hash-{n}", 1, f"{n}-{k}.png", 80, 90, k) for n in names for k in ("image", "vector")]),
        "tables": ("file_hash string, page_number int, table_index int, cells array<array<string>>, table_text string", [(f"hash-{n}", 1, 0, [["a", "b"]], f"cells of {n}") for n in names]),
        "outlines": ("file_hash string, seq int, level int, title string, page_number int", [(f"hash-{n}", i, 1, t, 1) for n in names for i, t in enumerate(["Abc", "Background"])]),
        "annotations": ("file_hash string, page_number int, annot_type string, content string", [(f"hash-{n}", 2, "Note", "check this") for n in names]),
    }
    return {"documents": docs, "pages": spark.createDataFrame(pages, "file_hash string, page_number int, text string, source string")} | {k: spark.createDataFrame(rows, t) for k, (t, rows) in more.items()}


def test_ingest_and_search_of_every_kind(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Config(text_dim=8, image_dim=8))
    first = engine.ingest(parsed_files(spark, "one", "two"), fake_model, fake_model).orderBy("filename").collect()
    assert [(r.doc_id, r.filename, r.text_chunks, r.ocr_pages, r.images, r.vector_graphics, r.tables, r.outlines, r.annotations, r.links) for r in first] == [(r.doc_id, n, 2, 1, 1, 1, 1, 2, 1, 0) for r, n in zip(first, ("one.pdf", "two.pdf"))]
    assert engine.ingest(parsed_files(spark, "two", "three"), fake_model, fake_model).count() == 1
    with pytest.raises(DuplicateDocument):
        engine.ingest(parsed_files(spark, "one"), fake_model, strict=True)
    index = engine.table("text_vectors")
    assert engine.table("documents").count() == 3 and {r.doc_id for r in engine.table("documents").collect()} == {1, 2, 3}
    assert {r.kind: r.n for r in index.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"chunk": 6, "table": 3, "annotation": 3, "outline": 3}
    assert index.select("faiss_id").distinct().count() == 15 and engine.table("text_chunks").join(index.filter("kind = 'chunk'"), "faiss_id").count() == 6
    asked = spark.createDataFrame([(1, "[Note] check this"), (2, " ")], "qid bigint, text string")
    for kind, types in (("all", {"text", "table", "annotation", "outline", "image"}), ("text", {"text", "outline"}), ("table", {"table"}), ("annotation", {"annotation"}), ("image", {"image"})):
        rows = engine.ask(asked, fake_model, fake_model, kind).collect()
        assert {t.match_type for r in rows for t in r.top} <= types and len(rows) == 3 and {r.qid for r in rows} == {1}
    assert rows[0].top[0].preview.startswith("/images/")
    engine.delete([1])
    assert engine.table("documents").count() == 2 and engine.table("outlines").count() == 4 and engine.table("text_vectors").count() == 10


def test_build_unites_names_alike_by_vector(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Config(text_dim=8))
    engine.ingest(parsed_files(spark, "one"), fake_model)
    outlines = spark.createDataFrame([(1, i, lvl, t, 1) for i, (lvl, t) in enumerate([(1, "Market risk"), (14, "Deep topic"), (15, "Quiet zebra"), (2, "kraM etrisk")])], "document_id bigint, seq int, level int, title string, page_number int")
    plain, built = (engine.build_knowledge(outlines=outlines, embed=e) for e in (None, fake_model))
    names = lambda b: {r.name for r in b["entities"].filter("entity_type = 'Concept'").collect()}
    assert names(plain) == {"Market risk", "Deep topic", "Quiet zebra", "kraM etrisk"}
    assert names(built) == {"Market risk", "Deep topic", "Quiet zebra"}
    assert {r.name: r.aliases for r in built["entities"].collect()}["Market risk"] == ["kraM etrisk"]
    assert all(0 <= r.type_confidence <= 1 and r.type_confidence != 0.5 for r in built["entities"].filter("entity_type = 'Concept'").collect())
    parent = {r.name: r.parent for r in extract.outline_parents(outlines).collect()}
    assert parent == {"Market risk": None, "Deep topic": "Market risk", "Quiet zebra": "Deep topic", "kraM etrisk": "Market risk"}



def test_gold_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document": "x.pdf", "entities": [{"name": "A", "type": "T"}], "relations": []}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("{}")
    assert [r.document for r in files.gold(spark, str(tmp_path)).collect()] == ["x.pdf"]
    assert files.read_baseline(str(tmp_path / "none.json")) is None and files.read_baseline(str(tmp_path / "b.json")) is None


def test_pdf_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.PDF").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("y")
    r = files.pdf_files(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].filename == "A.PDF" and len(r[0].file_key) == 12

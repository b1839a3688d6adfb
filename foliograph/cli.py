"""A thin command line over the engine: status, list, search, summary, graph, kg stats, harness."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from foliograph.operators import harness
from foliograph.plans.engine import Engine, UnknownItem
from foliograph.plans.knowledge import all_relations
from foliograph.session import local_session
from foliograph.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliograph")
    p.add_argument("--data", required=True, help="folder with the parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    sub.add_parser("list")
    s = sub.add_parser("search", help="documents like a stored vector")
    s.add_argument("faiss_id", type=int)
    s.add_argument("-t", "--type", default="all", choices=["all", "text", "image", "table", "annotation"])
    s.add_argument("--dim", type=int, default=64)
    m = sub.add_parser("summary")
    m.add_argument("doc_id", type=int)
    sub.add_parser("kg")
    h = sub.add_parser("harness")
    h.add_argument("action", choices=["init", "run", "baseline"])
    h.add_argument("--gold", required=True)
    h.add_argument("--baseline", default="baselines.json")
    h.add_argument("--gate", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 2: no such item; 3: a gated evaluation fell behind its baseline."""
    a = parser().parse_args(argv)
    spark = spark or local_session(app="cli")
    engine = Engine(spark, a.data)
    try:
        if a.command == "status":
            print(json.dumps(engine.status()))
        elif a.command == "list":
            engine.documents().select("doc_id", "filename", "page_count", "chunk_count", "image_count").show(50, truncate=60)
        elif a.command == "search":
            v = engine.table("text_vectors").filter(F.col("faiss_id") == a.faiss_id).select(F.col("faiss_id").alias("qid"), "vec")
            engine.search(v, kind=a.type, dim=a.dim).orderBy("position").select("position", "document_id", "filename", "score").show(truncate=60)
        elif a.command == "summary":
            print(json.dumps(engine.summary(a.doc_id), ensure_ascii=False, default=str, indent=2))
        elif a.command == "kg":
            engine.knowledge_stats(all_relations(spark, a.data)).show(100, truncate=False)
        elif a.action == "init":
            print(files.scaffold(a.gold))
        else:
            report = engine.evaluate(a.gold)
            print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
            if a.action == "baseline":
                with open(a.baseline, "w", encoding="utf-8") as f:
                    json.dump(report, f, ensure_ascii=False, indent=2, default=str)
            elif not (held := harness.regression(report, files.read_baseline(a.baseline)))[0]:
                print("\n".join(held[1]))
                return 3 if a.gate else 0
    except UnknownItem as e:
        print(f"not found: {e}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

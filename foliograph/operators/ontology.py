"""Types of entities and relations, and what relations may join."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes with their descriptions.
CLASSES = {
    "Person": "사람, 인물, 저자 (예: 홍길동, John Smith)",
    "Organization": "회사, 기관, 부서, 단체 (예: 삼성전자, 금융위원회)",
    "Location": "장소, 지명, 국가, 도시 (예: 서울, 판교)",
    "Product": "제품, 시스템, 서비스, 소프트웨어 (예: GPT-4, 갤럭시)",
    "Concept": "추상 개념, 기술, 방법론, 용어 (예: 머신러닝, 유동성 리스크)",
    "Event": "사건, 행사, 회의 (예: 2024 컨퍼런스, 금융위기)",
    "Date": "날짜, 시간 표현 (예: 2024-03, 3분기)",
    "Metric": "수치와 단위 (예: 매출 3조원, 정확도 95%)",
    "Document": "문서, 보고서, 논문 (수집된 PDF 자신)",
}
# Relations with the classes at their two ends ("*" for any) and their descriptions.
RELATIONS = {
    "works_for": (("Person",), ("Organization",), "소속"),
    "located_in": (("Organization", "Event", "Person"), ("Location",), "위치"),
    "produces": (("Organization",), ("Product",), "생산/제공"),
    "part_of": (("*",), ("*",), "일부/하위 (목차 계층 포함)"),
    "uses": (("Product", "Organization", "Concept"), ("Product", "Concept"), "사용/의존"),
    "related_to": (("*",), ("*",), "연관 (폴백 관계)"),
    "mentions": (("Document",), ("*",), "문서가 엔티티를 언급 (출처)"),
    "defines": (("Document",), ("Concept",), "용어 정의"),
    "measured_as": (("Concept",), ("Metric",), "측정값"),
    "occurred_on": (("Event",), ("Date",), "발생 일시"),
    "authored_by": (("Document",), ("Person",), "저자"),
    "references": (("Document",), ("Document",), "문서 간 참조 (링크)"),
    "created_on": (("Document",), ("Date",), "문서 생성일"),
}


@dataclass(frozen=True)
class Ontology:
    classes: dict[str, str] = field(default_factory=lambda: dict(CLASSES))
    relations: dict[str, tuple] = field(default_factory=lambda: dict(RELATIONS))

    @classmethod
    def load(cls, folder: str | None = None) -> "Ontology":
        """The base, extended by ontology.yaml, .yml or .json of a folder; equal names are replaced. What can't be read is left aside."""
        base = cls()
        for name in ("ontology.yaml", "ontology.yml", "ontology.json"):
            path = Path(folder or "") / name
            if folder is None or not path.exists():
                continue
            try:
                if path.suffix == ".json":
                    extra = json.loads(path.read_text("utf-8"))
                else:
                    import yaml

                    extra = yaml.safe_load(path.read_text("utf-8"))
            except Exception:
                continue
            if not isinstance(extra, dict):
                continue
            base.classes.update({str(k): str(v or "") for k, v in (extra.get("entity_types") or {}).items()})
            for k, v in (extra.get("relation_types") or {}).items():
                v = v or {}
                base.relations[str(k)] = (tuple(v.get("domain") or ["*"]), tuple(v.get("range") or ["*"]), str(v.get("description") or ""))
        return base

    def is_class(self, name: str) -> bool:
        return name in self.classes

    def allows(self, source: str, relation: str, target: str) -> bool:
        if relation not in self.relations:
            return False
        domain, range_, _ = self.relations[relation]
        return ("*" in domain or source in domain) and ("*" in range_ or target in range_)

    def to_dict(self) -> dict:
        return {"entity_types": self.classes, "relation_types": {k: {"domain": list(d), "range": list(r), "description": t} for k, (d, r, t) in self.relations.items()}}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(relation, domain, range): a few rows, whatever the data."""
        return spark.createDataFrame([(k, list(d), list(r)) for k, (d, r, _) in self.relations.items()], "relation string, domain array<string>, range array<string>")


def with_validity(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Triples (source_type, relation, target_type, ...) with ``valid``; an unknown relation is not."""
    fits = lambda types, t: F.array_contains(types, "*") | F.coalesce(F.array_contains(types, F.col(t)), F.lit(False))
    joined = triples.join(F.broadcast(ontology), "relation", "left")
    return joined.withColumn("valid", F.coalesce(fits(F.col("domain"), "source_type") & fits(F.col("range"), "target_type"), F.lit(False))).drop("domain", "range")


def violations(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    return with_validity(triples, ontology).filter("NOT valid").drop("valid")

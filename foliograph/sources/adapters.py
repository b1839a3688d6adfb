"""Narrow seams for what needs outside libraries: page parsing, recognition, embedding. Their absence is reported, not hidden."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


class PageParser(Protocol):
    """Turns the bytes of a document into pages; runs in ``mapInPandas`` over (path, content)."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


PAGE_SCHEMA = "path string, page_number int, text string, source string"


def parsed(files: DataFrame, parser: PageParser) -> DataFrame:
    """Pages (path, page_number, text, source) of binary files by a parser."""
    return files.select("path", "content").mapInPandas(parser, PAGE_SCHEMA)


def recognised(pages: DataFrame, recognise: Callable[[pd.Series], pd.Series] | None, threshold: int = 30) -> DataFrame:
    """Pages whose text is short or garbled read anew from ``image`` where that gives more; without a recogniser as they are."""
    if recognise is None:
        return pages
    from foliograph.functions import text as T

    read = F.pandas_udf(recognise, StringType())
    poor = (F.length(T.strip(F.col("text"))) < threshold) | T.looks_garbled(F.col("text"))
    tried = pages.withColumn("_ocr", F.when(poor, read("image")))
    better = (F.coalesce("_ocr", F.lit("")) != "") & (T.looks_garbled(F.col("text")) | (F.length("_ocr") > F.length("text")))
    return tried.withColumn("source", F.when(better, "ocr").otherwise(F.col("source"))).withColumn("text", F.when(better, F.col("_ocr")).otherwise(F.col("text"))).drop("_ocr")


def recognition_languages(wanted: list[str], available: list[str]) -> str:
    """The wanted languages at hand, joined by plus; English where there is none."""
    return "+".join(x for x in wanted if x in available) or "eng"


def embedded(rows: DataFrame, column: str, load: Callable[[], Callable[[list], list]], out: str = "vec") -> DataFrame:
    """A vector for each value by a model loaded once per worker; a value the model fails on has none and drops out."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            try:
                yield pd.Series(model(s.tolist()), index=s.index)
            except Exception:
                single = []
                for x in s:
                    try:
                        single.append(model([x])[0])
                    except Exception:
                        single.append(None)
                yield pd.Series(single, index=s.index)

    return rows.withColumn(out, run(column)).filter(F.col(out).isNotNull())


def capabilities() -> dict[str, bool]:
    """Which optional libraries are at hand."""
    has = lambda m: importlib.util.find_spec(m) is not None
    return {"page_parser": has("fitz") or has("pypdf"), "recogniser": has("pytesseract"), "text_model": has("sentence_transformers"), "image_model": has("sentence_transformers"), "entity_model": has("gliner")}

"""Chunks of page text: paragraphs packed to a size, long ones by sentences, long sentences by overlapping slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AFTER_MARK = re.compile(r"(?<=[.!?。])\s+")


def _units(text: str, size: int, overlap: int) -> Iterator[tuple[str, str, bool]]:
    """(piece, what joins it to the chunk before, whether it must begin a chunk) in order.

    A paragraph within the size is one piece. A longer one begins anew and comes by sentences, and a sentence above the
    size by slices that share ``overlap`` characters and each begin a chunk.
    """
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if len(paragraph) <= size:
            yield paragraph, "\n", False
            continue
        for k, sentence in enumerate(_AFTER_MARK.split(paragraph)):
            if len(sentence) <= size:
                yield sentence, " ", k == 0
            else:
                count = 1 + -(-(len(sentence) - size) // (size - overlap))
                yield from ((sentence[i * (size - overlap) :][:size], " ", True) for i in range(count))


def pack(text: str, size: int = 500, overlap: int = 50, least: int = 10) -> list[str]:
    """The chunks of a page: pieces folded from the left, each into the last chunk as long as the size allows."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    chunks = [""]
    for piece, glue, fresh in [(text, "", True)] if len(text) <= size else _units(text, size, overlap):
        if fresh or len(chunks[-1]) + 1 + len(piece) > size:
            chunks.append(piece)
        else:
            chunks[-1] = (chunks[-1] + glue + piece).strip()
    return [c for c in chunks if len(c) >= least]


def chunked(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(document_id, page_number, chunk_index, content) of pages (document_id, page_number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, n, i, c) for d, n, t in zip(*(x.to_pylist() for x in b.columns)) for i, c in enumerate(pack(t, size, overlap))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["document_id", "page_number", "chunk_index", "content"])

    rows = pages.filter(F.col("text").isNotNull()).select(F.col("document_id").cast("bigint"), F.col("page_number").cast("int"), "text")
    return rows.mapInArrow(run, "document_id bigint, page_number int, chunk_index int, content string")

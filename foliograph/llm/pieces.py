"""Cutting of oversized texts at natural boundaries.

A text is parsed into a tree: sections below their heading by its depth, blocks between blank lines, list items below the
item they are indented under, lines, sentences, words, and at last user-perceived characters. Only a node above the limit
is opened. The subtrees of its children are merged bottom-up: the two neighbours that are smallest together become one as
long as they stay within the limit. Each piece after the first then starts up to ``overlap`` characters earlier, at the first
natural boundary there.

Lengths count code points. Pieces keep white space, so that their spans less the overlap are the whole text.
Defined cases: null texts have no piece; an empty text and one within the limit are one piece as they stand;
repeated rows are cut alike; a run without any boundary is cut between user-perceived characters, and not between a Thai or
Lao leading vowel and its consonant; only a single such character above the limit is cut inside.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.sources.tables import Scratch

LIMIT, OVERLAP = 500, 50

_HEADING = re.compile(r"(?m)^[ \t]*(?:(?P<hash>#{1,6}) |(?P<number>\d+(?:\.\d+)*)\.?[ \t]+(?=[^\W\d_])(?=[^\n]{1,80}$)|(?P<han>第[^\n]{1,4}[編篇章節节])|(?P<ko>제\s?\d+\s?[편장절]))")
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_ITEM = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:[-*+•·–▪◦]|\d{1,3}[.)]|[a-z][.)])[ \t]")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।]+[」』”’）]*\s*|(?<=[다요음])\s+(?=\S)")
_WORD = re.compile(r"\s+|[、，；：,;]")
#: Depth of a heading by its last sign.
_DEPTH = {"編": 1, "篇": 1, "편": 1, "章": 2, "장": 2, "節": 3, "节": 3, "절": 3}
_GRAPHEME = regex.compile(r"\X")
#: Vowels written before their consonant.
_LEADING = frozenset("เแโใไເແໂໃໄ")

Span = tuple[int, int]


@dataclass
class Node:
    """A span of the text; its children cover it without gaps."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)

    def __len__(self) -> int:
        return self.end - self.start


def _depth(m: re.Match) -> int:
    if m["hash"]:
        return len(m["hash"])
    if m["number"]:
        return m["number"].count(".") + 1
    return _DEPTH[(m["han"] or m["ko"])[-1]]


def _nested(start: int, end: int, marks: list[tuple[int, int]]) -> list[Node]:
    """Nodes of (position, depth) marks: each reaches to the next mark of its depth or less and holds the deeper ones."""
    out = [Node(start, marks[0][0] if marks else end)] if not marks or marks[0][0] > start else []
    i = 0
    while i < len(marks):
        at, depth = marks[i]
        j = i + 1
        while j < len(marks) and marks[j][1] > depth:
            j += 1
        stop = marks[j][0] if j < len(marks) else end
        node = Node(at, stop)
        if j > i + 1:
            inner = marks[i + 1][0]
            node.children = [Node(at, inner), *_nested(inner, stop, marks[i + 1 : j])]
        out.append(node)
        i = j
    return out


def _split(node: Node, cuts: list[int]) -> list[Node]:
    marks = [node.start, *(x for x in cuts if node.start < x < node.end), node.end]
    return [Node(a, b) for a, b in zip(marks, marks[1:])]


def children(text: str, node: Node) -> list[Node]:
    """The next smaller parts of a node: those of its tree, else by the first kind of boundary that it holds."""
    if node.children:
        return node.children
    a, b = node.start, node.end
    headings = [(m.start(), _depth(m)) for m in _HEADING.finditer(text, a, b)]
    if any(x > a for x, _ in headings):
        return _nested(a, b, headings)
    blocks = _split(node, [m.end() for m in _BLANK.finditer(text, a, b)])
    if len(blocks) > 1:
        return blocks
    items = [(m.start(), len(m["indent"].expandtabs(4))) for m in _ITEM.finditer(text, a, b)]
    if any(x > a for x, _ in items):
        return _nested(a, b, items)
    for pattern in (_LINE, _SENTENCE, _WORD):
        parts = _split(node, [m.end() for m in pattern.finditer(text, a, b)])
        if len(parts) > 1:
            return parts
    return []


def _characters(text: str, start: int, end: int) -> Iterator[int]:
    """Positions between user-perceived characters after ``start``, which is one."""
    for m in _GRAPHEME.finditer(text, start, end):
        if m.end() < end and text[m.end() - 1] not in _LEADING:
            yield m.end()


def _slices(text: str, start: int, end: int, limit: int) -> list[Span]:
    out, at = [], start
    last = start
    for x in [*_characters(text, start, end), end]:
        while x - at > limit:
            last = last if last > at else at + limit
            out.append((at, last))
            at = last
        last = x
    return [*out, (at, end)]


def _merge(spans: list[Span], limit: int) -> list[Span]:
    """Neighbours united, the two that are smallest together first, as long as they stay within the limit."""
    n = len(spans)
    start, end = [s for s, _ in spans], [e for _, e in spans]
    after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
    heap = [(end[i + 1] - start[i], i, i + 1, end[i + 1], start[i]) for i in range(n - 1) if end[i + 1] - start[i] <= limit]
    heapq.heapify(heap)
    while heap:
        _, i, j, e, s = heapq.heappop(heap)
        if not (alive[i] and alive[j] and end[j] == e and start[i] == s):
            continue
        end[i], alive[j], after[i] = e, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and end[y] - start[x] <= limit:
                heapq.heappush(heap, (end[y] - start[x], x, y, end[y], start[x]))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def pack(text: str, limit: int) -> list[Span]:
    """Spans of the whole text within the limit; nodes above it are opened from a stack, then merged from the inside."""

    def opened(node: Node) -> tuple[Node, list[Node], list[Span]]:
        return node, children(text, node), []

    done: list[Span] = []
    stack = [opened(Node(0, len(text)))] if len(text) > limit else []
    if not stack:
        return [(0, len(text))]
    while stack:
        node, todo, spans = stack[-1]
        if not todo and not spans:
            spans.extend(_slices(text, node.start, node.end, limit))
        if todo:
            child = todo[0]
            stack[-1] = node, todo[1:], spans
            if len(child) <= limit:
                spans.append((child.start, child.end))
            else:
                stack.append(opened(child))
            continue
        stack.pop()
        done = _merge(spans, limit)
        if stack:
            stack[-1][2].extend(done)
    return done


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece; start is before core start by the overlap."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out, before = [], 0
    for s, e in pack(text, limit - overlap):
        back = max(0, s - overlap)
        if s and back:
            marks = [m.end() for p in (_SENTENCE, _WORD) for m in p.finditer(text, back, s) if m.end() < s]
            back = marks[0] if marks else next((x for x in _characters(text, before, s) if x >= back), s)
        out.append((back if s else 0, s, e))
        before = s
    return out


def oversized_pieces(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, start_pos, end_pos, piece) of the rows above ``limit`` alone; shorter rows never leave the JVM."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part, start, end, piece = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, _, b) in enumerate(cut(text, limit, overlap)):
                    ids.append(i), part.append(k), start.append(a), end.append(b), piece.append(text[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())],
                names=["id", "part", "start_pos", "end_pos", "piece"],
            )

    return rows.mapInArrow(run, "id bigint, part int, start_pos int, end_pos int, piece string")


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All rows of a chunk table as pieces (chunk_id, document_id, page_number, piece_index, start_pos, end_pos, content).

    Numbers run on through each page in the order of chunk_index, then id, then position. A row without document or page
    is a page of its own. Rows repeated under one id give the same pieces under the same numbers.
    """
    rows = df.filter("content IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "document_id", "page_number", "chunk_index", F.col("content").cast("string").alias("content"))
    long = Scratch(df.sparkSession).put(oversized_pieces(rows, limit=limit, overlap=overlap))
    # Keys and counts are numbered without the texts, so that a page of very many rows stays narrow.
    keys = rows.select("id", "document_id", "page_number", "chunk_index").dropDuplicates(["id"]).join(long.groupBy("id").agg((F.max("part") + 1).alias("k")), "id", "left")
    alone = F.when(F.col("document_id").isNull() | F.col("page_number").isNull(), F.col("id"))
    before = Window.partitionBy("document_id", "page_number", alone).orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)
    first = keys.select("id", "document_id", "page_number", F.coalesce(F.sum(F.coalesce("k", F.lit(1))).over(before), F.lit(0)).cast("int").alias("first"))
    short = rows.filter(F.length("content") <= limit).select("id", F.lit(0).alias("part"), F.lit(0).alias("start_pos"), F.length("content").alias("end_pos"), F.col("content").alias("piece"))
    parts = long.unionByName(short).join(first, "id")
    return parts.select(F.col("id").alias("chunk_id"), "document_id", "page_number", (F.col("first") + F.col("part")).alias("piece_index"), "start_pos", "end_pos", F.col("piece").alias("content"))

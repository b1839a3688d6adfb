"""Sentences of texts in several languages and scripts.

Blank lines end a unit; list lines are units of their own. In between, every place where a sentence could end is a
candidate: closing marks, the end of a Korean verb without a mark, a space between Thai clauses. What stands inside
quotation marks or brackets is none, nor what only closes them. A maximum-entropy classifier decides the rest from
the neighbouring tokens, their case, length, digits and script, and how often they end or begin a block. It is
trained on reliable boundaries of at most ``SAMPLE`` rows (by hash of the id): ends of blocks joined with the start of
another block, against marks followed by small letters and marks after tokens that never end a block. Every script and
every mark goes through it; whether a token is a known abbreviation is one feature among others. Marks that hardly any row
of the sample holds are decided by the weights that training starts from (``PRIOR``).

Positions count code points and leave out surrounding white space. Defined cases: null, empty and blank texts have no
sentence; a text without any boundary is one sentence; repeated rows are cut alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.sampling import by_hash

SAMPLE, EXAMPLES = 20_000, 60_000

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LIST = re.compile(r"[^\S\n]*[-*•·–▪◦]\s")
_MARK = re.compile(
    r"(?P<cjk>[。！？｡]+)|(?P<danda>[।॥]+)|(?P<mark>[.!?…]+)(?P<close>[)\]]*)(?=\s|$|(?<=[a-zà-ÿ]{3}.)[A-ZÀ-Ý“«„¿¡]|(?<=[가-힣].)[A-Z가-힣“\d])|(?P<ko>(?<=[다요음까죠])(?=\s+\S))|(?P<th>(?<=[฀-๿])(?=\s+\S))"
)
_TOKEN_BEFORE = re.compile(r"(\S+)\s*$")
_TOKEN_AFTER = re.compile(r"\s*(\S+)")
#: The Latin end of a token and the Latin start of one, where scripts without spaces surround a name.
_LATIN_END, _LATIN_START = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'’-]*$"), re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'’-]*")
_NUMBERED = re.compile(r"\s*(?:\d{1,3}\.\s*)+$")
#: Marks of scripts that have no capitals, reliable outside quotation marks, and the weights before training.
_NATIVE = "。！？｡।॥"
PRIOR = {"m。": 2.0, "m！": 2.0, "m？": 2.0, "m｡": 2.0, "m।": 2.0, "m॥": 2.0, "m!": 1.0, "m?": 1.0, "aTrue": -2.0}
_QUOTES = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]"}
_SIDES = re.compile("[“”«»„「」『』‹›()（）\\[\\]\"]")
#: Tokens that a period abbreviates and that another word follows; fixed values.
ABBREVIATIONS = frozenset("dr mr mrs ms prof eng fig sec no nr abb vgl cf vs approx ca est i.e e.g z d sr sra tel pág pag art p ej vol st डॉ".split())


def kind(token: str) -> str:
    """Case, length or script of a token, by its first letter or digit."""
    c = next((x for x in token if x.isalnum()), token[:1])
    if not c:
        return "end"
    if c.isdigit():
        return f"d{min(len(token.strip('.,()')), 5)}"
    o = ord(c)
    if 0xAC00 <= o <= 0xD7A3:
        return "hangul"
    if 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF:
        return "cjk"
    if 0x900 <= o <= 0x97F:
        return "deva"
    if 0xE00 <= o <= 0xE7F:
        return "thai"
    if not c.isalpha():
        return "sign"
    if c.islower():
        return "low"
    return "caps" if token.isupper() and len(token) > 1 else "one" if len(token.strip(".")) == 1 else "up"


def shape(token: str) -> str:
    """What identifies a token: the last syllables of Korean words, digits as 0, otherwise its small letters."""
    t = token.strip("\"'“”«»„‘’()[]¿¡,;:").rstrip(".!?…").lower()
    if t and 0xAC00 <= ord(t[-1]) <= 0xD7A3:
        return t[-2:]
    return re.sub(r"\d", "0", t)[:16]


def _masked(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans inside quotation marks and brackets of a block; an end that is missing is the block's."""
    out, stack = [], []
    for m in _SIDES.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            c = "”" if stack and stack[-1][0] == '"' else "open"
            if c == "open":
                stack.append(('"', i, '"'))
            else:
                out.append((stack.pop()[1], i))
        elif stack and c == stack[-1][2]:
            out.append((stack.pop()[1], i))
        elif c in _QUOTES:
            stack.append((c, i, _QUOTES[c]))
        elif c in "”»」』" and not stack and not out:
            out.append((start, i))
    out += [(i, end) for c, i, _ in stack if c not in "([（\""]
    return out


def features(before: str, mark: str, after: str, gap: str, ends: dict[str, int], starts: dict[str, int]) -> list[str]:
    p, n, pk, nk = shape(before), shape(after), kind(before), kind(after)
    first = after[:1]
    opens = "q" if first in "“«„「『¿¡\"'‘(" else ""
    return [
        "b", f"m{mark[:1]}", f"p{p}", f"n{n}", f"pk{pk}", f"nk{nk}", f"k{pk}|{nk}", f"mk{mark[:1]}|{nk}", f"o{opens}|{mark[:1]}", f"g{gap}", f"l{min(len(p), 6)}|{nk}",
        f"e{ends.get(p, 0)}", f"s{starts.get(n, 0)}", f"es{ends.get(p, 0)}|{starts.get(n, 0)}|{mark[:1]}", f"a{p in ABBREVIATIONS}",
    ]


class Model:
    """Weights of the classifier and the block statistics of tokens."""

    def __init__(self, weights: dict[str, float], ends: dict[str, int], starts: dict[str, int]):
        self.weights, self.ends, self.starts = weights, ends, starts
        self.known: dict[tuple, bool] = {}

    def boundary(self, before: str, mark: str, after: str, gap: str) -> bool:
        key = (shape(before), kind(before), mark[:1], shape(after), kind(after), after[:1] in "“«„「『¿¡\"'‘(", gap)
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = sum(self.weights.get(f, 0.0) for f in features(before, mark, after, gap, self.ends, self.starts)) > 0
        return self.known[key]


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a unit as it stands) between blank lines, list lines apart."""
    marks = [0, *(x for m in _BLANK.finditer(text) for x in m.span()), len(text)]
    for a, b in zip(marks[::2], marks[1::2]):
        at = start = a
        while at < b:
            stop = text.find("\n", at, b)
            stop = b if stop < 0 else stop
            if _LIST.match(text, at, stop):
                if start < at:
                    yield start, at, False
                yield at, stop, True
                start = stop + 1
            at = stop + 1
        if start < b:
            yield start, b, False


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, str, str, str, str]]:
    """(end of the sentence, token before, mark, token after, gap) of each possible boundary in a segment."""
    hidden = _masked(text, start, end)
    for m in _MARK.finditer(text, start, end):
        at, group = m.end(), m.lastgroup
        if any(a <= m.start() < b for a, b in hidden):
            continue
        group = "mark" if group == "close" else group
        mark = m.group().rstrip(")]") if group not in ("ko", "th") else group
        after = _TOKEN_AFTER.match(text, at, end)
        if after is None:
            continue
        cut = m.start()
        while cut > start and text[cut - 1].isspace():
            cut -= 1
        while cut > start and not text[cut - 1].isspace():
            cut -= 1
        before = _TOKEN_BEFORE.search(text, cut, m.start())
        gap = "n" if "\n" in text[at : after.start(1)] else "s" if after.start(1) > at else "0"
        p, n = before[1] if before else "", after[1]
        if not p.isascii() and (latin := _LATIN_END.search(p)):
            p = latin[0]
        if not n.isascii() and (latin := _LATIN_START.match(n)):
            n = latin[0]
        yield at, p, mark, n, gap


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out = []
    for a, b, whole in segments(text):
        start = a
        if not whole:
            for at, before, mark, after, gap in candidates(text, a, b):
                if not (mark == "." and _NUMBERED.match(text, start, at)) and model.boundary(before, mark, after, gap):
                    out.append((start, at))
                    start = at
        out.append((start, b))
    trimmed = []
    for s, e in out:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            trimmed.append((s, e))
    return trimmed


def _grade(at: Counter, total: Counter) -> dict[str, int]:
    """0: too rare to tell; 1: never; 2: seldom; 3: often - of tokens at a block's edge against all before a mark."""
    out = {}
    for t, n in total.items():
        k = at.get(t, 0)
        if n >= 3 or k:
            out[t] = 1 if k == 0 and n >= 12 else 3 if k * 12 >= n else 2 if k else 0
    return out


def fit(texts: list[str], limit: int = EXAMPLES, rounds: int = 4) -> Model:
    """Trains the classifier on reliable boundaries of ``texts``."""
    end_at, end_all, start_at, start_all = Counter(), Counter(), Counter(), Counter()
    blocks: list[tuple[str, str, str]] = []
    inner: list[tuple[str, str, str, str]] = []
    for t in texts:
        for a, b, whole in segments(t):
            block = t[a:b].strip()
            if whole or len(block) < 25 or "�" in block:
                continue
            m = re.search(r"(\S*?)([.!?…]+)[)\]]*$", block)
            last = m[1] if m else block.split()[-1]
            tokens = block.split(None, 1)
            if b == len(t) or t[b : b + 1] == "\n":
                blocks.append((last, m[2] if m else "ko" if last[-1:] in "다요음까" else "", tokens[0]))
                if m or last[-1:] in "다요음까":
                    end_at[shape(last)] += 1
            if a > 0:
                start_at[shape(tokens[0])] += 1
            for _, p, mark, n, g in candidates(t, a, b):
                inner.append((p, mark, n, g))
                end_all[shape(p)] += 1
                start_all[shape(n)] += 1
    end_all.update(end_at)
    start_all.update(start_at)
    ends, starts = _grade(end_at, end_all), _grade(start_at, start_all)
    rng = np.random.default_rng(3)
    ended = [x for x in blocks if x[1]]
    examples: list[tuple[list[str], int]] = []
    for i in rng.permutation(len(ended))[: limit // 2] if ended else []:
        nxt = blocks[int(rng.integers(len(blocks)))][2]
        examples.append((features(ended[i][0], ended[i][1], nxt, "sn"[int(rng.integers(2))], ends, starts), 1))
    for i in rng.permutation(len(inner)):
        p, mark, n, g = inner[i]
        e = ends.get(shape(p), 0)
        label = None
        if mark == "th" or mark[0] in _NATIVE:
            label = 1
        elif mark != "ko" and (kind(n) == "low" or kind(p) == "one" and mark == "." and kind(n) in ("up", "hangul", "one")):
            label = 0
        elif shape(p) in ABBREVIATIONS and e == 1:
            label = 0
        elif e == 1 and (kind(n)[0] == "d" or mark == "ko" or starts.get(shape(n), 0) == 1):
            label = 0
        elif kind(p)[0] == "d" and len(shape(p)) <= 2 and (kind(n)[0] == "d" or starts.get(shape(n), 0) == 1):
            label = 0
        elif e == 3 and starts.get(shape(n), 0) == 3:
            label = 1
        if label is not None:
            examples.append((features(p, mark, n, g, ends, starts), label))
            if len(examples) >= limit:
                break
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(f, len(index)) for f in fs]) for fs, _ in examples]
    w, h = np.zeros(len(index) + 1), np.full(len(index) + 1, 1e-6)
    for f, x in PRIOR.items():
        if f in index:
            w[index[f]] = x
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r, y = rows[i], examples[i][1]
            g = 1 / (1 + np.exp(-min(30.0, max(-30.0, w[r].sum())))) - y
            grad = g + 1e-5 * w[r]
            h[r] += grad * grad
            w[r] -= 0.3 * grad / np.sqrt(h[r])
    return Model(PRIOR | {f: float(w[i]) for f, i in index.items()}, ends, starts)


def sentences(df: DataFrame, id_col: str = "id", text_col: str = "content", sample: int = SAMPLE) -> DataFrame:
    """(id, start_pos, end_pos) of every sentence of every row."""
    rows = df.filter(F.length(text_col) > 0).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    drawn = by_hash(rows, sample).select("text").toArrow()
    model = df.sparkSession.sparkContext.broadcast(fit(drawn["text"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in split(t, model.value):
                    ids.append(i), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_pos", "end_pos"])

    return rows.mapInArrow(run, "id bigint, start_pos int, end_pos int")

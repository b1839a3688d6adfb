"""Noise in text from scanned pages: words broken at line ends, misread characters, running lines, page numbers.

Lines are labelled by a hidden Markov model with the states header, number, body and break. A line's observation is
its place (first, second, inner, last but one, last), its shape (blank, number, title, text) and whether it recurs
on another page of its document; keys of lines forgive case, numbers and misread characters. The model starts from
a prior and is re-estimated by Viterbi training on at most ``SAMPLE`` rows, by hash of the id.

A word is misread if undoing one or two of the confusions gives a word that stands in at least ``RATIO`` times as many rows,
or if a sign that no word holds stands in it. A hyphen at a line end breaks a word unless the hyphenated form is the
commoner one or the next part is a name. Both compare counts over all rows, none is cut off: every distinct word of the
corpus is undone once, what it may have been is joined with the whole table of counts, and the corrections are joined back
to the rows. Two filters of fixed size (``FILTER_BITS``) only save work: a word that passes one wrongly meets nothing in
the join. A word is a run of up to ``WORD`` characters; above ``DOUBLE`` one confusion is undone, up to it two.

Paragraphs are put together again from body lines: hyphens closed, confusions undone, blank lines inside a sentence
bridged.

Defined cases: null and empty contents have neither noise nor paragraphs; a null document or page means no
recurrence; repeated ids count as further rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.sampling import by_hash
from foliograph.sources.tables import Scratch

SAMPLE = 20_000
RATIO = 12
WORD, DOUBLE = 200, 30
#: Bits of a filter; 4 MB whatever the corpus.
FILTER_BITS = 25

#: (read wrongly as, meant) - confusions of scanning.
CONFUSIONS = (
    ("c", "e"), ("b", "h"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("!", "i"), ("†", "t"), ("1", "i"),
    ("룩", "록"), ("롤", "를"), ("즉", "측"), ("희", "회"), ("익", "약"), ("도", "토"), ("신", "산"), ("7ㅏ", "가"), ("01", "이"), ("일l", "일"),
)
_WORD = re.compile(r"(?<!\d[.,])[^\W_](?:[^\W_]|[†!](?=[a-zà-ÿ])|†)*|[†!](?=[a-zà-ÿ])[^\W_](?:[^\W_]|[†!](?=[a-zà-ÿ])|†)*")
_HYPHEN = re.compile(r"([-‐\u00ad¬]) *\n\s*([^\W_]+)")
_BEFORE = re.compile(r"[^\W\d_][^\s]*$")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_SOFT = "\u00ad¬"
#: Signs that no word holds: what must stand in a text for the pattern to be tried, and the pattern.
_SURE = (
    ("†", re.compile(r"[^\W\d_]†|†[a-zà-ÿ]")),
    ("!", re.compile(r"[a-zà-ÿ]![a-zà-ÿ]|(?:^|\s)![a-zà-ÿ]{3}")),
    ("7ㅏ", re.compile("7ㅏ")),
    ("l", re.compile("[가-힣]l[가-힣]")),
    ("|", re.compile(r"[가-힣]\|[가-힣]")),
    ("01", re.compile(r"(?<=[가-힣])01(?![\d.,])|(?<![\d.,])01(?=[가-힣])")),
)
_N = r"[\dOolI]{1,3}"
_NUMBER = re.compile(
    rf"\s*(?:[-–—]\s*{_N}\s*[-–—]|\[\s*{_N}\s*\]|(?:p|pg|s|pág)\.?\s*{_N}|(?:page|seite|página)\s+{_N}(?:\s*(?:of|von|de|/)\s*{_N})?|{_N}\s*/\s*{_N}|{_N}\s*쪽|第?\s*{_N}\s*[页頁ページ]+|หน้า\s*{_N}|पृष्ठ\s*{_N}|{_N}\.?|[ivxlc]{{1,7}})\s*", re.I
)
_TRAILING = re.compile(r"\s{2,}[\dOolI]{1,3}\s*$|^\s*[\dOolI]{1,3}\s{2,}")
_TITLE = re.compile(r"\S\s+[·|–—]\s+\S")
_END = re.compile(r"[.!?…。！？।:;][\"'”’»」』)\]]*\s*$")
#: A sentence's end inside a line; lines over 100 characters that have one are paragraphs.
_INSIDE = re.compile(r"[.!?…][\"'”’»)\]]*\s+\S|[。！？।]")
_LIST = re.compile(r"\s*(?:[-*•·–]\s|\d{1,3}[.)]\s)")

STATES = ("header", "number", "body", "break")
_FOLD = [(a, b) for a, b in CONFUSIONS if len(a) == 2 and a.isascii() and not a.isdigit()]
_SAME = str.maketrans({"1": "i", "l": "i", "!": "i", "|": "i", "0": "o", "5": "s", "9": "g", "c": "e", "h": "b", "†": "t"} | {a: b for a, b in CONFUSIONS if len(a) == 1 and "가" <= a <= "힣"})


def line_key(line: str) -> str:
    """A line without case, page number, blanks and what scanning confuses."""
    s = unicodedata.normalize("NFKD", _TRAILING.sub("", line)).lower()
    s = unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c)))
    for a, b in (("7ㅏ", "가"), ("01", "이"), ("일l", "일"), *_FOLD):
        s = s.replace(a, b)
    return "".join(c for c in s.translate(_SAME) if c.isalpha())


def is_number(line: str) -> bool:
    return bool(_NUMBER.fullmatch(line)) and any(c in "0123456789ivxlcIVXLCOo" for c in line)


def observe(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The observation of each line without its recurrence, and (line, key) of the lines that may recur.

    A # marks lines with a number set apart at their end; it is no part of what the model sees.
    """
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    out, keys = [], []
    rank = {i: n for n, i in enumerate(full)}
    for i, x in enumerate(lines):
        if i not in rank:
            out.append("_")
            continue
        n, m = rank[i], len(full) - 1 - rank[i]
        place = "f" if n == 0 else "l" if m == 0 else "s" if n == 1 else "p" if m == 1 else "i"
        shape = "N" if len(x.strip()) <= 20 and is_number(x) else "B"
        if shape == "B" and not _LIST.match(x) and (not _END.search(x) or _TRAILING.search(x)) and (len(x) <= 100 or not _INSIDE.search(x)):
            shape = "T" if _TITLE.search(x) else "U" if _TRAILING.search(x) else "t"
        out.append(place + shape + ("#" if shape in "TU" and _TRAILING.search(x) else ""))
        if (shape in "TU" or shape == "t" and place != "i") and len(k := line_key(x)) >= 4:
            keys.append((i, k))
    return out, keys


def prior() -> dict:
    """Starting probabilities, transitions and emissions as counts."""
    place = {"header": {"f": 6, "s": 2, "p": 2, "l": 4, "i": 1.5}, "number": {"f": 4, "s": 2, "p": 2, "l": 6, "i": 0.3}, "body": {"f": 2, "s": 2, "p": 2, "l": 2, "i": 8}}
    shape = {
        "header": {"TR": 10, "UR": 6, "tR": 4, "T": 3, "U": 1, "t": 0.01, "B": 1e-4, "N": 1e-3, "NR": 1e-3},
        "number": {"N": 10, "NR": 1, "U": 1e-3, "UR": 1e-3, "T": 1e-4, "TR": 1e-4, "t": 1e-4, "tR": 1e-4, "B": 1e-5},
        "body": {"B": 10, "t": 8, "T": 0.05, "U": 0.05, "TR": 0.01, "UR": 0.005, "tR": 0.02, "N": 0.01, "NR": 0.01},
    }
    emit = {}
    for s in place:
        p, q = sum(place[s].values()), sum(shape[s].values())
        emit[s] = {a + b: x / p * y / q for a, x in place[s].items() for b, y in shape[s].items()}
    emit["break"] = {"_": 1.0}
    move = {
        "start": {"header": 3, "number": 2, "body": 6, "break": 1},
        "header": {"header": 0.2, "number": 1, "body": 6, "break": 1},
        "number": {"header": 1.5, "number": 0.05, "body": 5, "break": 1},
        "body": {"header": 0.4, "number": 0.5, "body": 8, "break": 1},
        "break": {"header": 0.4, "number": 0.5, "body": 8, "break": 0.5},
    }
    return {"emit": emit, "move": {a: {b: x / sum(r.values()) for b, x in r.items()} for a, r in move.items()}}


def viterbi(model: dict, seen: list[str]) -> list[str]:
    """The likeliest states of a row's lines."""
    if not seen:
        return []
    log = lambda x: math.log(max(x, 1e-9))
    best, back = {s: log(model["move"]["start"][s]) + log(model["emit"][s].get(seen[0], 0)) for s in STATES}, []
    for o in seen[1:]:
        step, new = {}, {}
        for s in STATES:
            p = max(STATES, key=lambda q: best[q] + log(model["move"][q][s]))
            step[s], new[s] = p, best[p] + log(model["move"][p][s]) + log(model["emit"][s].get(o, 0))
        back.append(step)
        best = new
    s = max(STATES, key=best.get)
    out = [s]
    for step in reversed(back):
        out.append(s := step[s])
    return out[::-1]


def fit(rows: list[list[str]], rounds: int = 2, weight: float = 200.0) -> dict:
    """Viterbi training from the prior, which counts as ``weight`` lines of each state."""
    base = model = prior()
    for _ in range(rounds):
        move = {a: Counter({b: x * weight for b, x in r.items()}) for a, r in base["move"].items()}
        emit = {s: Counter({o: x * weight for o, x in e.items()}) for s, e in base["emit"].items()}
        for (seen, states), n in Counter((tuple(r), tuple(viterbi(model, r))) for r in rows).items():
            for a, b in zip(("start", *states), states):
                move[a][b] += n
            for s, o in zip(states, seen):
                emit[s][o] += n
        model = {k: {a: {b: x / r.total() for b, x in r.items()} for a, r in t.items()} for k, t in (("move", move), ("emit", emit))}
    return model


def undo(word: str) -> Iterator[str]:
    """The words that ``word`` may have been, one confusion undone at one or, up to DOUBLE characters, at two places."""
    first = set()
    for wrong, meant in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            first.add(word[:at] + meant + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    yield from first
    if 5 < len(word) <= DOUBLE:
        for w in first:
            for wrong, meant in CONFUSIONS:
                at = w.find(wrong)
                while at >= 0:
                    yield w[:at] + meant + w[at + len(wrong) :]
                    at = w.find(wrong, at + 1)


class Filter:
    """Which words a table may hold: never wrong about those it holds, by two bits a word in a field of fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.view(np.uint8).tobytes()

    @staticmethod
    def places(word: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(word)
        return h >> (64 - FILTER_BITS), h & ((1 << FILTER_BITS) - 1)

    @classmethod
    def of(cls, words: DataFrame, col: str = "w") -> Filter:
        """At most 2**(FILTER_BITS - 6) rows reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.array([x for w in b.column(0).to_pylist() for x in cls.places(w)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.int64(1) << (at & 63))], names=["place", "bit"])

        set_ = words.select(col).mapInArrow(run, "place int, bit bigint").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        bits[set_["place"].to_numpy()] = set_["bits"].to_numpy()
        return cls(bits)

    def __contains__(self, word: str) -> bool:
        a, b = self.places(word)
        return bool(self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1)


def breaks(text: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether a word is cut for certain, and the halves of those cut unless their hyphenated form is the commoner."""
    sure, perhaps = False, []
    for m in _HYPHEN.finditer(text):
        at = m.start()
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        before = _BEFORE.search(text[at : m.start()])
        if before is not None:
            if (halves := parts(before[0], m[1], m[2])) is True:
                sure = True
            elif halves:
                perhaps.append(halves)
    return sure, perhaps


def parts(a: str, mark: str, b: str) -> bool | tuple[str, str]:
    """True if the mark cuts a word for certain, False if it doesn't, else the two halves that may belong together."""
    if mark in _SOFT:
        return True
    a = re.split(r"[^\w]", a)[-1] or a
    if not b[:1].islower() and not b[:1].isdigit() or len(a) == 1 and a.isupper():
        return False
    return a, b


def words(text: str) -> tuple[set[str], set[str]]:
    """The words of a text, and those that stand in it only if the words cut at line ends are put together."""
    found = set(_WORD.findall(text))
    closed = set(_WORD.findall(_HYPHEN.sub(r"\2", text))) - found if _HYPHEN.search(text) else set()
    return found, closed


def _counts(rows: DataFrame) -> DataFrame:
    """(w, n): every word and every compound, with the number of rows it stands in; 0 for words only cut at line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own, closed = words(t)
                found.update(own.union(_COMPOUND.findall(t)) if "-" in t else own)
                found.update(dict.fromkeys(closed, 0))
            if len(found) > 200_000:
                yield out()
                found.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def corrections(counted: DataFrame) -> DataFrame:
    """(w, u): each misread word of (w, n) and the commonest word it may have been, ties to the first by letters."""
    frequent = counted.filter(F.col("n") >= RATIO)
    known = counted.sparkSession.sparkContext.broadcast(Filter.of(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = known.value
        for b in batches:
            out = [(w, n, u) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for u in {u for u in undo(w) if len(u) >= 2 and u != w and u in f}]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["w", "n", "u"])

    single = counted.filter(F.length("w").between(2, WORD) & ~F.col("w").rlike("^[0-9]+$"))
    perhaps = single.mapInArrow(run, "w string, n bigint, u string")
    met = perhaps.join(frequent.toDF("u", "m"), "u").filter(F.col("m") >= RATIO * F.greatest("n", F.lit(1)))
    return met.groupBy("w").agg(F.min(F.struct((-F.col("m")).alias("m"), "u")).alias("best")).select("w", F.col("best.u").alias("u"))


def compounds(counted: DataFrame) -> DataFrame:
    """(w): hyphenated forms that stand in more rows than the same letters without the hyphen."""
    hyphenated = counted.filter(F.contains("w", F.lit("-"))).select("w", "n", F.translate("w", "-", "").alias("joined"))
    return hyphenated.join(counted.toDF("joined", "k"), "joined", "left").filter(F.col("n") > F.coalesce("k", F.lit(0))).select("w")


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def labelled(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, broken, misread, states, numbered, fixes, kept) of each row: a state for each line, whether a header holds a
    page number, (w, u) of the misread words and the compounds that keep their hyphen."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.filter(F.length("content") > 0).select(
        F.col("id").cast("bigint").alias("id"), F.col("document_id").cast("bigint").alias("document_id"), F.col("page_number").cast("bigint").alias("page_number"), F.col("content").cast("string").alias("text")
    )
    counted = scratch.put(_counts(rows))
    fixed, keep = scratch.put(corrections(counted)), scratch.put(compounds(counted))
    filters = spark.sparkContext.broadcast((Filter.of(fixed), Filter.of(keep)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, whole = filters.value
        seen_words: dict[str, bool] = {}
        for b in batches:
            out = []
            for t in b.column(3).to_pylist():
                if len(seen_words) > 300_000:
                    seen_words.clear()
                o, k = observe(t)
                cut, halves = breaks(t)
                forms = [f"{x}-{y}" for x, y in halves]
                perhaps = [f for f in forms if f in whole]
                closed = _HYPHEN.sub(r"\2", t) if cut or halves else t
                sure = any(sign in closed and p.search(closed) for sign, p in _SURE)
                odd = []
                for w in set(_WORD.findall(closed)):
                    if (x := seen_words.get(w)) is None:
                        x = seen_words[w] = w in wrong
                    if x:
                        odd.append(w)
                out.append((cut or len(perhaps) < len(forms), sure, o, [i for i, _ in k], [_hash(x) for _, x in k], odd, sorted(set(perhaps))))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "document_id", "page_number", "broken", "misread", "seen", "lines", "keys", "odd", "perhaps"])

    looked = scratch.put(
        rows.mapInArrow(
            look, "id bigint, document_id bigint, page_number bigint, broken boolean, misread boolean, seen array<string>, lines array<int>, keys array<bigint>, odd array<string>, perhaps array<string>"
        )
    )
    edges = looked.select("id", "document_id", "page_number", F.explode(F.arrays_zip("lines", "keys")).alias("e")).select("id", "document_id", "page_number", "e.lines", "e.keys")
    recurring = edges.groupBy("document_id", "keys").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b")).filter("a < b").select("document_id", "keys")
    none = F.lit(None).cast("string")
    again = edges.join(recurring, ["document_id", "keys"], "left_semi").select("id", F.col("lines").alias("line"), none.alias("w"), none.alias("u"))
    misread = looked.select("id", F.explode("odd").alias("w")).join(fixed, "w").select("id", F.lit(None).cast("int").alias("line"), "w", "u")
    kept = looked.select("id", F.explode("perhaps").alias("w")).join(keep, "w").select("id", F.lit(None).cast("int").alias("line"), "w", none.alias("u"))
    marks = (
        again.unionByName(misread)
        .unionByName(kept)
        .groupBy("id")
        .agg(
            F.collect_set("line").alias("again"),
            F.collect_set(F.when(F.col("u").isNotNull(), F.struct("w", "u"))).alias("fixes"),
            F.collect_set(F.when(F.col("line").isNull() & F.col("u").isNull(), F.col("w"))).alias("kept"),
        )
    )
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    joined = scratch.put(
        looked.select("id", "broken", "misread", "seen", "perhaps")
        .join(marks, "id", "left")
        .select("id", "broken", "misread", "seen", "perhaps", empty("again", "array<int>"), empty("fixes", "array<struct<w:string,u:string>>"), empty("kept", "array<string>"))
        .select("id", (F.col("broken") | (F.size(F.array_except("perhaps", "kept")) > 0)).alias("broken"), (F.col("misread") | (F.size("fixes") > 0)).alias("misread"), "seen", "again", "fixes", "kept")
    )

    def marked(seen: list[str], again: list[int]) -> list[str]:
        lines = set(again)
        return [o.rstrip("#") + "R" * (i in lines) for i, o in enumerate(seen)]

    drawn = by_hash(joined, sample).select("seen", "again").toArrow()
    model = spark.sparkContext.broadcast(fit([marked(s, a) for s, a in zip(drawn["seen"].to_pylist(), drawn["again"].to_pylist())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str]] = {}
        for b in batches:
            states, numbered = [], []
            for s, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                o = tuple(marked(s, a))
                if o not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[o] = viterbi(model.value, list(o))
                states.append(known[o])
                numbered.append(any(x == "header" and y.endswith("#") for x, y in zip(known[o], s)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(states, pa.list_(pa.string())), pa.array(numbered), b.column(5), b.column(6)], names=["id", "broken", "misread", "states", "numbered", "fixes", "kept"])

    return joined.mapInArrow(decode, "id bigint, broken boolean, misread boolean, states array<string>, numbered boolean, fixes array<struct<w:string,u:string>>, kept array<string>")


def noise(df: DataFrame) -> DataFrame:
    """(chunk_id, noise): one row for each kind of noise in a row."""
    rows = labelled(df)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("broken"), F.lit("broken_word")),
            F.when(F.col("misread"), F.lit("misread")),
            F.when(F.array_contains("states", "header"), F.lit("running_line")),
            F.when(F.array_contains("states", "number") | F.col("numbered"), F.lit("page_number")),
        )
    )
    return rows.select(F.col("id").alias("chunk_id"), F.explode(kinds).alias("noise")).distinct()


def reassemble(text: str, states: list[str], fixes: dict[str, str], kept: set[str]) -> list[str]:
    """The paragraphs of a row: body lines only, joined where a sentence runs on, words repaired."""
    done: list[str] = []
    current, gap = "", False
    for line, state in zip(text.split("\n"), states):
        x = line.strip()
        if state == "break" or not x:
            gap = True
        elif state == "body":
            m = re.search(r"([^\W\d_]+)([-‐]|­|¬)$", current)
            halves = m and parts(m[1], m[2], re.match(r"\w*", x)[0] or x)
            if halves is True or halves and "-".join(halves) not in kept:
                current = current[: m.start(2)] + x
            elif current and not (gap and (_END.search(current) or not x[0].islower())) and not _LIST.match(x):
                current += ("" if m else " ") + x
            else:
                if current:
                    done.append(current)
                current = x
            gap = False
    if current:
        done.append(current)
    return [_WORD.sub(lambda m: fixes.get(m.group(), m.group()), p) for p in done]


def paragraphs(df: DataFrame) -> DataFrame:
    """(chunk_id, paragraph, text): the readable paragraphs of every row that has noise."""
    odd = labelled(df).filter(F.col("broken") | F.col("misread") | F.array_contains("states", "header") | F.array_contains("states", "number"))
    text = df.select(F.col("id").cast("bigint").alias("id"), F.col("content").cast("string").alias("text"))
    both = odd.select("id", "states", "fixes", "kept").join(text, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, n, p) for i, s, f, k, t in zip(*(c.to_pylist() for c in b.columns)) for n, p in enumerate(reassemble(t, s, {x["w"]: x["u"] for x in f}, set(k)))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["chunk_id", "paragraph", "text"])

    return both.mapInArrow(run, "chunk_id bigint, paragraph int, text string")

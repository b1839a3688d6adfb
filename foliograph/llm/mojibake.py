"""Texts that were decoded with a wrong encoding.

Every distinct run of non-ASCII characters of the corpus is a word. Its garbled forms under all encoding chains make
a table; the runs of each document that could be such a form are hash-joined against it. A document with a match
is affected, and the matches name its chains. Restoring joins the runs with the table again, with the clean words
that the forms come from: a run is replaced by its word where only one word gives it and garbling that word gives the
run again. Runs, lines and texts without such words are led back through the document's chains, if garbling gives
them again; other runs stay.

Words are taken from all documents, so a word needs one clean occurrence anywhere. Forms are compared by a 64-bit
hash; restoring garbles the word again before it is put in place. Word and form tables grow with the distinct runs,
not the text.

Between two double-byte encodings (``_MUTUAL``) every text is a form of some other text, and the way back is a chain as
well. There a form counts only if its word stands in at least ``CLEANER`` times as many documents as the form itself, and a
document is affected by such forms alone only if they have ``EVIDENCE`` characters together. A single letter inside an
ASCII word ("jalape" + one Han sign + "o") is no run of its own length and isn't decided.

Defined cases: null and ASCII-only texts are never affected; letters and symbols that no chain leads to are no case;
what a chain has lost (U+FFFD) is found, and put right where the table knows its only original; repeated rows are treated alike; extra columns are kept out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources.tables import Scratch

#: (encodings written, read wrongly), in turn. "1" in front of a name: bytes that it leaves undefined keep their number.
CHAINS: tuple[tuple[str, ...], ...] = (
    ("utf-8", "latin-1"),
    ("utf-8", "1cp1252"),
    ("utf-8", "1cp1251"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp437"),
    ("utf-8", "cp949"),
    ("utf-8", "gbk"),
    ("utf-8", "shift_jis"),
    ("1cp1252", "utf-8"),
    ("utf-8", "1cp1252", "utf-8", "1cp1252"),
    ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "latin-1", "utf-8", "1cp1252"),
    ("utf-8", "1cp1252", "utf-8", "latin-1"),
    ("cp949", "latin-1"),
    ("cp949", "1cp1252"),
    ("gbk", "latin-1"),
    ("gbk", "1cp1252"),
    ("shift_jis", "latin-1"),
    ("shift_jis", "1cp1252"),
    ("euc_jp", "latin-1"),
    ("euc_jp", "1cp1252"),
    ("1cp874", "latin-1"),
    ("1cp874", "1cp1252"),
    ("utf-8", "big5"),
    ("cp949", "gbk"),
    ("gbk", "cp949"),
    ("shift_jis", "gbk"),
    ("gbk", "shift_jis"),
    ("shift_jis", "cp949"),
    ("cp949", "shift_jis"),
    ("euc_jp", "gbk"),
    ("big5", "gbk"),
    ("gbk", "big5"),
)
_DOUBLE = {"cp949", "gbk", "shift_jis", "euc_jp", "big5"}
_MULTI = _DOUBLE | {"1cp874"}
#: Bits of the chains between double-byte encodings.
_MUTUAL = sum(1 << k for k, c in enumerate(CHAINS) if c[0] in _DOUBLE and c[-1] in _DOUBLE)
CLEANER, EVIDENCE = 3, 6
#: Of this chain only what it loses can be told from text; read the other way round it would garble.
_LOSES = ("1cp1252", "utf-8")
_RUN = re.compile(r"[^\x00-\x7f]+")


def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    plain = name.lstrip("1")
    to = {b: (bytes([b]).decode(plain, "ignore") or chr(b)) for b in range(256)}
    return to, {c: b for b, c in to.items()}


_SINGLE = {n: _tables(n) for n in ("1cp1252", "1cp1251", "1cp874")}


def _encode(text: str, name: str) -> bytes | None:
    if name in _SINGLE:
        back = _SINGLE[name][1]
        try:
            return bytes([back[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, name: str, errors: str = "replace") -> str | None:
    if name in _SINGLE:
        return data.decode("latin-1").translate(_SINGLE[name][0])
    try:
        return data.decode(name, errors)
    except UnicodeDecodeError:
        return None


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` written and read by the chain; None where it can't be written so."""
    for write, read in zip(chain[::2], chain[1::2]):
        data = _encode(text, write)
        if data is None:
            return None
        text = _decode(data, read) or ""
    return text


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The original that the chain turns into ``text``; None if there is none."""
    start = text
    for write, read in reversed(list(zip(chain[::2], chain[1::2]))):
        data = _encode(start, read)
        if data is None or (start := _decode(data, write, "strict")) is None:
            return None
    return start if garble(start, chain) == text else None


def pieces_of(form: str) -> list[str]:
    """The non-ASCII runs of a garbled form that are long enough to tell."""
    return [p for p in _RUN.findall(form) if len(p) >= 2 or "\ufffd" in p]


def forms(word: str) -> Iterator[tuple[str, int]]:
    """(piece, chain number) of each garbled form of a word."""
    for k, chain in enumerate(CHAINS):
        if chain[0] in _MULTI and len(word) < 2:
            continue
        form = garble(word, chain)
        if form and form != word:
            for p in set(pieces_of(form)):
                if (chain[0] not in _MULTI or len(p) >= 3) and (chain != _LOSES or "\ufffd" in p):
                    yield p, k


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): every distinct non-ASCII run of the corpus and the number of rows it stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                found.update(set(_RUN.findall(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _form_table(words: DataFrame) -> DataFrame:
    """(h, chains, own): hash of a piece of a garbled form, a bit for each chain that makes it, and the number of rows
    that hold the piece, where it may be a form between double-byte encodings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, list[int]] = {}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, k in forms(w):
                    row = made.setdefault(p, [0, 0, 0])
                    row[0] |= 1 << k
                    if _MUTUAL >> k & 1:
                        row[1] = max(row[1], n)
                if len(w) >= 3 and any(c >= "\u2e80" for c in w):
                    row = made.setdefault(w, [0, 0, 0])
                    row[2] = max(row[2], n)
            cols = list(zip(*made.values())) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([_hash(p) for p in made], pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["h", "chains", "source", "own"])

    made = words.mapInArrow(run, "h bigint, chains bigint, source bigint, own bigint")
    each = made.groupBy("h").agg(F.bit_or("chains").alias("chains"), F.max("source").alias("source"), F.max("own").alias("own"))
    clear = F.lit(~_MUTUAL).cast("bigint")
    return each.select("h", F.when(F.col("source") >= CLEANER * F.col("own"), F.col("chains")).otherwise(F.col("chains").bitwiseAND(clear)).alias("chains"), "own").filter("chains != 0")


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, size): the distinct runs of each document and their lengths."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, sizes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in set(_RUN.findall(t)):
                    if len(r) >= 2 or r == "\ufffd":
                        ids.append(i), hashes.append(_hash(r)), sizes.append(len(r))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32())], names=["id", "h", "size"])

    return rows.mapInArrow(run, "id bigint, h bigint, size int")


def _judged(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(id, chains, matches) of the affected documents."""
    clear = F.col("chains").bitwiseAND(F.lit(~_MUTUAL).cast("bigint"))
    met = tokens.join(table.select("h", "chains"), "h").dropDuplicates(["id", "h"])
    each = met.groupBy("id").agg(
        F.bit_or("chains").alias("chains"), F.bit_or(clear).alias("clear"), F.sum(F.when(clear == 0, F.col("size")).otherwise(0)).alias("evidence"), F.count("*").alias("matches")
    )
    enough = F.col("evidence") >= EVIDENCE
    return each.filter(enough | (F.col("clear") != 0)).select("id", F.when(enough, F.col("chains")).otherwise(F.col("clear")).alias("chains"), "matches")


def affected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chains, matches): documents with a garbled form, a bit for each chain, and how many distinct runs match."""
    return _judged(_tokens(df, id_col, text_col), _form_table(_words(df, text_col)))


def _source_table(words: DataFrame) -> DataFrame:
    """(h, made, word, n, self): every piece of a form with its chains, its word, the word's count and its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made: dict[str, int] = {}
                for p, k in forms(w):
                    made[p] = made.get(p, 0) | 1 << k
                own = _hash(w)
                out += [(_hash(p), c, w, n, own) for p, c in made.items()]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["h", "made", "word", "n", "self"])

    return words.mapInArrow(run, "h bigint, made bigint, word string, n bigint, self bigint")


def _matches(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, chains, originals): affected documents, a bit for each chain, and (h, chain, word) of each run and chain
    with one clean source. A source is clean if it has lost nothing and is no garbled form of another word itself."""
    words = scratch.put(_words(df, text_col))
    table = _form_table(words)
    tokens = _tokens(df, id_col, text_col).join(table, "h")
    tokens = scratch.put(tokens)
    judged = scratch.put(_judged(tokens.select("id", "h", "size"), tokens.select("h", "chains").distinct()))
    wanted = tokens.join(judged.select("id"), "id", "left_semi").select("h", "chains", "own").distinct()
    clear = F.lit(~_MUTUAL).cast("bigint")
    allowed = F.when(F.col("n") >= CLEANER * F.col("own"), F.col("made")).otherwise(F.col("made").bitwiseAND(clear))
    met = scratch.put(_source_table(words).join(wanted, "h").select("h", F.col("chains").bitwiseAND(allowed).alias("chains"), "word", "self").filter("chains != 0"))
    # Every run of a document is a word, so a word that is a garbled form is among the runs that met the table.
    clean = met.filter(~F.contains("word", F.lit("\ufffd"))).join(met.select(F.col("h").alias("self")).distinct(), "self", "left_anti")
    each = clean.select("h", "word", F.explode(F.sequence(F.lit(0), F.lit(len(CHAINS) - 1))).alias("chain"), "chains").filter("(shiftright(chains, chain) & 1) = 1")
    single = each.groupBy("h", "chain").agg(F.min("word").alias("word"), F.max("word").alias("last")).filter("word = last")
    originals = single.groupBy("h").agg(F.collect_list(F.struct("h", "chain", "word")).alias("originals"))
    found = tokens.select("id", "h").distinct().join(originals, "h").groupBy("id").agg(F.flatten(F.collect_list("originals")).alias("originals"))
    return judged.join(found, "id", "left").select("id", "chains", "originals")


def choose(originals: list[tuple[int, int, str]]) -> dict[int, tuple[str, list[int]]]:
    """The word of each hash, and its chains, of (h, chain, word); words that differ by chain go to the chain with the most runs."""
    weight = Counter(k for _, k, _ in originals)
    by: dict[int, dict[str, list[int]]] = {}
    for h, k, w in originals:
        by.setdefault(h, {}).setdefault(w, []).append(k)
    chosen = {}
    for h, words in by.items():
        ranked = sorted(((max(weight[k] for k in ks), w) for w, ks in words.items()), reverse=True)
        if len(ranked) == 1 or ranked[0][0] > ranked[1][0]:
            chosen[h] = ranked[0][1], words[ranked[0][1]]
    return chosen


def restore_text(text: str, chains: int, originals: list[tuple[int, int, str]] = ()) -> str:
    """``text`` with all runs put right: by their original (h, chain, word) where one is known and gives the run again,
    else by what one of the chains (as bits) leads back from, longest spans first."""
    own = [c for k, c in enumerate(CHAINS) if chains >> k & 1 and c != _LOSES]
    own.sort(key=len, reverse=True)
    chosen = choose(originals)

    def original(run: str) -> str | None:
        word, ks = chosen.get(_hash(run), (None, ()))
        return word if any(garble(word, CHAINS[k]) == run for k in ks) else None

    def known(span: str) -> str | None:
        """``span`` with each run replaced; None if one has no original."""
        words = [original(r) for r in _RUN.findall(span)]
        return None if None in words else _RUN.sub(lambda _, w=iter(words): next(w), span)

    def back(span: str) -> str | None:
        for c in own:
            if (u := ungarble(span, c)) is not None and u != span:
                return u
        return None

    def line(t: str) -> str:
        if t.isascii():
            return t
        if (u := known(t) or back(t)) is not None:
            return u
        return _RUN.sub(lambda m: original(m.group()) or back(m.group()) or m.group(), t)

    return known(text) or back(text) or "\n".join(line(t) for t in text.split("\n"))


def restored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, changed): the affected documents, put right as far as words are known and their chains lead back."""
    scratch = Scratch(df.sparkSession)
    hits = scratch.put(_matches(df, id_col, text_col, scratch))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(hits, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(1).to_pylist()
            new = [restore_text(t, c, [(o["h"], o["chain"], o["word"]) for o in w or ()]) for t, c, w in zip(old, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array([o != n for o, n in zip(old, new)])], names=["id", "text", "changed"])

    return rows.mapInArrow(run, "id bigint, text string, changed boolean")

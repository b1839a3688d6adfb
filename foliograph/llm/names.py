"""Entities whose names are spellings of one real person, organisation, product or place.

Every spelling (name, alias, mention) is brought to a common form: small Latin letters without diacritics, Hangul
romanised, titles and legal forms dropped. Tokens that stand beside many different others (kinds of body, given names)
are told from the rare ones, which together are the core of the name. The common part is translated to one form
(nicknames, abbreviations, Hangul) by what stands beside it in other spellings of the same entity. A spelling is then
a key: core, common part, number.

Keys with the same common part and number are compared where their cores collide: MinHash over padded 3-grams in
``BANDS`` bands of ``ROWS``. Collision curve 1 - (1 - s**3)**24: 0.9998 at s = 0.7 (one edit in a name of usual length),
0.96 at 0.5 (two edits), 0.04 at the 0.12 that unrelated names have. Below ``SHORT`` letters one edit leaves too few 3-grams
for the curve; there cores meet exactly, under what is left with one letter taken out. Candidates are verified by the Monge-Elkan
similarity of their tokens (Jaro-Winkler inside) and by edits of the core: two from ten letters up, one from four, none below.
Star clustering takes keys by falling weight: a key joins its heaviest neighbour that is a centre. Keys of one entity
tie their clusters together.
A key without a full given name or kind counts only for entities that have nothing better, and only if a single
cluster of the core agrees with it.

Defined cases: null and blank spellings and those without a core say nothing; null aliases count as none; repeated
rows count once; an empty table gives no pairs; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.groups import connected_groups
from foliograph.sources.tables import Scratch

BANDS, ROWS, Q = 24, 3, 3
SIMILAR, EDITS = 0.88, 2
#: Cores of fewer letters meet by deletion neighbourhoods.
SHORT = 6
#: A token is common if it stands beside that many different tokens: at least, and as a share of the entities.
COMMON_LEAST, COMMON_SHARE = 6, 3e-4

#: Titles, legal forms and small words that tell nothing about identity.
TITLES = frozenset("dr mr ms mrs eng prof sir 박사 씨 님".split())
LEGAL = frozenset("gmbh inc ltd holdings llc corp주 주 주식회사".split())
SMALL = frozenset("of the for and de la".split())
#: Revised Romanisation of the initial, medial and final letters of a Hangul syllable.
_INITIAL = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
_MEDIAL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
_FINAL = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"[^\W_]+")


def romanise(word: str) -> str:
    out = []
    for c in word:
        i = ord(c) - 0xAC00
        out.append(_INITIAL[i // 588] + _MEDIAL[i % 588 // 28] + _FINAL[i % 28] if 0 <= i < 11172 else c)
    return "".join(out)


def tokens(spelling: str) -> list[str]:
    """Small letters without diacritics, cut at blanks, signs and inner capitals; Hangul stays."""
    s = _CAMEL.sub(" ", spelling)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return _TOKEN.findall(unicodedata.normalize("NFC", s).lower())


def is_hangul(token: str) -> bool:
    return any("가" <= c <= "힣" for c in token)


def parse(spelling: str, common: set[str]) -> tuple[str, str, str, bool] | None:
    """(core, common part, number, in Hangul) of a spelling; None if it has no core."""
    core, rest, number = [], [], []
    found = tokens(spelling)
    for t in found:
        if t in TITLES or t in LEGAL or t in SMALL:
            continue
        if t.isdigit():
            number.append(t.lstrip("0") or "0")
        elif t in common or len(t) == 1 and not is_hangul(t):
            rest.append(t)
        else:
            core.append(romanise(t))
    if not core:
        return None
    full = sorted(t for t in rest if len(t) > 1 or is_hangul(t))
    return "".join(core), " ".join(full or sorted(rest)), " ".join(number), any(map(is_hangul, found))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken) if t]
    m, turned = len(first), sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over both sides of each token's best inner similarity."""
    if not a or not b:
        return 0.0
    one = lambda x, y: sum(max(jaro_winkler(s, t) for t in y) for s in x) / len(x)
    return (one(a, b) + one(b, a)) / 2


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and turned neighbours between two strings, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(a: str, b: str) -> int:
    """Edits between two cores of one name."""
    n = min(len(a), len(b))
    return EDITS if n >= 10 else 1 if n >= 4 else 0


def grams(core: str) -> list[str]:
    padded = "#" * (Q - 1) + core + "#" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bands(cores: list[str], block: list[str] | None = None) -> np.ndarray:
    """A row of BANDS hashes for each core: each of ROWS minimum hashes of its padded q-grams, and of its block."""
    owner, hashes = [], []
    for i, c in enumerate(cores):
        g = {xxhash.xxh32_intdigest(x) for x in grams(c)}
        hashes += g
        owner += [i] * len(g)
    h = np.array(hashes, np.uint64)
    first = np.searchsorted(np.array(owner), np.arange(len(cores)))
    salt = np.array([xxhash.xxh64_intdigest(x) for x in block or [""] * len(cores)], np.uint64)
    out = np.empty((len(cores), BANDS), np.uint64)
    for i in range(BANDS):
        key = salt + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            k = np.uint64(i * ROWS + j + 1)
            key = _mix(key ^ np.minimum.reduceat(_mix(h * (k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) + k) >> np.uint64(20), first))
        out[:, i] = key
    return out.view(np.int64)


def spellings(entities: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """(id, s): the distinct spellings of every entity."""
    named = entities.select(F.col("id").cast("bigint").alias("id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    if mentions is not None:
        known = entities.select(F.col("id").cast("bigint").alias("id"))
        named = named.unionByName(mentions.select(F.col("entity_id").cast("bigint").alias("id"), F.col("span_text").alias("s")).join(known, "id", "left_semi"))
    return named.select("id", F.trim("s").alias("s")).filter("id IS NOT NULL AND length(s) > 1").distinct()


def _common_tokens(spelled: DataFrame, n: int) -> set[str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, str]] = set()
            for s in b.column(0).to_pylist():
                ts = [t for t in tokens(s) if not t.isdigit()]
                for t in ts:
                    if other := max((x for x in ts if x != t), key=len, default=""):
                        found.add((t, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["t", "o"])

    beside = spelled.select("s").mapInArrow(run, "t string, o string").distinct().groupBy("t").count()
    return set(beside.filter(F.col("count") >= max(COMMON_LEAST, n * COMMON_SHARE)).toArrow()["t"].to_pylist())


def _translation(parsed: DataFrame, n: int) -> DataFrame:
    """(rest, form): common parts and what stands for them, the Latin form most often beside the same Hangul one."""
    parts = parsed.filter("rest != '' AND NOT (length(rest) <= 3 AND rest RLIKE '^[a-z]( [a-z])*$')").select("id", "rest", "num", "hangul").distinct()
    latin, hangul = parts.filter("NOT hangul"), parts.filter("hangul").withColumnRenamed("rest", "other").drop("hangul")
    pairs = latin.join(hangul, ["id", "num"]).groupBy("rest", "other").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= max(2, n * 1e-5))
    back = pairs.groupBy("other").agg(F.max(F.struct("n", "rest")).alias("best")).select("other", F.col("best.rest").alias("form"))
    most = pairs.groupBy("rest").agg(F.max(F.struct("n", "other")).alias("best"), F.sum("n").alias("total")).filter(F.col("best.n") * 2 > F.col("total"))
    to = most.select("rest", F.col("best.other").alias("other")).join(back, "other").select("rest", "form")
    return to.unionByName(back.withColumnRenamed("other", "rest").join(to, "rest", "left_anti"))


def same_entities(entities: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(group_id, id): entities in groups of two and more; group_id is the smallest id of the group."""
    spark = entities.sparkSession
    scratch = Scratch(spark)
    spelled = scratch.put(spellings(entities, mentions))
    n = entities.count()
    common = spark.sparkContext.broadcast(_common_tokens(spelled, n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, *p) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (p := parse(s, common.value))]
            cols = list(zip(*got)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["id", "core", "rest", "num", "hangul"])

    parsed = scratch.put(spelled.mapInArrow(read, "id bigint, core string, rest string, num string, hangul boolean").distinct())
    words = scratch.put(_translation(parsed, n))
    form = F.coalesce("form", "rest")
    keyed = parsed.join(words, "rest", "left").select("id", "core", form.alias("rest"), "num", form.rlike("^([^가-힣 ]( [^가-힣 ])*)?$").alias("weak")).distinct()
    keyed = scratch.put(keyed.withColumn("key", F.xxhash64("core", "rest", "num")))
    keys = scratch.put(keyed.filter("NOT weak").groupBy("key").agg(F.first("core").alias("core"), F.first("rest").alias("rest"), F.first("num").alias("num"), F.count("*").alias("weight")))
    centre = scratch.put(_stars(keys, _similar(keys)))
    strong = keyed.filter("NOT weak").select("id", "key").join(centre, "key", "left").select("id", F.coalesce("centre", "key").alias("c")).distinct()
    weak = _weak(keyed, strong, keys, centre)
    member = scratch.put(strong.unionByName(weak).distinct())
    # The clusters of one entity belong together: link each to the entity's smallest.
    tied = member.withColumn("least", F.min("c").over(Window.partitionBy("id"))).filter("c != least").select(F.col("least").alias("left_id"), F.col("c").alias("right_id")).distinct()
    joined = connected_groups(tied)
    cluster = member.join(joined.withColumnRenamed("member_id", "c"), "c", "left").select("id", F.coalesce("group_id", "c").alias("g")).distinct()
    head = cluster.groupBy("g").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return scratch.put(cluster.join(head, "g").select("group_id", "id").distinct())


def _similar(keys: DataFrame) -> DataFrame:
    """(a, b, wa, wb): keys of one common part and number whose cores are the same but for a few letters."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, core, rest, num = (c.to_pylist() for c in b.columns)
            blocks = [f"{r}|{x}" for r, x in zip(rest, num)]
            kept = [i for i, c in enumerate(core) if len(c) >= SHORT]
            if kept:
                h = bands([core[i] for i in kept], [blocks[i] for i in kept])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.repeat(np.array([key[i] for i in kept], np.int64), BANDS))], names=["band", "key"])
            # One edit from a core of SHORT letters leads to one of SHORT - 1, so that length stands on both sides.
            left = [(xxhash.xxh64_intdigest(f"{x}|{blocks[i]}") - (1 << 63), key[i]) for i, c in enumerate(core) if len(c) <= SHORT for x in {c[:j] + c[j + 1 :] for j in range(len(c))} | {c}]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left], pa.int64()), pa.array([x[1] for x in left], pa.int64())], names=["band", "key"])

    # Both sides are the same exchange; what the check needs is fetched for the pairs that met.
    placed = keys.select("key", "core", "rest", "num").mapInArrow(place, "band bigint, key bigint")
    met = placed.toDF("band", "a").join(placed.toDF("band", "b"), "band").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    left = keys.select(F.col("key").alias("a"), F.col("core").alias("core_a"), "rest", F.col("weight").alias("wa"))
    right = keys.select(F.col("key").alias("b"), F.col("core").alias("core_b"), F.col("weight").alias("wb"))
    met = met.join(left, "a").join(right, "b").select("a", "b", "core_a", "core_b", "rest", "wa", "wb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y, r = (t.column(i).to_pylist() for i in (2, 3, 4))
            ok = [edits(p, q, most := allowed(p, q)) <= most and monge_elkan([p, *s.split()], [q, *s.split()]) >= SIMILAR for p, q, s in zip(x, y, r)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(5), t.column(6)], names=["a", "b", "wa", "wb"]).filter(pa.array(ok))

    return met.mapInArrow(verify, "a bigint, b bigint, wa bigint, wb bigint")


def _stars(keys: DataFrame, similar: DataFrame) -> DataFrame:
    """(key, centre) of the keys that join another: centres are heavier than all their neighbours, ties to the smaller key."""
    scratch = Scratch(keys.sparkSession)
    similar = scratch.put(similar)
    both = scratch.put(similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("wb").alias("wa"), F.col("wa").alias("wb"))))
    heavier = F.struct(F.col("wb").alias("w"), (-F.col("b")).alias("k"))
    top = both.groupBy("a", "wa").agg(F.max(heavier).alias("best")).select(F.col("a").alias("key"), F.col("best.k").alias("k"), (F.struct(F.col("wa").alias("w"), (-F.col("a")).alias("k")) > F.col("best")).alias("centre"))
    centres = top.filter("centre").select("key")
    joined = both.join(centres.withColumnRenamed("key", "b"), "b", "left_semi").groupBy("a").agg(F.max(heavier).alias("best")).select(F.col("a").alias("key"), (-F.col("best.k")).alias("centre"))
    # A key none of whose neighbours is a centre joins its heaviest neighbour's star.
    rest = top.filter("NOT centre").join(joined, "key", "left_anti").select("key", (-F.col("k")).alias("via"))
    via = rest.join(joined.withColumnRenamed("key", "via"), "via", "left").select("key", F.coalesce("centre", "via").alias("centre"))
    return joined.join(centres, "key", "left_anti").unionByName(via)


def _weak(keyed: DataFrame, strong: DataFrame, keys: DataFrame, centre: DataFrame) -> DataFrame:
    """(id, c) of entities without a full key: the cluster of their core that alone agrees in number and initial."""
    lone = keyed.filter("weak").join(strong.select("id").distinct(), "id", "left_anti").select("id", "core", "rest", "num", F.substring("rest", 1, 1).alias("initial"))
    full = keys.join(centre, "key", "left").select(F.coalesce("centre", "key").alias("c"), "core", F.col("rest").alias("full"), "num")
    # One row for each core, number and initial ("" for all) before anything meets, so a common core costs no product.
    initials = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.split("full", " "), lambda t: F.substring(t, 1, 1))))
    each = full.select("core", "num", F.explode(initials).alias("initial"), "c").groupBy("core", "num", "initial").agg(F.min("c").alias("c"), F.max("c").alias("last"))
    met = lone.join(each.filter("c = last").drop("last"), ["core", "num", "initial"]).groupBy("id").agg(F.min("c").alias("c"), F.max("c").alias("last"))
    unsure = lone.join(each.filter("c != last").drop("c", "last"), ["core", "num", "initial"], "left_semi").select("id").distinct()
    found = met.filter("c = last").select("id", "c").join(unsure, "id", "left_anti")
    own = lone.join(found, "id", "left_anti").select("id", F.xxhash64("core", "rest", "num").alias("c"))
    return found.unionByName(own)


def pairs(groups: DataFrame) -> DataFrame:
    """(left_id, right_id): all pairs of each group, smaller id first."""
    a, b = groups.toDF("g", "left_id"), groups.toDF("g", "right_id")
    return a.join(b, "g").filter("left_id < right_id").select("left_id", "right_id").distinct()

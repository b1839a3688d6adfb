"""Text functions as column expressions; the two that Spark cannot express run as Arrow UDFs."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and line ends as Unicode has them.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Patterns that decide results.
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{ad}]"
DOT_LEADER = r"[.·•‥⋯…]{4,}"
SENTENCE_END = r"[.!?。:;)\]」』〉》다]['\"”’)]*" + WS + "*$"
PAGE_NUMBER = rf"(?i)^(?:[-–—•·]?{WS}*)?(?:page|p\.?|pg\.?)?{WS}*[0-9]{{1,4}}{WS}*(?:/{WS}*[0-9]{{1,4}})?{WS}*(?:쪽|페이지)?(?:{WS}*[-–—•·]?{WS}*)?$"
TOKEN = r"[가-힣]{2,}|[A-Za-z][A-Za-z\-]{1,}|[0-9]{4}"
DATE = r"(?:(?:19|20)[0-9]{2}[.\-/년]\s?(?:0?[1-9]|1[0-2])(?:[.\-/월]\s?(?:0?[1-9]|[12][0-9]|3[01])일?)?)|(?:(?:19|20)[0-9]{2}년)|(?:[0-9]\s?분기)"
DATE_LONGEST = r"(?:(?:19|20)[0-9]{2}[.\-/년]\s?(?:1[0-2]|0?[1-9])(?:[.\-/월]\s?(?:3[01]|[12][0-9]|0?[1-9])일?)?)|(?:(?:19|20)[0-9]{2}년)|(?:[0-9]\s?분기)"
METRIC = r"[0-9][0-9,.]*\s?(?:조|억|만|천)?\s?(?:원|달러|명|개|건|%|퍼센트|p|bp|배|시간|분|초|톤|kg|km|MW|GW|TB|GB)"
NAME_EDGE = "\"'()[]{}<>·,.:;"
# Particles in the order in which they are tried.
PARTICLES = (
    "으로부터 에서부터 이라는 라는 에서는 으로는 으로써 으로서 에게서 에서 에게 께서 부터 까지 으로 이나 이며 하고 "
    "와의 과의 들의 들은 들을 들이 은 는 이 가 을 를 의 에 와 과 도 만 로 요"
).split()
# Words that carry no topic.
STOP_WORDS = (
    "있다 있는 있으며 있습니다 한다 하는 하며 합니다 했다 된다 되는 됩니다 되어 대한 대해 위한 위해 통해 따라 경우 그리고 하지만 또한 또는 등의 "
    "이러한 그러한 것이 것은 것을 것으로 수있다 같은 같이 때문 관련 기타 이상 이하 미만 초과 각각 모든 해당 다음 아래 위의 내용 사항 부분 정도 "
    "우리 여기 저기 지금 오늘 "
    "the and for with that this from are was were has have had not but can will its all use using used may one two three per etc into than then when "
    "where which while also each such these those more most some any other about over under page pages http https www com org figure table fig vol no pp"
).split()


def strip(c: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def clean(c: Column) -> Column:
    """Runs of blanks to one, three and more line ends to two, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def control_ratio(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(0.0)).otherwise(F.regexp_count(s, F.lit(CONTROL)) / F.length(s))


def looks_garbled(c: Column, limit: float = 0.02) -> Column:
    return control_ratio(c) > limit


def drop_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def close_hyphens(c: Column) -> Column:
    """Joins English words cut at a line end; looks around, so that neighbours may share a letter."""
    return F.regexp_replace(c, "(?<=[A-Za-z])-\\n(?=[a-z])", "")


def drop_dot_leaders(c: Column) -> Column:
    return F.regexp_replace(c, DOT_LEADER, " ")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function. ASCII passes as it is."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


# Fixed value: three and more single letters or digits set apart.
_SPACED = re.compile(r"(?<!\w)(?:[A-Za-z0-9] ){2,}[A-Za-z0-9](?!\w)")


@F.pandas_udf(StringType())
def close_tracking(s: pd.Series) -> pd.Series:
    """Joins three and more single letters or digits that stand apart."""
    return s.map(lambda t: None if t is None else _SPACED.sub(lambda m: m[0].replace(" ", ""), t))


def normal_page(c: Column, native: bool = True) -> Column:
    """The whole normalisation of a page; letters set apart only in native text."""
    out = drop_dot_leaders(close_hyphens(drop_invisible(nfkc(c))))
    return close_tracking(out) if native else out


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def join_wrapped(c: Column) -> Column:
    """Lines of a paragraph joined by a blank, or by a line end where the text so far ends a sentence."""

    def fold(buf: Column, s: Column) -> Column:
        return F.when(buf == "", s).when(buf.rlike(SENTENCE_END), F.concat(buf, F.lit("\n"), s)).otherwise(F.concat(buf, F.lit(" "), s))

    def paragraph(p: Column) -> Column:
        return F.aggregate(F.filter(F.transform(lines(p), strip), lambda s: s != ""), F.lit("").cast("string"), fold)

    return F.array_join(F.filter(F.transform(F.split(c, "\\n\\n"), paragraph), lambda p: p != ""), "\n\n")


def is_page_number(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (F.length(s) <= 20) & s.rlike(PAGE_NUMBER)


def running_key(line: Column) -> Column:
    """A line as running headers are compared: trimmed, small letters, numbers as one sign."""
    return F.regexp_replace(F.lower(strip(line)), r"\p{Nd}+", "#")


def summary_sentences(c: Column, least: int = 20, most: int = 300) -> Column:
    """Sentences for summaries: white space collapsed, cut after . ! ? 。 and 다, of a length between the bounds."""
    flat = strip(F.regexp_replace(c, f"{WS}+", " "))
    cut = F.split(F.regexp_replace(flat, "([.!?。다]) +", "$1\u001f"), "\u001f")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s).between(least, most))


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def normal_token(t: Column) -> Column:
    """Small letters; of a Korean word the first particle in order goes, if two letters stay.

    Hangul has no case, and a token that starts with it is nothing else, so only other tokens are lowered.
    """
    out = F.when(~((t >= "가") & (t < chr(0xD7A4))), F.lower(t))
    # Neighbours of one length are one branch, as at most one of them fits: a branch for each makes code too long to be compiled.
    for k, some in itertools.groupby(PARTICLES, len):
        out = out.when((F.length(t) >= k + 2) & F.substring(t, -k, k).isin(*some), F.substring(t, F.lit(1), F.length(t) - k))
    return out.otherwise(t)


def tokens(c: Column) -> Column:
    """Normal tokens of two and more letters that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.transform(raw_tokens(c), normal_token), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def snippet(c: Column, most: int = 200) -> Column:
    flat = F.regexp_replace(c, "\\n", " ")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def normal_name(c: Column) -> Column:
    """White space collapsed, signs at the ends off."""
    edge = "[" + "".join(re.escape(x) for x in NAME_EDGE) + "]"
    return F.regexp_replace(strip(F.regexp_replace(c, f"{WS}+", " ")), f"^{edge}+|{edge}+$", "")


def normal_date(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, WS, ""), r"[.\-/]", "."), r"\.+$", "")


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"{WS}+", "")


def resolution_key(c: Column) -> Column:
    return F.replace(F.lower(normal_name(c)), F.lit(" "), F.lit(""))


def outline_title(c: Column) -> Column:
    return normal_name(F.regexp_replace(c, rf"^(?:[\p{{Nd}}.장절편부록]|{WS})+", ""))


def url_file_name(c: Column) -> Column:
    """The last part of a URL's path in small letters, without query and fragment; a slash at the end is left aside."""
    path = F.regexp_replace(F.regexp_extract(c, "^([^?#]*)", 1), "/+$", "")
    return F.lower(F.regexp_extract(path, "([^/]*)$", 1))


def dates(c: Column, most: int = 5, compat: bool = True) -> Column:
    """Up to ``most`` dates; ``compat`` tries short months and days first, as the stored graphs have them."""
    return F.slice(F.regexp_extract_all(c, F.lit(DATE if compat else DATE_LONGEST), F.lit(0)), 1, most)


def metrics(c: Column, most: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(METRIC), F.lit(0)), 1, most)

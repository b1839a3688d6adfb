"""Text and table functions on literals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliograph.functions import tables as C
from foliograph.functions import text as T
from foliograph.operators import chunks, pages


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.clean, " a  \t b\n\n\n\nc 　", "a b\n\nc"),
        (T.drop_invisible, "a​b﻿c­d", "abcd"),
        (T.close_hyphens, "infor-\nmation A-\nB a-\nb-\nc", "information A-\nB abc"),
        (T.drop_dot_leaders, "서론 ........ 5 … ...", "서론   5 … ..."),
        (T.nfkc, "ﬁｌｅ ①", "file 1"),
        (T.close_tracking, "A B C and a b, x 1 2 3", "ABC and a b, x123"),
        (T.join_wrapped, "한 줄\n두 줄이다\n셋\n\n  넷  \n\n\n", "한 줄 두 줄이다\n셋\n\n넷"),
        (T.normal_name, "  삼성   전자  ", "삼성 전자"),
        (T.normal_name, "(머신러닝)", "머신러닝"),
        (T.normal_name, '"인용구".', "인용구"),
        (T.normal_date, "2024-03-15", "2024.03.15"),
        (T.normal_date, "2024 / 03", "2024.03"),
        (T.match_key, "Machine  Learning", "machinelearning"),
        (T.resolution_key, " A B. ", "ab"),
        (T.outline_title, "1.2 장 배경", "배경"),
        (T.url_file_name, "http://x/y/Report.PDF?a=1#z", "report.pdf"),
        (T.url_file_name, "http://x/y/", "y"),
        (T.running_key, "  Report 12 / 34 ", "report # / #"),
        (T.normal_token, "학교에서", "학교"),
        (T.normal_token, "나는", "나는"),
        (T.normal_token, "Alpha", "alpha"),
        (T.clean, None, None),
        (T.snippet, "a\nb", "a b"),
    ],
)
def test_functions(spark, f, given, want):
    assert one(spark, f, given) == want


def test_normal_tokens_of_all_particles_in_few_branches(spark):
    def plain(t):
        if not "가" <= t[0] <= "힣":
            return t.lower()
        return next((t[: -len(p)] for p in T.PARTICLES if t.endswith(p) and len(t) >= len(p) + 2), t)

    words = [stem + p + q for stem in ("", "학", "학교", "라", "으로", "Ab") for p in ["", *T.PARTICLES] for q in ["", *T.PARTICLES]]
    words = [w for w in words if w]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "raw string")
    got = df.select(T.normal_token(F.col("raw")).alias("t"))
    assert [r.t for r in got.collect()] == [plain(w) for w in words] + [None]
    assert got._jdf.queryExecution().analyzed().toString().count("WHEN") < 10  # 39 made code that Java doesn't compile


def test_snippet_and_garbled(spark):
    assert one(spark, T.snippet, "x" * 201) == "x" * 200 + "…"
    assert one(spark, T.looks_garbled, "abc" * 10 + "\x01") and not one(spark, T.looks_garbled, "abc" * 50 + "\x01") and not one(spark, T.looks_garbled, "  ")


@pytest.mark.parametrize("line, is_number", [("12", True), ("- 12 -", True), ("Page 3 / 10", True), ("p.12", True), ("12쪽", True), ("2024", True), ("12345", False), ("12 people", False), ("", False)])
def test_page_numbers(spark, line, is_number):
    assert one(spark, T.is_page_number, line) is is_number


def test_dates_and_metrics(spark):
    assert one(spark, T.dates, "보고서는 2024년 3월에 발표되었다.") == ["2024년 3"]  # a month is closed only before a day
    assert one(spark, lambda c: T.dates(c, 5, True), "2024-12-31") == ["2024-1"] and one(spark, lambda c: T.dates(c, 5, False), "2024-12-31") == ["2024-12-31"]
    assert one(spark, T.metrics, "매출은 3조원, 성장률은 12% 였다.") == ["3조원", "12%"]
    assert len(one(spark, T.dates, " ".join(f"{y}년" for y in range(2000, 2030)))) == 5


def test_tokens_and_sentences(spark):
    assert one(spark, T.tokens, "The 보고서는 있다 a 2024 well-known 가") == ["보고서", "2024", "well-known"]
    assert one(spark, T.summary_sentences, "짧다. This sentence is long enough. 이 문장은 스무 글자가 넘는 문장이다 끝") == ["This sentence is long enough.", "이 문장은 스무 글자가 넘는 문장이다"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("x" * 500, ["x" * 500]),
        ("short", []),
        ("one paragraph", ["one paragraph"]),
        ("a" * 200 + "\n\n" + "b" * 200 + "\n\n" + "c" * 200, ["a" * 200 + "\n" + "b" * 200, "c" * 200]),
        ("a" * 300 + ". " + "b" * 300 + ".\n\n" + "c" * 100, ["a" * 300 + ".", "b" * 300 + ".\n" + "c" * 100]),
        ("head line\n\n" + "a" * 300 + ". " + "b" * 250, ["a" * 300 + ".", "b" * 250]),  # the heading is too short to stay
        ("".join(map(str, range(10))) * 95, ["0123456789" * 50, "0123456789" * 50]),
        ("x" * 501, ["x" * 500, "x" * 51]),
        ("x" * 951, ["x" * 500, "x" * 500, "x" * 51]),
    ],
)
def test_chunks(given, want):
    assert chunks.pack(given) == want


def test_chunks_keep_the_rules():
    rng = random.Random(5)
    for _ in range(300):
        parts = [" ".join("".join(rng.choices("abcdef", k=rng.choice([3, 30, 300, 499, 500, 501, 560, 950, 1200]))) + rng.choice([".", "", "!"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        text = "\n\n".join(parts)
        got = chunks.pack(text)
        assert all(10 <= len(c) <= 500 for c in got)
        # Nothing is lost but chunks below ten letters, and nothing but slices of long sentences stands twice.
        letters = lambda t: re.sub(r"\s", "", t)
        assert sum(len(letters(c)) for c in got) >= len(letters(text)) - 10 * text.count(" ") - 10
        at = 0
        for c in got:
            found = letters(text).find(letters(c), max(0, at - 60))
            assert found >= 0
            at = found + len(letters(c))


def test_running_lines(spark):
    def doc(i, n):
        return [(i, p, f"Report {p}\nbody {i}-{p} alpha\nmore {'x' * p}\nend\n{p}") for p in range(1, n + 1)]

    rows = doc(1, 2) + doc(2, 3) + doc(3, 11)
    df = spark.createDataFrame(rows, "document_id bigint, page_number int, text string")
    r = pages.running_lines(df)
    got = {(x.document_id, x.line_key) for x in r.collect()}
    assert not any(d == 1 for d, _ in got) and (2, "report #") in got and (3, "report #") in got
    text = {(x.document_id, x.page_number): x.text for x in pages.without_running_lines(df, r).collect()}
    assert text[1, 1].startswith("Report 1") and not text[1, 1].endswith("1\n1") and "Report" not in text[2, 1]


CELLS = "array<array<string>>"


def test_tables(spark):
    raw = [["2024", None, "2025"], ["매출", "이익"], ["A", "1", None]]
    assert one(spark, C.filled, raw, CELLS) == [["2024", "2024", "2025"], ["매출", "이익", "이익"], ["A", "1", "1"]]
    filled = one(spark, C.filled, raw, CELLS)
    assert one(spark, C.header_rows, filled, CELLS) == 2
    merged = one(spark, lambda c: C.one_header(c, F.lit(2)), filled, CELLS)
    assert merged == [["2024 매출", "2024 이익", "2025 이익"], ["A", "1", "1"]]
    assert one(spark, C.as_text, merged, CELLS) == "2024 매출 | 2024 이익 | 2025 이익\n2024 매출: A, 2024 이익: 1, 2025 이익: 1"
    assert one(spark, C.is_meaningful, merged, CELLS) and not one(spark, C.is_meaningful, [["a", "b"]], CELLS)
    assert one(spark, C.header_rows, [["a", "a"], ["1", "2"], ["x", "y"]], CELLS) == 1
    df = spark.createDataFrame([(1, raw), (2, [["", ""], ["", "a"]])], f"id int, cells {CELLS}")
    assert [r.id for r in C.processed(df).collect()] == [1]

"""Tokens, pieces, packing, sentences, garbled text: small cases against brute force and exact round trips."""

import os
import random
import unicodedata

import pytest
import tiktoken

from foliograph.llm import mojibake, packing, pieces, sentences, tokenize

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenize.DEFAULT_VOCABULARY), reason="no vocabulary files")
ODD = ["", " ", "a", "don't  stop\n\n", "가나다 라마", "é ﬁ 👩‍🔬", "x" * 3000, "1234 5,678.90", "　全角　", "<|endoftext|>", "\x00\x01", " lead", "ab" * 700 + " 가" * 300]


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


@needs_vocabulary
def test_merges_equal_another_encoder():
    ranks = tokenize.load_ranks(tokenize.DEFAULT_VOCABULARY)
    other = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cd가é1.\n'") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    e = tokenize.Encoder(tokenize.DEFAULT_VOCABULARY)
    assert [e.encode(t) for t in texts] == [other.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_encode_covers_every_row(spark):
    rows = [(1, "hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "hello world", 5)]
    out = tokenize.encode(documents(spark, rows, ", ids int")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(list(r.ids))
    assert by[2] == [[]] and by[3] == [[], []] and by[1] == by[None] and len(by[1][0]) == 2
    assert tokenize.encode(documents(spark, [])).count() == 0


def test_pieces_cover_the_text_and_keep_the_limits():
    rng = random.Random(2)
    alphabet = "ab  \n.。!가́"
    texts = ["x" * 1700, " " * 900, "A b. " * 300, "# H\n" + "word " * 200 + "\n\n- a\n- b\n" * 30] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(501, 2500))) for _ in range(60)]
    for t in texts:
        cut = pieces.cut(t)
        assert len(cut) > 1 and "".join(t[m:e] for _, m, e in cut) == t
        assert all(e - s <= 500 and 0 <= m - s <= 50 for s, m, e in cut)
    assert pieces.cut("short") == [(0, 0, 5)] and pieces.cut("") == [(0, 0, 0)]
    at = pieces.cut("One sentence here. " * 40)
    assert all(("One sentence here. " * 40)[m - 2] == "." for _, m, _ in at[1:])


def test_pieces_number_on_through_a_page(spark):
    rows = [(1, 7, 1, 0, "a" * 600, 9), (2, 7, 1, 1, "b", 9), (3, 7, 1, 2, None, 9), (4, 7, 2, 0, "", 9), (5, 7, 1, 0, "c", 9)]
    out = pieces.pieces(spark.createDataFrame(rows, "id bigint, document_id bigint, page_number int, chunk_index int, content string, piece int")).collect()
    assert [(r.chunk_id, r.piece_index) for r in sorted(out, key=lambda r: (r.page_number, r.piece_index))] == [(1, 0), (1, 1), (5, 2), (2, 3), (4, 0)]


def first_fit_decreasing(sizes, capacity):
    """Containers that the plain greedy rule needs; whole windows of oversized items count on their own."""
    rooms, whole = [], 0
    for s in sorted((s % capacity for s in sizes), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    for s in sizes:
        whole += s // capacity
    return len(rooms) + whole


@needs_vocabulary
def test_containers_hold_every_token_once(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 900)))) for i in range(150)] + [(900, None), (901, ""), (902, "z y " * 4000)]
    df = documents(spark, rows)
    n = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df).collect()}
    out = packing.containers(df).collect()
    fill, got = {}, {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        got.setdefault(r.id, []).append((r.start_token, r.n_tokens))
    assert max(fill.values()) <= packing.CAPACITY and set(got) == {i for i, k in n.items() if k}
    for i, parts in got.items():
        parts.sort()
        assert sum(k for _, k in parts) == n[i] and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
        assert len(parts) == 1 or n[i] > packing.CAPACITY
    assert len(fill) <= 1.02 * first_fit_decreasing(n.values(), packing.CAPACITY)
    assert packing.containers(documents(spark, [])).count() == 0


def test_index_ranks_like_plain_bm25():
    import math

    import numpy as np

    docs = [[1, 1, 2], [2, 3], [3, 3, 4], [1, 5, 5], [6], [7], [8], [9], [10, 11]]
    terms = [np.unique(np.array(x, np.int32)) for x in docs]
    counts = [np.array([x.count(t) for t in u], np.uint8) for x, u in zip(docs, terms)]
    index = packing.Index(terms, counts)
    n, mean = len(docs), sum(map(len, docs)) / len(docs)

    def score(seed, i):
        s = 0.0
        for t in set(docs[seed]):
            df = sum(t in x for x in docs)
            tf = docs[i].count(t)
            if tf and df * 4 <= max(n, 8):
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        return s

    for seed in range(n):
        assert np.allclose(index.scores(seed), [score(seed, i) for i in range(n)])


ENGLISH = ["The first annex was closed in March.", "Dr. Miller measured 4.5 m of pipe.", "“Is it done? Nobody knows,” said Ann before noon.", "See Fig. 3 and Sec. 2.4 for the plan.", "The visit ended at 5 p.m.", "Costs rose by 3.1 percent because nobody came!"]


def test_sentences_are_trimmed_and_in_order():
    rng = random.Random(4)
    texts = ["\n\n".join(" ".join(rng.choices(ENGLISH, k=4)) for _ in range(3)) for _ in range(300)]
    model = sentences.fit(texts)
    right = total = 0
    for t in texts[:100]:
        got = {t[s:e] for s, e in sentences.split(t, model)}
        want = [x for p in t.split("\n\n") for x in [s for s in ENGLISH if s in p]]
        right += sum(x in got for x in want)
        total += len(want)
    assert right / total > 0.95
    got = sentences.split("Title\n\n- one. two\n- three\n\n調査票が足りない。もう一度「比較した。本当に。」と述べた。終わり", model)
    assert len(got) == 6 and all(s < e for s, e in got)
    assert sentences.split(" \n ", model) == []


def test_sentences_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "no mark"), (4, "no mark")], "id bigint, content string")
    assert sorted(map(tuple, sentences.sentences(df).collect())) == [(4, 0, 7), (4, 0, 7)]
    assert sentences.sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize("chain", [c for c in mojibake.CHAINS if c != ("1cp1252", "utf-8")][:5])
def test_garbling_is_undone(chain):
    for word in ("résumé", "가브리엘", "“naïve”", "調査票"):
        form = mojibake.garble(word, chain)
        assert form != word and mojibake.ungarble(form, chain) == word


def test_garbled_documents_are_found_and_restored(spark):
    clean = [(i, f"Der Prüfplan für {w} wurde geändert. 보고서를 측정했다 “ok” – café") for i, w in enumerate(["Übung", "Maß", "Öl"])]
    bad = clean[0][1].encode().decode("cp1251")
    half = "Der Plan wurde geändert, " + "보고서를 측정했다".encode().decode("latin-1")
    rows = [*clean, (10, bad), (11, half), (12, None), (13, ""), (14, "plain"), (15, "Symbols: Ã, Â, ã. SÃO Âge Þessi"), (16, "gekürzt".encode("cp1252").decode("utf-8", "replace"))]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(17, "gekürzt", "x")], "doc_id bigint, text string, id string")
    got = {r.id: r for r in mojibake.restored(df).collect()}
    assert set(got) == {10, 11, 16}
    assert got[10].text == clean[0][1] and got[11].text == "Der Plan wurde geändert, 보고서를 측정했다" and not got[16].changed
    assert mojibake.affected(df.limit(0)).count() == 0


def test_lost_bytes_come_back_from_the_only_original(spark):
    lost = "전환의".encode().decode("cp949", "replace")
    assert "\ufffd" in lost and mojibake.ungarble(lost, ("utf-8", "cp949")) is None
    twins = [chr(c) * 2 for c in (0xFC, 0xE9)]  # both lose all their bytes: no only original
    rows = [(1, "디지털 전환의 시대"), (2, f"plan {lost} end\n{lost}"), (3, " ".join(twins)), (4, "a " + twins[0].encode("cp1252").decode("utf-8", "replace")), (5, f"시대 {lost}")]
    got = {r.id: r for r in mojibake.restored(documents(spark, rows)).collect()}
    assert set(got) == {2, 4, 5}
    assert got[2].text == "plan 전환의 end\n전환의" and got[5].text == "시대 전환의" and not got[4].changed


def test_forms_of_han_and_hangul_alone(spark):
    ko = "보고서를 측정했다 그리고 위원회가 승인했다 전시를 확대했다"
    zh = "数据处理 的 检查表 由 委员会 批准"
    rows = [(i, ko + f" {i}") for i in range(4)] + [(10 + i, zh + f" {i}") for i in range(4)]
    rows += [(20, ko.encode("cp949").decode("gbk")), (21, zh.encode("gbk").decode("cp949", "replace")), (22, "a " + "数据处理".encode().decode("gbk") + " b")]
    rows += [(30, "数据"), (31, "측정했다 보고서를"), (32, "茅"), (33, None)]
    assert "\ufffd" not in rows[-5][1] and all("一" <= c <= "鿿" for c in rows[8][1] if c > "z")
    got = {r.id: r for r in mojibake.restored(documents(spark, rows)).collect()}
    assert set(got) == {20, 21, 22}
    assert got[20].text == ko and got[22].text == "a 数据处理 b"
    once = {r.id for r in mojibake.affected(documents(spark, [*rows, *rows])).collect()}
    assert once == {20, 21, 22}


def test_the_index_fills_first():
    from collections import Counter

    import numpy as np

    rng = random.Random(9)
    topics = [[rng.randrange(1 << 20) for _ in range(60)] for _ in range(20)]
    items = [rng.choices(topics[i % 20], k=30) for i in range(600)]
    terms = [np.unique(np.array(x, np.int32)) for x in items]
    counts = [np.array([x.count(t) for t in u], np.uint8) for x, u in zip(items, terms)]
    sizes = np.array([rng.randint(50, 900) for _ in items], np.int64)
    by = Counter()
    filled = packing.fill(sizes, terms, counts, 2048, by)
    assert sorted(i for c in filled for i in c) == list(range(600)) and all(sizes[c].sum() <= 2048 for c in filled)
    assert by["index"] > by["size"] and len(filled) <= 1.02 * first_fit_decreasing(sizes.tolist(), 2048)
    same = np.mean([i % 20 == c[0] % 20 for c in filled for i in c[1:]])
    assert same > 0.4


def test_hot_signatures_are_cut(spark):
    rows = [(i, "same words here again") for i in range(60)]
    out = packing.containers(documents(spark, rows), capacity=16, shard=10).collect()
    assert len(out) == 60 and len({r.container_id for r in out}) >= 15
    assert len({r.container_id.split("-")[0] for r in out}) > 1
    assert {(r.container_id, r.id) for r in out} == {(r.container_id, r.id) for r in packing.containers(documents(spark, rows).repartition(3), capacity=16, shard=10).collect()}


def test_cuts_never_split_a_character():
    thai, hindi = "กำหนดที่เก็บน้ำ" * 90, "क्षत्रिय्ाँकि" * 120
    for t in (thai, hindi, "e\u0301" * 700, "👨‍👩‍👧" * 300):
        for s, m, e in pieces.cut(t)[1:]:
            for at in (s, m):
                assert unicodedata.category(t[at])[0] != "M" and t[at] != "ำ" and t[at - 1] not in "เแโใไ" and t[at] != "\u200d"
    one = "a" + "\u0301" * 1200
    assert all(e - s <= 500 for s, _, e in pieces.cut(one)) and "".join(one[m:e] for _, m, e in pieces.cut(one)) == one


def test_cuts_follow_headings_and_lists():
    text = "# One\n" + "alpha beta. " * 20 + "\n## Inner\n" + "gamma delta. " * 12 + "\n# Two\n" + "epsilon. " * 25
    starts = [m for _, m, _ in pieces.cut(text, 500, 0)]
    assert text.index("# Two") in starts and text.index("## Inner") - 1 <= starts[1] <= text.index("# Two")
    tree = pieces.children(text, pieces.Node(0, len(text)))
    assert [text[n.start : n.start + 5] for n in tree] == ["# One", "# Two"] and len(tree[0].children) == 2
    items = "".join(f"- item {i} {'x' * 60}\n" + "".join(f"  - sub {j} {'y' * 40}\n" for j in range(3)) for i in range(8))
    cuts = [m for _, m, _ in pieces.cut(items, 450, 0)]
    assert all(items.startswith("- item", m) for m in cuts)
    deep = "".join("#" * (1 + i % 6) + f" h{i}\nshort text\n" for i in range(5000))
    assert "".join(deep[m:e] for _, m, e in pieces.cut(deep)) == deep


def test_rows_without_a_page_are_their_own(spark):
    rows = [(1, None, 1, 0, "a" * 600), (2, None, 1, 1, "b"), (3, 7, None, 0, "c"), (4, 7, None, 0, "d"), (5, 8, 1, 0, "e"), (5, 8, 1, 0, "e")]
    out = pieces.pieces(spark.createDataFrame(rows, "id bigint, document_id bigint, page_number int, chunk_index int, content string")).collect()
    assert sorted((r.chunk_id, r.piece_index) for r in out) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (5, 0)]


def test_every_mark_is_the_classifiers_to_decide():
    text = "今日は晴れ。明日は雨。 We saw art. The museum closed."
    none, all_ = sentences.Model({"b": -1.0}, {}, {}), sentences.Model({"b": 1.0}, {}, {})
    assert [text[a:b] for a, b in sentences.split(text, none)] == [text]
    assert [text[a:b] for a, b in sentences.split(text, all_)] == ["今日は晴れ。", "明日は雨。", "We saw art.", "The museum closed."]
    fitted = sentences.fit([])  # nothing to learn from: the prior decides
    assert len(sentences.split("今日は晴れ。明日は雨。", fitted)) == 2 and len(sentences.split("Dr. Smith came.", fitted)) == 1


def test_long_tokens_are_seen_whole():
    seen = [p for _, p, *_ in sentences.candidates("x" * 70 + "end. Next one.", 0, 85)]
    assert seen[0] == "x" * 70 + "end"

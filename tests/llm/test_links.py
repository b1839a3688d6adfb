"""Names, groups, near-duplicates, neighbours, scans: small cases against brute force."""

import random
import tracemalloc

import numpy as np

from foliograph.llm import groups, names, neardup, neighbours, scans


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {(root(x), x) for x in up}


def test_groups_equal_union_find(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    star = [(5000, 5000 + i) for i in range(1, 120)]
    some = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(150)]
    pairs = chain + star + some + [(b, a) for a, b in chain[:20]] + chain[:5] + [(7, 7)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(None, 3, "x"), (4, None, "x")], "left_id bigint, right_id bigint, v string")
    got = set(map(tuple, groups.connected_groups(df).collect()))
    assert got == union_find([(a, b) for a, b in pairs if a != b])
    assert set(map(tuple, groups.connected_groups(df, max_steps=1).collect())) == got
    assert groups.connected_groups(df.limit(0)).count() == 0


def test_inner_measures():
    assert names.jaro_winkler("martha", "marhta") > 0.96 and names.jaro_winkler("a", "") == 0
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abc", "xyz", 2) == 3
    assert names.monge_elkan(["paper", "mills"], ["mills", "paper"]) == 1
    assert names.romanise("컁갼룩단") == "kyanggyanrukdan"
    cores = ["kyanggyanrukdan", "kyanggyanurkdan"]
    a, b = names.bands(cores)
    assert set(a) & set(b) and (names.bands(cores[::-1])[1] == a).all()
    assert not set(a) & set(names.bands(cores[:1], ["other block"])[0])


def entity_tables(spark):
    rng = random.Random(2)
    syllables = "kyang gyan ruk dan myo kun nwil peo swik rae tam cheol bwim jeol".split()
    ends = ["Viewer", "Harbour", "Turbine"]
    rows, mentions, i = [], [], 0
    for k in range(60):
        core = "".join(rng.sample(syllables, 4))
        i += 1
        rows.append((i, f"{core.title()} {ends[k % 3]}", "x", None))
        mentions.append((i, f"{ends[k % 3]} {core.title()}"))
    given = ["Gabriel", "Thomas", "Victoria"]
    for k in range(60):
        core = "".join(rng.sample(syllables, 4))
        i += 1
        rows.append((i, f"{given[k % 3]} {core.title()}", "Person", []))
    n = len(rows)
    first, person = rows[0][1].split()[0], rows[60][1].split()[1]
    rows += [(n + 1, f"Viewer, {first.upper()}", None, ["n/a", None]), (n + 2, f"{first[:3]}x{first[3:]} Viewer", None, None), (n + 3, f"{first} Harbour", None, None), (n + 4, f"{first} Viewer 2", None, None)]
    rows += [(n + 5, f"Dr. Gabriel Q. {person}", None, None), (n + 6, f"Thomas {person}", None, None), (n + 7, f"G. {person}", None, [f"Gabriel {person}"]), (n + 8, "  ", None, None)]
    e = spark.createDataFrame(rows, "id bigint, name string, entity_type string, aliases array<string>")
    m = spark.createDataFrame(mentions + [(None, "x"), (999, "ghost"), (1, None)], "entity_id bigint, span_text string")
    return e, m, n


def test_names_link_spellings_and_keep_namesakes_apart(spark):
    e, m, n = entity_tables(spark)
    got = set(map(tuple, names.pairs(names.same_entities(e, m)).collect()))
    want = {(1, n + 1), (1, n + 2), (n + 1, n + 2), (61, n + 5), (61, n + 7), (n + 5, n + 7)}
    assert got == want
    assert names.same_entities(e.limit(0), m).count() == 0


def test_cores_of_every_length_meet(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnoprstuvwz"
    rows, want = [], {}
    for n in range(1, 14):
        for i in range(40):
            core = "".join(rng.choices(letters, k=n))
            at = rng.randrange(n)
            other = rng.choice([core[:at] + "y" + core[at + 1 :], core[:at] + "y" + core[at:], core[:at] + core[at + 1 :]])
            key = 2 * (n * 100 + i)
            rows += [(key, core, f"r{key}", "", 1), (key + 1, other, f"r{key}", "", 1)]
            want[key] = n, min(len(core), len(other)) >= 4 and names.edits(core, other, 1) == 1
    keys = spark.createDataFrame(rows, "key bigint, core string, rest string, num string, weight bigint")
    got = {r.a for r in names._similar(keys).collect()}
    assert all(link or key not in got for key, (_, link) in want.items())
    recall = {n: np.mean([key in got for key, (m, link) in want.items() if m == n and link] or [1]) for n in range(1, 14)}
    # A single edit at a core's edge in few letters may fall under the similarity, never under the meeting.
    assert all(recall[n] >= (0.9 if n >= 6 else 0.75) for n in recall), recall


def test_short_names_have_keys():
    assert names.parse("Anna Li", {"anna"})[:3] == ("li", "anna", "") and names.parse("Ng Wei", {"wei"})[:3] == ("ng", "wei", "")
    assert names.parse("Dr.", set()) is None and names.parse("", set()) is None
    assert names.allowed("abc", "abd") == 0 and names.allowed("meier", "meyer") == 1 and names.allowed("a" * 10, "a" * 11) == 2


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij가나다라", k=rng.randint(3, 9))) for _ in range(500)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    texts = list(base)
    for t in base[:25]:
        w = t.split()
        for share in (0.03, 0.08, 0.15):
            x = [rng.choice(words) if rng.random() < share else y for y in w]
            texts.append(" ".join(x))
    texts += [base[0], base[0].upper() + "\n", "short", " " * 300, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id bigint, content string, rep int")
    full = [(i, neardup.normal(t)) for i, t in rows if t and len(t) >= 240]
    want = {(i, j) for i, a in full for j, b in full if i < j and neardup.jaccard(a, b) >= 0.6}
    got = set(map(tuple, neardup.expanded_pairs(*neardup.alike(df)).collect()))
    assert got <= want and len(got) >= 0.985 * len(want)
    assert (0, len(base) + 75) in got
    assert neardup.expanded_pairs(*neardup.alike(df.limit(0))).count() == 0


def _sketch_pair(rng, similarity):
    """Two texts of about the given 5-gram similarity and their exact one."""
    base = [chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400)]
    other = list(base)
    while (s := neardup.jaccard("".join(base), "".join(other))) > similarity:
        other[rng.randrange(400)] = chr(rng.randint(0x4E00, 0x9FFF))
    return "".join(base), "".join(other), s


def test_recall_near_the_threshold():
    rng = random.Random(11)
    pairs = [x for x in (_sketch_pair(rng, rng.uniform(0.605, 0.655)) for _ in range(600)) if x[2] >= 0.6]
    a, b = (neardup.vectors([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
    assert neardup.within_budget(a, b).mean() >= 0.985


def test_budgets_hold_for_every_prefix():
    a = np.zeros((1, neardup.SEGMENTS), np.int64)
    b = a.copy()
    b[0, :7] = (1 << 60) - 1  # 35 symbols differ, chains start behind them
    assert neardup.within_budget(a, b, 36).all()
    assert not neardup.within_budget(a, b, 34).any()
    b[:] = 0b11  # one symbol differs in each segment
    assert neardup.within_budget(a, b, 12).all() and not neardup.within_budget(a, b, 11).any()
    b[:] = 1 | 1 << 12  # two differ everywhere: no chain starts
    assert not neardup.within_budget(a, b, 36).any()


def test_meetings_pair_runs_and_pass_long_ones_on():
    key, ids = np.array([1, 2, 2, 2, 3, 3, 4, 4, 4, 4]), np.array([9, 1, 2, 5, 7, 7, 1, 2, 3, 4])
    a, b, rest = neardup.meetings(key, ids, 3)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (1, 5), (2, 5)] and rest.tolist() == [6, 7, 8, 9]


def test_crowded_keys_and_texts_of_little_variety(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=320))
    texts = [base[:k] + "#%d#" % k + base[k:] for k in range(20, 300, 10)] + ["-" * 300, "-" * 310, "ab" * 150, "ab" * 160, "0" * 250]
    full = [(i, neardup.normal(t)) for i, t in enumerate(texts)]
    want = {(i, j) for i, a in full for j, b in full if i < j and neardup.jaccard(a, b) >= 0.6}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, content string")
    got = {heavy: set(map(tuple, neardup.expanded_pairs(*neardup.alike(df, heavy=heavy)).collect())) for heavy in (3, 256)}
    assert got[3] == got[256] == want


def test_neighbours_meet_the_recall(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 64))
    x = np.repeat(centre, 30, axis=0) + 0.5 * rng.normal(size=(1200, 64))
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[0][1]) for i in range(9)] + [(3000, [0.0] * 64), (3001, None), (3002, [1.0])]
    df = spark.createDataFrame(rows, "faiss_id bigint, vec array<float>")
    near = {}
    for r in neighbours.nearest(df, list_size=60).collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    ids = np.array([i for i, v in rows if v and len(v) == 64 and any(v)])
    m = np.array([v for _, v in rows if v and len(v) == 64 and any(v)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    recall = np.mean([len(near.get(i, set()) & set(ids[b].tolist())) / 5 for i, b in zip(ids, best)])
    assert recall >= 0.9 and not {3000, 3001, 3002} & set(near)
    assert near[2008] == {0, 2000, 2001, 2002, 2003}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_large_lists_are_cut_without_loss(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(3, 64)), 120, axis=0) + rng.normal(size=(360, 64)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "faiss_id bigint, vec array<float>")
    whole, cut = (set(map(tuple, neighbours.nearest(df, list_size=120, block=b).select("id", "neighbour").collect())) for b in (10_000, 25))
    assert whole == cut and len(whole) == 5 * 360


def test_lists_grow_with_the_vectors():
    assert neighbours.probes(115, 7, 0) == neighbours.probes(100_000, 7, 0) == 7
    assert neighbours.probes(100) == 14 and neighbours.probes(1_000) == 28
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9_000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.fit_lists(x, 2_200)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    assert abs(len(c) - 2_200) < 60 and sizes.max() < 8 * sizes.mean()


def test_the_graph_of_many_centroids_holds_little_at_once():
    x = np.random.default_rng(7).normal(size=(6_000, 16)).astype(np.float32)
    tracemalloc.start()
    g = neighbours.CentroidGraph(x)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 100 and g.links.base is None  # the slices of whole orders held 8 bytes for each pair
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert all(set(g.links[i]) == set(np.argsort(-s[i])[:20]) for i in range(0, 6_000, 97))


def test_scan_noise_kinds(spark):
    body = ["The quarterly committee measured the northern warehouse in detail.", "Nobody expected the preliminary results to arrive before winter.", "The department stored each printed catalogue and receipt."]
    rows, i = [], 0
    for doc in range(30):
        for page in range(1, 4):
            i += 1
            rows.append((i, doc, page, "\n".join([f"Annual Report {doc * 0 + 2019} · Archive of Records", *body, f"- {page} -"])))
    n = i
    rows += [(n + 1, 90, 1, "The quarterly com-\nmittee measured the northern warehouse."), (n + 2, 90, 2, "The quarter1y cornmittee measured the northern warehouse."), (n + 3, 90, 3, "\n".join(body)), (n + 4, 91, 1, None), (n + 5, None, None, ""), (n + 6, 92, 1, "Nobody at the E-\nwarehouse of Kyang-\nRuk expected it.")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id bigint, document_id bigint, page_number int, content string, noise string")
    got = {}
    for r in scans.noise(df).collect():
        got.setdefault(r.chunk_id, set()).add(r.noise)
    assert all(got[k] == {"running_line", "page_number"} for k in range(1, n + 1))
    assert got[n + 1] == {"broken_word"} and got[n + 2] == {"misread"} and not {n + 3, n + 4, n + 5, n + 6} & set(got)
    text = {r.chunk_id: r.text for r in scans.paragraphs(df).collect()}
    assert text[n + 1] == "The quarterly committee measured the northern warehouse."
    assert text[n + 2] == "The quarterly committee measured the northern warehouse."
    assert "Annual" not in text[1] and "- 1 -" not in text[1]
    assert scans.noise(df.limit(0)).count() == 0


def _fixed(spark, counts):
    return {r.w: r.u for r in scans.corrections(spark.createDataFrame(list(counts.items()), "w string, n bigint")).collect()}


def test_misreading_is_a_ratio_at_every_size(spark):
    counts = {"rnarks": 40, "marks": 480, "plain": 9_000, "cat": 30, "eat": 359, "sornehow": 0, "somehow": 12, "rnice": 1, "mice": 11, "x" * 300 + "rn": 1, "123": 1}
    for times in (1, 100, 10_000):
        grown = {w: n * times for w, n in counts.items()}
        want = {"rnarks": "marks", "sornehow": "somehow"}
        assert _fixed(spark, grown) == want
    assert _fixed(spark, {"rnarks": 40, "marks": 479}) == {}
    assert scans.reassemble("the rnarks are plain", ["body"], {"rnarks": "marks"}, set()) == ["the marks are plain"]


def test_flags_stay_when_rows_recur(spark):
    line = "The committee stored the printed remarks of the northern warehouse"
    rows = [(i, i, 1, f"{line} number {i}.") for i in range(40)] + [(50, 50, 1, line.replace("remarks", "rernarks") + "."), (51, 51, 1, line.replace("printed", "prin-\nted") + "."), (52, 52, 1, "A well-\nknown well-known well-known fact.")]
    want = {(50, "misread"), (51, "broken_word")}
    for times in (1, 100):
        df = spark.createDataFrame([(i + 1000 * k, d + 1000 * k, p, t) for k in range(times) for i, d, p, t in rows], "id bigint, document_id bigint, page_number int, content string")
        assert {(r.chunk_id % 1000, r.noise) for r in scans.noise(df).collect()} == want


def test_long_running_lines(spark):
    head = "Proceedings of the Regional Commission for Inland Waterways and Reservoir Maintenance · Volume Fourteen of Records"
    assert len(head) > 109
    rows = [(10 * d + p, d, p, f"{head}\nSome text of its own stands here {d * 17 + p}.\nAnd more of it follows below.") for d in range(1, 6) for p in range(1, 4)]
    df = spark.createDataFrame(rows, "id bigint, document_id bigint, page_number int, content string")
    assert {(r.chunk_id, r.noise) for r in scans.noise(df).collect()} == {(r[0], "running_line") for r in rows}

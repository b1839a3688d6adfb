"""Queries over text functions, with the SQL that states them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import chunks as chunking
from foliograph.operators import pages as paging
from foliograph.plans.registry import query
from foliograph.sources.tables import table

# SQL side of the patterns; the same text, as both engines read it.
WS, CONTROL, LEADER, INVISIBLE = T.WS, T.CONTROL, T.DOT_LEADER, T.INVISIBLE
_q = lambda s: s.replace("'", "''")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL"


@query("txt_01", "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 12) AS file_key FROM documents")
def txt_01(spark, d):
    h = T.content_hash(F.col("text"))
    return _docs(spark, d).select("doc_id", h.alias("content_hash"), F.left(h, F.lit(12)).alias("file_key"))


SQL_CLEAN = f"SELECT doc_id, {sql_strip('''regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')} AS cleaned FROM documents"


@query("txt_02", SQL_CLEAN)
def txt_02(spark, d):
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(
    "txt_03",
    f"WITH s AS (SELECT doc_id, {sql_strip('text')} AS s FROM documents WHERE text IS NOT NULL) "
    f"SELECT doc_id, round(CASE WHEN s = '' THEN 0.0 ELSE (length(s) - length(regexp_replace(s, '{CONTROL}', '', 'g'))) / length(s)::DOUBLE END, 6) AS ratio, "
    f"CASE WHEN s = '' THEN false ELSE (length(s) - length(regexp_replace(s, '{CONTROL}', '', 'g'))) / length(s)::DOUBLE > 0.02 END AS garbled FROM s",
)
def txt_03(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.round(T.control_ratio(F.col("text")), 6).alias("ratio"), T.looks_garbled(F.col("text")).alias("garbled"))


@query("txt_04")
def txt_04(spark, d):
    return _docs(spark, d).select("doc_id", T.close_tracking(F.col("text")).alias("text"))


def sql_nfkc() -> str:
    """Compatibility composition in SQL: each character by its own form from a table made by rule, the whole then composed.

    The forms of single characters are canonically equivalent to those of the text, so composing them at the end is enough.
    """
    forms = [(c, unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKC", chr(c)) != unicodedata.normalize("NFC", chr(c))]
    rows = ", ".join(f"({c}, '{f.replace(chr(39), chr(39) * 2)}')" for c, f in forms)
    return f"""WITH forms(c, f) AS (VALUES {rows}), chars AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS x, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM documents),
done AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(f, x), '' ORDER BY i)) AS text FROM chars LEFT JOIN forms ON c = ord(x) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text = '' THEN '' ELSE done.text END AS text FROM documents d LEFT JOIN done USING (doc_id)"""


@query("txt_05", sql_nfkc())
def txt_05(spark, d):
    return _docs(spark, d).select("doc_id", T.nfkc(F.col("text")).alias("text"))


@query("txt_06", f"SELECT doc_id, regexp_replace(text, '{INVISIBLE}', '', 'g') AS text FROM documents")
def txt_06(spark, d):
    return _docs(spark, d).select("doc_id", T.drop_invisible(F.col("text")).alias("text"))


@query("txt_07", r"SELECT doc_id, regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS text FROM documents")
def txt_07(spark, d):
    return _docs(spark, d).select("doc_id", T.close_hyphens(F.col("text")).alias("text"))


@query("txt_08", f"SELECT doc_id, regexp_replace(text, '{LEADER}', ' ', 'g') AS text FROM documents")
def txt_08(spark, d):
    return _docs(spark, d).select("doc_id", T.drop_dot_leaders(F.col("text")).alias("text"))


_END = _q(T.SENTENCE_END)


@query(
    "txt_09",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k, list_filter(list_transform(regexp_split_to_array(p, '{T.LINE_END}'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM p),
j AS (SELECT doc_id, k, list_reduce(l, lambda b, s: CASE WHEN b = '' THEN s WHEN regexp_matches(b, '{_END}') THEN b || chr(10) || s ELSE b || ' ' || s END, '') AS t FROM l)
SELECT d.doc_id, coalesce(string_agg(j.t, chr(10) || chr(10) ORDER BY k) FILTER (j.t <> ''), '') AS text FROM documents d JOIN j USING (doc_id) GROUP BY d.doc_id""",
)
def txt_09(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.join_wrapped(F.col("text")).alias("text"))


_PN = _q(T.PAGE_NUMBER)


@query("txt_10", f"WITH l AS ({SQL_LINES}), s AS (SELECT doc_id, line_no, {sql_strip('line')} AS line FROM l) SELECT doc_id, line_no, line FROM s WHERE line <> '' AND length(line) <= 20 AND regexp_matches(line, '{_PN}')")
def txt_10(spark, d):
    return _lines(spark, d).filter(T.is_page_number(F.col("line"))).select("doc_id", "line_no", T.strip(F.col("line")).alias("line"))


@query("txt_11", f"WITH l AS ({SQL_LINES}) SELECT regexp_replace(lower({sql_strip('line')}), '\\p{{Nd}}+', '#', 'g') AS line_key, count(*) AS n FROM l GROUP BY 1")
def txt_11(spark, d):
    return _lines(spark, d).groupBy(T.running_key(F.col("line")).alias("line_key")).agg(F.count("*").alias("n"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages put together from their chunks (document_id, page_number, text)."""
    rows = table(spark, d, "text_chunks").filter("content IS NOT NULL").groupBy("document_id", "page_number")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))), lambda s: s["content"]), "\n").alias("text"))


SQL_PAGES = "SELECT document_id, page_number, string_agg(content, chr(10) ORDER BY chunk_index, id) AS text FROM text_chunks WHERE content IS NOT NULL GROUP BY ALL"
SQL_RUNNING = f"""pages AS ({SQL_PAGES}),
said AS (SELECT document_id, page_number, list_filter(list_transform(regexp_split_to_array(text, '{T.LINE_END}'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS s FROM pages),
edge AS (SELECT document_id, list_distinct(list_transform(list_filter(list_concat(s[1:3], s[greatest(len(s) - 2, 1):]), lambda x: length(x) <= 80), lambda x: regexp_replace(lower(x), '\\p{{Nd}}+', '#', 'g'))) AS keys FROM said),
n AS (SELECT document_id, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3),
counted AS (SELECT document_id, line_key, count(*) AS n_pages FROM (SELECT document_id, unnest(keys) AS line_key FROM edge) GROUP BY ALL),
running AS (SELECT c.* FROM counted c JOIN n USING (document_id) WHERE n_pages >= greatest(3, floor(n * 0.3)))"""


@query("agg_06", f"WITH {SQL_RUNNING} SELECT document_id, line_key, n_pages FROM running")
def agg_06(spark, d):
    return paging.running_lines(pages(spark, d))


@query(
    "txt_12",
    f"""WITH {SQL_RUNNING},
l AS (SELECT document_id, page_number, unnest(regexp_split_to_array(text, '{T.LINE_END}')) AS line, generate_subscripts(regexp_split_to_array(text, '{T.LINE_END}'), 1) AS i FROM pages),
k AS (SELECT *, {sql_strip('line')} AS s FROM l),
keep AS (SELECT * FROM k WHERE NOT (s <> '' AND length(s) <= 20 AND regexp_matches(s, '{_PN}')) AND NOT EXISTS (SELECT 1 FROM running r WHERE r.document_id = k.document_id AND r.line_key = regexp_replace(lower(s), '\\p{{Nd}}+', '#', 'g')))
SELECT document_id, page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM keep GROUP BY ALL""",
)
def txt_12(spark, d):
    p = pages(spark, d)
    return paging.without_running_lines(p, paging.running_lines(p))


@query("txt_13")
def txt_13(spark, d):
    return chunking.chunked(_docs(spark, d).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"))


SQL_SENTENCES = f"""WITH s AS (SELECT doc_id, string_split(regexp_replace({sql_strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")}, '([.!?。다]) +', '\\1' || chr(31), 'g'), chr(31)) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {sql_strip('x')}), lambda x: length(x) BETWEEN 20 AND 300) AS f FROM s)
SELECT doc_id, unnest(f) AS sentence, generate_subscripts(f, 1) - 1 AS seq FROM f"""


@query("txt_14", SQL_SENTENCES)
def txt_14(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.summary_sentences(F.col("text"))).alias("seq", "sentence"))


SQL_RAW = f"SELECT doc_id, unnest(regexp_extract_all(text, '{T.TOKEN}')) AS raw FROM documents WHERE text IS NOT NULL"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SQL_NORMAL = f"""CASE WHEN regexp_matches(lower(raw), '^[가-힣]') THEN left(lower(raw), length(raw) - coalesce(length(list_filter({_LIST(T.PARTICLES)}, lambda j: suffix(lower(raw), j) AND length(raw) - length(j) >= 2)[1]), 0)) ELSE lower(raw) END"""
_STOP = ", ".join(f"'{x}'" for x in T.STOP_WORDS)
#: Terms by document with their count and first place, as a list of common table expressions.
SQL_TERMS = f"""raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.TOKEN}')) AS raw, generate_subscripts(regexp_extract_all(text, '{T.TOKEN}'), 1) AS place FROM documents WHERE text IS NOT NULL),
normal AS (SELECT doc_id, place, {SQL_NORMAL} AS term FROM raw),
kept AS (SELECT * FROM normal WHERE length(term) >= 2 AND term NOT IN ({_STOP})),
counts AS (SELECT doc_id, term, count(*) AS n, min(place) AS place FROM kept GROUP BY ALL)"""


@query("txt_15", f"SELECT doc_id, raw AS token, count(*) AS n FROM ({SQL_RAW}) GROUP BY ALL")
def txt_15(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.raw_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("txt_16", f"SELECT DISTINCT raw AS token, {SQL_NORMAL} AS term FROM ({SQL_RAW})")
def txt_16(spark, d):
    return _docs(spark, d).select(F.explode(T.raw_tokens(F.col("text"))).alias("token")).distinct().select("token", T.normal_token(F.col("token")).alias("term"))


@query("txt_17", f"WITH {SQL_TERMS} SELECT doc_id, term, n FROM counts")
def txt_17(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("txt_18", "SELECT id, CASE WHEN length(content) <= 200 THEN replace(content, chr(10), ' ') ELSE left(replace(content, chr(10), ' '), 200) || '…' END AS snippet FROM text_chunks WHERE content IS NOT NULL")
def txt_18(spark, d):
    return table(spark, d, "text_chunks").filter("content IS NOT NULL").select("id", T.snippet(F.col("content")).alias("snippet"))


_EDGE = _q(r"""["'()\[\]{}<>·,.:;]""")
sql_name = lambda x: f"regexp_replace({sql_strip(f'''regexp_replace({x}, '{WS}+', ' ', 'g')''')}, '^{_EDGE}+|{_EDGE}+$', '', 'g')"


@query("txt_19", f"SELECT id, {sql_name('span_text')} AS name FROM entity_mentions")
def txt_19(spark, d):
    return table(spark, d, "entity_mentions").select("id", T.normal_name(F.col("span_text")).alias("name"))


_DATE = T.DATE


@query("txt_20", f"SELECT id, m AS found, regexp_replace(regexp_replace(regexp_replace(m, '{WS}', '', 'g'), '[.\\-/]', '.', 'g'), '\\.+$', '') AS date FROM (SELECT id, unnest(regexp_extract_all(content, '{_DATE}')) AS m FROM text_chunks)")
def txt_20(spark, d):
    found = table(spark, d, "text_chunks").select("id", F.explode(F.regexp_extract_all("content", F.lit(T.DATE), F.lit(0))).alias("found"))
    return found.select("id", "found", T.normal_date(F.col("found")).alias("date"))


@query("txt_21", f"SELECT id, regexp_replace(lower(name), '{WS}+', '', 'g') AS key FROM entities")
def txt_21(spark, d):
    return table(spark, d, "entities").select("id", T.match_key(F.col("name")).alias("key"))


@query("txt_22", f"SELECT id, replace(lower({sql_name('name')}), ' ', '') AS key FROM entities")
def txt_22(spark, d):
    return table(spark, d, "entities").select("id", T.resolution_key(F.col("name")).alias("key"))


_TITLE = "^(?:[\\p{Nd}.장절편부록]|" + WS + ")+"


@query("txt_23", f"WITH l AS ({SQL_LINES}) SELECT doc_id, line_no, {sql_name(f'''regexp_replace(line, '{_TITLE}', '')''')} AS title FROM l WHERE regexp_matches(line, '^ *[0-9]+[.]')")
def txt_23(spark, d):
    return _lines(spark, d).filter(F.col("line").rlike("^ *[0-9]+[.]")).select("doc_id", "line_no", T.outline_title(F.col("line")).alias("title"))


URL = r"https?://[A-Za-z0-9./_?#=&%-]+"


@query("txt_24", f"SELECT doc_id, url, lower(regexp_extract(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1)) AS file FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{URL}')) AS url FROM documents)")
def txt_24(spark, d):
    urls = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(URL), F.lit(0))).alias("url"))
    return urls.select("doc_id", "url", T.url_file_name(F.col("url")).alias("file"))


@query("txt_25", "SELECT id, '[' || kind || '] ' || image_path AS rendered FROM images")
def txt_25(spark, d):
    return table(spark, d, "images").select("id", F.concat(F.lit("["), "kind", F.lit("] "), "image_path").alias("rendered"))


@query("flt_03", f"WITH l AS ({SQL_LINES}) SELECT doc_id, line_no, '목차: ' || line AS rendered FROM l WHERE regexp_matches(line, '^ *[0-9]+[.]') AND length(line) >= 4")
def flt_03(spark, d):
    return _lines(spark, d).filter(F.col("line").rlike("^ *[0-9]+[.]") & (F.length("line") >= 4)).select("doc_id", "line_no", F.concat(F.lit("목차: "), "line").alias("rendered"))


@query("src_04", "SELECT doc_id, k, v FROM (SELECT doc_id, unnest(map_keys(metadata)) AS k, unnest(map_values(metadata)) AS v FROM documents) WHERE v <> ''")
def src_04(spark, d):
    kept = F.map_filter("metadata", lambda k, v: v != "")
    return table(spark, d, "documents").select("doc_id", F.explode(kept).alias("k", "v"))


@query("jsn_01", "SELECT id, len(coalesce(aliases, [])) AS n, array_to_string(list_sort(list_distinct(coalesce(aliases, []))), '|') AS aliases FROM entities")
def jsn_01(spark, d):
    """Aliases to JSON and back; what is no JSON list counts as an empty one."""
    text = F.to_json("aliases")
    back = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "entities").select("id", F.size(back).alias("n"), F.array_join(F.array_sort(F.array_distinct(back)), "|").alias("aliases"))

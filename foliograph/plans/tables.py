"""Queries over cell matrices. The test data has none, so order lines are laid out as tables with merged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import tables as C
from foliograph.plans.registry import query
from foliograph.sources.tables import table

#: A table for each order: two header rows, then a row a line; a ship flag as on the line before is a merged cell.
SQL_RAW = """lines AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k2, l_suppkey AS k3, l_extendedprice AS k4, [CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN NULL ELSE l_returnflag END, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE ' ' || l_linestatus || ' ' END, l_partkey::VARCHAR, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey::VARCHAR END] AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
raw AS (SELECT id, list_concat([['Line', NULL, 'Keys', 'Keys'], ['Flag', 'Status', 'Part', 'Supplier', 'More']], list(CASE WHEN n % 3 = 0 THEN r[1:3] ELSE r END ORDER BY n, k2, k3, k4)) AS cells FROM lines GROUP BY id),
wide AS (SELECT id, list_transform(cells, lambda r: list_resize(r, list_max(list_transform(cells, lambda x: len(x))), NULL)) AS cells FROM raw),
cell AS (SELECT id, r, c, v FROM (SELECT id, unnest(cells) AS row, generate_subscripts(cells, 1) AS r FROM wide), LATERAL (SELECT unnest(row) AS v, generate_subscripts(row, 1) AS c)),
across AS (SELECT id, r, c, last_value(v IGNORE NULLS) OVER (PARTITION BY id, r ORDER BY c) AS v FROM cell),
down AS (SELECT id, r, c, trim(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id, c ORDER BY r), '')) AS v FROM across)"""


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    flag = F.when(F.lag("l_returnflag").over(w) == F.col("l_returnflag"), None).otherwise(F.col("l_returnflag"))
    status = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit(" "), "l_linestatus", F.lit(" ")))
    supplier = F.when(F.col("l_suppkey") % 5 == 0, None).otherwise(F.col("l_suppkey").cast("string"))
    row = F.array(flag, status, F.col("l_partkey").cast("string"), supplier)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), row.alias("r"), "l_partkey", "l_suppkey", "l_extendedprice")
    short = F.when(F.col("n") % 3 == 0, F.slice("r", 1, 3)).otherwise(F.col("r"))
    head = F.array(F.array(F.lit("Line"), F.lit(None).cast("string"), F.lit("Keys"), F.lit("Keys")), F.array(*map(F.lit, ("Flag", "Status", "Part", "Supplier", "More"))))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n", "l_partkey", "l_suppkey", "l_extendedprice", short.alias("r")))), lambda s: s["r"])
    return lines.groupBy("id").agg(F.concat(head, body).alias("cells"))


def _flat(c):
    """Cells as one string: rows by /, cells by |."""
    return F.array_join(F.transform(c, lambda r: F.array_join(r, "|", "~")), "/")


@query("arr_01", f"WITH {SQL_RAW} SELECT id, array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda x: coalesce(x, '~')), '|')), '/') AS cells FROM wide")
def arr_01(spark, d):
    return raw_tables(spark, d).select("id", _flat(C.padded(F.col("cells"))).alias("cells"))


SQL_FILLED = f"{SQL_RAW}, filled AS (SELECT id, list(row ORDER BY r) AS cells FROM (SELECT id, r, list(v ORDER BY c) AS row FROM down GROUP BY id, r) GROUP BY id)"


@query("arr_02", f"WITH {SQL_FILLED} SELECT id, array_to_string(list_transform(cells, lambda r: array_to_string(r, '|')), '/') AS cells FROM filled")
def arr_02(spark, d):
    return raw_tables(spark, d).select("id", _flat(C.filled(F.col("cells"))).alias("cells"))


@query("win_02", f"WITH {SQL_RAW} SELECT id, r - 1 AS r, c - 1 AS c, v FROM down")
def win_02(spark, d):
    """The same fill by windows over exploded cells."""
    from pyspark.sql import Window

    cells = raw_tables(spark, d).select("id", C.padded(F.col("cells")).alias("cells")).select("id", F.posexplode("cells").alias("r", "row")).select("id", "r", F.posexplode("row").alias("c", "v"))
    over = lambda *p: Window.partitionBy("id", p[0]).orderBy(p[1]).rowsBetween(Window.unboundedPreceding, 0)
    across = cells.withColumn("v", F.last("v", True).over(over("r", "c")))
    return across.withColumn("v", F.trim(F.coalesce(F.last("v", True).over(over("c", "r")), F.lit(""))))


_HEAD = """CASE WHEN len(cells) >= 3 AND len(list_distinct(list_filter(cells[1], lambda x: x <> ''))) < len(list_filter(cells[1], lambda x: x <> ''))
AND len(list_filter(cells[2], lambda x: x <> '')) >= greatest(1, len(cells[2]) // 2) AND NOT len(list_filter(cells[2], lambda x: regexp_matches(x, '^[0-9,.%\\-+~ ]+$'))) > len(cells[2]) // 2 THEN 2 ELSE 1 END"""


@query("arr_03", f"WITH {SQL_FILLED} SELECT id, {_HEAD} AS header_rows FROM filled")
def arr_03(spark, d):
    return raw_tables(spark, d).select("id", C.filled(F.col("cells")).alias("cells")).select("id", C.header_rows(F.col("cells")).alias("header_rows"))


SQL_ONE = f"""{SQL_FILLED}, one AS (SELECT id, CASE WHEN {_HEAD} = 2 AND len(cells) > 2 THEN list_concat([list_transform(list_zip(cells[1], cells[2]), lambda p: CASE WHEN p[1] = p[2] OR p[2] = '' THEN p[1] WHEN p[1] = '' THEN p[2] ELSE p[1] || ' ' || p[2] END)], cells[3:]) ELSE cells END AS cells FROM filled)"""


def _one(spark, d):
    t = raw_tables(spark, d).select("id", C.filled(F.col("cells")).alias("cells")).withColumn("n", C.header_rows(F.col("cells")))
    return t.select("id", C.one_header(F.col("cells"), F.col("n")).alias("cells"))


@query("arr_04", f"WITH {SQL_ONE} SELECT id, array_to_string(cells[1], '|') AS header, len(cells) AS n_rows FROM one")
def arr_04(spark, d):
    t = _one(spark, d)
    return t.select("id", F.array_join(F.get("cells", F.lit(0)), "|").alias("header"), F.size("cells").alias("n_rows"))


_TEXT = """array_to_string(list_concat([array_to_string(list_filter(cells[1], lambda h: h <> ''), ' | ')], list_filter(list_transform(cells[2:], lambda r: array_to_string(list_filter(list_transform(list_zip(r, cells[1]), lambda p: CASE WHEN p[1] = '' THEN '' WHEN p[2] <> '' AND p[2] <> p[1] THEN p[2] || ': ' || p[1] ELSE p[1] END), lambda x: x <> ''), ', ')), lambda x: x <> '')), chr(10))"""


@query("arr_05", f"WITH {SQL_ONE} SELECT id, {_TEXT} AS text FROM one")
def arr_05(spark, d):
    t = _one(spark, d)
    return t.select("id", C.as_text(F.col("cells")).alias("text"))


@query("arr_06", f"WITH {SQL_FILLED} SELECT id, len(list_filter(flatten(cells), lambda x: x <> '')) >= 4 AND len(list_filter(flatten(cells), lambda x: x <> '')) * 4 >= len(flatten(cells)) AS meaningful FROM filled")
def arr_06(spark, d):
    return raw_tables(spark, d).select("id", C.is_meaningful(C.filled(F.col("cells"))).alias("meaningful"))


@query("arr_07", f"WITH {SQL_ONE} SELECT id, len(cells) AS n_rows, {_TEXT} AS text FROM one")
def arr_07(spark, d):
    return C.processed(raw_tables(spark, d)).select("id", F.size("cells").alias("n_rows"), "text")


@query("arr_08", f"WITH {SQL_FILLED} SELECT id, array_to_string(list_transform(cells[1:5], lambda r: array_to_string(r, '|')), '/') AS preview, len(cells) AS n_rows, list_max(list_transform(cells, lambda r: len(r))) AS n_cols FROM filled")
def arr_08(spark, d):
    t = raw_tables(spark, d).select("id", C.filled(F.col("cells")).alias("cells"))
    return t.select("id", _flat(C.preview(F.col("cells"), 5)).alias("preview"), F.size("cells").alias("n_rows"), C.columns(F.col("cells")).alias("n_cols"))

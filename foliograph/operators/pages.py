"""Running headers and footers of documents, and pages without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T


def running_lines(pages: DataFrame, share: float = 0.3, least: int = 3, edge: int = 3, longest: int = 80) -> DataFrame:
    """(document_id, line_key, n_pages): keys of the first and last lines of enough pages; none below three pages."""
    said = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda s: s != "")
    top, bottom = F.slice("said", 1, edge), F.when(F.size("said") <= edge, F.col("said")).otherwise(F.slice("said", -edge, edge))
    short = F.filter(F.concat(top, bottom), lambda s: F.length(s) <= longest)
    keys = pages.select("document_id", "page_number", said.alias("said")).select("document_id", F.explode(F.array_distinct(F.transform(short, T.running_key))).alias("line_key"))
    n = pages.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counted = keys.groupBy("document_id", "line_key").agg(F.count("*").alias("n_pages"))
    return counted.join(n, "document_id").filter(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))).select("document_id", "line_key", "n_pages")


def without_running_lines(pages: DataFrame, running: DataFrame) -> DataFrame:
    """(document_id, page_number, text): pages without page numbers and running lines; blank lines stay."""
    rows = pages.select("document_id", "page_number", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).withColumn("line_key", T.running_key(F.col("line")))
    kept = rows.filter(~T.is_page_number(F.col("line"))).join(running.select("document_id", "line_key"), ["document_id", "line_key"], "left_anti")
    grouped = kept.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("a"))
    return grouped.select("document_id", "page_number", F.array_join(F.transform("a", lambda s: s["line"]), "\n").alias("text"))

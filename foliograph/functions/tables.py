"""Cell matrices (array<array<string>>) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.text import strip

NUMERIC = r"^[0-9,.%\-+~ \t\n]+$"


def padded(cells: Column) -> Column:
    """Ragged rows filled with null to the widest row."""
    width = F.array_max(F.transform(cells, F.size))
    return F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r))))


def _carry(row: Column) -> Column:
    """Nulls of a row take the value to their left."""
    empty = F.array().cast("array<string>")
    return F.aggregate(row, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(x, F.get(acc, F.size(acc) - 1)))))


def filled(cells: Column) -> Column:
    """Merged cells: nulls take the value to the left, what is left the value above; then trimmed, null as ''."""
    rows = F.transform(padded(cells), _carry)
    none = F.array().cast("array<array<string>>")

    def down(acc: Column, row: Column) -> Column:
        above = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.when(F.size(acc) == 0, row).otherwise(F.zip_with(row, above, lambda x, y: F.coalesce(x, y)))))

    return F.transform(F.aggregate(rows, none, down), lambda r: F.transform(r, lambda x: F.coalesce(strip(x), F.lit(""))))


def header_rows(cells: Column) -> Column:
    """2 where the first row repeats a value and the second is filled with other than numbers; else 1."""
    top, second = F.get(cells, 0), F.get(cells, 1)
    said = F.filter(top, lambda x: x != "")
    half = F.floor(F.size(second) / 2)
    repeats = F.size(F.array_distinct(said)) < F.size(said)
    full = F.size(F.filter(second, lambda x: x != "")) >= F.greatest(F.lit(1), half)
    numbers = F.size(F.filter(second, lambda x: x.rlike(NUMERIC))) > half
    return F.when((F.size(cells) >= 3) & repeats & full & ~numbers, 2).otherwise(1)


def one_header(cells: Column, n: Column) -> Column:
    """Two header rows merged column by column, equal parts once."""
    both = F.zip_with(F.get(cells, 0), F.get(cells, 1), lambda a, b: F.array_join(F.array_distinct(F.filter(F.array(strip(a), strip(b)), lambda x: x != "")), " "))
    rest = F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0)))
    return F.when((n > 1) & (F.size(cells) > n), F.concat(F.array(both), rest)).otherwise(cells)


def as_text(cells: Column) -> Column:
    """'header: cell' lines below a line of headers."""
    head = F.transform(F.get(cells, 0), strip)
    title = F.array_join(F.filter(head, lambda x: x != ""), " | ")

    def line(row: Column) -> Column:
        named = F.transform(row, lambda x, i: F.when(strip(x) == "", F.lit("")).when((F.coalesce(F.get(head, i), F.lit("")) != "") & (F.get(head, i) != strip(x)), F.concat(F.get(head, i), F.lit(": "), strip(x))).otherwise(strip(x)))
        return F.array_join(F.filter(named, lambda x: x != ""), ", ")

    body = F.filter(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), line), lambda x: x != "")
    return F.when(F.size(cells) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(title), body), "\n"))


def is_meaningful(cells: Column, least_rows: int = 2) -> Column:
    flat = F.flatten(cells)
    said = F.size(F.filter(flat, lambda x: x != ""))
    return (F.size(cells) >= least_rows) & (F.size(flat) > 0) & (said >= 4) & (said * 4 >= F.size(flat))


def processed(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Tables filled, checked and with one header row, with their ``text``; those that say nothing drop out.

    Each step is a projection of its own, and no filter follows on what they compute, since it would be pushed down
    with a copy of every expression. Four cells that say something make a text, so none is blank.
    """
    out = df.withColumn(cells, filled(F.col(cells))).filter(is_meaningful(F.col(cells)))
    out = out.withColumn("_head", header_rows(F.col(cells))).withColumn(cells, one_header(F.col(cells), F.col("_head"))).drop("_head")
    return out.withColumn("text", as_text(F.col(cells)))


def preview(cells: Column, rows: int) -> Column:
    return F.slice(cells, 1, rows)


def columns(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))

"""Vectors (array<float>) as column expressions; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Brought to length 1; a zero vector stays one."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def centroids(rows: DataFrame, group: str, order: list[str], vec: str = "vec", most: int = 200) -> DataFrame:
    """(group, centroid): the unit mean of the first ``most`` vectors of each group; zero means are dropped."""
    first = rows.filter(F.col(vec).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= most)
    means = first.select(group, F.posexplode(vec).alias("_i", "_x")).groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_a")).select(group, F.transform("_a", lambda s: s["_m"]).alias("_v"))
    return whole.filter(norm(F.col("_v")) > 0).select(group, unit(F.col("_v")).alias("centroid"))

"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def by_hash(rows: DataFrame, size: int, id_col: str = "id", n: int | None = None) -> DataFrame:
    """``size`` rows, those of the smallest id hash; all rows if there are no more.

    Rows above a hash that about one and a half times as many stay below drop out where they are read, so what
    travels to the one task that cuts the sample off depends on its size, not on the number of partitions.
    """
    n = rows.count() if n is None else n
    h = F.pmod(F.xxhash64(id_col), F.lit(_SPAN))
    if n > 2 * size:
        rows = rows.filter(h < int(_SPAN * min(1.0, 1.5 * size / n + 100 / n)))
    return rows.orderBy(h, id_col).limit(size)

"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, items: Column | str, name: str, *columns: Column | str) -> DataFrame:
    """``(*columns, pos, name)`` for each item of an array that is costly to compute.

    The outer form plus a null filter: for the inner form the optimizer adds a size check on the array below the
    projections, and so computes it twice or more.
    """
    return df.select(*columns, F.posexplode_outer(items).alias("pos", name)).filter(F.col("pos").isNotNull())

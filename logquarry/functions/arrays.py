"""Explodes that compute their array once.

An inner explode lets the optimizer add a filter on the array's size, which runs the
array's expression again. For arrays from regexes that doubles the work; an outer
explode with the empty row dropped afterwards gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, array: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())

"""Correlations: Pearson, Spearman and Kendall, over all rows or per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.ranks import cumulative_counts, totals_before
from logquarry.session import cut_lineage


def pearson(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, x, y, r)`` for every pair of columns, in one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]
    )
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.x", "c.y", "c.r")


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``(keys, value, rank)``: ranks from 1, ties share their mean; ``weight`` counts equal rows."""
    c = cumulative_counts(df, value, weight, keys)
    return c.select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, rho)``. Ranks are looked up per distinct value, for cells of equal pairs."""
    cells = cut_lineage(df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n")))
    rx = average_ranks(cells, x, keys, "n").withColumnRenamed("rank", "rx")
    ry = average_ranks(cells, y, keys, "n").withColumnRenamed("rank", "ry")
    j = cells.join(rx, [*keys, x]).join(ry, [*keys, y])
    n = F.sum("n")
    s = lambda c: F.sum(F.col("n") * c)
    a, b = F.col("rx"), F.col("ry")
    return j.groupBy(*keys).agg(
        (
            (n * s(a * b) - s(a) * s(b))
            / F.sqrt((n * s(a * a) - s(a) * s(a)) * (n * s(b * b) - s(b) * s(b)))
        ).alias("rho")
    )


def spearman_pivot(df: DataFrame, x: str, y: str, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """Spearman per (row, column) with the columns side by side."""
    long = spearman(df, x, y, [row, column])
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first("rho"))


# A Chebyshev fit of log erfc, within 1.2e-7 of it in relative terms everywhere.
_ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277
)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, tails included."""
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.0)
    for c in reversed(_ERFC):
        poly = poly * t + c
    return t * F.exp(-z * z + poly)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b with its normal-approximation p-value, without forming pairs.

    Rows are counted per (x, y) first. Two different ``y`` ranks differ in a highest
    bit; among the cells that share the bits above it, those with a 0 lie below those
    with a 1. So per bit and shared prefix it is enough to count, in the order of
    ``x``, the zeros in front of each one and the ones in front of each zero.
    """
    cells = cut_lineage(
        df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    )
    rank_x = cut_lineage(
        cumulative_counts(cells, "x", "n").select(
            "x", F.col("below").alias("rx"), F.col("n").alias("tx")
        )
    )
    rank_y = cut_lineage(
        cumulative_counts(cells, "y", "n").select(
            "y", F.col("below").alias("ry"), F.col("n").alias("ty")
        )
    )
    placed = cells.join(rank_x, "x").join(rank_y, "y")
    total = cells.agg(F.sum("n")).first()[0] or 0
    # ranks are below the number of rows, so its bits tell them all apart
    bits = max(int(total).bit_length(), 1)
    levels = (
        placed.select("rx", "ry", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b"))
        .withColumn("prefix", F.expr("shiftright(ry, b + 1)"))
        .withColumn("one", F.expr("shiftright(ry, b) & 1"))
        .groupBy("b", "prefix", "rx")
        .agg(
            F.sum(F.when(F.col("one") == 0, F.col("n")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("one") == 1, F.col("n")).otherwise(0)).alias("ones"),
        )
    )
    # read twice: for the cut points of the ranges and for the rows
    counted = totals_before(cut_lineage(levels), ["b", "prefix"], "rx", {"zeros_before": "zeros", "ones_before": "ones"})
    order = counted.agg(
        F.sum((F.col("ones") * F.col("zeros_before")).cast("double")).alias("concordant"),
        F.sum((F.col("zeros") * F.col("ones_before")).cast("double")).alias("discordant"),
    )

    def ties(ranks: DataFrame, t: str, p: str) -> DataFrame:
        v = F.col(t).cast("double")
        return ranks.agg(
            F.sum(v * (v - 1)).alias(f"{p}2"),
            F.sum(v * (v - 1) * (v - 2)).alias(f"{p}3"),
            F.sum(v * (v - 1) * (2 * v + 5)).alias(f"{p}5"),
            F.sum(v).alias(f"{p}n"),
        )

    # three tables of one row each
    one = order.withColumn("k", F.lit(1)).join(ties(rank_x, "tx", "x").withColumn("k", F.lit(1)), "k").join(
        ties(rank_y, "ty", "y").withColumn("k", F.lit(1)), "k"
    )
    n = F.col("xn")
    s = F.col("concordant") - F.col("discordant")
    pairs = n * (n - 1)
    var = (
        (pairs * (2 * n + 5) - F.col("x5") - F.col("y5")) / 18
        + F.col("x2") * F.col("y2") / (2 * pairs)
        + F.col("x3") * F.col("y3") / (9 * pairs * (n - 2))
    )
    z = F.abs(s) / F.sqrt(var)
    return one.select(
        n.cast("bigint").alias("n"),
        "concordant",
        "discordant",
        (s / F.sqrt((pairs - F.col("x2")) / 2 * (pairs - F.col("y2")) / 2)).alias("tau"),
        erfc(z / F.sqrt(F.lit(2.0))).alias("p_value"),
    )

"""Running totals and ranks over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.session import cut_lineage


def running_count(
    df: DataFrame, keys: Sequence[str], block: str, within: str, out: str = "line_no"
) -> DataFrame:
    """Number rows per ``keys`` from 1 in the order (block, within).

    Rows are counted per block first; the running total is over the block table,
    which has one row per block. ``block`` must be a bounded run of rows, such as
    one file split.
    """
    per_block = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("block_n"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, block, F.coalesce(F.sum("block_n").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy(*keys, block).orderBy(within)
    return (
        df.withColumn("row_in_block", F.row_number().over(inside))
        .join(offsets, [*keys, block])
        .withColumn(out, (F.col("offset") + F.col("row_in_block")).cast("bigint"))
        .drop("offset", "row_in_block")
    )


def running_sum(
    df: DataFrame, value: str, keys: Sequence[str], block: str, within: str, out: str
) -> DataFrame:
    """Inclusive running total of ``value`` per ``keys`` in the order (block, within)."""
    per_block = df.groupBy(*keys, block).agg(F.sum(value).alias("block_sum"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, block, F.coalesce(F.sum("block_sum").over(before), F.lit(0)).alias("offset")
    )
    inside = (
        W.partitionBy(*keys, block).orderBy(within).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        df.withColumn("sum_in_block", F.sum(value).over(inside))
        .join(offsets, [*keys, block])
        .withColumn(out, (F.col("offset") + F.col("sum_in_block")).cast("bigint"))
        .drop("offset", "sum_in_block")
    )


def totals_before(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str]) -> DataFrame:
    """Adds, per new name of ``sums``, the sum of a column over all earlier rows of the same keys.

    Rows are dealt by ranges of the keys and ``order``, whose number follows the data and the
    session's partitions; a window runs inside one range, and the sums of the ranges in front are
    added. ``order`` is unique within its keys, which are not null.
    """
    placed = cut_lineage(df.repartitionByRange(*keys, order).withColumn("range_no", F.spark_partition_id()))
    per_range = placed.groupBy(*keys, "range_no").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    # one row for each range and key in it
    before = W.partitionBy(*keys).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(*keys, "range_no", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_offset") for n in sums])
    inside = W.partitionBy(*keys, "range_no").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    run = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(name) for name, c in sums.items()])
    whole = run.join(offsets, [*keys, "range_no"])
    return whole.select(*df.columns, *[(F.col(n) + F.col(f"{n}_offset")).alias(n) for n in sums])


def cumulative_counts(df: DataFrame, value: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct ``value``: its count ``n`` and the count ``below`` of all smaller values.

    A value that holds any share of the rows is one row here, as counting comes first.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    # read twice below: for the cut points of the ranges and for the rows
    counts = cut_lineage(df.groupBy(*keys, F.col(value)).agg(F.sum(w).alias("n")))
    return totals_before(counts, keys, value, {"below": "n"})


_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Adds ``out``, the place of a row from 0 among the rows with its keys, in the order of ``order``.

    Rows are dealt by ranges and sorted inside a range, so rows of one key may lie in many tasks;
    what is added up is one row for each range and key in it. Keys must not be null, and a tie is
    broken by the dealing, so ``order`` should be unique.
    """
    placed = cut_lineage(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("row_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("row_id", _ROW_BITS).alias("range_no")
    runs = placed.groupBy(*keys, part).agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("range_n"))
    before = W.partitionBy(*keys).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(*keys, "range_no", "first_id", F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("offset"))
    return (
        placed.withColumn("range_no", part)
        .join(offsets, [*keys, "range_no"])
        .withColumn(out, F.col("offset") + F.col("row_id") - F.col("first_id"))
        .drop("range_no", "row_id", "first_id", "offset")
    )

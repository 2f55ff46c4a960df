"""Formats of header columns: fixed text and numbers, found from the values, and their restoration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators.relations import long_columns

AGREEMENT = 0.95


def header_formats(df: DataFrame, columns: Sequence[str], agreement: float = AGREEMENT) -> DataFrame:
    """``(col, format, n_strings, n_numbers, widths)``, one row per header column.

    A format is a text with ``%d`` per number, or ``%s`` where the values do not agree.
    ``widths`` has -1 for a number without a fixed width. Values are counted before
    anything else, so repeated values cost one row.
    """
    counted = long_columns(df, [], columns).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    cut = counted.withColumn("parts", tk.digit_split(F.col("value"))).withColumn("k", F.size("parts"))
    lengths = cut.groupBy("col", "k").agg(F.sum("n").alias("kn"))
    shape = lengths.groupBy("col").agg(
        F.max_by("k", F.struct("kn", -F.col("k"))).alias("mode"),
        F.max("kn").alias("mode_n"),
        F.sum("kn").alias("total"),
    )
    parts = (
        cut.select("col", "n", F.posexplode("parts").alias("pos", "part"))
        .join(shape.select("col", "mode"), "col")
        .filter(F.col("pos") < F.col("mode"))
    )
    by_part = parts.groupBy("col", "pos", "part").agg(F.sum("n").alias("pn"))
    pivot = by_part.groupBy("col", "pos").agg(
        F.max_by("part", F.struct("pn", "part")).alias("pivot"),
        F.max("pn").alias("pivot_n"),
        F.sum("pn").alias("pos_n"),
    )
    by_width = by_part.groupBy("col", "pos", F.length("part").alias("w")).agg(F.sum("pn").alias("wn"))
    width = by_width.groupBy("col", "pos").agg(
        F.max_by("w", F.struct("wn", "w")).alias("width"), F.max("wn").alias("width_n")
    )
    number = F.col("pivot").rlike("^[0-9]+$")
    pos = pivot.join(width, ["col", "pos"]).select(
        "col",
        "pos",
        F.when(number, F.lit("%d")).otherwise(F.col("pivot")).alias("piece"),
        number.alias("number"),
        F.when(number, F.lit(True)).otherwise(F.col("pivot_n") >= agreement * F.col("pos_n")).alias("stable"),
        F.when(F.col("width_n") >= agreement * F.col("pos_n"), F.col("width")).otherwise(-1).alias("width"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece", "number", "width")))
    gathered = pos.groupBy("col").agg(ordered.alias("p"), F.bool_and("stable").alias("stable"))
    regular = F.col("stable") & (F.col("mode_n") >= agreement * F.col("total")) & (
        (F.col("mode") > 1) | F.get("p", F.lit(0))["number"]
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    numbers = F.filter("p", lambda x: x["number"])
    return (
        shape.join(gathered, "col")
        .withColumn("regular", regular)
        .select(
            "col",
            F.when(F.col("regular"), text).otherwise(F.lit("%s")).alias("format"),
            F.when(F.col("regular"), F.size("p") - F.size(numbers)).otherwise(1).cast("bigint").alias("n_strings"),
            F.when(F.col("regular"), F.size(numbers)).otherwise(0).cast("bigint").alias("n_numbers"),
            F.when(F.col("regular"), F.transform(numbers, lambda x: x["width"])).otherwise(F.array(F.lit(-1))).alias("widths"),
        )
    )


def header_numbers(value: Column) -> Column:
    """The digit runs of a header value, as numbers."""
    return F.transform(
        F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda d: d.try_cast("bigint")
    )


def header_text(fmt: Column, numbers: Column, widths: Column) -> Column:
    """A header value from its format: numbers padded to their width between the fixed texts."""
    texts = F.split(fmt, "%d", -1)
    padded = F.zip_with(
        numbers, widths, lambda n, w: F.when(w < 0, n.cast("string")).otherwise(tk.left_pad(n, w))
    )
    return F.array_join(
        F.zip_with(texts, F.array_append(padded, F.lit("")), lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), ""
    )


def assemble_log(matched: DataFrame, unmatched: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Lines from headers and templates together with the two kinds of lines kept as text."""
    columns = ["chunk_id", "line_no", "line"]
    out = matched.select(*columns)
    for part in (unmatched, unreadable):
        out = out.unionByName(part.select(*columns))
    return out

"""Corpus profiles: sizes, ratios of digits, compression reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.functions.arrays import explode_rows
from logquarry.session import ensure_checkpoint_dir


def line_profile(lines: DataFrame, keys: Sequence[str] = (), text: str = "line") -> DataFrame:
    """Lines, characters and bytes; every line counts one byte for its newline."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length(text) + 1).alias("size_bytes"),
        F.avg(F.length(text)).alias("avg_line_length"),
    )


def digit_ratio(lines: DataFrame, keys: Sequence[str] = (), text: str = "line") -> DataFrame:
    """Share of decimal digits (of any script) among characters, newlines included."""
    n_digits = F.sum(F.length(F.regexp_replace(text, r"\P{Nd}", "")))
    n_chars = F.sum(F.length(text) + 1)
    return lines.groupBy(*keys).agg(
        n_digits.alias("n_digits"),
        (n_chars - n_digits).alias("n_other"),
        (n_digits / n_chars).alias("digit_ratio"),
    )


def digit_token_ratio(
    lines: DataFrame,
    keys: Sequence[str] = (),
    text: str = "line",
    order: str | None = None,
    max_lines: int | None = None,
) -> DataFrame:
    """Share of tokens with a digit; ``max_lines`` limits the profile to the first lines."""
    if max_lines is not None:
        lines = lines.filter(F.col(order) <= max_lines)
    words = F.filter(F.split(F.trim(text), "[ ,:=/-]+"), lambda t: t != "")
    counted = lines.select(
        *keys,
        F.size(words).alias("n"),
        F.size(F.filter(words, lambda t: t.rlike(r"\p{Nd}"))).alias("d"),
    )
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("n_tokens"),
        F.sum("d").alias("n_digit_tokens"),
        F.try_divide(F.sum("d"), F.sum("n")).alias("digit_token_ratio"),
    )


def token_types(lines: DataFrame, text: str = "line") -> DataFrame:
    """Tokens by the kinds of characters they hold."""
    token = F.col("token")
    return (
        explode_rows(lines, [], tk.tokens(text), "token")
        .select(
            tk.has_alpha(token).alias("has_alpha"),
            tk.has_digit(token).alias("has_digit"),
            tk.has_special(token).alias("has_special"),
            tk.is_number(token).alias("is_number"),
        )
        .groupBy("has_alpha", "has_digit", "has_special", "is_number")
        .agg(F.count(F.lit(1)).alias("n_tokens"))
    )


def token_shapes(lines: DataFrame, text: str = "line") -> DataFrame:
    """Shapes of tokens with a digit. Tokens are counted first, so each is shaped once."""
    token = F.col("token")
    distinct = (
        explode_rows(lines, [], tk.tokens(text), "token")
        .filter(tk.has_digit(token))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return distinct.groupBy(tk.shape(token).alias("shape")).agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct")
    )


def size_ratio(original: Column, encoded: Column) -> Column:
    return original / encoded


def space_savings(original: Column, encoded: Column) -> Column:
    return 1 - encoded / original


CODECS = ("none", "snappy", "gzip", "zstd")


def codec_sizes(df: DataFrame, order: Sequence[str], codecs: Sequence[str] = CODECS, text: str = "line") -> DataFrame:
    """``(codec, n_rows, original_bytes, encoded_bytes)``: bytes of the table as Spark writes it under its own codecs.

    Rows are dealt by ranges of ``order`` and sorted, as a table for keeps would be, and written to the
    shared folder once a codec; sizes are those of the files. A line counts one byte for its end.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/codecs-{uuid.uuid4().hex}"
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    raw = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).cast("bigint").alias("original_bytes"))
    out = None
    for codec in codecs:
        sorted_rows.write.option("compression", codec).parquet(f"{folder}/{codec}")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{codec}")
        # only the files' lengths are read
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("encoded_bytes"))
        row = raw.select(F.lit(codec).alias("codec"), "*", size.scalar().alias("encoded_bytes"))
        out = row if out is None else out.union(row)
    return out


def codec_report(sizes: DataFrame) -> DataFrame:
    """Ratio and savings per codec over all chunks."""
    original, encoded = F.sum("original_bytes"), F.sum("encoded_bytes")
    return sizes.groupBy("codec").agg(
        original.alias("original_bytes"),
        encoded.alias("encoded_bytes"),
        size_ratio(original, encoded).alias("compression_ratio"),
        space_savings(original, encoded).alias("space_savings"),
    )


def run_summary(sizes: DataFrame, keys: Sequence[str], seconds: Column) -> DataFrame:
    """Size, ratio and speed of runs."""
    original, encoded = F.sum("original_bytes"), F.sum("encoded_bytes")
    return sizes.groupBy(*keys).agg(
        original.alias("original_bytes"),
        encoded.alias("encoded_bytes"),
        size_ratio(original, encoded).alias("ratio"),
        (original / 1048576 / seconds).alias("mb_per_second"),
    )


def with_average_row(df: DataFrame, label: str, metrics: Sequence[str], name: str = "Average") -> DataFrame:
    """The table plus one row of column means."""
    mean = df.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit(name).alias(label), *metrics)
    return df.select(label, *metrics).unionByName(mean)


def speed_up(df: DataFrame, keys: Sequence[str], threads: str, seconds: str) -> DataFrame:
    """Time at the fewest threads over the time at each count, and that per thread."""
    base = df.groupBy(*keys).agg(
        F.min_by(seconds, threads).alias("base_seconds"), F.min(threads).alias("base_threads")
    )
    gain = F.col("base_seconds") / F.col(seconds)
    return df.join(base, list(keys)).select(
        *keys,
        threads,
        seconds,
        gain.alias("speed_up"),
        (gain * F.col("base_threads") / F.col(threads)).alias("efficiency"),
    )

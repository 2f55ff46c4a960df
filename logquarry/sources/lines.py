"""Line sources: text files, table columns, chunks and records of several lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions.ranks import running_sum
from logquarry.operators.templates import checked_broadcast
from logquarry.session import cut_lineage


def spread(df: DataFrame) -> DataFrame:
    """Spread a source with fewer splits than there are cores.

    A small file is one split, and the work per row is heavy. A source with enough
    splits, as on a cluster, is left alone and pays no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_lines(spark: SparkSession, path: str, chunk_lines: int = 100_000) -> DataFrame:
    """``(source, chunk_id, line_no, line)`` of text files, numbered from 1 per file.

    The splits of the files are counted first; a line's number is the lines of its file in the
    splits before plus its place in its own split, which the rows' running ids give, as a split is
    read in order by one task. Lines stay where they are read: what is moved is one row a split,
    sent to all tasks while its measured size is small.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    # the same scan gives the same ids each time
    splits = cut_lineage(raw.groupBy("source", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")))
    before = W.partitionBy("source").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("source", "block_start", "first_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    line_no = (F.col("offset") + F.col("seq") - F.col("first_seq") + 1).cast("bigint")
    numbered = raw.join(checked_broadcast(offsets, "source"), ["source", "block_start"]).withColumn("line_no", line_no)
    return numbered.select(
        "source",
        F.floor((F.col("line_no") - 1) / chunk_lines).alias("chunk_id"),
        "line_no",
        "line",
    )


def final_newline_flags(spark: SparkSession, path: str) -> DataFrame:
    """Whether each non-empty text file ends with a newline.

    Lines are counted with one byte for their newline; without the last newline
    the sum is one more than the file's size.
    """
    size = F.col("_metadata.file_size")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        size.alias("file_bytes"),
        (F.octet_length("value") + 1).alias("line_bytes"),
    )
    return (
        lines.groupBy("source")
        .agg(F.max("file_bytes").alias("file_bytes"), F.sum("line_bytes").alias("line_bytes"))
        .select("source", (F.col("file_bytes") >= F.col("line_bytes")).alias("final_newline"))
    )


def lines_of_text(df: DataFrame, doc_id: str, text: str, chunk_docs: int) -> DataFrame:
    """Lines of a text column: a chunk is a run of ``chunk_docs`` consecutive documents.

    ``line_no`` holds the document in its upper and the position in its lower 32 bits.
    """
    return df.filter(F.col(text).isNotNull()).select(
        F.expr(f"{doc_id} div {chunk_docs}").alias("chunk_id"),
        F.col(doc_id),
        F.posexplode_outer(F.split(text, "\n", -1)).alias("pos", "line"),
    ).select(
        "chunk_id",
        (F.shiftleft(F.col(doc_id).cast("bigint"), 32) + F.col("pos")).alias("line_no"),
        "line",
    )


def join_continuations(
    lines: DataFrame,
    boundary: str,
    keys: Sequence[str],
    order: str,
    block: str,
    text: str = "line",
    max_length: int | None = None,
) -> DataFrame:
    """Records that span lines: a line that matches ``boundary`` begins a record.

    Lines in front of the first header of a source (``keys``) are dropped, as are
    records longer than ``max_length`` where that is set. ``block`` is a bounded run
    of lines, ascending with ``order``; a record may cross blocks.
    """
    starts = lines.withColumn("starts", F.col(text).rlike(boundary).cast("bigint"))
    numbered = running_sum(starts, "starts", keys, block, order, "record_no").filter("record_no > 0")
    if max_length is not None:
        # lengths are added up before any line is gathered; a record has a newline between lines
        length = F.sum(F.length(text) + 1) - 1
        fitting = numbered.groupBy(*keys, "record_no").agg(length.alias("length")).filter(F.col("length") <= max_length)
        numbered = numbered.join(fitting.drop("length"), [*keys, "record_no"])
    return (
        numbered.groupBy(*keys, "record_no")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
        .select(
            *keys,
            "record_no",
            F.size("parts").cast("bigint").alias("n_lines"),
            F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("record"),
        )
    )


def filter_lines(df: DataFrame, pattern: str, text: str = "line") -> DataFrame:
    return df.filter(F.col(text).rlike(pattern))


def convert_lines(df: DataFrame, pattern: str, template: str, text: str = "line") -> DataFrame:
    """Keep matching lines, rewritten by a template with ``$1``, ``${1}``, ``$0`` and ``$$``.

    ``$+{name}`` refers to a named group. An unknown or unmatched group is empty.
    """
    return df.filter(F.col(text).rlike(pattern)).withColumn(text, _filled(F.col(text), pattern, template))


def _filled(text: Column, pattern: str, template: str) -> Column:
    import re

    names = {name: number for name, number in re.compile(pattern.replace("(?<", "(?P<")).groupindex.items()}
    groups = re.compile(pattern.replace("(?<", "(?P<")).groups
    out, last = [], 0
    for m in re.finditer(r"\$(?:(\$)|(\d+)|\{(\d+)\}|\+\{(\w+)\})", template):
        out.append(F.lit(template[last : m.start()]))
        dollar, plain, braced, name = m.groups()
        if dollar:
            out.append(F.lit("$"))
        else:
            number = names.get(name, groups + 1) if name else int(plain or braced)
            if number == 0:
                out.append(text)
            elif number <= groups:
                out.append(F.regexp_extract(text, pattern, number))
        last = m.end()
    out.append(F.lit(template[last:]))
    return F.concat(*out)


def map_lines(df: DataFrame, convert: Callable[[Column], Column], text: str = "line") -> DataFrame:
    """User conversion on the line column; a null result drops the line."""
    return df.withColumn(text, convert(F.col(text))).filter(F.col(text).isNotNull())


def drop_blank(df: DataFrame, text: str = "line") -> DataFrame:
    return df.filter(F.trim(F.regexp_replace(text, r"\s", " ")) != "")


def first_lines(df: DataFrame, order: str, n: int) -> DataFrame:
    """Lines numbered up to ``n``; the number is part of the data."""
    return df.filter(F.col(order) <= n)


def split_parameters(df: DataFrame, text: str = "line", separator: str = r"\|\|") -> DataFrame:
    """``eid||v1||v2||`` rows to an event id and a parameter array."""
    parts = F.split(text, separator, -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(
        "*",
        F.get(trimmed, F.lit(0)).alias("event_id"),
        F.slice(trimmed, F.lit(2), F.greatest(F.size(trimmed) - 1, F.lit(0))).alias("params"),
    )

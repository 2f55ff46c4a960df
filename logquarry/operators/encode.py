"""Lossless column encoding of tagged lines.

Every dictionary is local to a chunk. A chunk is a bounded block of lines, so
every window below is bounded as well, however often one tag occurs overall.
Values are shuffled once, by chunk and tag; statistics, dictionary ids and deltas
are windows over that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.functions.presets import DICTIONARY_TAGS, PLAIN_NUMBER_TAGS, VERBATIM_TAGS
from logquarry.operators import tagging as tg
from logquarry.session import drop_written, task_count, written

MAPPING, ALLSAME = "MAPPING", "ALLSAME"
DELTA, NODELTA = "NUMERIC_DELTA", "NUMERIC_NODELTA"
MAX_NUMBER_DIGITS = 18
TASK_LINES = 25_000  # lines of one task, with all their values


@dataclass(frozen=True)
class Encoded:
    """The tables of an encoded data set."""

    templates: DataFrame
    line_map: DataFrame
    tags: DataFrame
    values: DataFrame
    dictionary: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "templates": self.templates,
            "line_map": self.line_map,
            "tags": self.tags,
            "values": self.values,
            "dictionary": self.dictionary,
        }


def dealt(lines: DataFrame) -> DataFrame:
    """Lines dealt by chunk to as many tasks as their number asks for; windows inside a chunk keep the dealing."""
    return lines.repartition(task_count(lines, TASK_LINES), "chunk_id")


def number_templates(tagged: DataFrame) -> DataFrame:
    """Adds ``template_id``: 1, 2, .. in first-seen order within the chunk, 0 for an empty line; and per
    line the ``first_line_no`` and ``n_lines`` of its template."""
    template = [F.col("parts.statics"), F.col("parts.tags")]
    by_chunk = W.partitionBy("chunk_id").orderBy("first_line_no")
    alike = W.partitionBy("chunk_id", *template)
    empty = F.col("parts.statics") == F.array(F.lit(""))
    return (
        tagged.withColumn("empty", empty)
        .withColumn("first_line_no", F.when(~F.col("empty"), F.min("line_no").over(alike)))
        .withColumn("n_lines", F.count(F.lit(1)).over(alike))
        # an empty line has no first line and sorts in front, as rank 1
        .withColumn("rank", F.dense_rank().over(by_chunk))
        .withColumn("any_empty", F.max(F.col("empty").cast("int")).over(W.partitionBy("chunk_id")))
        .withColumn(
            "template_id",
            F.when(F.col("empty"), 0).otherwise(F.col("rank") - F.col("any_empty")).cast("bigint"),
        )
        .drop("rank", "any_empty", "empty")
    )


def _compact(numbered: DataFrame) -> DataFrame:
    """Numbered lines without their parts, but for the first line of each template."""
    first = (F.col("template_id") > 0) & (F.col("line_no") == F.col("first_line_no"))
    return numbered.select(
        "chunk_id", "line_no", "template_id", "n_lines",
        F.when(first, F.struct(F.col("parts.statics").alias("statics"), F.col("parts.tags").alias("tags"))).alias("form"),
    )


def template_table(compact: DataFrame) -> DataFrame:
    """One row a template, taken from its first line."""
    return compact.filter(F.col("form").isNotNull()).select(
        "chunk_id", "template_id", "n_lines", F.col("line_no").alias("first_line_no"), "form.statics", "form.tags",
        tg.template_text(F.col("form.statics"), F.col("form.tags")).alias("template"),
    )


def stored_form(tag: Column, value: Column, handlers: Mapping[str, tuple] | None = None) -> Column:
    """What is kept of a value, before it is known whether the digits alone suffice."""
    is_pattern = tag.rlike("^<[^=|:]+>$")
    digit_token = tk.has_digit(value) & ~tk.has_alpha(value)
    form = F.when(tag.isin(VERBATIM_TAGS) | tag.startswith("<json:"), value)
    for name, (encode, _) in (handlers or {}).items():
        form = form.when(tag == name, encode(value))
    return (
        form.when((tag == "<I>") & tk.is_canonical_ipv4(value), tk.ipv4_number(value))
        .when(is_pattern & (tag != "<I>") & tk.has_digit(value), tk.digits(value))
        .when(digit_token & (tag != "<I>"), tk.digits(value))
        .otherwise(value)
    )


def restored_form(
    tag: Column,
    stored: Column,
    mask: Column,
    handlers: Mapping[str, tuple] | None = None,
) -> Column:
    """Inverse of :func:`stored_form`, given the common mask of the tag's values, if any."""
    form = F.when(mask.isNull(), stored).when(tag == "<I>", tk.ipv4_text(stored))
    for name, (_, decode) in (handlers or {}).items():
        form = form.when(tag == name, decode(stored))
    return form.otherwise(tk.refill(stored, tk.refill_pattern(mask), tk.refill_layout(mask)))


def digit_mask(tag: Column, value: Column, form: Column, handlers: Mapping[str, tuple] | None) -> Column:
    """What the reduced form leaves out: the value with every digit as 0; null if nothing is.

    Addresses and handled tags come back without a mask, so theirs is a constant.
    """
    mask = F.when(form == value, F.lit(None)).when(tag == "<I>", F.lit("ipv4"))
    for name, (_, decode) in (handlers or {}).items():
        mask = mask.when(tag == name, F.when(decode(form) == value, F.lit("handler")))
    return mask.otherwise(F.regexp_replace(value, "[0-9]", "0"))


def encode_values(
    values: DataFrame, mode: str = "normal", handlers: Mapping[str, tuple] | None = None
) -> DataFrame:
    """Adds the storage decision and the encoded form to every value.

    The reduced form of a tag (digits only, or a handler's) is used when all values of
    the tag in the chunk have one mask, so each comes back exactly; else values are
    kept as written. ``mask`` is set where a reduced form is used.

    Equal values of such a tag have equal reduced forms and the other way round, so
    one sort by value serves both the first sight of a value and the tag's mask.
    """
    group = W.partitionBy("chunk_id", "tag")
    by_value = W.partitionBy("chunk_id", "tag", "value")
    in_order = group.orderBy("line_no", "var_no")
    tag, value = F.col("tag"), F.col("value")

    base = values
    if mode != "fast":
        base = base.withColumn("form", stored_form(tag, value, handlers)).withColumn(
            "own_mask", digit_mask(tag, value, F.col("form"), handlers)
        )
    seen = base.withColumn("first_at", F.min(F.struct("line_no", "var_no")).over(by_value))
    if mode == "fast":
        prepared = seen.withColumn("stored", value).withColumn("mask", F.lit(None).cast("string"))
    else:
        n_masked = F.count("own_mask").over(group)
        uniform = (n_masked == F.count(F.lit(1)).over(group)) & (
            F.min("own_mask").over(group) == F.max("own_mask").over(group)
        )
        prepared = (
            seen.withColumn("uniform", uniform)
            .withColumn("stored", F.when(F.col("uniform"), F.col("form")).otherwise(value))
            .withColumn("mask", F.when(F.col("uniform"), F.col("own_mask")))
        )
    number = F.col("stored").try_cast("bigint")
    prepared = prepared.select(
        "chunk_id",
        "tag",
        "line_no",
        "var_no",
        "stored",
        "mask",
        "first_at",
        F.length("stored").alias("len"),
        F.when(F.col("stored").rlike(f"^[0-9]{{1,{MAX_NUMBER_DIGITS}}}$"), number).alias("number"),
    ).withColumn(
        # one bit per number of digits without leading zeros
        "len_bit", F.expr("shiftleft(1, length(cast(number as string)))")
    )
    ranked = (
        prepared.withColumn("dict_rank", F.dense_rank().over(group.orderBy("first_at")))
        .select(
            "*",
            F.count(F.lit(1)).over(group).alias("n"),
            F.count("number").over(group).alias("n_num"),
            F.max("dict_rank").over(group).alias("n_distinct"),
            F.bit_or("len_bit").over(group).alias("len_bits"),
            F.min("len").over(group).alias("min_len"),
            F.max("len").over(group).alias("max_len"),
        )
    )
    if mode == "fast":
        storage = F.lit(MAPPING)
    else:
        storage = storage_type(
            tag,
            F.col("n"),
            F.col("n_distinct"),
            F.col("n_num") == F.col("n"),
            F.coalesce(F.bit_count("len_bits"), F.lit(0)),
        )
    numeric = F.col("storage_type").isin(ALLSAME, DELTA, NODELTA)
    return (
        ranked.withColumn("storage_type", storage)
        .withColumn(
            "num",
            F.when(
                F.col("storage_type") == DELTA,
                F.col("number") - F.coalesce(F.lag("number").over(in_order), F.lit(0)),
            ).when(numeric, F.col("number")),
        )
        .withColumn("dict_id", F.when(~numeric, F.col("dict_rank")).cast("bigint"))
        .withColumn(
            "width",
            F.when(numeric & (F.col("min_len") != F.col("max_len")), F.col("len")).cast("bigint"),
        )
        .drop("dict_rank", "first_at", "len", "len_bit", "len_bits", "n_num", "number")
    )


def storage_type(
    tag: Column, n: Column, n_distinct: Column, all_num: Column, n_lengths: Column
) -> Column:
    """How a tag's values are stored: rules in order of priority."""
    return (
        F.when(tag.isin(DICTIONARY_TAGS), MAPPING)
        .when(~all_num, MAPPING)
        .when(n_distinct == 1, ALLSAME)
        .when(tag.isin(PLAIN_NUMBER_TAGS), NODELTA)
        .when((n > 100) & (n_lengths >= 3), NODELTA)
        .otherwise(DELTA)
    )


def tag_table(encoded_values: DataFrame) -> DataFrame:
    """One row per chunk and tag."""
    return encoded_values.groupBy("chunk_id", "tag").agg(
        F.first("storage_type").alias("storage_type"),
        F.first("n").alias("n"),
        F.first("n_distinct").cast("bigint").alias("n_distinct"),
        F.first("min_len").cast("bigint").alias("min_len"),
        F.first("max_len").cast("bigint").alias("max_len"),
        F.first("mask").alias("mask"),
        F.sum(tk.varint_size(F.coalesce("num", "dict_id"))).alias("id_bytes"),
    )


def dictionary_table(encoded_values: DataFrame) -> DataFrame:
    return (
        encoded_values.filter(F.col("dict_id").isNotNull())
        .groupBy("chunk_id", "tag", "dict_id")
        .agg(F.first("stored").alias("value"), F.count(F.lit(1)).alias("n"))
    )


def encode(
    tagged: DataFrame, mode: str = "normal", handlers: Mapping[str, tuple] | None = None
) -> Encoded:
    """All tables of an encoded data set from ``(chunk_id, line_no, parts)``.

    Tagged lines are written once and dealt by chunk as they are read, since a written table does not
    keep its dealing; numbered lines and encoded values are written once more, without text. All are
    written as compressed columns, and tagged lines are dropped when the others are there.
    """
    whole = written(tagged.select("chunk_id", "line_no", "parts"))
    lines = dealt(whole)
    tasks = lines.rdd.getNumPartitions()
    numbered = written(_compact(number_templates(lines)))
    # variables alone are dealt, without the fixed text
    variables = whole.select("chunk_id", "line_no", F.struct("parts.tags", "parts.vars").alias("parts")).repartition(tasks, "chunk_id")
    values = written(encode_values(tg.variable_rows(variables), mode, handlers))
    drop_written(whole)
    return Encoded(
        templates=template_table(numbered),
        line_map=numbered.select("chunk_id", "line_no", "template_id").repartition(tasks, "chunk_id"),
        tags=tag_table(values),
        values=values.select("chunk_id", "tag", "line_no", "var_no", "num", "dict_id", "width"),
        dictionary=dictionary_table(values),
    )


def encoded_sizes(encoded: Encoded) -> DataFrame:
    """``(chunk_id, part, bytes)``: what the parts of a chunk take, numbers and ids in variable-length form
    and texts with a byte for their end."""
    end = lambda c: F.octet_length(c) + 1
    parts = {
        "values": (encoded.tags, F.col("id_bytes")),
        "dictionary": (encoded.dictionary, end("value")),
        "templates": (encoded.templates, end("template")),
        "line_map": (encoded.line_map, tk.varint_size(F.col("template_id"))),
    }
    out = None
    for name, (df, size) in parts.items():
        rows = df.groupBy("chunk_id").agg(F.lit(name).alias("part"), F.sum(size).cast("bigint").alias("bytes"))
        out = rows if out is None else out.union(rows)
    return out


def delta(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "delta") -> DataFrame:
    """First value kept, then differences to the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    return df.withColumn(out, v - F.coalesce(F.lag(v).over(w), F.lit(0)))


def undelta(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "value") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.sum(value).over(w))

"""Columns of text split by their common delimiters, each field in its cheapest form, and back.

A column's values are numbered by ``seq`` inside a chunk; once encoded, a cell is known by its
place alone. A field is kept as ``text``, as ``delta`` (steps between whole numbers), as ``dict``
(ids of its words in the order of first sight) or as ``dict_delta`` (steps between those ids).
All windows stay inside one field of one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.operators import relations as rel
from logquarry.session import joined, task_count, written

TEXT, DELTA, DICT, DICT_DELTA = "text", "delta", "dict", "dict_delta"
COLUMN = ["chunk_id", "col"]
FIELD = [*COLUMN, "field"]
_NUMBER = "^(0|-?[1-9][0-9]{0,17})$"
_DIGITS = "^[0-9]{1,18}$"
TASK_VALUES = 100_000  # values of one task, with all their fields


@dataclass(frozen=True)
class Columns:
    """``patterns`` (chunk_id, col, pattern), ``fields`` (.., field, form, width), ``cells`` (.., seq, num, text)
    and ``words`` (.., dict_id, word), for work in ``tasks`` tasks."""

    patterns: DataFrame
    fields: DataFrame
    cells: DataFrame
    words: DataFrame
    tasks: int


def _entropy(value: Column, field: W, same: W) -> Column:
    """``-sum p ln p log2(|v|+1)`` of a field, from counts of equal values; rows without value are left out."""
    n, c = F.count(value).over(field), F.count(value).over(same)
    return F.sum(F.when(value.isNotNull(), (F.log(n) - F.log(c)) * F.log2(F.abs(value) + 1) / n)).over(field)


def _cheaper(before: Column, after: Column) -> Column:
    """A single value has no steps, and steps of no entropy are as cheap as can be."""
    return F.round(before, 9) >= F.round(F.coalesce(after, F.lit(0.0)), 9)


def field_forms(cells: DataFrame, share: float = 0.5, tasks: int | None = None) -> DataFrame:
    """Adds ``form``, ``width``, ``number``, ``step``, ``dict_id`` and ``id_step`` to cells (chunk_id, col, field, seq, text).

    Numbers are whole numbers as written without padding, or digits that all have one width. Steps
    are taken if their weighted entropy is no larger; a dictionary if distinct values are fewer than
    ``share`` of all. Cells are dealt by field to ``tasks`` tasks, or by their number.
    """
    tasks = tasks or task_count(cells, TASK_VALUES)
    field = W.partitionBy(*FIELD)
    in_order = field.orderBy("seq")
    same = lambda c: W.partitionBy(*FIELD, c)
    one_width = (F.min(F.length("text")).over(field) == F.max(F.length("text")).over(field)) & F.bool_and(
        F.coalesce(F.col("text").rlike(_DIGITS), F.lit(False))
    ).over(field)
    plain = F.bool_and(F.coalesce(F.col("text").rlike(_NUMBER), F.lit(False))).over(field)
    seen = cells.repartition(tasks, *FIELD).select(
        "*",
        F.min("seq").over(same("text")).alias("first_at"),
        F.count(F.lit(1)).over(field).alias("n"),
        plain.alias("plain"),
        one_width.alias("one_width"),
    )
    numbered = seen.select(
        *FIELD, "seq", "text", "n", "plain", "one_width",
        F.when(F.col("plain") | F.col("one_width"), F.col("text").try_cast("bigint")).alias("number"),
        (F.dense_rank().over(field.orderBy("first_at")) - 1).cast("bigint").alias("dict_id"),
    )
    steps = numbered.select(
        "*",
        (F.col("number") - F.lag("number").over(in_order)).alias("step"),
        (F.col("dict_id") - F.lag("dict_id").over(in_order)).alias("id_step"),
    )
    judged = steps.select(
        *FIELD, "seq", "text", "number", "step", "dict_id", "id_step", "plain", "one_width",
        (F.max("dict_id").over(field) + 1 < share * F.col("n")).alias("few"),
        _cheaper(_entropy(F.col("number"), field, same("number")), _entropy(F.col("step"), field, same("step"))).alias("by_step"),
        _cheaper(_entropy(F.col("dict_id"), field, same("dict_id")), _entropy(F.col("id_step"), field, same("id_step"))).alias("by_id_step"),
    )
    form = (
        F.when((F.col("plain") | F.col("one_width")) & F.col("by_step"), DELTA)
        .when(F.col("few") & F.col("by_id_step"), DICT_DELTA)
        .when(F.col("few"), DICT)
        .otherwise(TEXT)
    )
    width = F.when(~F.col("plain"), F.length("text"))
    return judged.select(
        *FIELD, "seq", "text", "number", "step", "dict_id", "id_step",
        form.alias("form"), F.when(form == DELTA, width).cast("int").alias("width"),
    )


def encode_columns(values: DataFrame, share: float = 0.5) -> Columns:
    """Encode ``values`` (chunk_id, col, seq, value); (chunk_id, col, seq) is unique and values are not null.

    Patterns and encoded cells are written once: every table is read from them.
    """
    tasks = task_count(values, TASK_VALUES)
    patterns = written(rel.column_patterns(values, "value", "seq", COLUMN))
    cut = joined(values, patterns, COLUMN, tasks).select(
        *COLUMN, "seq", F.posexplode(rel.split_by_pattern(F.col("value"), F.col("pattern"))).alias("field", "text")
    )
    judged = field_forms(cut.select(*FIELD, "seq", "text"), share, tasks)
    form = F.col("form")
    num = (
        F.when(form == DELTA, F.coalesce("step", "number"))
        .when(form == DICT_DELTA, F.coalesce("id_step", "dict_id"))
        .when(form == DICT, F.col("dict_id"))
    )
    kept = F.when(form != DELTA, F.col("text")).alias("text")
    coded = written(judged.select(*FIELD, "seq", kept, "form", "width", "dict_id", num.alias("num")))
    dealt = coded.repartition(tasks, *FIELD)
    words = dealt.where(form.isin(DICT, DICT_DELTA)).groupBy(*FIELD, "dict_id").agg(F.first("text").alias("word"))
    return Columns(
        patterns=patterns,
        fields=dealt.groupBy(*FIELD).agg(F.first("form").alias("form"), F.first("width").alias("width"), F.count(F.lit(1)).alias("n")),
        cells=dealt.select(*FIELD, "seq", "num", F.when(form == TEXT, F.col("text")).alias("text")),
        words=words,
        tasks=tasks,
    )


def decode_columns(encoded: Columns) -> DataFrame:
    """``(chunk_id, col, seq, value)`` from the encoded tables: steps summed up, ids looked up, fields joined."""
    in_order = W.partitionBy(*FIELD).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    form = F.col("form")
    whole = F.when(form.isin(DELTA, DICT_DELTA), F.sum("num").over(in_order)).otherwise(F.col("num"))
    kinds = encoded.fields.select(*FIELD, "form", "width")
    cells = joined(encoded.cells, kinds, FIELD, encoded.tasks).withColumn("whole", whole)
    padded = F.when(F.col("width").isNull(), F.col("whole").cast("string")).otherwise(tk.left_pad(F.col("whole"), F.col("width")))
    ids = cells.withColumn("dict_id", F.when(form.isin(DICT, DICT_DELTA), F.col("whole")))
    found = (
        joined(ids, encoded.words, [*FIELD, "dict_id"], encoded.tasks, "left")
        .select(*FIELD, "seq", F.when(form == DELTA, padded).otherwise(F.coalesce("text", "word")).alias("piece"))
    )
    # a group holds the fields of one value
    whole_values = found.repartition(encoded.tasks, *COLUMN, "seq").groupBy(*COLUMN, "seq").agg(F.array_sort(F.collect_list(F.struct("field", "piece"))).alias("f"))
    return joined(whole_values, encoded.patterns, COLUMN, encoded.tasks).select(
        *COLUMN, "seq", rel.join_by_pattern(F.col("f.piece"), F.col("pattern")).alias("value")
    )

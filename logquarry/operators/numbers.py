"""Number groups: digit runs keyed by length and first digit, the rest by mined delimiters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.functions import tokens as tk
from logquarry.functions.arrays import posexplode_rows
from logquarry.operators import tagging as tg
from logquarry.session import drop_written, joined, task_count, written

# Delimiters to choose from, and the groups stored without delta.
DELIMITER_CANDIDATES = [",", " ", "|", ";", "[", "]", "(", ")", "_", "/"]
PLAIN_GROUPS = ["<I>", "<a>", "<b>", "<c>"]


def number_groups(lines: DataFrame, patterns: tg.Patterns = ()) -> DataFrame:
    """``(chunk_id, line_no, seq, grp, num)``: pattern values, then digit runs of up to 14 digits.

    ``seq`` is the order of a number in its line. Lines without text give none.
    """
    segs = tg.segments(F.col("line"), patterns)

    def numbers(s: Column) -> Column:
        runs = F.regexp_extract_all(s["text"], F.lit("[0-9]+"), F.lit(0))
        free = F.transform(runs, lambda r: F.struct(tk.number_group(r).alias("grp"), r.alias("digits")))
        digits = F.when(s["tag"] == "<I>", tk.ipv4_number(s["text"])).otherwise(tk.digits(s["text"]))
        hit = F.array(F.struct(s["tag"].alias("grp"), digits.alias("digits")))
        return F.when(s["tag"] != "", hit).otherwise(F.filter(free, lambda f: f["grp"].isNotNull()))

    found = F.flatten(F.transform(segs, numbers))
    return (
        posexplode_rows(lines.filter("line <> ''"), ["chunk_id", "line_no"], found, "seq", "g")
        .select(
            "chunk_id",
            "line_no",
            F.col("seq").cast("bigint").alias("seq"),
            F.col("g.grp").alias("grp"),
            F.col("g.digits").try_cast("bigint").alias("num"),
            F.length("g.digits").cast("bigint").alias("width"),
        )
    )


def number_columns(groups: DataFrame) -> DataFrame:
    """Numbers as stored: deltas along the group, plain for the short groups."""
    w = W.partitionBy("chunk_id", "grp").orderBy("line_no", "seq")
    step = F.col("num") - F.coalesce(F.lag("num").over(w), F.lit(0))
    return groups.withColumn(
        "stored", F.when(F.col("grp").isin(PLAIN_GROUPS), F.col("num")).otherwise(step)
    )


def restore_numbers(columns: DataFrame) -> DataFrame:
    """Inverse of :func:`number_columns`; ``digits`` has its leading zeros back."""
    w = (
        W.partitionBy("chunk_id", "grp")
        .orderBy("line_no", "seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    num = F.when(F.col("grp").isin(PLAIN_GROUPS), F.col("stored")).otherwise(F.sum("stored").over(w))
    return columns.withColumn("num", num).withColumn(
        "digits", tk.left_pad(F.col("num"), F.col("width").cast("int"))
    )


def grouped_text(line: Column, patterns: tg.Patterns = ()) -> Column:
    """The line with every number replaced by its group."""

    def text(s: Column) -> Column:
        parts = F.regexp_extract_all(s["text"], F.lit("[0-9]+|[^0-9]+"), F.lit(0))
        named = F.transform(
            parts, lambda p: F.when(p.rlike("^[0-9]"), F.coalesce(tk.number_group(p), p)).otherwise(p)
        )
        return F.when(s["tag"] != "", s["tag"]).otherwise(F.array_join(named, ""))

    return F.array_join(F.transform(tg.segments(line, patterns), text), "")


def length_sample(lines: DataFrame, text: str, seed: int = 0) -> DataFrame:
    """One line of every length: the first in the order of a seeded md5."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(text)))
    first = lines.groupBy(F.length(text).alias("len")).agg(F.min(F.struct(order.alias("o"), F.col(text))).alias("m"))
    return first.filter("len IS NOT NULL").select(F.col(f"m.{text}").alias(text))


def mined_delimiters(sample: DataFrame, text: str, min_share: float = 1.0) -> DataFrame:
    """Candidates that occur more than ``min_share`` times a line on average; a blank if none does."""
    counts = sample.agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[
            F.coalesce(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{i}")
            for i, c in enumerate(DELIMITER_CANDIDATES)
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("delimiter"), F.col(f"c{i}").alias("n"))
            for i, c in enumerate(DELIMITER_CANDIDATES)
        ]
    )
    kept = F.filter(entries, lambda e: e["n"] > min_share * F.col("n_lines"))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(
        F.array(F.struct(F.lit(" ").alias("delimiter"), F.lit(0).cast("bigint").alias("n")))
    )
    return counts.select(F.explode(chosen).alias("e")).select("e.delimiter", "e.n")


def mask_by_delimiters(line: Column, delimiters: list[str]) -> Column:
    """Words between the delimiters that hold a digit become ``<*>``."""
    chars = "".join("\\" + c if c in "[]|()/" else c for c in delimiters)
    words = F.regexp_extract_all(line, F.lit(f"[{chars}]|[^{chars}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit("<*>")).otherwise(w)), "")


# --- lines from number groups

WORD = "<*>"
_MOST_DIGITS = 18  # of a number kept as one
TASK_LINES = 25_000  # lines of one task, with all their values


@dataclass(frozen=True)
class NumberLog:
    """``line_map`` (chunk_id, line_no, template_id), ``templates`` (.., template_id, statics, tags), ``numbers``
    (.., grp, rank, stored, mask_id), ``words`` (.., grp, rank, word_id) and ``dictionary`` (.., grp, id, text) of
    masks (kind ``mask``) and words (kind ``word``)."""

    line_map: DataFrame
    templates: DataFrame
    numbers: DataFrame
    words: DataFrame
    dictionary: DataFrame


def _piece(text: Column, tag: Column) -> Column:
    return F.struct(text.alias("text"), tag.alias("tag"))


def number_pieces(line: Column, patterns: tg.Patterns, delimiters: Sequence[str]) -> Column:
    """A line as pieces (text, tag) that joined are the line; the tag of fixed text is empty.

    Pattern values have their tag. Of the rest, a word between the mined delimiters whose digit runs all
    have a group is cut into those runs and fixed text; another word with a digit is ``<*>`` as a whole.
    """
    chars = "".join("\\" + c if c in r"[]|()/\^-" else c for c in delimiters)
    none = F.lit("")

    def word(w: Column) -> Column:
        runs = F.regexp_extract_all(w, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
        cut = F.transform(runs, lambda r: _piece(r, F.when(r.rlike("^[0-9]"), tk.number_group(r)).otherwise(none)))
        grouped = ~w.rlike("[0-9]{15}")
        return F.when(~w.rlike("[0-9]"), F.array(_piece(w, none))).when(grouped, cut).otherwise(F.array(_piece(w, F.lit(WORD))))

    def segment(s: Column) -> Column:
        words = F.regexp_extract_all(s["text"], F.lit(f"[{chars}]+|[^{chars}]+"), F.lit(0))
        return F.when(s["tag"] != "", F.array(_piece(s["text"], s["tag"]))).otherwise(F.flatten(F.transform(words, word)))

    return F.flatten(F.transform(tg.segments(line, patterns), segment))


def encode_numbers(lines: DataFrame, patterns: tg.Patterns = (), delimiters: Sequence[str] = (" ",)) -> NumberLog:
    """Encode lines (chunk_id, line_no, line) by number groups; a null line is an empty one.

    A value is known by its group and its place among all values of that group in the chunk, counted
    by line and then by place in the line, so a line is got back by the k-th occurrences of groups in it.
    """
    pieces = number_pieces(F.coalesce("line", F.lit("")), patterns, delimiters)
    cut = lines.select("chunk_id", "line_no", pieces.alias("p"))
    blank = F.transform("p", lambda x: F.when(x["tag"] == "", x["text"]))
    # written once: lines with their templates, and values, are made from it
    whole = written(
        cut.select(
            "chunk_id", "line_no", blank.alias("statics"), F.col("p.tag").alias("tags"),
            F.filter("p", lambda x: x["tag"] != "").alias("values"),
        )
    )
    # a written table does not keep its dealing
    tasks = task_count(whole, TASK_LINES)
    shaped = whole.repartition(tasks, "chunk_id")
    by_form = W.partitionBy("chunk_id", "statics", "tags")
    first = shaped.select("*", F.min("line_no").over(by_form).alias("at"))
    numbered = first.withColumn("template_id", F.dense_rank().over(W.partitionBy("chunk_id").orderBy("at")).cast("bigint"))
    form = F.when(F.col("line_no").eqNullSafe(F.col("at")), F.struct("statics", "tags"))
    compact = written(numbered.select("chunk_id", "line_no", "template_id", form.alias("form")))
    # values alone are dealt, without the text
    values = posexplode_rows(whole.select("chunk_id", "line_no", "values").repartition(tasks, "chunk_id"), ["chunk_id", "line_no"], F.col("values"), "pos", "v").select(
        "chunk_id", "line_no", "pos", F.col("v.tag").alias("grp"), F.col("v.text").alias("text")
    )
    group = W.partitionBy("chunk_id", "grp")
    placed = group.orderBy("line_no", "pos")
    numeric = (F.col("grp") != WORD) & F.length(tk.digits(F.col("text"))).between(1, _MOST_DIGITS)
    ranked = values.withColumn("rank", F.row_number().over(placed).cast("bigint")).withColumn("numeric", numeric)
    # digits as 0: what a number leaves out
    kept = F.when(F.col("numeric"), F.regexp_replace("text", "[0-9]", "0")).otherwise(F.col("text"))
    kept_rows = ranked.withColumn("kind", F.when(F.col("numeric"), "mask").otherwise("word")).withColumn("kept", kept)
    same = W.partitionBy("chunk_id", "grp", "kind", "kept")
    known = kept_rows.withColumn("first_at", F.min("rank").over(same)).withColumn(
        "id", F.dense_rank().over(W.partitionBy("chunk_id", "grp", "kind").orderBy("first_at")).cast("bigint")
    )
    num = F.when(F.col("numeric"), tk.digits(F.col("text")).try_cast("bigint"))
    coded = known.withColumn("num", num)
    step = F.col("num") - F.coalesce(F.lag("num").over(W.partitionBy("chunk_id", "grp", "kind").orderBy("rank")), F.lit(0))
    stored = written(
        coded.select(
            "chunk_id", "grp", "rank", "numeric", "kind", "kept", "id",
            F.when(F.col("grp").isin(PLAIN_GROUPS), F.col("num")).otherwise(step).alias("stored"),
        )
    )
    drop_written(whole)
    forms = compact.where("form IS NOT NULL").groupBy("chunk_id", "template_id").agg(F.first("form").alias("form"))
    return NumberLog(
        line_map=compact.select("chunk_id", "line_no", "template_id"),
        templates=forms.select("chunk_id", "template_id", "form.statics", "form.tags"),
        numbers=stored.where("numeric").select("chunk_id", "grp", "rank", "stored", F.col("id").alias("mask_id")),
        words=stored.where("NOT numeric").select("chunk_id", "grp", "rank", F.col("id").alias("word_id")),
        dictionary=stored.groupBy("chunk_id", "grp", "kind", "id").agg(F.first("kept").alias("text"), F.count(F.lit(1)).alias("n")),
    )


def decode_numbers(encoded: NumberLog) -> DataFrame:
    """``(chunk_id, line_no, line)``: each tag of a line takes the next value of its group."""
    tasks = task_count(encoded.line_map, TASK_LINES)
    # fixed text comes last, so it is moved once
    tagged = joined(encoded.line_map, encoded.templates.drop("statics"), ["chunk_id", "template_id"], tasks)
    tags = posexplode_rows(tagged, ["chunk_id", "line_no"], F.col("tags"), "pos", "grp").where("grp <> ''")
    placed = W.partitionBy("chunk_id", "grp").orderBy("line_no", "pos")
    places = tags.repartition(tasks, "chunk_id", "grp").withColumn("rank", F.row_number().over(placed).cast("bigint"))
    in_order = W.partitionBy("chunk_id", "grp").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    num = F.when(F.col("grp").isin(PLAIN_GROUPS), F.col("stored")).otherwise(F.sum("stored").over(in_order))
    no = lambda kind: F.lit(None).cast(kind)
    numbers = encoded.numbers.select("chunk_id", "grp", "rank", F.lit("mask").alias("kind"), F.col("mask_id").alias("id"), num.alias("num"))
    words = encoded.words.select("chunk_id", "grp", "rank", F.lit("word").alias("kind"), F.col("word_id").alias("id"), no("bigint").alias("num"))
    known = encoded.dictionary.select("chunk_id", "grp", "kind", "id", "text")
    found = joined(numbers.union(words), known, ["chunk_id", "grp", "kind", "id"], tasks)
    width = F.length(tk.digits(F.col("text")))
    digits = tk.left_pad(F.col("num"), width)
    # most masks are digits only
    refilled = F.when(F.col("text").rlike("^0*$"), digits).otherwise(tk.refill(digits, tk.refill_pattern(F.col("text")), tk.refill_layout(F.col("text"))))
    values = found.select("chunk_id", "grp", "rank", F.when(F.col("kind") == "mask", refilled).otherwise(F.col("text")).alias("value"))
    # a group holds the values of one line
    per_line = (
        joined(places, values, ["chunk_id", "grp", "rank"], tasks)
        .repartition(tasks, "chunk_id", "line_no")
        .groupBy("chunk_id", "line_no")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("v"))
    )
    whole = F.array_join(F.transform("statics", lambda s, i: F.coalesce(s, F.element_at("v", i))), "")
    filled = joined(encoded.line_map, per_line, ["chunk_id", "line_no"], tasks, "left")
    return joined(filled, encoded.templates.drop("tags"), ["chunk_id", "template_id"], tasks).select("chunk_id", "line_no", whole.alias("line"))


def number_template_text(statics: Column, tags: Column) -> Column:
    """A template to read: fixed text with the groups in their places."""
    return F.array_join(F.zip_with(statics, tags, lambda s, t: F.coalesce(s, t)), "")

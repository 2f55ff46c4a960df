"""A log as headers, templates, variables and two side tables, and the log from these parts again.

Lines of a chunk are three kinds: matched (readable by the header format, content equal to a
template with its variables filled in), unmatched (readable, no template) and unreadable. Only
``events`` knows where a line stands. Everything else is in running order: the k-th matched line has
the k-th headers of its chunk, the k-th line of an event has the k-th variables of that event, and
the k-th unmatched or unreadable line is the k-th row of its side table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.operators import templates as tm
from logquarry.operators.columns import Columns, decode_columns, encode_columns
from logquarry.session import cut_lineage
from logquarry.sources.formatted import line_format

UNREADABLE, UNMATCHED = -1, 0
CONTENT = "Content"
_HEAD = "head:"  # in front of header names, which may be any


@dataclass(frozen=True)
class LogParts:
    """``events`` (chunk_id, line_no, event), ``headers`` and ``variables`` as encoded columns, ``templates``
    (event, template), ``sides`` (chunk_id, event, k, line) for the two kinds kept as text, and the format."""

    events: DataFrame
    headers: Columns
    variables: Columns
    templates: DataFrame
    sides: DataFrame
    format: str

    @property
    def unmatched(self) -> DataFrame:
        return self.sides.where(F.col("event") == UNMATCHED).select("chunk_id", "k", "line")

    @property
    def unreadable(self) -> DataFrame:
        return self.sides.where(F.col("event") == UNREADABLE).select("chunk_id", "k", "line")


def format_pieces(text: str) -> list[str]:
    """Fixed texts and header names of a format in turn; fixed texts are plain, escapes taken off.

    A format whose fixed texts hold other regex signs has no single text and is refused.
    """
    pieces = re.split(r"<([^<>]+)>", text)
    for i in range(0, len(pieces), 2):
        if re.search(r"(?<!\\)[()\[\]{}*+?|^$.]", pieces[i]):
            raise ValueError(f"no fixed text: {pieces[i]!r}")
        pieces[i] = re.sub(r"\\(.)", r"\1", pieces[i])
    return pieces


def _head(name: str) -> Column:
    return F.col(f"`{_HEAD}{name}`")


def rendered(pieces: list[str], value) -> Column:
    """A line from the pieces of its format; ``value(name)`` is the column of a header."""
    return F.concat(*[value(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def filled(template: Column, values: Column) -> Column:
    """A template with its wildcards replaced by values, in order."""
    texts = F.split(template, r"<\*>", -1)
    tail = F.array_append(values, F.lit(""))
    return F.array_join(F.zip_with(texts, tail, lambda t, v: F.concat(t, v)), "")


def split_log(lines: DataFrame, fmt: str, templates: DataFrame) -> LogParts:
    """Take ``lines`` (chunk_id, line_no, line) apart by a header format and templates (template_id from 1, template).

    A line counts as readable only if its headers put back into the format are the line, and as
    matched only if its template filled in is its content; so nothing is lost where a format allows
    any run of blanks. A null line is an empty one.
    """
    pieces = format_pieces(fmt)
    form = line_format(fmt)
    headers = [h for h in form.headers if h != CONTENT]
    text = F.coalesce("line", F.lit(""))
    cut = lines.select("chunk_id", "line_no", text.alias("line")).select(
        "*", *[F.regexp_extract("line", form.regex, g).alias(_HEAD + h) for h, g in zip(form.headers, form.groups, strict=True)]
    )
    readable = F.col("line").rlike(form.regex) & (rendered(pieces, _head) == F.col("line"))
    cut = cut.withColumn("readable", readable)
    candidates = cut.where("readable").select("chunk_id", "line_no", _head(CONTENT).alias("content"))
    known = tm.match_templates(candidates, templates, ["chunk_id", "line_no"], "content")
    params = tm.template_params(known, "content", "template")
    exact = params.where(F.col("template_id").isNotNull() & (filled(F.col("template"), F.col("params")) == F.col("content")))
    matched = exact.select("chunk_id", "line_no", F.col("template_id").cast("bigint").alias("event"), "params")
    event = F.coalesce("event", F.when(F.col("readable"), UNMATCHED).otherwise(UNREADABLE)).cast("bigint")
    of_event = W.partitionBy("chunk_id", "event").orderBy("line_no")
    of_matched = W.partitionBy("chunk_id", F.col("event") > 0).orderBy("line_no")
    # written once: all parts are read from it
    placed = cut_lineage(
        cut.join(matched, ["chunk_id", "line_no"], "left")
        .withColumn("event", event)
        .withColumn("k", F.row_number().over(of_event).cast("bigint"))
        .withColumn("h", F.row_number().over(of_matched).cast("bigint"))
    )
    named = F.array(*[F.struct(F.lit(h).alias("col"), _head(h).alias("value")) for h in headers])
    head = placed.where("event > 0").select("chunk_id", F.col("h").alias("seq"), F.explode(named).alias("c"))
    variable = placed.where("event > 0").select("chunk_id", "event", F.col("k").alias("seq"), F.posexplode("params").alias("pos", "value"))
    column = F.concat_ws(":", F.col("event").cast("string"), F.col("pos").cast("string"))
    return LogParts(
        events=placed.select("chunk_id", "line_no", "event"),
        headers=encode_columns(head.select("chunk_id", "c.col", "seq", "c.value")),
        variables=encode_columns(variable.select("chunk_id", column.alias("col"), "seq", "value")),
        templates=templates.select(F.col("template_id").cast("bigint").alias("event"), "template"),
        sides=placed.where("event <= 0").select("chunk_id", "event", "k", "line"),
        format=fmt,
    )


def rebuild_log(parts: LogParts) -> DataFrame:
    """``(chunk_id, line_no, line)`` from the parts alone: three kinds of lines merged in the order of ``events``.

    Running numbers are counted per chunk, and every join is on the chunk with one of them.
    """
    pieces = format_pieces(parts.format)
    headers = [p for i, p in enumerate(pieces) if i % 2 and p != CONTENT]
    of_event = W.partitionBy("chunk_id", "event").orderBy("line_no")
    of_matched = W.partitionBy("chunk_id", F.col("event") > 0).orderBy("line_no")
    places = parts.events.select(
        "chunk_id", "line_no", "event",
        F.row_number().over(of_event).cast("bigint").alias("k"),
        F.when(F.col("event") > 0, F.row_number().over(of_matched).cast("bigint")).alias("h"),
    )
    one = lambda name: F.max(F.when(F.col("col") == name, F.col("value"))).alias(_HEAD + name)
    head = decode_columns(parts.headers).groupBy("chunk_id", F.col("seq").alias("h")).agg(F.lit(True).alias("has_head"), *map(one, headers))
    of = F.split("col", ":")
    values = decode_columns(parts.variables).select(
        "chunk_id", of[0].cast("bigint").alias("event"), F.col("seq").alias("k"), of[1].cast("int").alias("pos"), "value"
    )
    # a group holds the variables of one line
    variables = values.groupBy("chunk_id", "event", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    variables = variables.select("chunk_id", "event", "k", F.col("v.value").alias("vars"))
    none = F.expr("cast(array() as array<string>)")
    content = filled(F.col("template"), F.coalesce("vars", none))
    line = rendered(pieces, lambda name: content if name == CONTENT else _head(name))
    return (
        places.join(tm.checked_broadcast(parts.templates, "template"), "event", "left")
        .join(head, ["chunk_id", "h"], "left")
        .join(variables, ["chunk_id", "event", "k"], "left")
        .join(parts.sides.withColumnRenamed("line", "kept"), ["chunk_id", "event", "k"], "left")
        .select("chunk_id", "line_no", F.when(F.col("event") > 0, line).otherwise(F.col("kept")).alias("line"))
    )

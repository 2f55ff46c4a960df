"""Matching lines to known templates, and columns of template variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.arrays import posexplode_rows

WILDCARD = "<*>"
# A template set below this many bytes may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def words(text: Column | str) -> Column:
    """Words between white space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def is_small(table: DataFrame, text: str) -> bool:
    """Whether the bytes of a text column, with an allowance for a row, are few enough for every task."""
    return table.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES


def checked_broadcast(small: DataFrame, text: str, known: bool | None = None) -> DataFrame:
    """Broadcast a table if the bytes of its text column are proven to be few.

    The size is measured, which runs the small side once, unless it is ``known`` from before; a
    larger side is left to a shuffle join.
    """
    return F.broadcast(small) if (is_small(small, text) if known is None else known) else small


def match_templates(
    lines: DataFrame, templates: DataFrame, keys: list[str], text: str = "line", small: bool | None = None
) -> DataFrame:
    """First template of each line: same number of words, equal wherever the template is fixed.

    ``templates`` has ``template_id`` and ``template``. The join is on word count and
    on the first fixed word with its position; templates of wildcards only are
    joined on word count alone. Lines without a template have a null ``template_id``.
    ``small`` says that the templates' size is known already.
    """
    t = templates.select("template_id", "template", words("template").alias("t_words"))
    t = t.withColumn("n_words", F.size("t_words")).withColumn(
        "anchor", F.array_position(F.transform("t_words", lambda w: w != WILDCARD), True).cast("int")
    ).withColumn("anchor_word", F.when(F.col("anchor") > 0, F.get(F.col("t_words"), F.col("anchor") - 1)))
    t = t.withColumn("anchor_word", F.coalesce("anchor_word", F.lit("")))
    # the positions at which some template of this length has its first fixed word
    anchors = t.groupBy("n_words").agg(F.collect_set("anchor").alias("anchors"))
    l = lines.select(*keys, F.col(text), words(text).alias("l_words")).withColumn("n_words", F.size("l_words"))
    probe = (
        l.join(checked_broadcast(anchors, "n_words", small), "n_words")
        .select(*keys, "l_words", "n_words", F.explode("anchors").alias("anchor"))
        .withColumn(
            "anchor_word",
            F.when(F.col("anchor") > 0, F.get(F.col("l_words"), F.col("anchor") - 1)).otherwise(F.lit("")),
        )
    )
    fits = F.forall(
        F.zip_with("t_words", "l_words", lambda a, b: (a == WILDCARD) | (a == b)), lambda ok: ok
    )
    best = (
        probe.join(checked_broadcast(t, "template", small), ["n_words", "anchor", "anchor_word"])
        .filter(fits)
        .groupBy(*keys)
        .agg(F.min(F.struct("template_id", "template")).alias("m"))
        .select(*keys, "m.template_id", "m.template")
    )
    return lines.join(best, keys, "left")


def template_params(df: DataFrame, text: str = "line", template: str = "template") -> DataFrame:
    """Adds ``params``: the words of the line at the wildcards of its template.

    A wildcard word such as ``id=<*>`` gives the part of the line's word that stands
    for the wildcard. Null if the word counts differ.
    """
    pairs = F.arrays_zip(words(template).alias("t"), words(text).alias("w"))
    same = F.size(words(template)) == F.size(words(text))

    def value(p: Column) -> Column:
        head = F.substring_index(p["t"], WILDCARD, 1)
        tail = F.substring_index(p["t"], WILDCARD, -1)
        n = F.length(p["w"]) - F.length(head) - F.length(tail)
        return F.when(p["t"] == WILDCARD, p["w"]).otherwise(F.substring(p["w"], F.length(head) + 1, n))

    wild = F.filter(pairs, lambda p: p["t"].contains(WILDCARD))
    return df.withColumn("params", F.when(same, F.transform(wild, value)))


def variable_columns(df: DataFrame, keys: list[str], text: str = "line", template: str = "template") -> DataFrame:
    """``(keys, template, position, value)`` for wildcards; words keep their position from 1.

    A line with another number of words than its template gives no variables.
    """
    zipped = F.arrays_zip(words(template).alias("t"), words(text).alias("w"))
    same = df.filter(F.size(words(template)) == F.size(words(text)))
    return (
        posexplode_rows(same, [*keys, template], zipped, "pos", "z")
        .filter(F.col("z.t").contains(WILDCARD))
        .select(*keys, template, (F.col("pos") + 1).cast("bigint").alias("position"), F.col("z.w").alias("value"))
    )


def event_text(df: DataFrame, text: str = "line", template: str = "template") -> Column:
    """Event of a line: its template, or the line itself where word counts differ."""
    return F.when(F.size(words(template)) == F.size(words(text)), F.col(template)).otherwise(F.col(text))


def parameter_columns(df: DataFrame, keys: list[str], template: str = "template", params: str = "params") -> DataFrame:
    """``(keys, template, position, value)`` from a parameter array."""
    return df.select(*keys, template, F.posexplode(params).alias("pos", "value")).select(
        *keys, template, (F.col("pos") + 1).cast("bigint").alias("position"), "value"
    )


def damage_template(
    df: DataFrame, keys: list[str], seed: int = 0, text: str = "line", template: str = "template"
) -> DataFrame:
    """Put one wildcard of one template, picked by a seeded hash, back to the words of the lines.

    Returns the lines with ``template`` changed where touched and a flag ``touched``.
    """
    wild = (
        df.select(template)
        .distinct()
        .select(template, F.posexplode(words(template)).alias("pos", "w"))
        .filter(F.col("w") == WILDCARD)
    )
    pick = wild.agg(F.min_by(F.struct(template, "pos"), F.xxhash64(F.lit(seed), template, "pos")).alias("p"))
    df = df.withColumn("chosen", pick.scalar())
    chosen = F.col("chosen")
    hit = (F.col(template) == chosen[template]) & (F.size(words(text)) == F.size(words(template)))
    changed = F.array_join(
        F.transform(
            F.arrays_zip(words(template).alias("t"), words(text).alias("w")),
            lambda z, i: F.when(i == chosen["pos"], z["w"]).otherwise(z["t"]),
        ),
        " ",
    )
    return df.select(
        *keys,
        text,
        F.when(hit, changed).otherwise(F.col(template)).alias(template),
        F.coalesce(hit, F.lit(False)).alias("touched"),
    )


def with_event(lines: DataFrame, events: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """Event of each line, the raw text where no event is known."""
    e = events.select(*keys, F.col("template").alias("event_template"))
    return lines.join(e, keys, "left").withColumn("event_template", F.coalesce("event_template", F.col(text)))


def frequent_templates(df: DataFrame, min_lines: int = 2, template: str = "template") -> DataFrame:
    """Templates with at least ``min_lines`` lines."""
    return df.groupBy(template).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lines)


def template_params_regex(df: DataFrame, text: str = "line", template: str = "template") -> DataFrame:
    """Adds ``params`` by matching the line against its template as a regex.

    For templates whose words do not line up with the line's: a wildcard is lazy,
    blanks match any white space, other characters match themselves. The array is
    empty where the line does not match.
    """
    fixed = F.split(F.col(template), r"<\*>", -1)
    quoted = F.transform(
        fixed,
        lambda t: F.regexp_replace(F.regexp_replace(t, r"([^A-Za-z0-9\s])", r"\\$1"), r"\s+", r"\\s+"),
    )
    pattern = F.concat(F.lit("^"), F.array_join(quoted, "(.*?)"), F.lit("$"))
    n = F.size(fixed) - 1
    found = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.call_function("regexp_extract", F.col(text), F.col("pattern"), i),
    )
    none = F.expr("cast(array() as array<string>)")
    matched = (n > 0) & F.call_function("rlike", F.col(text), F.col("pattern"))
    return (
        df.withColumn("pattern", pattern)
        .withColumn("params", F.when(matched, found).otherwise(none))
        .drop("pattern")
    )
